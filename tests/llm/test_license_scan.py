"""Licence scans against words compared one by one, and expressions against a recursive reading."""

import random
import re

import pytest

from stemforge.llm.license_scan import BASE_PHRASES, NOTICES, OBLIGATIONS, digest, evaluate, label_of, lexemes, scan, scan_licenses, to_postfix

SCHEMA = "doc_id long, text string, score string, evidence string, n_words string, labels string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def places(text, phrases):
    w = words(text)
    return [(i, label) for i in range(len(w)) for phrase, label in phrases.items() if w[i : i + phrase.count(" ") + 1] == phrase.split()]


def recursive(tokens):
    """(expression, obligation) of a whole expression by recursive descent."""

    def choice(i):
        left, i = both(i)
        while i < len(tokens) and tokens[i].lower() == "or":
            right, i = both(i + 1)
            left = (f"({left[0]} or {right[0]})", min(left[1], right[1]))
        return left, i

    def both(i):
        left, i = excepted(i)
        while i < len(tokens) and tokens[i].lower() == "and":
            right, i = excepted(i + 1)
            left = (f"({left[0]} and {right[0]})", max(left[1], right[1]))
        return left, i

    def excepted(i):
        left, i = one(i)
        while i < len(tokens) and tokens[i].lower() == "with":
            right, i = one(i + 1)
            left = (f"({left[0]} with {right[0]})", min(left[1], 1))
        return left, i

    def one(i):
        if tokens[i] == "(":
            inner, i = choice(i + 1)
            return inner, i + 1
        return (tokens[i], OBLIGATIONS.get(label_of(tokens[i]), 3)), i + 1

    return choice(0)[0]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    pool = ["gnu", "general", "public", "license", "License,", "apache", "CC", "by", "cc-by", "MIT", "sa", "é", "ÀB", "the", "\n", "::", "lesser", "v2"]
    out = [None, "", " \n", "MIT", "mit license mit license", "cc by cc by-sa", "GNU General\n# Public License.", "x" * 200_000 + " apache license", "apache license " * 3000]
    out += [" ".join(r.choice(pool) for _ in range(r.randrange(1, 60))) for _ in range(200)]
    out += ["SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0).\nmore", "// spdx-license-identifier : LGPL-2.1+ */ x", "SPDX License Identifier MIT", "SPDX-License-Identifier:\nMIT"]
    return out


def test_base_and_labels_against_words(spark, texts):
    docs = spark.createDataFrame([(i % 150, t, "s", "e", "n", "l") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = sorted(tuple("" if x is None else x for x in r) for r in digest(scan_licenses(docs)).drop("score", "obligation", "expressions").collect())
    want = []
    for i, t in enumerate(texts):
        base = places(t, BASE_PHRASES)
        labels = {x for _, x in base} | {x for _, x in places(t, NOTICES)} | {e.label for e in scan(t)[1] if e.kind == "expression"}
        want.append((i % 150, len(words(t)), len(base), min((p for p, _ in base), default=""), max((p for p, _ in base), default=""), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))))
    assert got == sorted(want, key=lambda row: tuple(row))


def test_expressions_against_recursive_reading():
    r = random.Random(4)
    ids = ["MIT", "Apache-2.0", "GPL-3.0-or-later", "LGPL-2.1+", "CC-BY-NC-4.0", "Strange-1.0", "AGPL-3.0"]

    def made(depth):
        kind = r.randrange(5) if depth else 0
        if kind < 2:
            return [r.choice(ids)]
        if kind == 2:
            return ["(", *made(depth - 1), ")"]
        if kind == 3:
            return [r.choice(ids), r.choice(["with", "WITH"]), "Some-exception"]
        return [*made(depth - 1), r.choice(["and", "OR", "And", "or"]), *made(depth - 1)]

    for _ in range(500):
        tokens = made(5)
        _, obligation, expression = evaluate(to_postfix(tokens))
        assert (expression, obligation) == recursive(tokens)
        # what follows a whole expression does not change it
        for tail in ([")"], ["word"], ["and"], ["or", "("], ["and", "(", "MIT"]):
            assert evaluate(to_postfix([*tokens, *tail]))[2] == expression or tail[0] in ("and", "or")
    assert to_postfix([]) == to_postfix(["and"]) == to_postfix(["(", "MIT"]) == to_postfix([")"]) == []
    assert to_postfix(["MIT", "and"]) == ["MIT"]


def test_tags():
    found = {t: [(e.label, e.expression, e.obligation) for e in scan(t)[1] if e.kind == "expression"] for t in (
        "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0).\nmore",
        "// spdx-license-identifier : LGPL-2.1+ */ x", "SPDX License Identifier MIT", "SPDX-License-Identifier:\nMIT", "Nonsense-1.0", "License-Expression: ((MIT)) and nothing",
    )}
    values = list(found.values())
    expression = "(MIT or ((GPL-2.0-only with Classpath-exception-2.0) and Apache-2.0))"
    assert values[0] == [(x, expression, 0) for x in ("apache", "gpl", "mit")]
    assert values[1] == [("lgpl", "LGPL-2.1+", 1)]
    assert values[2] == values[3] == values[4] == []
    assert values[5] == [("mit", "(MIT and nothing)", 3), ("other", "(MIT and nothing)", 3)]
    assert list(lexemes("MIT. Next")) == ["MIT"] and label_of("CC-BY-SA-4.0") == "cc-by-sa" and label_of("x") == "other"


def test_score_obligation_and_clean_documents(spark):
    texts = ["Released under the MIT License.", "plain words about an apache and a license", "SPDX-License-Identifier: GPL-3.0", None, "cc by", "MIT License and GNU General Public License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in digest(scan_licenses(docs)).collect()}
    assert [round(got[i]["score"], 3) for i in range(6)] == [0.8, 0, 0.95, 0, 0.5, 0.96]
    assert [got[i]["obligation"] for i in range(6)] == [0, None, 2, None, 0, 2]
    assert digest(scan_licenses(docs.where("false"))).collect() == []


def test_long_line_of_tags_takes_linear_time():
    text = "SPDX-License-Identifier: MIT and " * 20_000
    n, found = scan(text)
    assert n == 100_000 and len(found) == 2 * 20_000 - 1  # the last tag has one identifier, the others take the next tag's first word
