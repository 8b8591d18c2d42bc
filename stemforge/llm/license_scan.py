"""Licence scans: an Aho-Corasick automaton over words finds identifier tags and notice phrases; a shunting-yard
parser evaluates the expression behind a tag.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered, so that punctuation, line ends and
comment marks inside a notice do not matter; a phrase is found where its words stand one after the other.  Behind
`SPDX-License-Identifier:` (or a like tag) the longest whole expression of the same line is taken:
identifiers with `+`, parentheses, `with` before `and` before `or`, in any case.  Its value is an obligation:
`or` leaves the choice of the lesser, `and` and separate pieces of evidence bind together, an exception
(`with`) lowers strong copyleft to weak.

Null texts are empty.  Texts without evidence have no labels, score 0 and a null obligation.  Evidence is a column of
its own row, so nothing is shuffled; repeated rows and extra columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import map_rows

# Phrases and labels of the base scan.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of notices beyond those.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "permission is hereby granted free of charge": "mit",
    "boost software license": "bsl", "this is free and unencumbered software": "unlicense", "creative commons attribution": "cc-by", "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "all rights reserved": "all-rights-reserved",
}
#: Tags before an expression, as words.
TAGS = ("spdx license identifier", "packagelicensedeclared", "license expression")
#: Labels of identifiers, by the identifier's first parts (the longest that fits), and their obligations:
#: 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 use restricted.
OBLIGATIONS = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "bsl": 0, "unlicense": 0, "cc0": 0, "cc-by": 0, "zlib": 0, "lgpl": 1, "mpl": 1, "epl": 1,
    "gpl": 2, "agpl": 2, "cc-by-sa": 2, "cc-by-nc": 3, "cc-by-nd": 3, "all-rights-reserved": 3,
}
#: An identifier that no entry fits.
OTHER = "other"
OTHER_OBLIGATION = 3
#: How far one piece of evidence of a kind is believed; independent ones add up as chances do.
STRENGTH = {"expression": 0.95, "base": 0.8, "notice": 0.8, "weak": 0.5}
WEAK = {"cc by", "all rights reserved"}

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LEXEME = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?)")
_COLON = re.compile(r"[ \t]*:")
_BINDS = {"or": 1, "and": 2, "with": 3}
KIND = "struct<label:string,kind:string,word:long,words:int,expression:string,obligation:int>"


@dataclass(frozen=True)
class Evidence:
    label: str
    kind: str
    word: int
    words: int
    expression: str | None = None
    obligation: int | None = None


def label_of(identifier: str) -> str:
    """The label whose parts begin the identifier: GPL-3.0-or-later is gpl, CC-BY-SA-4.0 is cc-by-sa; else `other`."""
    parts = identifier.lower().rstrip("+").split("-")
    return next((x for n in range(len(parts), 0, -1) if (x := "-".join(parts[:n])) in OBLIGATIONS), OTHER)


def lexemes(text: str, at: int = 0) -> Iterator[str]:
    """Lexemes from a place up to the line's end or anything else; a full stop at a lexeme's end ends them and is not its own."""
    while m := _LEXEME.match(text, at):
        yield m[1].rstrip(".") or m[1]
        at = m.end()
        if m[1].endswith("."):
            return


def to_postfix(tokens: Iterable[str]) -> list[str]:
    """Shunting-yard: the longest prefix of the tokens that is a whole expression, operators behind their operands; empty if there is none.

    Tokens are read only up to the first one that continues no expression.
    """
    out: list[str] = []
    held: list[str] = []
    depth, operand = 0, True
    whole: tuple[int, list[str]] = (0, [])
    for token in tokens:
        low = token.lower()
        if operand:
            if token == "(":
                held.append(token)
                depth += 1
                continue
            if token == ")" or low in _BINDS:
                break
            out.append(token)
            operand = False
        elif low in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
            continue
        elif token == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
        if not depth:
            whole = (len(out), held[::-1])
    return out[: whole[0]] + whole[1]


def evaluate(postfix: list[str]) -> tuple[set[str], int, str]:
    """Labels, obligation and the expression written with all parentheses."""
    stack: list[tuple[set[str], int, str]] = []
    for token in postfix:
        if token not in _BINDS:
            label = label_of(token)
            stack.append(({label}, OBLIGATIONS.get(label, OTHER_OBLIGATION), token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            # an exception is no licence of its own
            stack.append((left[0], min(left[1], 1), f"({left[2]} with {right[2]})"))
        else:
            stack.append((left[0] | right[0], (min if token == "or" else max)(left[1], right[1]), f"({left[2]} {token} {right[2]})"))
    return stack[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, phrases in (("tag", dict.fromkeys(TAGS, "")), ("notice", NOTICES), ("base", BASE_PHRASES)):
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", (label, kind, phrase.count(" ") + 1, phrase))
    made.make_automaton()
    return made


def scan(text: str | None) -> tuple[int, list[Evidence]]:
    """Number of words, and the evidence in the order of its last words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    line = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    out: list[Evidence] = []
    spaces = at = 0
    places: list[tuple[int, int]] | None = None
    for end, (label, kind, n, phrase) in automaton().iter(line):
        spaces += line.count(" ", at, end + 1)
        at = end + 1
        word = spaces - 1 - n
        if kind != "tag":
            out.append(Evidence(label, "weak" if phrase in WEAK and kind != "base" else kind, word, n, None, OBLIGATIONS[label]))
            continue
        places = places or [m.span() for m in _WORD.finditer(text)]
        colon = _COLON.match(text, places[word + n - 1][1])
        if colon and (postfix := to_postfix(lexemes(text, colon.end()))):
            labels, obligation, expression = evaluate(postfix)
            out += [Evidence(x, "expression", word, n, expression, obligation) for x in sorted(labels)]
    return len(words), out


def believed(evidence: list[Evidence]) -> float:
    """Score of all evidence: each label counts once, by its strongest kind."""
    best: dict[str, float] = {}
    for e in evidence:
        strength = STRENGTH["weak"] if e.kind == "base" and e.label == "cc-by" else STRENGTH[e.kind]
        best[e.label] = max(best.get(e.label, 0.0), strength)
    doubt = 1.0
    for strength in sorted(best.values()):
        doubt *= 1 - strength
    return 1 - doubt


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, score, obligation (the greatest of all evidence) and the evidence itself of every whole text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, scores, obligations, evidence = [], [], [], []
        for text in batch.column(text_column).to_pylist():
            n, found = scan(text)
            n_words.append(n)
            scores.append(believed(found))
            obligations.append(max((e.obligation for e in found), default=None))
            evidence.append([vars(e) for e in found])
        kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64()), ("words", pa.int32()), ("expression", pa.string()), ("obligation", pa.int32())]))
        return pa.record_batch([batch.column(id_column), pa.array(n_words, pa.int64()), pa.array(scores, pa.float64()), pa.array(obligations, pa.int32()), pa.array(evidence, kind)], names=[id_column, "n_words", "score", "obligation", "evidence"])

    return map_rows(docs.select(id_column, text_column), each, f"{id_column} {dict(docs.dtypes)[id_column]}, n_words long, score double, obligation int, evidence array<{KIND}>")


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row of plain columns a document."""
    base = F.filter("evidence", lambda e: e["kind"] == "base")

    def joined(rows):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda e: e["label"]))), ",")

    starts = F.transform(base, lambda e: e["word"])
    expressions = F.array_join(F.array_distinct(F.filter(F.transform("evidence", lambda e: e["expression"]), lambda x: x.isNotNull())), "; ")
    return scanned.select(
        id_column, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("evidence")).alias("labels"), "score", "obligation", expressions.alias("expressions"),
    )
