"""Alignment by segments against whole texts tokenised and aligned by a plain loop."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stemforge.llm import token_alignment
from stemforge.llm.token_alignment import align_documents, vocabularies

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "the", "The", "don't", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "▁", "é", "é", "日本語", "😀", "12", "!?", "<s>", "<|endoftext|>", "<0x0A>", "\0", "​", "ﬁ"]
SCHEMA = "doc_id long, text string, chunk string, idx string, body string, groups string"


def plain(texts):
    """Rows by whole texts, with byte offsets in sets."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = vocabularies(A, B)
    found, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xb, yb = [table.a_bytes[i] for i in x], [table.b_bytes[i] for i in y]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                ends = [{sum(map(len, t[: i + 1])) for i in range(len(t))} for t in (xb, yb)]
                start = 0
                for end in sorted(ends[0] & ends[1]):
                    group = []
                    for ids, parts in ((x, xb), (y, yb)):
                        at, inside = 0, []
                        for i, part in zip(ids, parts, strict=True):
                            at += len(part)
                            if start < at <= end:
                                inside.append(i)
                        group.append(inside)
                    groups.append(group)
                    start = end
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        held.update(links.keys())
        found.append((groups, links))
    top = Counter()
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        n = [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values())]
        out.append((*n, sum(m for p, m in links.items() if held[p] == top[p[0]]), sum(m * held[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def rows(df):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in columns)) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = [None, "", " ", "\n", "  \n ", "one", "one", " ".join(r.choice(["alpha", "beta", "gammas,", "it's"]) for _ in range(300))]
    return out + ["".join(r.choice(ODD) for _ in range(r.randrange(1, 15))) for _ in range(250)]


def test_documents_against_whole_texts(spark, texts):
    docs = spark.createDataFrame([(i, t, "c", "i", "b", "g") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = rows(align_documents(docs, A, B))
    assert got == [(False, i, *w) for i, w in enumerate(plain(texts))]
    assert sum(1 for g in got if g[2]) > 150 and sum(1 for g in got if texts[g[1]] and not g[2]) > 20


def test_repeated_and_null_ids_over_small_chunks(spark, texts):
    some = texts[:40] * 2
    ids = [None if i % 9 == 0 else i % 5 for i in range(len(some))]
    docs = spark.createDataFrame(list(zip(ids, some, strict=True)), "doc_id long, text string").coalesce(1)
    want = sorted((i is None, i or 0, *w) for i, w in zip(ids, plain(some), strict=True))
    assert rows(align_documents(docs, A, B, most_segments=7)) == want


def test_chunks_end_at_their_bound(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    parts = token_alignment.chunks(docs, A, B, most_segments=30).cache()
    segments = parts.where("first is not null").selectExpr("chunk", "first", "posexplode(segments) as (pos, segment)").selectExpr("chunk", "first + pos as idx", "segment")
    numbers = segments.groupBy("chunk").agg({"segment": "count", "idx": "max"}).collect()
    assert len(numbers) > 5 and all(r["count(segment)"] == r["max(idx)"] + 1 < 45 for r in numbers)
    assert segments.groupBy("chunk", "segment").count().where("count > 1").count() == 0
    assert parts.where("first is null").count() == len(texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align_documents(docs, A, B).collect() == []


def test_long_text_without_white_space(spark):
    texts = ["ab" * 100_000, "x " * 50_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in align_documents(docs, A, B).collect()}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    for i, t in enumerate(texts):
        assert (got[i]["n_a"], got[i]["n_b"]) == (len(a.encode(" " + t).ids), len(b.encode(t)))


def test_segments_join_to_the_text_and_break_where_proven():
    v = vocabularies(A, B)
    assert v.breaks == " \n"
    assert v.split("a  b\nc \td") == [" a", "  b", "\nc", " \td"]
    assert v._b_parts(" ", ["▁a", "▁▁", "b"]) and not v._b_parts(" ", ["a▁b"]) and not v._b_parts("\n", ["▁\n"])
