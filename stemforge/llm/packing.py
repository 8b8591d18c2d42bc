"""Best-fit packing: tokenised documents into as few sequences of bounded length as patterns allow.

Only a histogram of piece lengths reaches the driver.  There, patterns of one to three lengths that
fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative
least squares and rounded, and what they leave is packed best fit first.  The plan says for every
length which ranks go to which pattern; pieces get ranks among their equals from counts by
partition, so no task ever holds all pieces of a length.

Null texts are empty texts: one piece with the end mark alone.  Repeated rows are packed each on its
own, extra columns ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from array import array
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemforge.llm.bpe_automaton import byte_symbols
from stemforge.llm.common import map_rows, materialize, slices

CAPACITY = 2048
END_ID = 0
#: One of so many triples is enumerated: enough columns for every length, and a plan of bounded size.
#: All of them (1) take ten times the time for 14 sequences less in 493,521, which the bound holds at 493,506.
TRIPLES_OF = 16

#: Fixed value: how byte-level vocabularies of this kind split texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What keeps a text from being cut at single spaces and line ends: other or repeated white space.
_UNEVEN = re.compile(r"[ \n]{2}|[^\S \n]|\x00")


class ByteEncoder:
    """Ids of whole texts by a tokenizers file with byte-level BPE, as little-endian 32-bit bytes.

    With even white space a text falls into chunks (a space or none, and what follows up to the next
    white space) that the splitter never joins; their ids are kept in a bounded table.
    """

    def __init__(self, path: str, kept: int = 250_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._special = special
        self._marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._kept = kept
        self._chunks: dict[str, bytes] = {"": b""}
        self._older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self._encoding.encode_ordinary(text)).tobytes()

    def _plain(self, text: str) -> bytes:
        if _UNEVEN.search(text):
            return self._ids(text)
        chunks = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        found = list(map(self._chunks.get, chunks))
        if None in found:
            known, ids = self._chunks, self._ids
            for i, hit in enumerate(found):
                if hit is None:
                    chunk = chunks[i]
                    if (hit := known.get(chunk) or self._older.get(chunk)) is None:
                        hit = ids(chunk)
                    if len(known) >= self._kept:
                        self._older, self._chunks = known, {"": b""}
                        known = self._chunks
                    found[i] = known[chunk] = hit
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._marks is None or "<|" not in text or not self._marks.search(text):
            return self._plain(text)
        return b"".join(array("I", [self._special[x]]).tobytes() if x in self._special else self._plain(x) for x in self._marks.split(text) if x)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    made = ByteEncoder(path)
    gc.collect()
    gc.freeze()  # the vocabulary stays for good
    return made


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


@dataclass
class Plan:
    """For each length, in order of the ranks: first rank, first sequence, uses in a sequence, and their offsets."""

    rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]]
    sequences: int

    def place(self, length: int, rank: int) -> tuple[int, int]:
        first, base, uses, offsets = self.rows[length]
        i = int(np.searchsorted(first, rank, side="right")) - 1
        k = rank - int(first[i])
        return int(base[i]) + k // int(uses[i]), offsets[i][k % int(uses[i])]


def patterns(present: np.ndarray, capacity: int = CAPACITY, triples_of: int = TRIPLES_OF) -> list[tuple[int, ...]]:
    """One to three of the lengths present that add up to the capacity."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    out: list[tuple[int, ...]] = [(capacity,)] if has[capacity] else []
    out += [(a, capacity - a) for a in range((capacity + 1) // 2, capacity) if has[a] and has[capacity - a]]
    for a in present[present < capacity - 1]:
        b = np.arange((capacity - a + 1) // 2, min(a, capacity - a - 1) + 1)
        c = capacity - a - b
        ok = has[b] & has[c] & ((a * 7919 + b * 104729) % triples_of == 0)
        out += [(int(a), int(x), int(y)) for x, y in zip(b[ok], c[ok], strict=True)]
    return out


def fit_counts(columns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares for the repeat counts, by multiplicative steps that keep them non-negative."""
    width = max(map(len, columns))
    at = np.array([c + (0,) * (width - len(c)) for c in columns])  # place 0 of the histogram is a pad
    b = histogram.astype(float).copy()
    b[0] = 0
    pull = b[at].sum(1)
    uses = np.bincount(at[at > 0], minlength=len(b))
    x = np.minimum.reduce([np.where(at[:, k] > 0, b[at[:, k]] / np.maximum(uses[at[:, k]], 1), np.inf) for k in range(width)])
    for _ in range(rounds):
        made = np.zeros(len(b))
        for k in range(width):
            made += np.bincount(at[:, k], x, len(b))
        made[0] = 0
        x *= pull / np.maximum(made[at].sum(1), 1e-9)
    return x


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) for all pieces of a histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    columns = patterns(np.flatnonzero(left), capacity)
    if columns:
        x = fit_counts(columns, left)
        carry = 0.0
        for p, want in zip(columns, x, strict=True):
            carry += want
            n = int(carry)
            carry -= n
            for length, k in Counter(p).items():
                n = min(n, int(left[length]) // k)
            if n:
                out.append((p, n))
                for length in p:
                    left[length] -= n
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences with the same content move together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    have = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(have[length:])
            if not len(fits):
                # as many of the length as fit into new sequences
                k = min(capacity // length, n)
                m = n // k
                room[capacity - k * length].append(((length,) * k, m))
                have[capacity - k * length] = True
                n -= m * k
                continue
            r = length + int(fits[0])
            content, m = room[r].pop()
            if not room[r]:
                have[r] = False
            t = min(m, n)
            if m > t:
                room[r].append((content, m - t))
                have[r] = True
            room[r - length].append(((*content, length), t))
            have[r - length] = True
            n -= t
    return [x for r in sorted(room) for x in room[r]]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    packed = pack_histogram(histogram, capacity)
    rows: dict[int, list] = defaultdict(list)
    ranks: Counter = Counter()
    base = 0
    for content, n in packed:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for length in content:
            offsets[length].append(at)
            at += length
        for length, places in offsets.items():
            rows[length].append((ranks[length], base, len(places), places))
            ranks[length] += n * len(places)
        base += n
    return Plan({k: (np.array([r[0] for r in v]), np.array([r[1] for r in v]), np.array([r[2] for r in v]), [r[3] for r in v]) for k, v in rows.items()}, base)


def pieces(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32, and the piece's partition and rank among the partition's pieces of its length."""
    end = array("I", [end_id]).tobytes()

    def each(batches):
        encoder = byte_encoder(path)
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                rows: list[list[int]] = [[] for _ in range(7)]
                for i, text in enumerate(batch.column(text_column)):
                    ids = encoder.encode(text.as_py()) + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        for c, v in zip(rows, (i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]), strict=True):
                            c.append(v)
                        seen[length] += 1
                taken = batch.column(id_column).take(pa.array(rows[0], pa.int64()))
                yield pa.record_batch([taken, pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], names=[id_column, "piece", "start", "length", "ids_crc32", "part", "place"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(each, f"{id_column} {kind}, piece int, start long, length long, ids_crc32 long, part long, place long")


def pack_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every whole text.

    Texts are read and tokenised once, with no shuffle; only piece rows without their ids are shuffled.
    """
    made = materialize(pieces(docs, path, id_column, text_column, capacity, end_id))
    by_part = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, capacity))  # bounded by the patterns of `capacity`
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = made.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = plan.value
        got = [p.place(n, r) for n, r in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True)]
        return pa.record_batch(
            [*(batch.column(c) for c in kept), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())],
            names=[*kept, "sequence_id", "offset"],
        )

    kept = [id_column, "piece", "start", "length", "ids_crc32"]
    kind = dict(docs.dtypes)[id_column]
    return map_rows(ranked.select(*kept, "rank"), place, f"{id_column} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
