"""Cross-tokenizer alignment by segment deduplication.

Each text (with the space that vocabulary B puts before it) is split before runs of white space at
which neither vocabulary can merge.  The distinct segments of the corpus are tokenised and aligned
once; the alignments are joined back to the places that use them, and documents are composed of them.

A scan numbers the segments of a *chunk* of documents, so that a document is a row of small numbers
and a segment appears once a chunk, however often its documents repeat it.  All places of a segment then
come together, in order, and it is tokenised and aligned there once; each chunk gets its answers in packs
and composes its documents.  The same device brings corpus-wide counts of linked id pairs back: every chunk
asks once for each of its pairs.  A hot segment or pair thus has one row a chunk, and a chunk is bounded
by `CHUNK_SEGMENTS` and `CHUNK_BYTES` (one document at least).

Every row is a document of its own, repeated ids included.  Null and empty texts, and texts that one of
the vocabularies does not give back byte by byte, have no tokens: zeros and an empty string.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.llm.bpe_automaton import byte_symbols
from stemforge.llm.common import pack_ints, release, removed, slices, unpack_ints, written

#: A chunk ends with the document in which its segments reach this number, or this size.
CHUNK_SEGMENTS = 300_000
CHUNK_BYTES = 24_000_000
#: Segments tokenised in one call, or in one row.
STEP = 4_000
#: Answers that a task holds before it hands them on, in one pack for each chunk.
HELD_ANSWERS = 400_000

SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


class Vocabularies:
    """The two tokenizers, the bytes of their ids, and the white space at which both part."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id(SPACE)
        self.breaks = "".join(c for c in " \n" if self._a_parts(path_a) and self._b_parts(c, pieces))
        # a run of white space that begins with one of these, what follows, and runs that do not begin so
        c = re.escape(self.breaks)
        self.segment = re.compile(rf"[{c}]\s*\S*(?:[^\S{c}]\s*\S*)*", re.DOTALL) if self.breaks else re.compile(r".+", re.DOTALL)

    @staticmethod
    def _a_parts(path: str) -> bool:
        """A's words end before white space that follows other characters: only its own splitter is known to do so."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        return spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]

    @staticmethod
    def _b_parts(c: str, pieces: list[str]) -> bool:
        """No piece of B holds c after another character; and none begins with the prefix space and c, so that this space can be dropped."""
        mark = SPACE if c == " " else c
        return not any(mark in p.lstrip(mark) for p in pieces) and (c == " " or not any(p.startswith(SPACE + c) for p in pieces))

    def split(self, text: str) -> list[str]:
        """Segments of space+text; joined, they are space+text."""
        return self.segment.findall(" " + text)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of segments of `split`."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        # B adds a space: it stands for the segment's own, or is dropped again
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                b[i] = [self.b_space]
            elif s[0] != " ":
                b[i] = b[i][1:] if b[i][:1] == [self.b_space] else [-1]
        return a, b

    def groups(self, segment: str, a: list[int], b: list[int]) -> str:
        """Groups as `a1,a2|b1;a3|b2,b3`; empty where bytes differ."""
        raw = segment.encode("utf-8", "surrogatepass")
        if -1 in b or b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return ""
        if len(a) == 1 or len(b) == 1:
            return f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        out: list[str] = []
        i0 = j0 = j = ends_b = ends_a = 0
        for i, x in enumerate(a):
            ends_a += len(self.a_bytes[x])
            while ends_b < ends_a:
                ends_b += len(self.b_bytes[b[j]])
                j += 1
            if ends_a == ends_b:
                out.append(f"{','.join(map(str, a[i0 : i + 1]))}|{','.join(map(str, b[j0:j]))}")
                i0, j0 = i + 1, j
        return ";".join(out)


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def pairs_of(groups: str, codes: list[int], times: list[int]) -> tuple[int, int, int, int]:
    """Adds the distinct linked id pairs (A id in the high half of 64 bits) of a segment's groups, and how often each is linked; numbers of A tokens, B tokens, groups and links."""
    parts = groups.split(";")
    n_a = n_b = links = 0
    start = len(codes)
    for part in parts:
        left, right = part.split("|")
        if "," not in left and "," not in right:
            codes.append(int(left) << 32 | int(right))
            n_a, n_b, links = n_a + 1, n_b + 1, links + 1
            continue
        x, y = [int(i) << 32 for i in left.split(",")], list(map(int, right.split(",")))
        codes += [i | j for i in x for j in y]
        n_a, n_b, links = n_a + len(x), n_b + len(y), links + len(x) * len(y)
    if len(set(codes[start:])) < links:
        often = Counter(codes[start:])
        codes[start:] = often.keys()
        times += often.values()
    else:
        times += [1] * links
    return n_a, n_b, len(parts), links


def chunks(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", most_segments: int = CHUNK_SEGMENTS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, and either some of its segments and the number of the first, or a document: id and the packed numbers of its segments in order."""
    names = [id_column, "chunk", "first", "segments", "body"]
    some_segments = pa.list_(pa.string())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabularies(path_a, path_b).split
        part, sequence = TaskContext.get().partitionId(), 0
        numbers: dict[str, int] = {}
        held = 0

        def segments() -> Iterator[pa.RecordBatch]:
            found = list(numbers)
            for i in range(0, len(found), STEP):
                yield pa.record_batch([pa.nulls(1, id_type), pa.array([chunk], pa.int64()), pa.array([i], pa.int32()), pa.array([found[i : i + STEP]], some_segments), pa.nulls(1, pa.binary())], names=names)

        for whole in batches:
            for batch in slices(whole):
                id_type = batch.schema.field(id_column).type
                start, bodies = 0, []
                chunk = part | sequence << 32
                ids = batch.column(id_column)

                def documents(end: int) -> pa.RecordBatch:
                    n = end - start
                    return pa.record_batch([ids.slice(start, n), pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, some_segments), pa.array(bodies, pa.binary())], names=names)

                for i, text in enumerate(batch.column(text_column).to_pylist()):
                    at = []
                    for s in split(text) if text else []:
                        if (k := numbers.get(s)) is None:
                            k = numbers[s] = len(numbers)
                            held += len(s)
                        at.append(k)
                    bodies.append(pack_ints(np.array(at, "<u4")))
                    if len(numbers) >= most_segments or held >= most_bytes:
                        yield documents(i + 1)
                        yield from segments()
                        start, bodies, numbers, held, sequence = i + 1, [], {}, 0, sequence + 1
                        chunk = part | sequence << 32
                if bodies:
                    yield documents(batch.num_rows)
        if numbers:
            yield from segments()

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(each, f"{id_column} {kind}, chunk long, first int, segments array<string>, body binary")


def answers(segments: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """chunk, and packed numbers and groups of some of its segments, from rows (chunk, idx, segment) with equal segments one after the other.

    A segment is tokenised and aligned once, where its rows begin.  Its groups are empty where a vocabulary does not give its bytes back.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        last, last_groups = None, ""
        packs: dict[int, tuple[list[int], list[str]]] = {}
        held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            whole = list(packs.items())
            for i in range(0, len(whole), 64):
                some = whole[i : i + 64]
                numbers = [pack_ints(np.array(idx, "<u4")) for _, (idx, _) in some]
                groups = [zstandard.compress("\n".join(g).encode(), 1) for _, (_, g) in some]
                yield pa.record_batch([pa.array([c for c, _ in some], pa.int64()), pa.array(numbers, pa.binary()), pa.array(groups, pa.binary())], names=["chunk", "numbers", "groups"])

        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                rows = batch.slice(i, STEP)
                names = rows.column("segment").to_pylist()
                new = list(dict.fromkeys(s for s in names if s != last))
                known = {last: last_groups}
                known.update((s, v.groups(s, x, y)) for s, x, y in zip(new, *v.encode(new), strict=True))
                last, last_groups = names[-1], known[names[-1]]
                for s, chunk, idx in zip(names, rows.column("chunk").to_pylist(), rows.column("idx").to_pylist(), strict=True):
                    if (pack := packs.get(chunk)) is None:
                        pack = packs[chunk] = ([], [])
                    pack[0].append(idx)
                    pack[1].append(known[s])
                held += len(names)
                if held >= HELD_ANSWERS:
                    yield from hand_on()
                    packs, held = {}, 0
        yield from hand_on()

    return segments.mapInArrow(each, "chunk long, numbers binary, groups binary")


def _by_chunk(rows: DataFrame) -> DataFrame:
    """Rows of a chunk in one task, those of kind 0 before those of kind 1; chunks are dealt evenly by the part and sequence that name them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.col("chunk").bitwiseAND(0xFFFFFFFF) + F.shiftright("chunk", 32) * 7919, F.lit(n)).cast("int")
    return rows.repartitionById(n, place).sortWithinPartitions("chunk", "kind")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(chunk, kind, rows) for each run of like rows."""
    if not batch.num_rows:
        return
    chunk, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "kind"))
    cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
    for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True):
        yield int(chunk[i]), int(kind[i]), batch.slice(i, j - i)


class _Chunk:
    """Alignments of a chunk's segments by number, and its distinct pairs."""

    def __init__(self) -> None:
        self.numbers: list[np.ndarray] = []
        self.found: list[str] = []

    def add(self, rows: pa.RecordBatch) -> None:
        for numbers, groups in zip(rows.column("numbers").to_pylist(), rows.column("data").to_pylist(), strict=True):
            self.numbers.append(unpack_ints(numbers, "<u4"))
            self.found += zstandard.decompress(groups).decode().split("\n")

    def close(self) -> None:
        order = np.argsort(np.concatenate(self.numbers)).tolist() if self.numbers else []
        self.groups = [self.found[i] for i in order]
        del self.found, self.numbers
        codes: list[int] = []
        times: list[int] = []
        ptr, counts = [0], []
        for g in self.groups:
            n = (0, 0, 0, 0)
            if g:
                n = pairs_of(g, codes, times)
            ptr.append(len(codes))
            counts.append(n)
        self.n = np.array(counts, np.int64).reshape(-1, 4)
        self.starts, self.weights = np.array(ptr, np.int64), np.array(times, np.int64)
        self.pairs, self.pair = np.unique(np.array(codes, np.int64), return_inverse=True)
        self.pair = self.pair.ravel()
        self.held = np.zeros(len(self.pairs), np.int64)

    def compose(self, body: bytes) -> tuple[list[int], str, bytes]:
        """Numbers, digest, and the document's linked pairs as packed pair numbers (as steps) and times."""
        at = unpack_ints(body, "<u4")
        texts = [self.groups[i] for i in at.tolist()]
        if not texts or "" in texts:
            return [0, 0, 0, 0], "", b""
        distinct, often = np.unique(at, return_counts=True)
        lengths = self.starts[distinct + 1] - self.starts[distinct]
        ends = np.cumsum(lengths)
        flat = np.arange(ends[-1]) + np.repeat(self.starts[distinct] - (ends - lengths), lengths)
        pair, where = np.unique(self.pair[flat], return_inverse=True)
        times = np.zeros(len(pair), np.int64)
        np.add.at(times, where.ravel(), self.weights[flat] * np.repeat(often, lengths))
        self.held[pair] += 1
        return self.n[at].sum(0).tolist(), hashlib.sha256(";".join(texts).encode()).hexdigest(), pack_ints(np.concatenate([np.diff(pair, prepend=0), times]).astype("<i8"))


def compose(rows: DataFrame, id_column: str) -> DataFrame:
    """Documents with their numbers, digest and packed pairs; and a row (chunk, idx, a, b, held) for each pair of a chunk."""
    names = ["chunk", "idx", "a", "b", "held", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "body"]
    types = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 5, pa.string(), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, closed = _Chunk(), None, False
        id_type = None

        def pairs() -> Iterator[pa.RecordBatch]:
            if now is None or not closed:
                return
            for i in range(0, len(state.pairs), 50_000):
                codes = state.pairs[i : i + 50_000]
                n = len(codes)
                columns = [[now] * n, range(i, i + n), codes >> 32, codes & 0xFFFFFFFF, state.held[i : i + n]]
                yield pa.record_batch([pa.nulls(n, id_type), *(pa.array(c, t) for c, t in zip(columns, types, strict=False)), *(pa.nulls(n, t) for t in types[5:])], names=[id_column, *names])

        for whole in batches:
            for chunk, kind, run in _runs(whole):
                id_type = run.schema.field(id_column).type
                if chunk != now:
                    yield from pairs()
                    state, now, closed = _Chunk(), chunk, False
                if kind == 0:
                    state.add(run)
                    continue
                if not closed:
                    state.close()
                    closed = True
                for some in slices(run):
                    made = [state.compose(x) for x in some.column("data").to_pylist()]
                    counts = list(zip(*(m[0] for m in made), strict=True))
                    n = len(made)
                    columns = [some.column("chunk"), *(pa.nulls(n, t) for t in types[1:5]), *(pa.array(c, pa.int64()) for c in counts), pa.array([m[1] for m in made]), pa.array([m[2] for m in made], pa.binary())]
                    yield pa.record_batch([some.column(id_column), *columns], names=[id_column, *names])
        yield from pairs()

    kind = dict(rows.dtypes)[id_column]
    return rows.mapInArrow(each, f"{id_column} {kind}, chunk long, idx int, a int, b int, held long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, body binary")


def weigh(rows: DataFrame, id_column: str) -> DataFrame:
    """Documents with n_best and count_sum from their packed pairs and the counts of their chunk's pairs."""
    kept = [id_column, "n_a", "n_b", "n_groups", "n_links"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        counts, best = np.empty(0, np.int64), np.empty(0, np.int64)
        now = None
        for whole in batches:
            for chunk, kind, run in _runs(whole):
                if chunk != now:
                    found, now = [], chunk
                if kind == 0:
                    found.append(np.stack([run.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("idx", "count", "best")]))
                    continue
                if found:
                    idx, *both = np.concatenate(found, 1)
                    counts, best = (x[np.argsort(idx)] for x in both)
                    found = []
                sums = []
                for body in run.column("body").to_pylist():
                    if not body:
                        sums.append((0, 0))
                        continue
                    steps, times = np.split(unpack_ints(body, "<i8"), 2)
                    pair = np.cumsum(steps)
                    sums.append((int((times * best[pair]).sum()), int((times * counts[pair]).sum())))
                made = list(zip(*sums, strict=True))
                yield pa.record_batch([*(run.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in made), run.column("groups_sha256")], names=[*kept, "n_best", "count_sum", "groups_sha256"])

    kind = dict(rows.dtypes)[id_column]
    return rows.mapInArrow(each, f"{id_column} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked) and best (1 where no pair of the A id has a higher count)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("held").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", most_segments: int = CHUNK_SEGMENTS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text."""
    spark = docs.sparkSession
    composed = spark.read.parquet(_composed(docs, path_a, path_b, id_column, text_column, most_segments))
    release(spark)  # shuffle files of the steps so far
    pairs = composed.where("idx is not null").select("chunk", "idx", "a", "b", "held")
    told = pairs.drop("held").join(pair_counts(pairs), ["a", "b"])
    carried = [id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "body"]
    rows = told.select("chunk", F.lit(0).alias("kind"), "idx", "count", "best", *(F.lit(None).cast(composed.schema[c].dataType).alias(c) for c in carried))
    bodies = composed.where("idx is null").select("chunk", F.lit(1).alias("kind"), "idx", F.lit(None).cast("long").alias("count"), F.lit(None).cast("int").alias("best"), *carried)
    return weigh(_by_chunk(rows.unionByName(bodies)), id_column)


def _composed(docs: DataFrame, path_a: str, path_b: str, id_column: str, text_column: str, most_segments: int) -> str:
    """The path of a table of the rows of `compose`."""
    spark = docs.sparkSession
    path = written(chunks(docs, path_a, path_b, id_column, text_column, most_segments))
    parts = spark.read.parquet(path)
    segments = parts.where("first is not null").select("chunk", "first", F.posexplode("segments").alias("pos", "segment")).select("chunk", (F.col("first") + F.col("pos")).alias("idx"), "segment")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = answers(segments.repartition(n, "segment").sortWithinPartitions("segment"), path_a, path_b)
    nobody = F.lit(None).cast(dict(docs.dtypes)[id_column]).alias(id_column)
    packs = found.select(nobody, "chunk", F.lit(0).alias("kind"), "numbers", F.col("groups").alias("data"))
    documents = parts.where("first is null").select(id_column, "chunk", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("numbers"), F.col("body").alias("data"))
    out = written(compose(_by_chunk(packs.unionByName(documents)), id_column))
    removed(spark, path)  # the composed rows hold all that is needed
    return out
