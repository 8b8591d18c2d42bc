"""Divergence of sources within a language, by systolic rotation.

The kept terms of a language are dealt into buckets by hash.  In each bucket every (language, source) group
has one compressed vector of term counts.  Vectors are *residents*: a vector stays in the
partition of its (language, bucket, group) while those of its peers visit it in the rounds of a round-robin
tournament (circle method, a bye where the number of groups is odd).  Every pair of groups meets once a bucket,
at one of the two, and the meeting evaluates both directions.  A partition reads its resident, then its visitors
one after the other, so it holds two vectors of one bucket at a time, however many groups or terms
there are.  A resident also ranks its terms against the language's in a heap of fixed size.

With p = 1 + floor(SCALE * (count + 1) / (N + V)) for the V kept terms of a language (those of
at least LEAST_DOCUMENTS documents; N is the sum of the counts), the divergence of p from q at a term is
floor((p - q)**2 / q).  All arithmetic is in integers: exact while N + V is under 9 * 10**15.

Null text, language or source is ''.  Every row is a document of its own (repeated ids and rows too); groups
without terms take part.  A language without kept terms has divergence 0 everywhere.  Ties go by the
item's UTF-8 bytes.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.llm.common import pack_ints, slices, unpack_ints, written

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
#: Count rows of a bucket, on average over the languages: the memory of a task.
BUCKET_ROWS = 400_000
#: Counts that a scanning task holds before it hands them on.
HELD_COUNTS = 600_000
RESIDENT = -1

#: Letters, with A-Z lowered, and all bytes of other characters; the rest separates terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def count_terms(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", held_counts: int = HELD_COUNTS) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents), partly summed in each task; the term '' marks that a group occurs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                n[b""], d[b""] = 0, 0
                names = list(n)
                for i in range(0, len(names), 100_000):
                    some = names[i : i + 100_000]
                    size = len(some)
                    yield pa.record_batch(
                        [pa.array([lang] * size), pa.array([source] * size), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())],
                        names=["lang", "source", "term", "n", "d"],
                    )

        for whole in batches:
            for batch in slices(whole):
                for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    n, d = counts.setdefault((lang or "", source or ""), (Counter(), Counter()))
                    before = len(n)
                    found = terms(text)
                    n.update(found)
                    d.update(set(found))
                    held += len(n) - before + 1
                    if held >= held_counts:
                        yield from hand_on()
                        counts, held = {}, 0
        yield from hand_on()

    return docs.select(F.col(lang_column).cast("string"), F.col(source_column).cast("string"), text_column).mapInArrow(each, "lang string, source string, term string, n long, d long")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) by long division in three digits of base 1000."""
    left = np.asarray(counts, np.int64) + 1
    whole = left // total
    left = left % total
    for _ in range(3):
        left = left * 1000
        whole = whole * 1000 + left // total
        left = left % total
    return whole + 1


def _vectors(key: tuple[pa.Scalar, ...], rows: pa.Table, least_documents: int) -> pa.Table:
    """The vectors of all groups of a language over the kept terms of one bucket, those without any included."""
    lang, bucket = key[0].as_py(), key[1].as_py()
    sources = sorted(rows.column("source").unique().to_pylist(), key=str.encode)
    summed = rows.filter(pc.not_equal(rows.column("term"), "")).group_by(["term", "source"]).aggregate([("n", "sum"), ("d", "sum")])
    by_term = summed.group_by("term").aggregate([("n_sum", "sum"), ("d_sum", "sum")])
    kept = by_term.filter(pc.greater_equal(by_term.column("d_sum_sum"), least_documents))
    kept = kept.take(pc.sort_indices(kept.column("term").cast(pa.binary())))  # in the order of UTF-8
    names, of_lang = kept.column("term").combine_chunks(), kept.column("n_sum_sum").to_numpy()
    at = pc.index_in(summed.column("term"), value_set=names)
    summed = summed.append_column("at", at).filter(at.is_valid())
    at, n = summed.column("at").to_numpy(), summed.column("n_sum").to_numpy()
    slot = pc.index_in(summed.column("source"), value_set=pa.array(sources, pa.string())).to_numpy() if len(at) else np.empty(0, np.int32)
    order = np.lexsort((at, slot))
    cuts = np.searchsorted(slot[order], np.arange(len(sources) + 1))
    out: list[list] = [[] for _ in range(5)]
    for i in range(len(sources)):
        mine = order[cuts[i] : cuts[i + 1]]
        places = at[mine].astype(np.int64)
        body = np.concatenate([np.diff(places, prepend=0), n[mine]]).astype("<i8")
        for c, x in zip(out, (int(n[mine].sum()), pack_ints(body), pack_ints(of_lang[places].astype("<i8")), names.take(pa.array(places)).to_pylist(), i), strict=True):
            c.append(x)
    size = len(sources)
    return pa.table(
        [pa.array([lang] * size, pa.string()), pa.array([bucket] * size, pa.int32()), pa.array(out[4], pa.int32()), pa.array(sources, pa.string()), pa.array([len(names)] * size, pa.int64()), pa.array(out[0], pa.int64()),
         pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.string()))],
        names=["lang", "bucket", "slot", "source", "v", "n", "body", "of_lang", "names"],
    )


def bucket_vectors(counts: DataFrame, buckets: int, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, bucket, slot (the source's place in its language), source, v (kept terms of the bucket), n, and the packed counts.

    `body` holds the places (as steps) and counts of the group's terms, `of_lang` the language's counts there, `names` the terms.
    """
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = counts.where("term != ''").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    marks = counts.where("term = ''").groupBy("lang", "source", "term").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("d")).withColumn("bucket", F.explode(every))

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _vectors(key, rows, least_documents)

    schema = "lang string, bucket int, slot int, source string, v long, n long, body binary, of_lang binary, names array<string>"
    return dealt.unionByName(marks).groupBy("lang", "bucket").applyInArrow(build, schema)


def opponent(slot: Column, round_: Column, players: Column) -> Column:
    """Who meets whom in a round of the circle method, for an even number of players: the last one stays, the others turn."""
    ring = players - 1
    across = F.pmod(round_ - slot, ring)
    return F.when(slot == ring, F.pmod(round_ * (players / 2).cast("long"), ring)).when(across == slot, ring).otherwise(across)


def host(a: Column, b: Column) -> Column:
    """The one of two groups at which they meet: either, in turn, so that every group is host about half the time."""
    return F.when((a + b) % 2 == 0, F.least(a, b)).otherwise(F.greatest(a, b))


def tournament(vectors: DataFrame) -> DataFrame:
    """Residents (round -1) and the visitors of each round, in the partitions and in the order in which they meet."""
    spark = vectors.sparkSession
    totals = vectors.groupBy("lang", "slot").agg(F.sum("n").alias("total"), F.sum("v").alias("terms"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("groups"))
    facts = totals.join(langs, "lang")
    rows = vectors.join(facts, ["lang", "slot"]).withColumn("slot", F.col("slot").cast("long"))
    shared = ["lang", "bucket", "source", "v", "total", "terms", "lang_total", "body"]
    residents = rows.select(F.col("slot").alias("host"), F.lit(RESIDENT).cast("long").alias("round"), *shared, "of_lang", "names")
    players = F.col("groups") + F.col("groups") % 2
    visits = rows.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), players - 2))).withColumn("peer", opponent(F.col("slot"), F.col("round"), players))
    visitors = visits.where("peer < groups").withColumn("host", host(F.col("slot"), F.col("peer"))).where("host != slot")
    visitors = visitors.select("host", "round", *shared, F.lit(None).cast("binary").alias("of_lang"), F.lit(None).cast("array<string>").alias("names"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return residents.unionByName(visitors).repartition(n, "lang", "bucket", "host").sortWithinPartitions("lang", "bucket", "host", "round")


def _ranked(row: dict, counts: np.ndarray, ranks: int) -> list[tuple[str, int]]:
    """The terms of a resident that diverge most from the language: share above the language's, largest value first, ties by place."""
    p, q = shares(counts, row["total"] + row["terms"]), shares(unpack_ints(row["of_lang"], "<i8"), row["lang_total"] + row["terms"])
    value = (p - q) ** 2 // q
    above = np.flatnonzero(p > q)
    best = heapq.nsmallest(ranks, zip((-value[above]).tolist(), above.tolist(), strict=True))
    return [(row["names"][i], -v) for v, i in best]


def meet(rows: DataFrame, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value: of one bucket each, `pair` values of both directions and the best of `term`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_home = ""
        p = np.empty(0, np.int64)
        for whole in batches:
            for batch in slices(whole):
                out: list[tuple[str, str, str, str, int]] = []
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    steps, counts = np.split(unpack_ints(row["body"], "<i8"), 2)
                    dense = np.zeros(row["v"], np.int64)
                    dense[np.cumsum(steps)] = counts
                    q = shares(dense, row["total"] + row["terms"]) if row["terms"] else dense
                    if row["round"] == RESIDENT:
                        at_home, p = row["source"], q
                        if len(counts):
                            out += [(row["lang"], at_home, "term", t, v) for t, v in _ranked(row, counts, ranks)]
                        continue
                    gap = (p - q) ** 2
                    out.append((row["lang"], at_home, "pair", row["source"], int((gap // q).sum())))
                    out.append((row["lang"], row["source"], "pair", at_home, int((gap // p).sum())))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.int64())], names=["lang", "source", "part", "item", "value"])

    return rows.mapInArrow(each, "lang string, source string, part string, item string, value long")


def source_divergence(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_documents: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: of `pair` all, of `term` the first `ranks`."""
    spark = docs.sparkSession
    counts = spark.read.parquet(written(count_terms(docs, text_column, lang_column, source_column)))
    buckets = max(1, math.ceil(counts.count() / bucket_rows))
    vectors = spark.read.parquet(written(bucket_vectors(counts, buckets, least_documents)))
    met = spark.read.parquet(written(meet(tournament(vectors), ranks)))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = met.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(best)


#: The same in SQL, over all rows.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
k AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS of_lang FROM g JOIN kept ON kept.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT lang, source, sum(n) AS n FROM k GROUP BY ALL),
p AS (SELECT k.lang, k.source, k.term, k.n, 1 + (1000000000::HUGEINT * (k.n + 1)) // (s.n + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.of_lang + 1)) // (v.n + v.v)::HUGEINT AS q
      FROM k JOIN s ON s.lang = k.lang AND s.source = k.source JOIN v ON v.lang = k.lang),
m AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
