"""Nearest neighbours by largest inner product through an inverted multi-index.

Each half of a vector is quantised by its own centroids; a cell is a pair of them.  A query walks
the pairs in order of their summed inner products with its halves (a heap over the two sorted
lists), until the cells that it has met hold enough entries, and these are reranked exactly.
Centroids are fitted on a bounded sample, on which the share of entries that gives the wanted recall is
measured too; every vector is indexed.

Equal vectors form a class that is indexed once and stands for its smallest ids, of which no query
can need more than `wanted` and one: that loses nothing, and a vector that a third of the rows hold
is no hot cell.  Cells and their queries are dealt out in blocks of bounded size.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part, neither as queries nor as candidates.  Rows that repeat an id and its vector are one row;
rows of one id with other vectors are a query, and a candidate, each.  A query never finds its own id.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemforge.llm.common import hash_share, map_rows, materialize

WANTED = 20
#: Recall that the share of reranked entries is set for.
RECALL = 0.94
#: Bound of the sample on the driver that centroids are fitted on.
SAMPLE_VECTORS = 20_000
#: Entries, and queries, that one block holds.
BLOCK = 20_000


def cells_per_half(n: int) -> int:
    return max(2, min(256, round(math.sqrt(n) / 3.5)))


def _means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (0.5 * (c**2).sum(1) - x @ c.T).argmin(1)


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, vectors: np.ndarray, k: int) -> MultiIndex:
        half = vectors.shape[1] // 2
        return cls(_means(vectors[:, :half], k), _means(vectors[:, half:], k, seed=6))

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(vectors[:, :half], self.first), _nearest(vectors[:, half:], self.second)

    def share_for(self, vectors: np.ndarray, recall: float, wanted: int, queries: int = 400) -> float:
        """The share of the entries to rerank for a recall, measured against brute force within the sample.

        Neighbours in a sample are farther away than in the whole, so that this errs on the safe side.
        """
        n = len(vectors)
        if n <= wanted + 1:
            return 1.0
        half = self.first.shape[1]
        a, b = self.cells(vectors)
        ranks = []
        for i in range(0, n, max(1, n // queries)):
            exact = vectors @ vectors[i]
            exact[i] = -np.inf
            near = np.argpartition(-exact, wanted)[:wanted]
            rough = (self.first @ vectors[i, :half])[a] + (self.second @ vectors[i, half:])[b]
            ranks.append((rough[None, :] > rough[near, None]).sum(1))
        return float(min(1.0, np.quantile(np.concatenate(ranks) / n, recall) + 1.0 / n))

    def visit(self, query: np.ndarray, counts: np.ndarray, wanted: int) -> dict[int, list[int]]:
        """Second centroids to visit under each first one; counts[i, j] is how many entries a cell holds."""
        half = self.first.shape[1]
        a, b = self.first @ query[:half], self.second @ query[half:]
        i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[i_of], b[j_of]
        heap = [(-(a[0] + b[0]), 0, 0)]
        out: dict[int, list[int]] = {}
        met = 0
        while heap and met < wanted:
            _, i, j = heapq.heappop(heap)
            if n := int(counts[i_of[i], j_of[j]]):
                out.setdefault(int(i_of[i]), []).append(int(j_of[j]))
                met += n
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return out


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if isinstance(column, (pa.Array, pa.ChunkedArray)) else np.concatenate(list(column))
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _search_block(entries: pd.DataFrame, queries: pd.DataFrame, keep: int, halves: int) -> pd.DataFrame:
    columns = ["q1", "q2", "e1", "e2", "rep", "score"]
    if not len(entries) or not len(queries):
        return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in columns})
    e, cell = _matrix(entries["vector"]), entries["c2"].to_numpy()
    rep = entries["rep"].to_numpy()
    parts = []
    for start in range(0, len(queries), 256):
        q = queries.iloc[start : start + 256]
        visited = np.zeros((len(q), halves), bool)
        for r, cells in enumerate(q["visits"]):
            visited[r, np.asarray(cells)] = True
        score = _matrix(q["vector"]) @ e.T
        score[~visited[:, cell]] = -np.inf
        for r in range(len(q)):
            s = score[r]
            found = np.flatnonzero(s > -np.inf)
            if len(found) > keep:
                least = np.partition(s[found], len(found) - keep)[len(found) - keep]
                # what ties with the last one, but for rounding, competes by its id
                found = found[s[found] >= least - 1e-9 * max(1.0, abs(least))]
            qv = np.asarray(q["vector"].iloc[r], np.float64)
            exact = (e[found] * qv).sum(1)
            found = found[np.lexsort((rep[found], -exact))[:keep]] if len(found) else found
            exact = (e[found] * qv).sum(1)
            parts.append(pd.DataFrame({"q1": q["k1"].iloc[r], "q2": q["k2"].iloc[r], "e1": entries["k1"].to_numpy()[found], "e2": entries["k2"].to_numpy()[found], "rep": rep[found], "score": exact}))
    return pd.concat(parts, ignore_index=True)


def valid_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vector (of doubles) and two hashes that name the vector."""
    v = F.col("vector")
    d = table.select(F.col(id_column).alias("id"), F.transform(vector_column, lambda x: x.cast("double")).alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    d = d.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    return d.withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0))).withColumns({"k1": F.xxhash64(v), "k2": F.xxhash64(F.lit(1), v)})


def nearest(table: DataFrame, queries_where, id_column: str = "vec_id", vector_column: str = "embedding", wanted: int = WANTED, recall: float = RECALL, sample_vectors: int = SAMPLE_VECTORS) -> DataFrame:
    """query_id, rank, vec_id and score of the `wanted` nearest found for every row that `queries_where` (a Column of `id`) selects."""
    spark = table.sparkSession
    rows = valid_vectors(table, id_column, vector_column)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().collect()  # one row for each length
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    width = max(sizes, key=lambda r: (r["count"], r["n"]))["n"]
    rows = rows.where(F.size("vector") == width)
    order = Window.partitionBy("k1", "k2").orderBy("id")
    # rows that repeat an id and its vector are one; they lie in one partition already
    members = materialize(rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= wanted + 1).dropDuplicates(["k1", "k2", "id"]))
    reps = members.where("nth = 1").select("k1", "k2", F.col("id").alias("rep"), "vector")
    n = reps.count()
    sample = reps.where(hash_share("rep", sample_vectors / max(n, 1))).select("rep", "vector").toPandas().sort_values("rep")
    if not len(sample):
        sample = reps.orderBy("rep").limit(100).select("rep", "vector").toPandas()
    index = MultiIndex.fit(_matrix(sample["vector"]), cells_per_half(n))
    k1, k2 = len(index.first), len(index.second)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = index.cells(_matrix(batch.column("vector")))
        return pa.record_batch([*batch.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=[*batch.schema.names, "c1", "c2"])

    placed = materialize(map_rows(reps, assign, "k1 long, k2 long, rep long, vector array<double>, c1 int, c2 int"))
    counts = np.zeros((k1, k2), np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():  # one row for each cell
        counts[r["c1"], r["c2"]] = r["count"]
    target = math.ceil(index.share_for(_matrix(sample["vector"]), recall, wanted) * n)

    query_rows = rows.where(queries_where(F.col("id"))).select("id", "k1", "k2").distinct()
    asked = placed.join(query_rows.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", "vector")

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, cell, visits = [], [], []
        for i, q in enumerate(_matrix(batch.column("vector"))):
            for c, js in index.visit(q, counts, target).items():
                at.append(i)
                cell.append(c)
                visits.append(js)
        took = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("k1", "k2", "vector")]
        return pa.record_batch([*took, pa.array(cell, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["k1", "k2", "vector", "c1", "visits"])

    routed = materialize(map_rows(asked, route, "k1 long, k2 long, vector array<double>, c1 int, visits array<int>"))
    q_count = {r["c1"]: r["count"] for r in routed.groupBy("c1").count().collect()}  # one row for each first centroid
    e_blocks = F.create_map(*[F.lit(x) for c in range(k1) for x in (c, max(1, math.ceil(int(counts[c].sum()) / BLOCK)))])
    q_blocks = F.create_map(*[F.lit(x) for c in range(k1) for x in (c, max(1, math.ceil(q_count.get(c, 0) / BLOCK)))])
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks[F.col("c1")] - 1))
    own = lambda key, blocks: F.pmod(F.xxhash64(key), blocks[F.col("c1")]).cast("int")
    entries = placed.where(F.col("c1").isin([int(c) for c in q_count])).withColumn("eb", own("rep", e_blocks)).withColumn("qb", every(q_blocks))
    queries = routed.withColumn("qb", own("k1", q_blocks)).withColumn("eb", every(e_blocks))
    keep = wanted + 1
    found = (
        entries.groupBy("c1", "eb", "qb")
        .cogroup(queries.groupBy("c1", "eb", "qb"))
        .applyInPandas(lambda e, q: _search_block(e, q, keep, k2), "q1 long, q2 long, e1 long, e2 long, rep long, score double")
    )
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "rep"))).where(F.col("nth") <= keep).drop("nth")
    spread = best.join(members.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), "id"), ["e1", "e2"])
    top = spread.withColumn("nth", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= keep)
    # many queries may hold one vector: its answers are copied to a few salts
    salts = 16
    answers = top.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.col("id").alias("vec_id"), "score").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ids = query_rows.select(F.col("id").alias("query_id"), "k1", "k2", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    all_found = ids.join(answers, ["k1", "k2", "salt"]).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "k1", "k2").orderBy(F.desc("score"), "vec_id"))
    return all_found.select(F.col("query_id").cast("long"), rank.cast("int").alias("rank"), F.col("vec_id").cast("long"), "score").where(F.col("rank") <= wanted)
