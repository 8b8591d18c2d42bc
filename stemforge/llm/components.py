"""Distributed union-find over link tables, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.llm.common import removed, written


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 8) -> DataFrame:
    """A join whose left side may hold a hot key: its rows are dealt over `salts` copies of the right side, which has a key once."""
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges from a larger node `u` to a smaller node `v`."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = salted_join(both.where("v > u"), least, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = salted_join(large, least, ["u"], F.col("v")).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that a link names; links may repeat and point either way.

    Large-star and small-star steps alternate until the edges are stars around the smallest nodes, which
    takes a number of rounds that grows with the logarithm of the longest chain.  Each round's
    edges are a table in the shared folder, with the size of its files as its estimate.
    """
    spark = links.sparkSession
    path = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    state = None
    while True:
        edges = spark.read.parquet(path)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        before, path = path, written(_stars(edges))
        removed(spark, before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
