"""Merged intervals against the SQL of the query, with nulls."""

import random

import duckdb

from stemforge.operators import windows
from stemforge.plans.catalogue import ORACLES, QUERIES


def test_intervals_with_nulls_equal_the_sql(spark, tmp_path):
    r = random.Random(4)
    spots = [r.sample(range(50), 6) for _ in range(60)]  # no two intervals of an order are equal, so that none ties
    rows = [(k if k % 20 else None, p if r.random() < 0.8 else None, float(r.randrange(1, 51)) if r.random() < 0.8 else None) for k, ps in enumerate(spots) if k % 20 or not k for p in ps]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(x) for x in QUERIES["interval_merge"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(ORACLES["interval_merge"]).fetchall(), key=str)


def test_null_intervals_come_last_and_open_no_gap(spark):
    d = spark.createDataFrame([("a", None, None), ("a", 1, 2), ("a", 9, None), ("a", 9, 9), ("b", None, None)], "g string, start int, end int")
    assert sorted((r["g"], r["start"], r["end"], r["merged"]) for r in windows.merge_intervals(d, ["g"]).collect() if r["g"] == "a") == [("a", 1, 2, 1), ("a", 9, 9, 3)]
    assert [(r["start"], r["end"], r["merged"]) for r in windows.merge_intervals(d, ["g"]).where("g = 'b'").collect()] == [(None, None, 1)]
