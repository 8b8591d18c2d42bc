"""Phases of a run, scopes, replacements and orders."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stemforge.operators import phases, results

ROWS = phases.ROWS


def rows(spark, found, failed=(), kind="json", stage=None, blocked=None):
    return spark.createDataFrame([(b, k, f"q {k}", None, None, None) for b, k in found] + [(b, None, None, kind, stage, blocked) for b in failed], ROWS)


def numbered(n, start=0):
    return [(i // 5, f"k{i}") for i in range(start, start + n)]


def keys(outcome):
    return sorted(r["key"] for r in outcome.rows.where("question IS NOT NULL").collect())


def test_first_pass_alone(spark):
    out = phases.run_phases(lambda: rows(spark, numbered(10)), lambda: 1 / 0, lambda f: 1 / 0, estimated=11)
    assert (out.questions, out.failed, out.audit, out.phases) == (10, 0, False, ["initial"])


def test_fallback_counts_only_if_it_finds_more(spark):
    first = lambda: rows(spark, numbered(5), [7])
    more = phases.run_phases(first, lambda: rows(spark, numbered(9, 100)), estimated=10)
    assert (more.questions, more.failed, more.audit, more.phases) == (9, 0, False, ["initial", "fallback"]) and keys(more)[0] == "k100"
    equal = phases.run_phases(first, lambda: rows(spark, numbered(5, 100)), estimated=10)
    assert (equal.questions, equal.failed, equal.audit) == (5, 1, True) and keys(equal)[0] == "k0"
    broken = phases.run_phases(first, lambda: 1 / 0, estimated=10)
    assert (broken.questions, broken.phases) == (5, ["initial"])
    assert phases.run_phases(first, lambda: 1 / 0, estimated=0).phases == ["initial"]  # without an estimate there is none


def test_rescue_adds_what_is_new_and_keeps_what_fails_again(spark):
    asked = []

    def rescue(failures):
        asked.extend(sorted(r["batch"] for r in failures.collect()))
        return rows(spark, [(7, "k1"), (7, "new"), (7, "new")], [8])

    out = phases.run_phases(lambda: rows(spark, numbered(5), [7, 8]), None, rescue, detected=6)
    assert asked == [7, 8] and (out.questions, out.failed, out.rescued, out.audit) == (6, 1, 1, False)
    assert keys(out) == ["k0", "k1", "k2", "k3", "k4", "new"] and out.rows.where("question IS NULL").count() == 1
    assert phases.run_phases(lambda: rows(spark, numbered(5), [7]), None, lambda f: 1 / 0).questions == 5


@pytest.mark.parametrize(("failed", "kind", "stage", "blocked", "waits"), [([1, 2], "rateLimit", None, None, True), ([1], "serverBusy", None, None, False), ([1], "json", None, 3, True), ([1, 2, 3], "json", "split", None, True), ([1, 2], "json", "partial", None, False)])
def test_rescue_waits_while_the_provider_is_hot(spark, failed, kind, stage, blocked, waits):
    ran = []
    out = phases.run_phases(lambda: rows(spark, numbered(5), failed, kind, stage, blocked), None, lambda f: ran.append(1) or rows(spark, []), detected=5)
    assert bool(ran) != waits and out.failed == (len(failed) if waits else 0)


def test_audit_is_due_below_four_fifths(spark):
    assert phases.run_phases(lambda: rows(spark, numbered(7)), detected=9).audit and not phases.run_phases(lambda: rows(spark, numbered(8)), detected=10).audit
    assert not phases.run_phases(lambda: rows(spark, []), detected=0).audit


def test_no_phase_is_read_to_decide(spark):
    """The first pass runs once, however many branches ask for its counts."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    first = lambda: rows(spark, numbered(5), [7]).coalesce(1).mapInArrow(counted, ROWS)
    phases.run_phases(first, lambda: rows(spark, numbered(1)), lambda f: rows(spark, [(7, "x")]), estimated=10)
    assert seen.value == 6


def test_scope(spark):
    fields = "id int, source string, file_id string, file_name string, start int, end int"
    parts = spark.createDataFrame([(1, " File  A p1", "f1", "a.pdf", 1, 3, "text"), (2, "", "", "a.pdf", 2, 4, "pdfVision"), (3, None, "f2", "A.PDF", 1, 9, "text")], fields + ", mode string")
    asked = spark.createDataFrame([(10, "file a P1", "f1", None, None, None), (11, "file a p1", "f2", None, None, None), (12, "x", None, " A.pdf", 2, 3), (13, "x", None, "a.pdf", 1, 3), (14, "file a p1", None, None, None, None)], fields)
    assert sorted(tuple(r) for r in results.covered(parts, asked).collect()) == [(1, 10), (1, 14), (2, 12)]
    p = parts.select(F.col("id").alias("pid"), F.struct(*parts.columns).alias("p"))
    q = asked.select(F.col("id").alias("qid"), F.struct(*asked.columns).alias("q"))
    brute = p.join(q).where(results.in_scope(F.col("q"), F.col("p"))).select("pid", "qid")
    assert sorted(tuple(r) for r in brute.collect()) == [(1, 10), (1, 14), (2, 12)]


def test_compact_records(spark):
    d = spark.createDataFrame([(1, "q", list("abcdefg"), "A", "s", "long"), (2, "q", None, "B", "s", None)], "id int, question string, options array<string>, answer string, source string, explanation string")
    got = results.compact(d).orderBy("id").collect()
    assert got[0]["options"] == list("abcde") and got[1]["options"] == [] and "explanation" not in got[0].asDict() and got[0]["difficulty"] == ""


def test_places_of_a_sort_over_many_partitions(spark):
    """Each step may coalesce its partitions differently: places and partition sizes must come of one run."""
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.shuffle.partitions"]
    had = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ["20000", "false", "1", "40"], strict=True):
        spark.conf.set(n, v)
    try:
        entry.queries()["final_order"](spark, "/root/testdata/sf0.01").createOrReplaceTempView("placed")
        got = [(r["id"], r["place"]) for r in spark.sql("SELECT id, place FROM placed ORDER BY place").collect()]
    finally:
        for n, v in had.items():
            spark.conf.set(n, v)
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_size").collect()
    want = sorted((r["p_size"] if r["p_partkey"] % 5 < 3 else 999_999, r["p_partkey"]) for r in part)
    assert got == [(k, i) for i, (_, k) in enumerate(want, 1)]
