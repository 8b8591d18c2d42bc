"""Divergence of sources against plain loops over whole texts, and the tournament's schedule."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stemforge.llm.source_divergence import host, opponent, shares, source_divergence, tournament

SCHEMA = "doc_id long, text string, lang string, source string, n long, d long, bucket string, rank string, value string"


def plain(rows, least=3, ranks=200):
    """(lang, source, part, item, value, rank) with Python's own integers."""
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
        groups[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        mine = {s: c for (x, s), c in groups.items() if x == lang}

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = {s: share(c) for s, c in mine.items()}
        q = share(sum(mine.values(), Counter()))
        for s in mine:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in mine if o != s]
            best = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:ranks])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    pool = [f"{a}{b}" for a in ("alpha", "Beta", "é", "Ωmega", "zz", "日本") for b in ("", "x", "yy", "é", "q")]
    out = [(None, None, None), ("", "en", "s1"), ("123 -- 45", "en", "only digits"), (None, "de", "s1"), ("once", "de", "s2"), ("word " * 5000, "en", "s2")]
    for i in range(300):
        lang, source = r.choice(["en", "fr", None]), r.choice(["s1", "s2", "s10", "é", None, "s3"])
        out.append((" ".join(r.choice(pool[: 10 + i % 20]) + r.choice([",", "", "1b", "\n"]) for _ in range(r.randrange(40))), lang, source))
    return out + out[50:60]


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("bucket_rows", "ranks"), [(10**6, 200), (40, 3)])
def test_against_plain_loops(spark, rows, bucket_rows, ranks):
    docs = spark.createDataFrame([(i % 9, *x, 1, 1, "b", "r", "v") for i, x in enumerate(rows)], SCHEMA).repartition(5)
    assert collected(source_divergence(docs, bucket_rows=bucket_rows, ranks=ranks)) == plain(rows, ranks=ranks)


def test_groups_without_kept_terms_and_empty_table(spark):
    rows = [("a b", "en", "x"), (None, "en", "y"), ("c", "fr", "x")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert collected(source_divergence(docs)) == plain(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert source_divergence(docs.where("false")).collect() == []


def test_every_pair_meets_once_in_a_round_of_its_own(spark):
    for groups in range(1, 12):
        players = groups + groups % 2
        seats = spark.range(groups).withColumnRenamed("id", "slot").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(players - 2).cast("long"))))
        seats = seats.withColumn("peer", opponent(F.col("slot"), F.col("round"), F.lit(players))).where(F.col("peer") < groups)
        found = seats.withColumn("host", host(F.col("slot"), F.col("peer"))).collect()
        assert sorted({(min(r.slot, r.peer), max(r.slot, r.peer)) for r in found}) == [(a, b) for a in range(groups) for b in range(a + 1, groups)]
        assert len(found) == groups * (groups - 1) and all(n == 1 for n in Counter((r.round, r.slot) for r in found).values())
        hosts = Counter(r.host for r in found)
        assert groups < 3 or max(hosts.values()) - min(hosts.values()) <= 4


def test_residents_come_before_their_visitors(spark):
    schema = "lang string, bucket int, slot int, source string, v long, n long, body binary, of_lang binary, names array<string>"
    vectors = spark.createDataFrame([("en", b, s, f"s{s}", 1, 1, b"x", b"x", ["t"]) for b in range(3) for s in range(5)], schema)
    for part in tournament(vectors).select("lang", "bucket", "host", "round", F.spark_partition_id().alias("part")).toPandas().groupby(["part"]):
        for _, of_host in part[1].groupby(["lang", "bucket", "host"]):
            assert of_host["round"].iloc[0] == -1 and of_host["round"].is_monotonic_increasing and of_host.index.max() - of_host.index.min() == len(of_host) - 1


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.choice([r.randrange(1, 50), r.randrange(1, 10**15)])
        count = r.randrange(total)
        assert int(shares([count], total)[0]) == 1 + 10**9 * (count + 1) // total
