"""Streams against batches and whole texts: drained answers, key health, and a moving average over a hot key."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stemforge.operators import windows
from stemforge.streaming import drain, keys

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answers():
    r = random.Random(12)
    out = {}
    for name in ("plain", "fenced", "broken", "list"):
        records = [{"question": f"Câu {i}: what {{is}} \"{name}\" ] {i % 7}?", "options": [f"A. {i}", "B. } x", "C. \\ y"], "correctAnswer": "B", "meta": {"deep": [{"a": 1}]}} for i in range(12)]
        records.insert(3, records[1])  # a repeat
        body = json.dumps({"meta": {"n": 1}, "questions": records}, ensure_ascii=False, indent=r.choice([None, 1]))
        out[name] = {"plain": body, "fenced": f"Here it is:\n```json\n{body}\n```", "broken": body[: len(body) * 2 // 3], "list": json.dumps(records)}[name]
    return out


def whole(text):
    found, seen = [], set()
    for t in drain.Scanner().feed(text):
        record = drain.read_object(t)
        if record and drain.record_key(record) not in seen:
            seen.add(drain.record_key(record))
            found.append(record["question"])
    return found


def test_any_cutting_gives_the_objects_of_the_whole():
    r = random.Random(5)
    for text in answers().values():
        want = list(drain.Scanner().feed(text))
        assert len(want) >= 8
        for _ in range(40):
            cuts = sorted(r.randrange(len(text) + 1) for _ in range(r.randrange(60)))
            scanner = drain.Scanner()
            got = [x for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) for x in scanner.feed(text[a:b])]
            assert got == want
            assert len(scanner.held) < 1500  # the open object alone


def test_records_come_once_while_the_answer_comes_in_any_order(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for name, text in answers().items():
        cuts = sorted(r.sample(range(1, len(text)), 40))
        rows += [(name, i, text[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True))]
    rows += rows[5:9]
    r.shuffle(rows)
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k::3], "response string, seq long, text string").coalesce(1).write.mode("append").parquet(str(source))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema("response string, seq long, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    out = drain.drained(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination(240)
    got = {}
    for x in spark.read.parquet(str(tmp_path / "out")).orderBy("response", "ordinal").collect():
        got.setdefault(x["response"], []).append(x["question"])
    assert got == {name: whole(text) for name, text in answers().items()}


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(7)
    kinds = ["ok", "ok", "ok", "rateLimit", "quota", "auth", "suspect", "serverBusy", "format"]
    rows, i = [], 0
    for k in range(25):
        at = 1_700_000_000_000
        for _ in range(r.randrange(1, 120)):
            at += r.choice([0, 500, 20_000, 40_000, 70_000, 400_000])
            kind = r.choice(kinds)
            rows.append((f"k{k}", i, at, kind, r.choice([None, 100.0 * r.random()]) if kind == "ok" else None, r.choice([None, None, 1000, 200_000]), kind == "auth" and r.random() < 0.1))
            i += 1
    return rows


SCHEMA = "key string, event_id long, at long, kind string, latency_ms double, retry_after_ms long, permanent boolean"


def replayed(rows):
    state = {}
    for k, _, at, kind, ms, retry, permanent in sorted(rows, key=lambda x: (x[2], x[1])):
        state.setdefault(k, keys.KeyHealth()).event(at, kind, ms, retry, permanent)
    return state


def compare(got, health):
    for c in keys.HEALTH_COLUMNS:
        want = len(health.usage) if c == "recent" else getattr(health, c)
        assert got[c] == (pytest.approx(want) if c == "latency" and want is not None else want), c


def test_batch_health_is_the_replay_of_all_events(spark, events):
    want = replayed(events)
    got = {x["key"]: x for x in keys.key_health(spark.createDataFrame(events, SCHEMA).repartition(4)).collect()}
    assert set(got) == set(want)
    for k, health in want.items():
        compare(got[k], health)
    assert {x["status"] for x in got.values()} >= {"healthy", "cooldown"}


def test_stream_health_agrees_with_batch_and_timers_end_blocks(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = tmp_path / "in"
    ordered = sorted(events, key=lambda x: (x[2], x[1]))
    third = len(ordered) // 3
    late = max(x[2] for x in events) + 10 * 24 * 3_600_000
    for part in (ordered[:third], ordered[third : 2 * third], ordered[2 * third :], [("other", 10**6, late, "ok", None, None, False)], [("other", 10**6 + 1, late + 1, "ok", None, None, False)]):
        d = spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_millis("at"))
        d.coalesce(1).write.mode("append").parquet(str(source))
    schema = SCHEMA + ", ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    seen = []
    q = keys.stream_health(stream, delay="1 hour").writeStream.outputMode("update").foreachBatch(lambda d, n: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    want = replayed(events)
    last = {x["key"]: x for x in seen if x["change"] == "events"}
    for k, health in want.items():
        compare(last[k], health)
    # far later all blocks but permanent ones are over, and all keys forgotten
    assert {x["key"] for x in seen if x["change"] == "forgotten"} == set(want)
    blocked = {k for k, h in want.items() if h.status != "healthy" and h.blocked_until < keys.FOREVER}
    assert blocked and blocked <= {x["key"] for x in seen if x["change"] == "unblocked"} and all(x["status"] == "healthy" for x in seen if x["change"] == "unblocked")


def test_moving_average_of_a_key_with_a_million_rows(spark):
    n = 1_000_000
    d = spark.range(n).select(F.when(F.col("id") % 10 == 3, F.concat(F.lit("k"), F.col("id") % 50)).otherwise("hot").alias("key"), F.col("id").alias("at"), F.when(F.col("id") % 11 != 5, F.hash("id") % 1000 / 7.0).alias("v"))
    got = {x["key"]: x["average"] for x in windows.moving_average(d.repartition(6), "key", ["at"], "v").collect()}
    want = {}
    for x in d.orderBy("at").toLocalIterator():
        if x["v"] is not None:
            want[x["key"]] = x["v"] if x["key"] not in want else want[x["key"]] * 0.8 + x["v"] * 0.2
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_moving_average_of_few_rows_and_none(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 10.0), ("b", 1, None)], "key string, at int, v double")
    assert {x["key"]: x["average"] for x in windows.moving_average(d, "key", ["at"], "v", block=1).collect()} == {"a": 6.0, "b": None}
