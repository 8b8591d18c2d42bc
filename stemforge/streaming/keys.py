"""Rolling-window admission and key health: windows and aggregates in batch, one transition function each as state in streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from stemforge.operators.windows import moving_average, streaks

WINDOW_MS = 60_000
#: Least, usual and greatest block times in ms, and the EMA's weight.
RATE_LIMIT = (45_000, 180_000, 300_000)
AUTH = (900_000, 900_000, 3_600_000)
QUOTA = (1_800_000, 1_800_000, 21_600_000)
SUSPECT = (30_000, 30_000, 120_000)
PRESSURE_WINDOW_MS = 45_000
PRESSURE_GONE_MS = 60_000
ALPHA = 0.2
USAGE_KEPT = 100
FOREVER = 2**62
#: A stream forgets a key after so long without an event.
FORGET_MS = 24 * 3_600_000

#: What an error of a kind makes of its key.
STATUS = {"rateLimit": "cooldown", "quota": "quotaBlocked", "auth": "authBlocked", "suspect": "suspect"}
PRESSING = ("rateLimit", "quota", "serverBusy")


@dataclass
class Limiter:
    """Admissions of the last minute; a request waits until the oldest that stands in its way has left the window."""

    limit: int = 30
    admitted: list[int] = field(default_factory=list)

    def admit(self, now: int) -> int:
        """The time at which a request that comes at `now` is admitted."""
        at = max(now, self.admitted[-1] if self.admitted else now)
        self.admitted = [t for t in self.admitted if t > at - WINDOW_MS]
        if len(self.admitted) >= self.limit:
            at = self.admitted[-self.limit] + WINDOW_MS
            self.admitted = [t for t in self.admitted if t > at - WINDOW_MS]
        self.admitted.append(at)
        return at


@dataclass
class KeyHealth:
    """What is known of one key."""

    status: str = "healthy"
    blocked_until: int = 0
    successes: int = 0
    failures: int = 0
    format_errors: int = 0
    rate_strikes: int = 0
    quota_strikes: int = 0
    auth_strikes: int = 0
    suspect_strikes: int = 0
    pressure: int = 0
    last_pressure: int | None = None
    last_success: int | None = None
    last_failure: int | None = None
    latency: float | None = None
    usage: list[int] = field(default_factory=list)

    def settle(self, now: int) -> KeyHealth:
        """A block that is over ends; uses older than a minute are forgotten."""
        if self.status != "healthy" and 0 < self.blocked_until <= now:
            self.status, self.blocked_until = "healthy", 0
        self.usage = [t for t in self.usage if now - t <= WINDOW_MS]
        return self

    def event(self, now: int, kind: str, latency_ms: float | None = None, retry_after_ms: int | None = None, permanent: bool = False) -> KeyHealth:
        """kind: ok, format (the answer says nothing about the key), serverBusy (nor does this, but it presses), or an error of the key."""
        if kind in PRESSING:
            self.pressure = self.pressure + 1 if self.last_pressure is not None and now - self.last_pressure <= PRESSURE_WINDOW_MS else 1
            self.last_pressure = now
        if kind == "serverBusy":
            return self
        self.settle(now)
        if kind in ("ok", "format"):
            self.status, self.blocked_until = "healthy", 0
        if kind == "format":
            self.format_errors += 1
        elif kind == "ok":
            self.successes += 1
            self.failures, self.rate_strikes, self.suspect_strikes = (max(0, n - 1) for n in (self.failures, self.rate_strikes, self.suspect_strikes))
            self.last_success = now
            self.usage = [*self.usage, now][-USAGE_KEPT:]
            if latency_ms is not None:
                self.latency = float(latency_ms) if self.latency is None else (1 - ALPHA) * self.latency + ALPHA * latency_ms
            if self.last_pressure is not None and now - self.last_pressure > PRESSURE_GONE_MS:
                self.pressure = 0
        else:
            self.failures += 1
            self.last_failure = now
            self.blocked_until = max(self.blocked_until, min(FOREVER, now + self._block_ms(kind, retry_after_ms, permanent)))
            self.status = STATUS[kind]
        return self

    def _block_ms(self, kind: str, asked: int | None, permanent: bool) -> int:
        if kind == "rateLimit":
            self.rate_strikes += 1
            (least, usual, most) = RATE_LIMIT
        elif kind == "quota":
            self.quota_strikes += 1
            (least, usual, most) = QUOTA
            usual *= 2 ** min(self.quota_strikes - 1, 10)
        elif kind == "auth":
            self.auth_strikes += 1
            if permanent:
                return FOREVER
            (least, usual, most) = AUTH
            usual *= self.auth_strikes
        else:
            self.suspect_strikes += 1
            (least, usual, most) = SUSPECT
        return min(max(usual if asked is None else asked, least), most)

    def score(self, now: int, jitter: float = 0.0) -> float:
        """Better keys score higher; blocked ones are out."""
        self.settle(now)
        if self.status != "healthy":
            return float("-inf")
        total = self.successes + self.failures
        pressed = self.last_pressure is not None and now - self.last_pressure <= PRESSURE_WINDOW_MS
        return 100 * (self.successes + 1) / (total + 2) - 2 * len(self.usage) - (self.latency or 0.0) / 1000 - 5 * self.pressure * pressed + jitter


ADMISSIONS = "key string, event_id long, at long, admitted_at long"


def admissions(events: DataFrame, limit: int = 30) -> DataFrame:
    """key, event_id, at and admitted_at of events (key, event_id, at in ms): each key's requests in order of their times.

    A request waits for the one `limit` places before it to leave the window, so that with every
    limit-th request as a chain, a time is the running maximum of (at - windows passed in the chain):
    windows over sorted rows, which spill, and no group in memory.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy("at", "event_id")) - 1
    passed = F.floor(F.col("__place") / limit) * WINDOW_MS
    chain = Window.partitionBy("key", "__chain").orderBy("__place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = events.select("key", "event_id", "at").withColumn("__place", place).withColumn("__chain", F.col("__place") % limit)
    return d.select("key", "event_id", "at", (F.max(F.col("at") - passed).over(chain) + passed).cast("long").alias("admitted_at"))


HEALTH_COLUMNS = [
    "status", "blocked_until", "successes", "failures", "format_errors", "rate_strikes", "quota_strikes", "auth_strikes", "suspect_strikes", "pressure", "last_success", "last_failure", "recent", "latency",
]


def key_health(events: DataFrame) -> DataFrame:
    """State of each key after its last event (key, event_id, at in ms, kind, latency_ms, retry_after_ms, permanent), as KeyHealth has it.

    Windows over a key's sorted rows, which spill, and aggregates; no key is in memory as a whole:
    * a count that errors raise and successes lower, but not below 0, is its running sum less the least that sum has been;
    * what blocks a key is the maximum of its blocks since the last event that cleared it (the running count of those is an island);
    * pressure is the place of the last pressing event in its run without a longer gap;
    * the mean latency is the last value of a moving average by blocks.
    """
    permanent = F.coalesce("permanent", F.lit(False)) if "permanent" in events.columns else F.lit(False)
    d = events.select("key", "event_id", "at", "kind", "latency_ms", "retry_after_ms", permanent.alias("permanent"))
    kind, at = F.col("kind"), F.struct("at", "event_id")
    w = Window.partitionBy("key").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ~kind.isin("serverBusy", "ok", "format")
    walk = lambda raised: F.sum(F.when(raised, 1).when(kind == "ok", -1).otherwise(0)).over(w)
    n = lambda name: F.count_if(kind == name).over(w)
    d = d.withColumns({"walk": walk(own), "rate_walk": walk(kind == "rateLimit"), "suspect_walk": walk(kind == "suspect"), "quota_n": n("quota"), "auth_n": n("auth"), "epoch": F.count_if(kind.isin("ok", "format")).over(w)})

    def clamped(usual: Column, bounds: tuple[int, int, int]) -> Column:
        return F.least(F.greatest(F.coalesce("retry_after_ms", usual), F.lit(bounds[0])), F.lit(bounds[2]))

    doubled = F.lit(QUOTA[1]) * F.pow(F.lit(2), F.least(F.col("quota_n") - 1, F.lit(10))).cast("long")
    ms = (
        F.when(kind == "rateLimit", clamped(F.lit(RATE_LIMIT[1]), RATE_LIMIT)).when(kind == "quota", clamped(doubled, QUOTA)).when((kind == "auth") & F.col("permanent"), F.lit(FOREVER))
        .when(kind == "auth", clamped(F.lit(AUTH[1]) * F.col("auth_n"), AUTH)).when(own, clamped(F.lit(SUSPECT[1]), SUSPECT))
    )
    until = F.when(ms == FOREVER, F.lit(FOREVER)).when(ms.isNotNull(), F.col("at") + ms)
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[kind]
    by_epoch = d.groupBy("key", "epoch").agg(F.max(until).alias("until"), F.max_by(status, F.when(own, at)).alias("status"))
    blocks = by_epoch.groupBy("key").agg(F.max(F.struct("epoch", "until", "status")).alias("b"))
    blocks = blocks.select("key", F.coalesce("b.status", F.lit("healthy")).alias("status"), F.coalesce("b.until", F.lit(0).cast("long")).alias("blocked_until"))

    floored = lambda c: F.max_by(c, at) - F.least(F.lit(0), F.min(c))
    counts = d.groupBy("key").agg(
        F.count_if(kind == "ok").alias("successes"), floored("walk").alias("failures"), F.count_if(kind == "format").alias("format_errors"), floored("rate_walk").alias("rate_strikes"), F.count_if(kind == "quota").alias("quota_strikes"),
        F.count_if(kind == "auth").alias("auth_strikes"), floored("suspect_walk").alias("suspect_strikes"), F.max(F.when(kind == "ok", F.col("at"))).alias("last_success"), F.max(F.when(own, F.col("at"))).alias("last_failure"),
    )
    seen = Window.partitionBy("key")
    touched = F.max(F.when(kind != "serverBusy", F.col("at"))).over(seen)
    recent = d.withColumn("touched", touched).where((kind == "ok") & (F.col("touched") - F.col("at") <= WINDOW_MS)).groupBy("key").agg(F.least(F.count(F.lit(1)), F.lit(USAGE_KEPT)).alias("recent"))
    pressing = streaks(d.where(kind.isin(*PRESSING)), "key", ["at", "event_id"], "at", PRESSURE_WINDOW_MS).groupBy("key").agg(F.max_by("streak", at).alias("run"), F.max(at).alias("pressed"))
    latency = moving_average(d.where(kind == "ok"), "key", ["at", "event_id"], "latency_ms", ALPHA).withColumnRenamed("average", "latency")
    out = counts.join(blocks, "key").join(recent, "key", "left").join(pressing, "key", "left").join(latency, "key", "left")
    gone = F.col("last_success") - F.col("pressed.at") > PRESSURE_GONE_MS
    pressure = F.when(F.col("run").isNull() | F.coalesce(gone, F.lit(False)), 0).otherwise(F.col("run")).alias("pressure")
    longs = {"pressure": pressure.cast("long"), "recent": F.coalesce("recent", F.lit(0)).cast("long")}
    return out.withColumns(longs).select("key", *HEALTH_COLUMNS)


def best_key(health: DataFrame, now: int) -> DataFrame:
    """The key to use next: of those that are not blocked, the one with the best record."""
    score = 100 * (F.col("successes") + 1) / (F.col("successes") + F.col("failures") + 2) - 2 * F.col("recent") - F.coalesce("latency", F.lit(0.0)) / 1000 - 5 * F.col("pressure")
    return health.where((F.col("status") == "healthy") | (F.col("blocked_until") <= now)).withColumn("score", score).orderBy(F.desc("score"), "key").limit(1)


class AdmissionProcessor(StatefulProcessor):
    """The limiter as stream state, one for each key."""

    limit = 30

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limiter", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.state.get()[0]) if self.state.exists() else []
        limiter = Limiter(self.limit, kept)
        for batch in rows:
            batch = batch.sort_values(["at", "event_id"])
            yield batch.assign(admitted_at=[limiter.admit(int(t)) for t in batch["at"]])[["key", "event_id", "at", "admitted_at"]]
        self.state.update((json.dumps(limiter.admitted),))

    def close(self) -> None:
        pass


def stream_admissions(events: DataFrame) -> DataFrame:
    """The same as `admissions` over a stream; needs the RocksDB state store."""
    return events.select("key", "event_id", "at").groupBy("key").transformWithStateInPandas(AdmissionProcessor(), ADMISSIONS, "Append", "None")


HEALTH = "key string, change string, status string, blocked_until long, successes long, failures long, format_errors long, rate_strikes long, quota_strikes long, auth_strikes long, suspect_strikes long, pressure long, last_success long, last_failure long, recent long, latency double"


class HealthProcessor(StatefulProcessor):
    """Key health as stream state: a row for each batch of a key's events, one when its block ends by event time, and no state once it is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", StructType([StructField("json", StringType())]))

    def _row(self, key: tuple, change: str, health: KeyHealth) -> pd.DataFrame:
        kept = asdict(health)
        kept["recent"] = len(health.usage)
        return pd.DataFrame([{"key": key[0], "change": change, **{c: kept[c] for c in HEALTH_COLUMNS}}]).astype({c: "Int64" for c in HEALTH_COLUMNS if c not in ("status", "latency")} | {"latency": "float64"})

    def _kept(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"health": {}, "last": 0}

    def _save(self, health: KeyHealth, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = {last + FORGET_MS}
        if health.status != "healthy" and health.blocked_until < FOREVER:
            due.add(health.blocked_until)
        for at in due:
            self.handle.registerTimer(at)
        self.state.update((json.dumps({"health": asdict(health), "last": last}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        kept = self._kept()
        health, last = KeyHealth(**kept["health"]), kept["last"]
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])  # one key's rows of one micro-batch
        for r in events.itertuples(index=False):
            last = max(last, int(r.at))
            health.event(int(r.at), r.kind, None if pd.isna(r.latency_ms) else float(r.latency_ms), None if pd.isna(r.retry_after_ms) else int(r.retry_after_ms), bool(r.permanent))
        self._save(health, last)
        yield self._row(key, "events", health)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803  names that Spark passes
        kept = self._kept()
        health, now = KeyHealth(**kept["health"]), int(expiredTimerInfo.getExpiryTimeInMs())
        if now >= kept["last"] + FORGET_MS:
            self.state.clear()
            yield self._row(key, "forgotten", health.settle(now))
            return
        self.state.update((json.dumps({"health": asdict(health.settle(now)), "last": kept["last"]}),))
        yield self._row(key, "unblocked", health)

    def close(self) -> None:
        pass


def stream_health(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The same as `key_health` over a stream (with ts, the time of `at`): each key's state whenever it changes; needs the RocksDB state store."""
    rows = events.select("key", "event_id", "ts", "at", "kind", "latency_ms", "retry_after_ms", "permanent").withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(HealthProcessor(), HEALTH, "Update", "EventTime")
