"""A run in phases: a first pass, a fallback where it found too little, a rescue of what failed, and word that an audit is due.

What a phase found is written once, and its counts are observed while it is written (`Observation`); the branches look at these
counts alone, so no phase is read again to decide about the next one.

Rows of a phase: batch int, key string (what makes two questions the same), question string (null where the batch failed), and of
failures kind, stage and blocked_keys.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stemforge.functions.lineage import checkpoint_dir

log = logging.getLogger(__name__)

ROWS = "batch int, key string, question string, kind string, stage string, blocked_keys int"
#: Parts of the estimate under which a fallback, and an audit, are due.
FALLBACK_BELOW = 0.9
AUDIT_BELOW = 0.8
#: A rescue waits after so many failures under pressure, or one with so many blocked keys, or so many batches of which so many were cut already.
PRESSED = 2
BLOCKED_KEYS = 3
MANY_FAILED, MANY_CUT = 3, 2


@dataclass(frozen=True)
class Phase:
    """A phase's rows, and what was counted while they were written."""

    name: str
    rows: DataFrame
    questions: int
    failed: int
    pressed: int
    cut: int
    most_blocked: int

    @property
    def rescue_waits(self) -> bool:
        return self.failed > 0 and (self.pressed >= PRESSED or self.most_blocked >= BLOCKED_KEYS or (self.failed >= MANY_FAILED and self.cut >= MANY_CUT))

    @property
    def failures(self) -> DataFrame:
        return self.rows.where("question IS NULL")


@dataclass
class Outcome:
    rows: DataFrame
    questions: int
    failed: int
    rescued: int = 0
    audit: bool = False
    phases: list[str] = field(default_factory=list)


def observed(name: str, rows: DataFrame) -> Phase:
    """The rows, written to the shared folder, with their counts."""
    path = f"{checkpoint_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    failed = F.col("question").isNull()
    counts = Observation()
    measures = {
        "questions": F.count_if(~failed), "failed": F.count_if(failed), "pressed": F.count_if(failed & F.col("kind").isin("rateLimit", "serverBusy")),
        "cut": F.count_if(failed & F.col("stage").isin("partial", "split")), "most_blocked": F.max(F.when(failed, F.coalesce("blocked_keys", F.lit(0)))),
    }
    rows.select("batch", "key", "question", "kind", "stage", "blocked_keys").observe(counts, *[c.alias(n) for n, c in measures.items()]).write.parquet(path)
    got = counts.get
    return Phase(name, rows.sparkSession.read.schema(ROWS).parquet(path), *(int(got[n] or 0) for n in measures))


def run_phases(
    initial: Callable[[], DataFrame], fallback: Callable[[], DataFrame] | None = None, rescue: Callable[[DataFrame], DataFrame] | None = None, estimated: int = 0, detected: int = 0,
) -> Outcome:
    """What a run finds in the end.  `fallback` is given where another reader can be tried, `rescue` (failures to rows) where failures are tried again.

    A fallback counts only if it finds more; one that breaks off leaves the first pass as it is, and so does a rescue.
    """
    now = observed("initial", initial())
    done = [now.name]
    if fallback and estimated > 0 and now.questions < estimated * FALLBACK_BELOW:
        try:
            other = observed("fallback", fallback())
            done.append(other.name)
            now = other if other.questions > now.questions else now
        except Exception:  # noqa: BLE001  whatever it was, the first pass stands
            log.exception("fallback failed")
    out = Outcome(now.rows, now.questions, now.failed, phases=done)
    if rescue and now.failed and not now.rescue_waits:
        try:
            found = rescue(now.failures)
            known = now.rows.where("question IS NOT NULL").select("key")
            fresh = found.where("question IS NOT NULL").dropDuplicates(["key"]).join(known, "key", "left_anti").select(*now.rows.columns)
            saved = observed("rescue", fresh.unionByName(found.where("question IS NULL").select(*now.rows.columns)))
            done.append(saved.name)
            rows = now.rows.where("question IS NOT NULL").unionByName(saved.rows)
            out = Outcome(rows, now.questions + saved.questions, saved.failed, saved.questions, phases=done)
        except Exception:  # noqa: BLE001
            log.exception("rescue failed")
    expected = estimated or detected
    out.audit = expected > 0 and out.questions < expected * AUDIT_BELOW
    return out
