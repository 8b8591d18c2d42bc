"""Several tables saved as one: data first, a manifest last, and readers that pin a version.

A save writes each table into a folder of its own, which nothing names yet, and then one small manifest that names them all.
Manifests are numbered; a number is taken by renaming a finished file to it, which fails if another save has taken it.  So a save
that breaks off anywhere leaves the version before it in force, two savers never mix their tables, and a reader
that has pinned a version keeps reading it.  Old versions go by `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 12


class Conflict(RuntimeError):
    """Another save has taken the version."""


@dataclass(frozen=True)
class Version:
    """One version: its number, and the folder and schema of each of its tables."""

    number: int
    folders: dict[str, str]
    schemas: dict[str, str]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(self.schemas[name]).parquet(self.folders[name])


class Versions:
    """The versions below a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifests/{number:0{DIGITS}d}.json"

    def numbers(self) -> list[int]:
        folder = self._place(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int | None = None) -> Version | None:
        """The version of a number, or the last one; None before the first save."""
        if number is None:
            known = self.numbers()
            if not known:
                return None
            number = known[-1]
        stream = self._fs.open(self._place(self._manifest(number)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        kept = json.loads(text)
        return Version(number, kept["folders"], kept["schemas"])

    def save(self, tables: dict[str, DataFrame], after: int | None = None, between: Callable[[str], None] | None = None) -> Version:
        """Saves all tables as the version after `after` (the last one, if not said); tables of that version that are not given stay.

        A saver that has read a version gives its number, so that a save in the meantime is a Conflict instead of a loss.
        `between` is called with each table's name before it is written.
        """
        before = self.read(after) if after else self.read()
        base = before.number if before else 0
        if after is not None and (self.numbers() or [0])[-1] != after:
            raise Conflict(f"version {after} is no longer the last one")
        folders, schemas = (dict(before.folders), dict(before.schemas)) if before else ({}, {})
        for name, df in tables.items():
            if between:
                between(name)
            folder = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(folder)
            folders[name], schemas[name] = folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return self._commit(Version(base + 1, folders, schemas))

    def _commit(self, version: Version) -> Version:
        draft = self._place(f"{self.path}/drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"folders": version.folders, "schemas": version.schemas}), "utf-8"))
        finally:
            out.close()
        self._fs.mkdirs(self._place(f"{self.path}/manifests"))
        target = self._place(self._manifest(version.number))
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version.number} is taken")
        return version

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes manifests but the last `keep`, and data that no kept manifest names; gives the folders removed."""
        known = self.numbers()
        used = {f for n in known[-keep:] for f in self.read(n).folders.values()}
        for n in known[:-keep]:
            self._fs.delete(self._place(self._manifest(n)), False)
        removed = []
        data = self._place(f"{self.path}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(table.getPath()):
                name = f"{self.path}/data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in used:
                    self._fs.delete(folder.getPath(), True)
                    removed.append(name)
        return removed


def save_project(store: Versions, projects: DataFrame, records: DataFrame, after: int | None = None) -> Version:
    """A project list and its records, in one version."""
    return store.save({"projects": projects, "records": records}, after)


def save_health(store: Versions, health: DataFrame) -> Version:
    """Key health, for the next session."""
    return store.save({"health": health})


def restored_health(store: Versions, keys: DataFrame, now: int, relevant_ms: int = 3_600_000) -> DataFrame:
    """Saved health of the keys in use: what is blocked now, or was within `relevant_ms`; blocks that are over are lifted."""
    version = store.read()
    if version is None or "health" not in version.folders:
        return keys.select("key").limit(0)
    kept = version.table(store.spark, "health").join(keys.select("key").distinct(), "key", "left_semi").where(F.col("blocked_until") > now - relevant_ms)
    over = (F.col("status") != "healthy") & (F.col("blocked_until") > 0) & (F.col("blocked_until") <= now)
    return kept.withColumns({"status": F.when(over, "healthy").otherwise(F.col("status")), "blocked_until": F.when(over, F.lit(0).cast("long")).otherwise(F.col("blocked_until"))})
