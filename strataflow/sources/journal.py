"""The migration journal: an append-only Parquet table of what was applied, and what follows from it."""

from __future__ import annotations

import datetime as dt
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.plugins import Finding
from . import files

SCHEMA = T.StructType(
    [T.StructField("name", T.StringType(), False), T.StructField("applied_at", T.TimestampType()), T.StructField("checksum", T.StringType()), T.StructField("version", T.StringType())]
)
ATTEMPTS, WAIT_S = 5, 0.15


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path if "://" in path else os.path.abspath(path)

    def read(self) -> DataFrame:
        """One row for each migration, the earliest if a retry wrote it twice, by name."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.groupBy("name").agg(F.min_by(F.struct("applied_at", "checksum", "version"), "applied_at").alias("r")).select("name", "r.*").orderBy("name")

    def append(self, name: str, checksum: str, version: str, now: dt.datetime | None = None) -> None:
        """Retried with a linear wait; reading tolerates a row that was written twice."""
        row = self.spark.createDataFrame([(name, now or dt.datetime.now(dt.UTC), checksum, version)], SCHEMA)
        for attempt in range(1, ATTEMPTS + 1):
            try:
                row.coalesce(1).write.mode("append").parquet(self.path)
                return
            except Exception:
                if attempt == ATTEMPTS:
                    raise
                time.sleep(WAIT_S * attempt)


def pending(migrations: DataFrame, journal: DataFrame) -> DataFrame:
    """Migrations not applied yet."""
    return migrations.join(journal.select("name"), "name", "left_anti")


def mismatches(migrations: DataFrame, journal: DataFrame) -> DataFrame:
    """Applied migrations whose file differs from what was applied; missing files and empty checksums don't count."""
    applied = journal.select("name", F.col("checksum").alias("applied")).where("applied is not null and applied != ''")
    return migrations.join(applied, "name").where("checksum != applied").select("name", F.col("applied").alias("expected"), F.col("checksum").alias("actual"))


@dataclass(frozen=True)
class Status:
    total: int
    applied: int
    pending: int
    mismatches: int


def status(migrations: DataFrame, journal: DataFrame) -> Status:
    total, waiting = migrations.count(), pending(migrations, journal).count()
    return Status(total, total - waiting, waiting, mismatches(migrations, journal).count())


class ChecksumMismatch(RuntimeError):
    """An applied migration's file has changed."""


class DestructiveBlocked(RuntimeError):
    """A dangerous operation without permission; ``warnings`` says which."""

    def __init__(self, warnings: list[files.Warning_]):
        super().__init__(", ".join(f"{w.migration}: {w.code} {w.key}" for w in warnings))
        self.warnings = warnings


def apply_migrations(
    journal: Journal,
    contents: dict[str, str],
    execute: Callable[[str], None],
    allow_destructive: bool = False,
    before: Callable[[str, list[str]], list[str]] | None = None,
    after: Callable[[str, list[str]], None] | None = None,
    version: str = "1",
    only: set[str] | None = None,
) -> list[str]:
    """Applies what is pending, in order of name, each journaled after its last statement. Not transactional: a
    failure inside a file leaves the statements before it applied, and the file pending."""
    done = {r.name: r.checksum for r in journal.read().collect()}  # one short row for each migration
    changed = [n for n, c in done.items() if c and n in contents and files.checksum(contents[n]) != c]
    if changed:
        raise ChecksumMismatch(", ".join(sorted(changed)))
    waiting = [n for n in sorted(contents) if n not in done and (only is None or n in only)]
    warnings = [w for n in waiting for w in files.destructive(n, contents[n])]
    if warnings and not allow_destructive:
        raise DestructiveBlocked(warnings)
    for name in waiting:
        todo = files.statements(contents[name])
        todo = before(name, todo) if before else todo
        for statement in todo:
            execute(statement)
        journal.append(name, files.checksum(contents[name]), version)
        if after:
            after(name, todo)
    return waiting


CHECKS = {"pending": "pending_migrations", "checksum": "checksum_mismatch", "drift": "schema_drift"}  # fixed values: the codes


def check_findings(state: Status, drifted: bool | None, plugins: dict[str, list[Finding]], strict: bool, fail_on: tuple[str, ...] = tuple(CHECKS)) -> list[str]:
    """Codes of failed checks. ``strict`` fails on all that was found; drift is None where there is no snapshot to compare
    with; of a plugin's findings only errors fail."""
    found = {"pending": state.pending > 0, "checksum": state.mismatches > 0, "drift": bool(drifted)}
    out = [CHECKS[k] for k, bad in found.items() if bad and (strict or k in fail_on)]
    return out + [f"plugin:{name}" for name, fs in plugins.items() if any(f.severity == "error" for f in fs)]
