"""Time-chunked replay of view queries: chunk grids, filtered views, idempotent application.

A chunk restricts the rows of the *source* before the view runs, so that no query text is rewritten and nothing depends on
where a predicate would land. Chunks are aligned to the view's buckets, or their results are merged again by
the target's engine. Each chunk is written into a folder of its own name and then entered in a ledger; a chunk that
is in the ledger is not applied again, and what an interrupted attempt left is overwritten.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import is_time_type
from .model import Definition, MaterializedView, Table, canonical_all

# Names taken for time columns when no sort key has one.
TIME_NAMES = ("created_at", "timestamp", "ingested_at", "event_time", "event_at", "occurred_at")
ViewFn = Callable[[DataFrame], DataFrame]


class ReplayError(ValueError):
    """A window, target or column that cannot be replayed."""


@dataclass(frozen=True)
class Limits:
    max_window_hours: float = 720
    min_chunk_minutes: float = 15


@dataclass(frozen=True)
class Chunk:
    id: str
    token: str
    start: dt.datetime
    end: dt.datetime
    force: bool = False  # apply it even if its token is in the ledger


def parse_time(text: str | dt.datetime) -> dt.datetime:
    """UTC; a time without a zone is UTC."""
    t = text if isinstance(text, dt.datetime) else dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return (t if t.tzinfo else t.replace(tzinfo=dt.UTC)).astimezone(dt.UTC)


def parse_target(text: str) -> tuple[str, str]:
    m = re.fullmatch(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)", text.strip())
    if not m:
        raise ReplayError(f"target {text!r}: expected database.table")
    return m[1], m[2]


def time_candidates(table: Table) -> list[tuple[str, str]]:
    """(column, found by) in order of preference: time columns of the sort key, then well-known names."""
    times = [c.name for c in table.columns if is_time_type(c.type)]
    first = [(c, "order_by") for c in times if c in table.order_by]
    return first + [(c, "column_scan") for c in times if c in TIME_NAMES and (c, "order_by") not in first]


def time_column(table: Table | None, flag: str | None = None, default: str | None = None) -> str:
    """Flag, then what the table's plugin settings say, then the default, then the first candidate."""
    declared = (table.plugins.get("backfill") or {}).get("time_column") if table else None
    found = time_candidates(table) if table else []
    column = flag or declared or default or (found[0][0] if found else None)
    if not column:
        raise ReplayError("no time column: name one")
    return column


def view_for(definitions: list[Definition], target: tuple[str, str]) -> MaterializedView | None:
    """The first materialized view, in canonical order, that writes to the target."""
    return next((d for d in canonical_all(definitions) if isinstance(d, MaterializedView) and d.to == target), None)


def source_table(definitions: list[Definition], target: tuple[str, str]) -> Table | None:
    """The table whose rows are replayed: that in the FROM of the target's view, or the target itself."""
    tables = {(d.database, d.name): d for d in definitions if isinstance(d, Table)}
    view = view_for(definitions, target)
    if view is None:
        return tables.get(target)
    m = re.search(r"\bFROM\s+`?(\w+)`?(?:\.`?(\w+)`?)?", view.query, re.I)
    name = (m[1], m[2]) if m and m[2] else (view.database, m[1]) if m else None
    return tables.get(name)


def check_window(start: dt.datetime, end: dt.datetime, chunk: dt.timedelta, limits: Limits = Limits(), force: bool = False) -> None:
    if end <= start:
        raise ReplayError("the window must end after it starts")
    if chunk < dt.timedelta(minutes=limits.min_chunk_minutes):
        raise ReplayError(f"chunks must have at least {limits.min_chunk_minutes:g} minutes")
    if end - start > dt.timedelta(hours=limits.max_window_hours) and not force:
        raise ReplayError(f"the window has more than {limits.max_window_hours:g} hours; force it if that is meant")


def short_hash(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def plan_id(target: tuple[str, str], start: dt.datetime, end: dt.datetime, chunk: dt.timedelta, column: str) -> str:
    return short_hash(".".join(target), start.isoformat(), end.isoformat(), str(int(chunk.total_seconds())), column)


def chunks(plan: str, start: dt.datetime, end: dt.datetime, step: dt.timedelta) -> list[Chunk]:
    """Half-open chunks from start on, the last one cut at the end."""
    out, at = [], start
    while at < end:
        to = min(at + step, end)
        a, b = at.isoformat(), to.isoformat()
        out.append(Chunk(short_hash(plan, a, b), short_hash("token", plan, a, b), at, to))
        at = to
    return out


def chunk_grid(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """(chunk, start, end) of a grid, as timestamps without zone; ``step`` is an interval such as '6 hours'."""
    a, b, width = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}")
    starts = spark.range(1).select(F.posexplode(F.sequence(a, b, width)).alias("chunk", "start")).where(F.col("start") < b)
    return starts.select(F.col("chunk").cast("long").alias("chunk"), "start", F.least(F.col("start") + width, b).alias("end"))


def chunk_identity(grid: DataFrame, plan: str) -> DataFrame:
    """The grid with ids and tokens from its bounds."""
    bounds = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")]
    make = lambda *x: F.substring(F.sha2(F.concat_ws("|", *x), 256), 1, 16)
    return grid.withColumns({"id": make(F.lit(plan), *bounds), "token": make(F.lit("token"), F.lit(plan), *bounds)})


def in_window(df: DataFrame, column: str, start, end) -> DataFrame:
    """Half-open; literals take the column's own type, so that the range reaches the scan."""
    kind = df.schema[column].dataType
    plain = lambda t: t.replace(tzinfo=None).isoformat(sep=" ") if isinstance(t, dt.datetime) else t
    a, b = (F.lit(plain(t)).cast(kind) for t in (start, end))
    return df.where((F.col(column) >= a) & (F.col(column) < b))


def replay(source: DataFrame, view: ViewFn, column: str, start, end, target_columns: Sequence[str] = ()) -> DataFrame:
    """The view over the window's rows, in the target's column order."""
    out = view(in_window(source, column, start, end))
    return out.select(*target_columns) if target_columns else out


def assigned(source: DataFrame, column: str, start: str, step_s: int, name: str = "chunk") -> DataFrame:
    """Each row's chunk number on a grid of equal steps, by arithmetic: all chunks are replayed in one pass."""
    seconds = F.unix_micros(F.col(column).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    return source.withColumn(name, F.floor(seconds / (step_s * 1_000_000)).cast("long"))


def view_function(spark: SparkSession, query: str, source: str) -> ViewFn:
    """A declared view body as a function of its source; other tables come from the catalog."""
    import uuid

    from ..functions.vocabulary import translate_query

    sql = translate_query(query)

    def view(df: DataFrame) -> DataFrame:
        name = f"source_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        return spark.sql(re.sub(rf"\b{re.escape(source)}\b(?!\s*\()", name, sql))

    return view


LEDGER = T.StructType(
    [T.StructField("token", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("applied_at", T.TimestampType()), T.StructField("folder", T.StringType())]
)


class Target:
    """A replayed table: a folder for each applied chunk, and the ledger of applied tokens.

    ``read`` only sees the folders that the ledger names last for their token, so that a chunk that is replayed again is
    exchanged at once, when its new folder is in the ledger. With an engine of merging semantics, pass the result to
    ``operators.merge.final``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _ledger(self) -> DataFrame:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_ledger")
        if not fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/_ledger")

    def entries(self) -> DataFrame:
        """(token, rows, folder, times): what counts for each token, and how often it was applied."""
        last = F.max_by(F.struct("rows", "folder"), "applied_at").alias("last")
        return self._ledger().groupBy("token").agg(last, F.count("*").alias("times")).select("token", "last.rows", F.coalesce("last.folder", F.concat(F.lit("chunk="), "token")).alias("folder"), "times")

    def tokens(self) -> set[str]:
        return {r.token for r in self.entries().select("token").collect()}  # one for each chunk

    def apply(self, token: str, rows: DataFrame, force: bool = False) -> int:
        """Writes a chunk, unless its token is in the ledger and it is not forced; returns the rows that the chunk has."""
        known = self.entries().where(F.col("token") == token).first()
        if known and not force:
            return known.rows
        name = f"chunk={token}" + (f"-{known.times}" if known else "")
        folder = f"{self.path}/{name}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.mode("overwrite").parquet(folder)
        n = self.spark.read.schema(self.schema).parquet(folder).count()
        entry = self.spark.createDataFrame([(token, n, dt.datetime.now(dt.UTC), name)], LEDGER)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/_ledger")
        return n

    def read(self) -> DataFrame:
        paths = sorted(f"{self.path}/{r.folder}" for r in self.entries().select("folder").collect())  # one for each chunk
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)


def self_replay(df: DataFrame, table: Table, column: str, start, end) -> DataFrame:
    """Rows of a table replayed into itself: only where merging makes the second copy go, since an append doubles rows."""
    if not table.engine.removeprefix("Shared").startswith("Replacing"):
        raise ReplayError(f"{table.engine} would keep both copies of a replayed row")
    return in_window(df, column, start, end)
