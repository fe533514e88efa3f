"""What a merged read of each table engine returns, as DataFrame functions.

Rows of one sort key are put together by the engine's rule. Every rule is an aggregation with map-side partial
results, except the last-version one, whose candidates are compared as whole rows so that columns of
different rows never mix.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import key_columns, normalize_engine
from ..functions.vocabulary import translate_expression
from ..plans.model import Table

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.first, "anyLast": F.last, "groupBitOr": F.bit_or, "groupBitAnd": F.bit_and, "groupBitXor": F.bit_xor}


def replacing(df: DataFrame, key: Sequence[str], version: str | None = None, arrival: Sequence[str] = ()) -> DataFrame:
    """The last row of each key: highest version, then latest arrival. Give ``arrival`` a total order for a fixed result.

    Whole rows are compared in one aggregate, so that a key's rows are reduced before the shuffle; types that have no
    order (maps, variants) fall back to a window.
    """
    order = [c for c in (version, *arrival) if c]
    rest = [c for c in df.columns if c not in key and c not in order]
    plain = all(not isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema)
    if order and plain:
        last = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
        return last.select(*(F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in df.columns))
    w = Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in order or key))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summing(df: DataFrame, key: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Sums per key, by default of all numeric columns off the key; rows whose sums are all zero go."""
    sums = list(columns) or [f.name for f in df.schema if f.name not in key and isinstance(f.dataType, _NUMERIC)]
    other = [F.first(c, ignorenulls=True).alias(c) for c in df.columns if c not in key and c not in sums]
    out = df.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums), *other)
    if sums:
        nonzero = F.lit(False)
        for c in sums:
            nonzero = nonzero | (F.coalesce(F.col(c), F.lit(0)) != 0)
        out = out.where(nonzero)
    return out.select(*df.columns)


def aggregating(df: DataFrame, key: Sequence[str], functions: dict[str, str]) -> DataFrame:
    """Each column by its declared function; columns without one take any value."""
    aggs = []
    for c in df.columns:
        if c in key:
            continue
        f = functions.get(c, "any")
        if f not in _AGGREGATES:
            raise ValueError(f"no merge for aggregate function {f!r}")
        aggs.append(_AGGREGATES[f](c).alias(c))
    return df.groupBy(*key).agg(*aggs).select(*df.columns)


def collapsing(df: DataFrame, key: Sequence[str], sign: str, arrival: Sequence[str] = ()) -> DataFrame:
    """Rows whose signs don't cancel: the last positive one of each key with a positive sum."""
    rest = [c for c in df.columns if c not in key and c != sign]
    row = F.struct(*arrival, *(c for c in rest if c not in arrival))
    out = df.groupBy(*key).agg(F.sum(sign).alias("_sum"), F.max(F.when(F.col(sign) > 0, row)).alias("_row")).where("_sum > 0 and _row is not null")
    kind = df.schema[sign].dataType
    return out.select(*(F.col(c) if c in key else F.lit(1).cast(kind).alias(c) if c == sign else F.col(f"_row.{c}").alias(c) for c in df.columns))


def versioned_collapsing(df: DataFrame, key: Sequence[str], sign: str, version: str, arrival: Sequence[str] = ()) -> DataFrame:
    """As collapsing, with pairs matched by key and version."""
    return collapsing(df, [*key, version], sign, arrival)


def collapsed_sums(df: DataFrame, key: Sequence[str], sign: str, values: Sequence[str]) -> DataFrame:
    """Aggregates over a collapsing table without collapsing it first: sum(sign * x) where the signs' sum is positive."""
    return df.groupBy(*key).agg(F.sum(sign).alias("n"), *(F.sum(F.col(sign) * F.col(v)).alias(v) for v in values)).where("n > 0")


def final(df: DataFrame, table: Table, arrival: Sequence[str] = ()) -> DataFrame:
    """The merged read that a table's engine asks for."""
    m = re.fullmatch(r"(\w+)\((.*)\)", normalize_engine(table.engine), re.S)
    name, args = m[1], key_columns([m[2].strip("()")]) if m[2].strip() else []
    key = list(table.order_by or table.primary_key)
    if name == "MergeTree":
        return df
    if name == "ReplacingMergeTree":
        return replacing(df, key, args[0] if args else None, arrival)
    if name == "SummingMergeTree":
        return summing(df, key, args)
    if name == "AggregatingMergeTree":
        functions = {c.name: f.metadata["agg"] for c, f in zip(table.columns, table.spark_schema(), strict=True) if "agg" in f.metadata}
        return aggregating(df, key, functions)
    if name == "CollapsingMergeTree":
        return collapsing(df, key, args[0], arrival)
    if name == "VersionedCollapsingMergeTree":
        return versioned_collapsing(df, key, args[0], args[1], arrival)
    raise ValueError(f"engine {table.engine!r} has no merged read")


def retained(df: DataFrame, ttl: str, now: Column) -> DataFrame:
    """Rows whose TTL expression is after ``now``. A row without an expiry stays."""
    expiry = F.expr(translate_expression(re.sub(r"\s+DELETE\s*$", "", ttl, flags=re.I)))
    return df.where(expiry.isNull() | (expiry > now))


def partition_columns(partition_by: str) -> dict[str, Column]:
    """Derived partition columns of a partition expression; a tuple gives one for each part."""
    inner = re.fullmatch(r"\s*tuple\((.*)\)\s*|\s*\((.*)\)\s*", partition_by, re.S)
    parts = key_columns([next(g for g in inner.groups() if g is not None)]) if inner else [partition_by]
    return {p if p.isidentifier() else f"p{i}": F.expr(translate_expression(p)) for i, p in enumerate(parts)}


def write_partitioned(df: DataFrame, path: str, table: Table, mode: str = "append") -> None:
    """Partition folders by the derived columns, rows sorted by the sort key inside each file."""
    columns = partition_columns(table.partition_by) if table.partition_by else {}
    out = df.withColumns({f"_{k}" if k not in df.columns else k: v for k, v in columns.items()})
    names = [f"_{k}" if k not in df.columns else k for k in columns]
    keys = [k for k in table.order_by if k in df.columns]
    out = out.sortWithinPartitions(*names, *keys) if names or keys else out
    writer = out.write.mode(mode)
    (writer.partitionBy(*names) if names else writer).parquet(path)


def month_range(column: str, partition: str, start: str, end: str) -> Column:
    """A half-open range of ``column`` with the predicate on its month partition that prunes folders."""
    months = lambda t: F.year(t) * 100 + F.month(t)
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return (F.col(column) >= a) & (F.col(column) < b) & F.col(partition).between(months(a), months(b))


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
