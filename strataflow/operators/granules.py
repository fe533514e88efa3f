"""Skip indexes as granule summaries, and pruning by them; projections as companion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = "[^A-Za-z0-9]+"


def with_granule(df: DataFrame, position: str, rows: int, name: str = "granule") -> DataFrame:
    """The granule of each row, from a dense row position."""
    return df.withColumn(name, F.floor(F.col(position) / rows).cast("long"))


def minmax(df: DataFrame, column: str, granule: str = "granule") -> DataFrame:
    return df.groupBy(granule).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))


def value_set(df: DataFrame, column: str | Column, most: int, granule: str = "granule") -> DataFrame:
    """Distinct values of each granule, null where there are more than ``most``: such a granule is always read."""
    values = F.array_sort(F.collect_set(column))
    return df.groupBy(granule).agg(values.alias("v")).select(granule, F.when(F.size("v") <= most, F.col("v")).alias("members"))


def tokens(column: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(column), WORDS), lambda x: x != ""))


def ngrams(column: str, n: int) -> Column:
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def token_sets(df: DataFrame, column: str, granule: str = "granule", n: int | None = None) -> DataFrame:
    """(granule, token), distinct: exact in place of a bloom filter. ``n``: n-grams instead of words."""
    parts = ngrams(column, n) if n else tokens(column)
    return df.select(granule, F.explode(parts).alias("token")).distinct()


def prune_minmax(df: DataFrame, summary: DataFrame, low, high, granule: str = "granule") -> DataFrame:
    """Rows of granules that may hold values in [low, high]. Filter exactly afterwards."""
    return df.join(summary.where((F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high))).select(granule), granule, "left_semi")


def prune_set(df: DataFrame, summary: DataFrame, value, granule: str = "granule") -> DataFrame:
    keep = summary.where(F.col("members").isNull() | F.array_contains("members", value)).select(granule)
    return df.join(keep, granule, "left_semi")


def prune_tokens(df: DataFrame, sets: DataFrame, wanted: list[str], granule: str = "granule") -> DataFrame:
    """Rows of granules that hold every wanted token."""
    need = sorted({w.lower() for w in wanted})
    keep = sets.where(F.col("token").isin(need)).groupBy(granule).agg(F.count("*").alias("n")).where(F.col("n") == len(need)).select(granule)
    return df.join(keep, granule, "left_semi")


def write_with_bloom(df: DataFrame, path: str, columns: dict[str, int], false_positives: float = 0.01, mode: str = "overwrite") -> None:
    """Parquet with bloom filters on ``columns`` (name to expected distinct values); scans use them by themselves."""
    writer = df.write.mode(mode)
    for name, distinct in columns.items():
        base = "parquet.bloom.filter"
        writer = writer.option(f"{base}.enabled#{name}", "true").option(f"{base}.expected.ndv#{name}", distinct).option(f"{base}.fpp#{name}", false_positives)
    writer.parquet(path)


def projection(df: DataFrame, query: str) -> DataFrame:
    """A projection body (a SELECT without FROM) over a table."""
    import re
    import uuid

    from ..functions.vocabulary import translate_query

    view = f"projection_{uuid.uuid4().hex[:12]}"
    df.createOrReplaceTempView(view)
    m = re.search(r"\b(GROUP\s+BY|ORDER\s+BY|WHERE|LIMIT)\b", query, re.I)
    at = m.start() if m else len(query)
    return df.sparkSession.sql(translate_query(f"{query[:at]} FROM {view} {query[at:]}"))
