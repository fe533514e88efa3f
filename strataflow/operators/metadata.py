"""Catalog facts as DataFrames, where a warehouse has many objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_details(tables: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables with their columns by position and their indexes by name, joined by (database, name)."""
    key = ["database", "name"]
    cols = columns.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column", "type"))), lambda x: F.struct(x["column"], x["type"])).alias("columns"))
    idx = indexes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("index", "expression"))).alias("indexes"))
    return tables.join(cols, key, "left").join(idx, key, "left").orderBy(*key)
