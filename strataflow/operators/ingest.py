"""Rows against a declared table: valid ones in its types, the others apart with what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import struct_field, value_check
from ..plans.model import Table


def problems(df: DataFrame, table: Table) -> Column:
    """Names of the columns that are missing, null without leave, not convertible, or out of their declared range."""
    wrong = []
    for c in table.columns:
        f = struct_field(c.name, c.type, c.nullable)
        if c.name not in df.columns:
            if not f.nullable and c.default is None:
                wrong.append(F.lit(c.name))
            continue
        given = F.col(f"`{c.name}`")
        value = given.try_cast(f.dataType)
        bad = given.isNotNull() & (value.isNull() | ~F.coalesce(value_check(value, c.type), F.lit(True)))
        if not f.nullable:
            bad = bad | given.isNull()
        wrong.append(F.when(bad, F.lit(c.name)))
    return F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")


def checked(df: DataFrame, table: Table, name: str = "_problems") -> DataFrame:
    return df.withColumn(name, problems(df, table))


def split(df: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """(valid rows in the table's columns and types, other rows as they came with ``_problems``)."""
    from ..plans.ddl import default_value

    marked = checked(df, table)
    columns = []
    for c in table.columns:
        f = struct_field(c.name, c.type, c.nullable)
        value = F.col(f"`{c.name}`") if c.name in df.columns else F.expr(default_value(c.default)) if c.default is not None else F.lit(None)
        columns.append(value.try_cast(f.dataType).alias(c.name))
    return marked.where(F.size("_problems") == 0).select(*columns), marked.where(F.size("_problems") > 0)
