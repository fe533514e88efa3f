"""Definitions as DDL text. Tables, views and alterations render in the declared dialect, which is
what migration files hold; ``spark_create`` renders the Spark counterpart that ``sources.catalog`` applies."""

from __future__ import annotations

from typing import Any

from ..functions.text import normalize_clause, quote_literal
from ..functions.vocabulary import translate_query
from .model import Column, Definition, MaterializedView, Projection, SkipIndex, Table, View


def place(d: Definition) -> str:
    return f"{d.database}.{d.name}"


def default_value(value: str | int | float | bool) -> str:
    """``fn:`` marks an expression; other strings are literals."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value[3:] if value.startswith("fn:") else quote_literal(value)
    return str(value)


def column(c: Column) -> str:
    kind = f"Nullable({c.type})" if c.nullable and not c.type.startswith("Nullable(") else c.type
    out = f"`{c.name}` {kind}"
    if c.default is not None:
        out += f" DEFAULT {default_value(c.default)}"
    if c.comment:
        out += f" COMMENT {quote_literal(c.comment)}"
    return out


def index(i: SkipIndex) -> str:
    args = f"({i.type_args})" if i.type_args is not None else ""
    return f"INDEX `{i.name}` ({i.expression}) TYPE {i.type}{args} GRANULARITY {i.granularity}"


def projection(p: Projection) -> str:
    return f"PROJECTION `{p.name}` ({p.query})"


def _keys(keys: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"`{k}`" if k.isidentifier() else k for k in keys) + ")"


def create(d: Definition) -> str:
    if isinstance(d, View):
        return f"CREATE VIEW IF NOT EXISTS {place(d)} AS\n{d.query};"
    if isinstance(d, MaterializedView):
        return f"CREATE MATERIALIZED VIEW IF NOT EXISTS {place(d)} TO {'.'.join(d.to)} AS\n{d.query};"
    body = [*map(column, d.columns), *map(index, d.indexes), *map(projection, d.projections)]
    lines = [f"CREATE TABLE IF NOT EXISTS {place(d)} (", ",\n".join(f"  {x}" for x in body), f") ENGINE = {d.engine}"]
    if d.partition_by:
        lines.append(f"PARTITION BY {d.partition_by}")
    for word, keys in (("PRIMARY KEY", d.primary_key), ("ORDER BY", d.order_by), ("UNIQUE KEY", d.unique_key)):
        if keys:
            lines.append(f"{word} {_keys(keys)}")
    if d.ttl:
        lines.append(f"TTL {d.ttl}")
    if d.settings:
        lines.append("SETTINGS " + ", ".join(f"{k} = {_setting(v)}" for k, v in d.settings.items()))
    if d.comment:
        lines.append(f"COMMENT {quote_literal(d.comment)}")
    return "\n".join(lines) + ";"


def _setting(value: Any) -> str:
    return default_value(value) if isinstance(value, str) else str(int(value)) if isinstance(value, bool) else str(value)


def drop(d: Definition) -> str:
    return f"DROP {'TABLE' if d.kind != 'view' else 'VIEW'} IF EXISTS {place(d)} SYNC;"


def create_database(name: str) -> str:
    return f"CREATE DATABASE IF NOT EXISTS {name};"


def rename_table(database: str, name: str, new_database: str, new_name: str) -> str:
    return f"RENAME TABLE {database}.{name} TO {new_database}.{new_name};"


def _alter(d: Table, what: str) -> str:
    return f"ALTER TABLE {place(d)} {what};"


def add_column(d: Table, c: Column) -> str:
    return _alter(d, f"ADD COLUMN IF NOT EXISTS {column(c)}")


def modify_column(d: Table, c: Column) -> str:
    return _alter(d, f"MODIFY COLUMN {column(c)}")


def drop_column(d: Table, name: str) -> str:
    return _alter(d, f"DROP COLUMN IF EXISTS `{name}`")


def rename_column(d: Table, source: str, target: str) -> str:
    return _alter(d, f"RENAME COLUMN `{source}` TO `{target}`")


def add_index(d: Table, i: SkipIndex) -> str:
    return _alter(d, f"ADD {index(i).replace('INDEX', 'INDEX IF NOT EXISTS', 1)}")


def drop_index(d: Table, name: str) -> str:
    return _alter(d, f"DROP INDEX IF EXISTS `{name}`")


def add_projection(d: Table, p: Projection) -> str:
    return _alter(d, f"ADD {projection(p).replace('PROJECTION', 'PROJECTION IF NOT EXISTS', 1)}")


def drop_projection(d: Table, name: str) -> str:
    return _alter(d, f"DROP PROJECTION IF EXISTS `{name}`")


def modify_setting(d: Table, name: str, value: Any) -> str:
    return _alter(d, f"MODIFY SETTING {name} = {_setting(value)}")


def reset_setting(d: Table, name: str) -> str:
    return _alter(d, f"RESET SETTING {name}")


def modify_ttl(d: Table) -> str:
    return _alter(d, f"MODIFY TTL {d.ttl}" if d.ttl else "REMOVE TTL")


def properties(d: Table) -> dict[str, str]:
    """What Spark keeps in table properties: all that its Parquet tables have no clause for."""
    import json

    out = {"engine": d.engine, "primary_key": ", ".join(d.primary_key), "order_by": ", ".join(d.order_by), "unique_key": ", ".join(d.unique_key)}
    out |= {"partition_by": d.partition_by or "", "ttl": d.ttl or ""}
    out |= {f"setting.{k}": str(v) for k, v in d.settings.items()}
    out |= {f"index.{i.name}": json.dumps([i.expression, i.type, i.type_args, i.granularity]) for i in d.indexes}
    out |= {f"projection.{p.name}": p.query for p in d.projections}
    out |= {f"column.{c.name}": json.dumps([c.type, c.nullable, c.default]) for c in d.columns}
    return {f"declared.{k}": v for k, v in out.items() if v != ""}


def file_options(d: Table) -> dict[str, str]:
    """Parquet options of the indexes that Spark's scans can use: bloom filters on plain columns, for indexes that answer equality
    (minmax needs none: row groups have it, and rows are sorted by the table's key)."""
    names, out = {c.name for c in d.columns}, {}
    for i in d.indexes:
        column = normalize_clause(i.expression)
        if i.type in ("bloom_filter", "set") and column in names:
            out[f"parquet.bloom.filter.enabled#{column}"] = "true"
            if i.type == "bloom_filter" and i.type_args:
                out[f"parquet.bloom.filter.fpp#{column}"] = i.type_args.strip()
    return dict(sorted(out.items()))


def spark_create(d: Definition) -> str:
    if isinstance(d, (View, MaterializedView)):
        # The catalog entry of a materialized view is a view with its query: streaming.views and plans.replay move the rows.
        held = {"declared.kind": d.kind, "declared.query": d.query}
        if isinstance(d, MaterializedView):
            held["declared.to"] = ".".join(d.to)
        props = ", ".join(f"{quote_literal(k)} = {quote_literal(v)}" for k, v in held.items())
        comment = f" COMMENT {quote_literal(d.comment)}" if d.comment else ""
        return f"CREATE OR REPLACE VIEW {place(d)}{comment} TBLPROPERTIES ({props}) AS {translate_query(d.query)}"
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" + (f" COMMENT {quote_literal(f.metadata['comment'])}" if f.metadata.get("comment") else "") for f in d.spark_schema())
    props = ", ".join(f"{quote_literal(k)} = {quote_literal(v)}" for k, v in properties(d).items())
    comment = f" COMMENT {quote_literal(d.comment)}" if d.comment else ""
    held = ", ".join(f"{quote_literal(k)} = {quote_literal(v)}" for k, v in file_options(d).items())
    options = f" OPTIONS ({held})" if held else ""
    return f"CREATE TABLE IF NOT EXISTS {place(d)} ({cols}) USING parquet{options}{comment} TBLPROPERTIES ({props})"
