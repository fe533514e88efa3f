"""Spark's catalog: what is there, and declared changes applied to it.

Parquet tables take added columns and properties as DDL. Type changes, drops and renames of columns are copied: the new
table is written beside the old one, the two are swapped by renames, and a leftover of an
interrupted swap is finished or thrown away by the next call.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import key_columns
from ..functions.types import struct_field
from ..plans import ddl
from ..plans.model import Column, Definition, MaterializedView, Projection, SkipIndex, Table, View

SYSTEM_DATABASES = ("information_schema", "sys", "global_temp")
OBJECTS = T.StructType([T.StructField(n, T.StringType()) for n in ("database", "name", "kind")])
_NEW, _OLD, _PROJECTION = "__next", "__previous", "__projection_"


def run(spark: SparkSession, statement: str) -> None:
    spark.sql(statement.rstrip().rstrip(";"))


def query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def insert(rows: DataFrame, table: str) -> None:
    """Appends by name; columns that the table has and the rows lack are null. Each file is sorted by the table's declared key, so
    that the least and greatest values of its row groups let scans skip them."""
    spark = rows.sparkSession
    target = spark.table(table).schema
    have = set(rows.columns)
    out = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in target))
    _sorted(out, key_columns([_properties(spark, table).get("declared.order_by", "")])).write.insertInto(table)


def _sorted(rows: DataFrame, key: Iterable[str]) -> DataFrame:
    plain = [k for k in key if k in rows.columns]
    return rows.sortWithinPartitions(*plain) if plain else rows


def objects(spark: SparkSession, databases: Iterable[str] | None = None) -> DataFrame:
    """(database, name, kind) of what is not temporary, a system object or half of a swap. A materialized view is a
    view to Spark; its properties say what it is."""
    rows = []
    wanted = set(databases) if databases is not None else None
    for db in spark.catalog.listDatabases():
        if db.name in SYSTEM_DATABASES or (wanted is not None and db.name not in wanted):
            continue
        for t in spark.catalog.listTables(db.name):
            if not t.isTemporary and not t.name.endswith((_NEW, _OLD)) and _PROJECTION not in t.name:
                kind = "table" if t.tableType != "VIEW" else _properties(spark, f"{db.name}.{t.name}").get("declared.kind", "view")
                rows.append((db.name, t.name, kind))
    return spark.createDataFrame(sorted(rows), OBJECTS)


def views(spark: SparkSession, databases: Iterable[str] | None = None) -> DataFrame:
    return objects(spark, databases).where("kind = 'view'")


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    """From the session's catalog: SHOW TBLPROPERTIES hides values that look secret, such as any with "url" in it."""
    return _pairs(_metadata(spark, name).properties())


def _metadata(spark: SparkSession, name: str):
    state = spark._jsparkSession.sessionState()
    return state.catalog().getTableMetadata(state.sqlParser().parseTableIdentifier(name))


def _pairs(scala_map) -> dict[str, str]:
    found, out = scala_map.iterator(), {}
    while found.hasNext():
        pair = found.next()
        out[pair._1()] = pair._2()
    return out


def describe(spark: SparkSession, database: str, name: str) -> Table:
    """A table as a definition: what its properties declare, else what Spark knows."""
    props = {k.removeprefix("declared."): v for k, v in _properties(spark, f"{database}.{name}").items() if k.startswith("declared.")}
    columns = []
    for f in spark.table(f"{database}.{name}").schema:
        declared = json.loads(props[f"column.{f.name}"]) if f"column.{f.name}" in props else [_type_name(f.dataType), False, None]
        columns.append(Column(f.name, declared[0], declared[1], declared[2], f.metadata.get("comment")))
    part = lambda prefix: {k.removeprefix(prefix): v for k, v in sorted(props.items()) if k.startswith(prefix)}
    keys = lambda k: tuple(key_columns([props.get(k, "")]))
    indexes = [SkipIndex(n, *(lambda e, t, a, g: (e, t, int(g), a))(*json.loads(v))) for n, v in part("index.").items()]
    return Table(
        database, name, tuple(columns), props.get("engine", "MergeTree()"), keys("primary_key"), keys("order_by"), keys("unique_key"),
        props.get("partition_by"), props.get("ttl"), part("setting."), tuple(indexes), tuple(Projection(n, q) for n, q in part("projection.").items()),
        spark.catalog.getTable(f"{database}.{name}").description or None,
    )


def _type_name(kind: T.DataType) -> str:
    names = {"string": "String", "bigint": "Int64", "int": "Int32", "smallint": "Int16", "tinyint": "Int8", "double": "Float64", "float": "Float32", "boolean": "Bool", "date": "Date", "timestamp": "DateTime64(6)", "timestamp_ntz": "DateTime64(6)"}
    if isinstance(kind, T.ArrayType):
        return f"Array({_type_name(kind.elementType)})"
    if isinstance(kind, T.MapType):
        return f"Map({_type_name(kind.keyType)}, {_type_name(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return f"Tuple({', '.join(f'{f.name} {_type_name(f.dataType)}' for f in kind)})"
    if isinstance(kind, T.DecimalType):
        return f"Decimal({kind.precision}, {kind.scale})"
    return names.get(kind.simpleString(), "String")


def describe_view(spark: SparkSession, database: str, name: str) -> View | MaterializedView:
    """A view as a definition: the query that was declared, else Spark's text of it."""
    rows = {x.col_name: x.data_type for x in spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{name}").collect()}
    props = _properties(spark, f"{database}.{name}")
    text, comment = props.get("declared.query", rows.get("View Text", "")), rows.get("Comment") or None
    if props.get("declared.kind") == "materialized_view":
        return MaterializedView(database, name, text, tuple(props["declared.to"].split(".")), comment)
    return View(database, name, text, comment)


def describe_all(spark: SparkSession, databases: Iterable[str] | None = None) -> list[Definition]:
    """Tables and views as definitions, by name."""
    out: list[Definition] = []
    for r in objects(spark, databases).collect():  # one short row for each object
        out.append(describe(spark, r.database, r.name) if r.kind == "table" else describe_view(spark, r.database, r.name))
    return out


def create(spark: SparkSession, d: Definition) -> None:
    run(spark, ddl.create_database(d.database))
    run(spark, ddl.spark_create(d))
    if isinstance(d, Table):
        refresh_projections(spark, d)


def _companions(spark: SparkSession, database: str, name: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables(database, f"{name}{_PROJECTION}*")]


def _drop_companions(spark: SparkSession, database: str, name: str) -> None:
    for companion in _companions(spark, database, name):
        run(spark, f"DROP TABLE IF EXISTS {database}.{companion}")


def refresh_projections(spark: SparkSession, d: Table) -> list[str]:
    """Writes the table of each declared projection anew and drops those of other ones; their names, by which a query reads one.

    They hold what the table held at the last refresh: after rows were added, refresh again.
    """
    from ..operators.granules import projection

    want = {f"{d.name}{_PROJECTION}{p.name}".lower(): p for p in d.projections}
    for name in _companions(spark, d.database, d.name):
        if name not in want:
            run(spark, f"DROP TABLE IF EXISTS {d.database}.{name}")
    for name, p in want.items():
        projection(spark.table(f"{d.database}.{d.name}"), p.query).write.mode("overwrite").saveAsTable(f"{d.database}.{name}")
    return [f"{d.database}.{name}" for name in want]


def expire(spark: SparkSession, database: str, name: str, now: SparkColumn | None = None) -> int:
    """Removes rows whose declared TTL has passed, by copy and swap; returns how many went."""
    from ..operators.merge import retained

    d = describe(spark, database, name)
    if not d.ttl:
        return 0
    table = spark.table(f"{database}.{name}")
    before, left = table.count(), retained(table, d.ttl, F.current_timestamp() if now is None else now)
    if left.count() < before:
        _exchange(spark, d, left)
    return before - spark.table(f"{database}.{name}").count()


def drop(spark: SparkSession, d: Definition) -> None:
    drop_named(spark, d.database, d.name, isinstance(d, Table))


def drop_named(spark: SparkSession, database: str, name: str, table: bool) -> None:
    """A table with the tables of its projections, or a view."""
    if table and spark.catalog.databaseExists(database):
        _drop_companions(spark, database, name)
    run(spark, f"DROP {'TABLE' if table else 'VIEW'} IF EXISTS {database}.{name}")


def set_properties(spark: SparkSession, d: Table) -> None:
    """The declared properties of a definition, and none of an earlier one. Index options hold for files that are written from now on."""
    name = f"{d.database}.{d.name}"
    want = ddl.properties(d)
    gone = [k for k in _properties(spark, name) if k.startswith("declared.") and k not in want]
    if gone:
        keys = ", ".join(ddl.quote_literal(k) for k in gone)
        run(spark, f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ({keys})")
    pairs = lambda m: ", ".join(f"{ddl.quote_literal(k)} = {ddl.quote_literal(v)}" for k, v in m.items())
    run(spark, f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs(want)})")
    options = ddl.file_options(d)
    off = {k: "false" for k, v in _pairs(_metadata(spark, name).storage().properties()).items() if k.startswith("parquet.bloom.filter.enabled#") and v == "true" and k not in options}
    if off or options:
        run(spark, f"ALTER TABLE {name} SET SERDEPROPERTIES ({pairs({**off, **options})})")


def recover(spark: SparkSession, database: str, name: str) -> None:
    """Finishes or undoes an interrupted swap: with the table gone, the old one comes back; otherwise leftovers go."""
    has = lambda n: spark.catalog.tableExists(f"{database}.{n}")
    if not has(name) and has(name + _OLD):
        run(spark, f"ALTER TABLE {database}.{name}{_OLD} RENAME TO {database}.{name}")
    for end in (_NEW, _OLD):
        run(spark, f"DROP TABLE IF EXISTS {database}.{name}{end}")


def rewrite(spark: SparkSession, d: Table, renames: dict[str, str] | None = None) -> None:
    """Copy and swap: the table gets the columns of the definition; ``renames`` maps old column names to new ones.

    New columns take their default, or null. Values that don't fit a changed type fail the copy, before any swap.
    """
    recover(spark, d.database, d.name)
    old = spark.table(f"{d.database}.{d.name}")
    source = {new: prev for prev, new in (renames or {}).items()}
    columns = []
    for c in d.columns:
        f = struct_field(c.name, c.type, c.nullable)
        given = source.get(c.name, c.name)
        if given in old.columns:
            value = F.col(f"`{given}`")
        else:
            value = F.expr(ddl.default_value(c.default)) if c.default is not None else F.lit(None)
        columns.append(value.cast(f.dataType).alias(c.name))
    _exchange(spark, d, old.select(*columns))


def _exchange(spark: SparkSession, d: Table, rows: DataFrame) -> None:
    """Rows written into a new table of the definition, which then takes the old one's place."""
    fresh = replace(d, name=d.name + _NEW, projections=())
    recover(spark, d.database, d.name)
    create(spark, fresh)
    _sorted(rows, d.order_by).write.insertInto(f"{d.database}.{fresh.name}")
    run(spark, f"ALTER TABLE {d.database}.{d.name} RENAME TO {d.database}.{d.name}{_OLD}")
    run(spark, f"ALTER TABLE {d.database}.{fresh.name} RENAME TO {d.database}.{d.name}")
    run(spark, f"DROP TABLE IF EXISTS {d.database}.{d.name}{_OLD}")
    set_properties(spark, d)
    refresh_projections(spark, d)


def alter(spark: SparkSession, old: Table, new: Table, renames: dict[str, str] | None = None) -> str:
    """Brings a table to a new definition; says how: properties, columns (added in place) or rewrite."""
    before = {c.name: c for c in old.columns}
    added = [c for c in new.columns if c.name not in before]
    kept = [c for c in new.columns if c.name in before]
    same = all(struct_field(c.name, c.type).dataType == struct_field(c.name, before[c.name].type).dataType for c in kept)
    in_place = same and len(kept) == len(old.columns) and not renames and all(c.default is None for c in added)
    in_place = in_place and list(new.columns[: len(kept)]) == kept
    if not in_place:
        rewrite(spark, new, renames)
        return "rewrite"
    if added:
        cols = ", ".join(f"`{c.name}` {struct_field(c.name, c.type).dataType.simpleString()}" for c in added)
        run(spark, f"ALTER TABLE {new.database}.{new.name} ADD COLUMNS ({cols})")
    set_properties(spark, new)
    if new.projections != old.projections:
        refresh_projections(spark, new)
    return "columns" if added else "properties"


def rename_table(spark: SparkSession, old: tuple[str, str], new: tuple[str, str]) -> None:
    """In one database a rename; across databases a copy, then a drop."""
    if old[0] == new[0]:
        d = replace(describe(spark, *old), name=new[1])
        run(spark, f"ALTER TABLE {'.'.join(old)} RENAME TO {'.'.join(new)}")
        _drop_companions(spark, *old)
        refresh_projections(spark, d)
        return
    d = describe(spark, *old)
    moved = replace(d, database=new[0], name=new[1])
    create(spark, moved)
    spark.table(".".join(old)).write.insertInto(".".join(new))
    set_properties(spark, moved)
    refresh_projections(spark, moved)
    run(spark, f"DROP TABLE {'.'.join(old)}")
    _drop_companions(spark, *old)
