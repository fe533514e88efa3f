"""Queries that run the engine's own functions on declared objects, files and state, each with the SQL of what must come out.

Inputs are small and literal, as metadata is; where rows of the test tables are involved they are read whole.
"""

from __future__ import annotations

import datetime as dt
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, types
from ..operators import merge
from ..streaming.views import maintain
from . import codegen, ddl, drift, model, parser, planner, plugins, renames, replay, runstate, scope
from .model import Column, MaterializedView, Projection, SkipIndex, Table, View

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def values(columns: str, *rows: tuple) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT {columns} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"


def _rows(spark: SparkSession, schema: str, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _fails(f, *args, **kw) -> bool:
    try:
        f(*args, **kw)
    except (ValueError, RuntimeError, FileNotFoundError):
        return True
    return False


@contextmanager
def _folder():
    """A folder of the driver's own, for schema files and run states."""
    path = tempfile.mkdtemp(prefix="strataflow-")
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that executors see too: below ``spark.checkpoint.dir``, or in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# --- definitions ---------------------------------------------------------------------------------------------------------

_ENGINES = ["SharedMergeTree", " ReplacingMergeTree(v) ", "SharedReplacingMergeTree(ts)", "Sharedx", "Log"]


@query(f"SELECT e AS engine, CASE WHEN contains(n, '(') THEN n ELSE n || '()' END AS normal FROM (SELECT e, CASE WHEN regexp_matches(trim(e), '^Shared[A-Z]') THEN substr(trim(e), 7) ELSE trim(e) END AS n FROM (SELECT unnest({_ENGINES}) AS e))")
def normal_engines(spark, d):
    return _rows(spark, "engine string, normal string", [(e, text.normalize_engine(e)) for e in _ENGINES])


@query(values("part, seq, value", ("a, f(b, c), 'x,y'", 1, "a"), ("a, f(b, c), 'x,y'", 2, "f(b, c)"), ("a, f(b, c), 'x,y'", 3, "'x,y'"), (" , k ,, `p,q`", 1, "k"), (" , k ,, `p,q`", 2, "`p,q`")))
def top_level_parts(spark, d):
    return _rows(spark, "part string, seq int, value string", [(p, i, v) for p in ("a, f(b, c), 'x,y'", " , k ,, `p,q`") for i, v in enumerate(text.split_top_level(p), 1)])


_MESSY = [
    View("b", "v", "SELECT 1"),
    View(" b ", "v", "SELECT   'a  b'\n FROM t "),
    MaterializedView("a", "m", " SELECT 1 ", (" a ", "t")),
    Table(" a", "t ", (Column(" id ", " UInt64 "),), "SharedMergeTree", ("id, at",), ("id", "at"), settings={"b": 1, "a": 2}, ttl="x +  INTERVAL 1 DAY", indexes=(SkipIndex("z", "a", "set"), SkipIndex("b", "lower( x )", "minmax"))),
]


@query(values("seq, key, facts", (1, "table:a.t", "id UInt64|MergeTree()|id,at|a,b|x + INTERVAL 1 DAY|b,z"), (2, "view:b.v", "SELECT 'a  b' FROM t"), (3, "materialized_view:a.m", "SELECT 1")))
def canonical_definitions(spark, d):
    def facts(x):
        if not isinstance(x, Table):
            return x.query
        return "|".join((f"{x.columns[0].name} {x.columns[0].type}", x.engine, ",".join(x.primary_key), ",".join(x.settings), x.ttl, ",".join(i.name for i in x.indexes)))

    return _rows(spark, "seq int, key string, facts string", [(i, model.key_of(x), facts(x)) for i, x in enumerate(model.canonical_all(_MESSY), 1)])


_BAD = [
    Table("t", "a", (Column("id", "UInt64"), Column("x", "Date"), Column("x", "Date")), primary_key=("id",), order_by=("id, nope",)),
    Table("t", "b", (Column("id", "UInt64"),), primary_key=("x",), indexes=(SkipIndex("i", "id", "set"), SkipIndex("i", "id", "set")), projections=(Projection("p", "SELECT 1"), Projection("p", "SELECT 2"))),
    View("t", "v", "SELECT 1"),
    View("t", "v", "SELECT 1"),
]


@query("""
WITH c AS (SELECT * FROM (VALUES ('t.a', 'id', 1), ('t.a', 'x', 2), ('t.a', 'x', 3), ('t.b', 'id', 1)) AS t(object, name, pos)),
n AS (SELECT * FROM (VALUES ('t.b', 'duplicate_index_name', 'i', 1), ('t.b', 'duplicate_index_name', 'i', 2), ('t.b', 'duplicate_projection_name', 'p', 1), ('t.b', 'duplicate_projection_name', 'p', 2), ('t.v', 'duplicate_object_name', 'v', 1), ('t.v', 'duplicate_object_name', 'v', 2)) AS t(object, code, name, pos)),
k AS (SELECT * FROM (VALUES ('t.a', 'primary_key_missing_column', 'id'), ('t.a', 'order_by_missing_column', 'id'), ('t.a', 'order_by_missing_column', 'nope'), ('t.b', 'primary_key_missing_column', 'x')) AS t(object, code, name))
SELECT 'duplicate_column_name' AS code, object FROM c QUALIFY row_number() OVER (PARTITION BY object, name ORDER BY pos) > 1
UNION ALL SELECT code, object FROM n QUALIFY row_number() OVER (PARTITION BY object, code, name ORDER BY pos) > 1
UNION ALL SELECT code, object FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.object = k.object AND c.name = k.name)
""")
def validation_issues(spark, d):
    return _rows(spark, "code string, object string", [(i.code, f"{i.database}.{i.name}") for i in model.validate(_BAD)])


@query(values("name, valid", ("bad", False), ("good", True)))
def definitions_asserted(spark, d):
    return _rows(spark, "name string, valid boolean", [("bad", not _fails(model.assert_valid, _BAD)), ("good", not _fails(model.assert_valid, _MESSY[2:3]))])


# --- diffs and plans -----------------------------------------------------------------------------------------------------

_T = Table("app", "e", (Column("id", "UInt64"),), order_by=("id",))


def _table(columns, **more) -> Table:
    return replace(_T, columns=tuple(Column(*c) for c in columns), order_by=(), **more)


_OLD_COLS = (("id", "UInt64", False), ("email", "String", False), ("age", "UInt8", True), ("gone", "Date", False))
_NEW_COLS = (("id", "UInt64", False), ("email", "String", True), ("age", "UInt16", True), ("city", "String", False))


@query(f"""
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'add' WHEN b.name IS NULL THEN 'drop' ELSE 'modify' END AS op,
 CASE WHEN a.name IS NULL THEN 'safe' WHEN b.name IS NULL THEN 'danger' ELSE 'caution' END AS risk
FROM (VALUES {", ".join(map(str, _OLD_COLS))}) AS a(name, type, nullable) FULL JOIN (VALUES {", ".join(map(str, _NEW_COLS))}) AS b(name, type, nullable) ON a.name = b.name
WHERE a.name IS NULL OR b.name IS NULL OR a.type <> b.type OR a.nullable <> b.nullable
""")
def columns_diff(spark, d):
    ops = planner.diff_tables(_table(_OLD_COLS), _table(_NEW_COLS)).operations
    return _rows(spark, "name string, op string, risk string", [(o.key.rsplit(":", 1)[1], o.type.split("_")[2], o.risk) for o in ops])


@query("""
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'reset' ELSE 'modify' END AS op, b.value AS value
FROM (VALUES ('a', '1'), ('b', '2'), ('c', '3')) AS a(name, value) FULL JOIN (VALUES ('b', '2'), ('c', '4'), ('d', '5')) AS b(name, value) ON a.name = b.name
WHERE a.value IS DISTINCT FROM b.value
""")
def settings_diff(spark, d):
    return _rows(spark, "op string, name string, value string", planner.diff_settings({"a": "1", "b": "2", "c": "3"}, {"b": "2", "c": "4", "d": "5"}))


@query("""
SELECT coalesce(a.n, b.n) AS name, CASE WHEN a.n IS NULL THEN 'add' WHEN b.n IS NULL THEN 'drop' ELSE 'change' END AS op
FROM (VALUES ('i', 'x'), ('j', 'y'), ('k', 'z')) AS a(n, e) FULL JOIN (VALUES ('j', 'y'), ('k', 'w'), ('l', 'v')) AS b(n, e) ON a.n = b.n WHERE a.e IS DISTINCT FROM b.e
""")
def named_diff(spark, d):
    make = lambda *xs: [SkipIndex(n, e, "set") for n, e in xs]
    more, gone, other = planner.diff_named(make(("i", "x"), ("j", "y"), ("k", "z")), make(("j", "y"), ("k", "w"), ("l", "v")), lambda a, b: a == b)
    return _rows(spark, "name string, op string", [*((x.name, "add") for x in more), *((x.name, "drop") for x in gone), *((b.name, "change") for _, b in other)])


@query("""
WITH o AS (SELECT * FROM (VALUES ('email', 'String', 1), ('mail', 'String', 2), ('age', 'UInt8', 3), ('x', 'Date', 4)) AS t(name, sig, pos)),
n AS (SELECT * FROM (VALUES ('address', 'String'), ('years', 'UInt8'), ('y', 'Date'), ('z', 'Date')) AS t(name, sig)),
u AS (SELECT sig, min(name) AS target FROM n GROUP BY 1 HAVING count(*) = 1)
SELECT o.name AS source, u.target FROM o JOIN u USING (sig) QUALIFY row_number() OVER (PARTITION BY sig ORDER BY pos) = 1
""")
def rename_suggestions(spark, d):
    old = [(n, t) for n, t in (("email", "String"), ("mail", "String"), ("age", "UInt8"), ("x", "Date"))]
    new = [(n, t) for n, t in (("address", "String"), ("years", "UInt8"), ("y", "Date"), ("z", "Date"))]
    return _rows(spark, "source string, target string", [(s.source, s.target) for s in planner.diff_tables(_table(old), _table(new)).suggestions])


@query(values("facet, recreate", ("engine", True), ("primary_key", True), ("order_by", True), ("partition_by", True), ("unique_key", True), ("ttl", False), ("settings", False), ("columns", False), ("comment", False)))
def recreate_rules(spark, d):
    changes = {"engine": "Log()", "primary_key": ("a",), "order_by": ("a",), "partition_by": "a", "unique_key": ("a",), "ttl": "a", "settings": {"a": 1}, "columns": (), "comment": "a"}
    return _rows(spark, "facet string, recreate boolean", [(k, planner.needs_recreate(_T, replace(_T, **{k: v}))) for k, v in changes.items()])


_PLAN_OLD = [
    replace(_T, columns=(Column("id", "UInt64"), Column("a", "String"), Column("gone", "Date")), ttl="at + INTERVAL 1 DAY", settings={"s": 1, "r": 2}, indexes=(SkipIndex("i", "a", "set"), SkipIndex("j", "a", "set")), projections=(Projection("p", "SELECT id"),)),
    Table("app", "old", (Column("id", "UInt64"),)),
    Table("app", "key", (Column("id", "UInt64"),), order_by=()),
    View("app", "v", "SELECT 1"),
    MaterializedView("app", "m", "SELECT 1", ("app", "e")),
    View("app", "same", "SELECT  1"),
]
_PLAN_NEW = [
    replace(_T, columns=(Column("id", "UInt64"), Column("a", "String", True), Column("b", "Int8")), settings={"s": 3, "t": 4}, indexes=(SkipIndex("i", "b", "set"), SkipIndex("k", "a", "minmax")), projections=(Projection("q", "SELECT a"),)),
    Table("app", "key", (Column("id", "UInt64"),), order_by=("id",)),
    Table("log", "new", (Column("id", "UInt64"),)),
    View("app", "v", "SELECT 2"),
    MaterializedView("app", "m", "SELECT 1", ("app", "key")),
    View("app", "same", "SELECT 1"),
]
_PLANNED = (
    ("drop_materialized_view", "materialized_view:app.m", "caution"), ("drop_table", "table:app.key", "danger"), ("drop_table", "table:app.old", "danger"), ("drop_view", "view:app.v", "caution"),
    ("alter_table_drop_index", "table:app.e:index:i", "caution"), ("alter_table_drop_index", "table:app.e:index:j", "caution"), ("alter_table_drop_projection", "table:app.e:projection:p", "caution"),
    ("alter_table_modify_column", "table:app.e:column:a", "caution"), ("alter_table_add_column", "table:app.e:column:b", "safe"), ("alter_table_add_index", "table:app.e:index:i", "caution"),
    ("alter_table_add_index", "table:app.e:index:k", "caution"), ("alter_table_add_projection", "table:app.e:projection:q", "caution"), ("alter_table_reset_setting", "table:app.e:setting:r", "caution"),
    ("alter_table_modify_setting", "table:app.e:setting:s", "caution"), ("alter_table_modify_setting", "table:app.e:setting:t", "caution"), ("alter_table_modify_ttl", "table:app.e:ttl", "caution"),
    ("alter_table_drop_column", "table:app.e:column:gone", "danger"), ("create_database", "database:app", "safe"), ("create_database", "database:log", "safe"), ("create_table", "table:app.key", "safe"),
    ("create_table", "table:log.new", "safe"), ("create_view", "view:app.v", "caution"), ("create_materialized_view", "materialized_view:app.m", "caution"),
)


@query(values("seq, type, key, risk", *((i, *o) for i, o in enumerate(_PLANNED, 1))))
def planned_changes(spark, d):
    return _rows(spark, "seq int, type string, key string, risk string", [(i, o.type, o.key, o.risk) for i, o in enumerate(planner.plan_changes(_PLAN_OLD, _PLAN_NEW).operations, 1)])


@query(f"SELECT r.risk, CAST(count(t.key) AS BIGINT) AS n FROM (VALUES ('safe'), ('caution'), ('danger')) AS r(risk) LEFT JOIN ({values('type, key, risk', *_PLANNED)}) t ON t.risk = r.risk GROUP BY 1")
def plan_risk_summary(spark, d):
    return _rows(spark, "risk string, n long", planner.plan_changes(_PLAN_OLD, _PLAN_NEW).risks.items())


_OPS = (
    ("create_table", "table:app.b", "safe"), ("alter_table_add_column", "table:app.a:column:x", "safe"), ("drop_view", "view:app.v", "danger"), ("create_view", "view:app.w", "safe"),
    ("create_database", "database:app", "safe"), ("create_materialized_view", "materialized_view:app.m", "caution"), ("alter_table_modify_ttl", "table:app.a:ttl", "caution"),
    ("create_table", "table:log.events_raw", "safe"), ("create_database", "database:log", "safe"), ("drop_table", "table:log.events_old", "danger"),
)
_OPS_SQL = "(VALUES " + ", ".join(map(str, _OPS)) + ") AS t(type, key, risk)"


def _operations():
    return [planner.Operation(*o, "") for o in _OPS]


@query(f"""
SELECT type, key, risk, CAST(row_number() OVER (ORDER BY CASE WHEN type LIKE 'drop%' THEN 0 WHEN type LIKE 'alter%' THEN 1 WHEN type = 'create_database' THEN 2
 WHEN type = 'create_table' THEN 3 WHEN type = 'create_view' THEN 4 ELSE 5 END, key, type) AS BIGINT) AS seq FROM {_OPS_SQL}
""")
def plan_ordered(spark, d):
    return _rows(spark, "type string, key string, risk string, seq long", [(o.type, o.key, o.risk, i) for i, o in enumerate(planner.ordered(_operations()), 1)])


# --- renames -------------------------------------------------------------------------------------------------------------


@query(values("text, kind, old, new, ok", ("a.b=c.d", "table", "a.b", "c.d", True), ("a.b", "table", None, None, False), ("a=c.d", "table", None, None, False), (" a . b = c . d ", "table", "a.b", "c.d", True), ("a.b.x=y", "column", "a.b.x", "y", True), ("a.x=y", "column", None, None, False), ("a.b.x=", "column", None, None, False)))
def rename_mappings(spark, d):
    rows = []
    for t, kind in (("a.b=c.d", "table"), ("a.b", "table"), ("a=c.d", "table"), (" a . b = c . d ", "table"), ("a.b.x=y", "column"), ("a.x=y", "column"), ("a.b.x=", "column")):
        parse = renames.parse_table_rename if kind == "table" else renames.parse_column_rename
        if _fails(parse, t):
            rows.append((t, kind, None, None, False))
        else:
            r = parse(t)
            rows.append((t, kind, ".".join(r.old if kind == "table" else (*r.table, r.old)), ".".join(r.new) if kind == "table" else r.new, True))
    return _rows(spark, "text string, kind string, old string, new string, ok boolean", rows)


_R_OLD = [Table("a", "t", (Column("x", "Int8"), Column("k", "Int8"))), Table("a", "u", (Column("k", "Int8"),))]
_R_NEW = [Table("b", "t2", (Column("y", "Int8", renamed_from="x"), Column("k", "Int8"), Column("z", "Int8", renamed_from="nope")), renamed_from="a.t"), Table("a", "u", (Column("k", "Int8"),), renamed_from="gone")]


@query(values("step, value", ("declared", "a.t>b.t2"), ("declared", "a.gone>a.u"), ("declared", "b.t2.x>y"), ("declared", "b.t2.nope>z"), ("merged", "a.t>b.t3"), ("merged", "a.gone>a.u"), ("active", "a.t>b.t2"), ("active column", "b.t2.x>y"), ("moved", "b.t2"), ("moved", "a.u")))
def rename_sources(spark, d):
    show = lambda r: f"{'.'.join(r.old)}>{'.'.join(r.new)}" if isinstance(r, renames.TableRename) else f"{'.'.join(r.table)}.{r.old}>{r.new}"
    tables, columns = renames.from_schema(_R_NEW)
    live = renames.active(tables, _R_OLD, _R_NEW)
    moved = renames.remap(_R_OLD, live)
    rows = [("declared", show(r)) for r in [*tables, *columns]]
    rows += [("merged", show(r)) for r in renames.merge([renames.parse_table_rename("a.t=b.t3")], tables)]
    rows += [("active", show(r)) for r in live] + [("active column", show(r)) for r in renames.active(columns, moved, _R_NEW)]
    return _rows(spark, "step string, value string", rows + [("moved", f"{x.database}.{x.name}") for x in moved])


_MAPS = {"fine": ["a.a=a.b", "a.c=a.d"], "two targets": ["a.a=a.b", "a.a=a.c"], "two sources": ["a.a=a.c", "a.b=a.c"], "chain": ["a.a=a.b", "a.b=a.c"], "circle": ["a.a=a.b", "a.b=a.a"]}


@query("""
WITH m AS (SELECT * FROM (VALUES ('fine', 'a', 'b'), ('fine', 'c', 'd'), ('two targets', 'a', 'b'), ('two targets', 'a', 'c'), ('two sources', 'a', 'c'), ('two sources', 'b', 'c'),
 ('chain', 'a', 'b'), ('chain', 'b', 'c'), ('circle', 'a', 'b'), ('circle', 'b', 'a')) AS t(k, s, n))
SELECT k AS name, CAST((SELECT count(*) FROM (SELECT s FROM m WHERE m.k = q.k GROUP BY s HAVING count(DISTINCT n) > 1)) + (SELECT count(*) FROM (SELECT n FROM m WHERE m.k = q.k GROUP BY n HAVING count(DISTINCT s) > 1))
 + (SELECT count(DISTINCT a.s) FROM m a JOIN m b ON a.k = b.k AND a.s = b.n WHERE a.k = q.k) AS BIGINT) AS n FROM (SELECT DISTINCT k FROM m) q
""")
def rename_conflicts(spark, d):
    return _rows(spark, "name string, n long", [(k, len(renames.conflicts([renames.parse_table_rename(x) for x in v]))) for k, v in _MAPS.items()])


@query(values("mapping, problems", ("a.t=b.t2", 0), ("a.q=b.t2", 1), ("a.q=b.q", 2), ("a.u.k=k", 0), ("a.u.nope=k", 1), ("a.q.k=nope", 2)))
def renames_unresolved(spark, d):
    parse = lambda x: renames.parse_table_rename(x) if x.split("=")[0].count(".") == 1 else renames.parse_column_rename(x)
    return _rows(spark, "mapping string, problems int", [(x, len(renames.unresolved([parse(x)], _R_OLD, _R_NEW))) for x in ("a.t=b.t2", "a.q=b.t2", "a.q=b.q", "a.u.k=k", "a.u.nope=k", "a.q.k=nope")])


@query(values("seq, type, key, sql", (1, "create_database", "database:b", "CREATE DATABASE IF NOT EXISTS b;"), (2, "alter_table_rename_table", "table:b.t2", "RENAME TABLE a.t TO b.t2;"), (3, "alter_table_add_column", "table:b.t2:column:z", "ALTER TABLE b.t2 ADD COLUMN IF NOT EXISTS `z` Int8;"), (4, "alter_table_rename_column", "table:b.t2:column:y", "ALTER TABLE b.t2 RENAME COLUMN `x` TO `y`;")))
def renames_applied(spark, d):
    tables, columns = renames.from_schema(_R_NEW)
    tables = renames.active(tables, _R_OLD, _R_NEW)
    moved = renames.remap(_R_OLD, tables)
    plan = renames.apply_table_renames(planner.plan_changes(moved, _R_NEW), tables, {"a"})
    plan = renames.apply_column_renames(plan, renames.active(columns, moved, _R_NEW), _R_NEW)
    return _rows(spark, "seq int, type string, key string, sql string", [(i, o.type, o.key, o.sql) for i, o in enumerate(plan.operations, 1)])


@query("""
WITH o AS (SELECT * FROM (VALUES ('drop', 'a'), ('add', 'b'), ('add', 'c'), ('drop', 'd'), ('modify', 'e')) AS t(type, name)),
r AS (SELECT * FROM (VALUES ('a', 'b'), ('d', 'x')) AS t(s, n)),
u AS (SELECT * FROM r WHERE EXISTS (SELECT 1 FROM o WHERE type = 'drop' AND name = s) AND EXISTS (SELECT 1 FROM o WHERE type = 'add' AND name = n))
SELECT type, name FROM o WHERE NOT EXISTS (SELECT 1 FROM u WHERE (type = 'drop' AND name = s) OR (type = 'add' AND name = n))
UNION ALL SELECT 'rename', n FROM u
""")
def explicit_renames_applied(spark, d):
    ops = [planner.Operation(f"alter_table_{t}_column", f"table:app.e:column:{n}", "caution", "") for t, n in (("drop", "a"), ("add", "b"), ("add", "c"), ("drop", "d"), ("modify", "e"))]
    given = [renames.ColumnRename(("app", "e"), "a", "b"), renames.ColumnRename(("app", "e"), "d", "x")]
    out = renames.apply_column_renames(planner.Plan(ops), given, [_T]).operations
    return _rows(spark, "type string, name string", [(o.type.split("_")[2], o.key.rsplit(":", 1)[1]) for o in out])


# --- table scope ---------------------------------------------------------------------------------------------------------

_SELECTORS = ["users", "user*", "app.users", "app.us*", "*", "a*b", "app.", "*.users", "app.*"]


@query("""
SELECT s AS selector, CASE WHEN ok THEN db END AS db, CASE WHEN ok THEN rtrim(tb, '*') END AS value, CASE WHEN ok THEN ends_with(tb, '*') END AS prefix, ok
FROM (SELECT *, length(rtrim(tb, '*')) > 0 AND regexp_matches(tb, '^[^*]+[*]?$') AND (db IS NULL OR regexp_matches(db, '^[^*]+$')) AS ok
 FROM (SELECT s, CASE WHEN contains(s, '.') THEN split_part(s, '.', 1) END AS db, CASE WHEN contains(s, '.') THEN split_part(s, '.', 2) ELSE s END AS tb FROM (SELECT unnest(['users', 'user*', 'app.users', 'app.us*', '*', 'a*b', 'app.', '*.users', 'app.*']) AS s)))
""")
def selectors(spark, d):
    rows = []
    for s in _SELECTORS:
        p = None if _fails(scope.parse_selector, s) else scope.parse_selector(s)
        rows.append((s, p.database, p.value, p.prefix, True) if p else (s, None, None, None, False))
    return _rows(spark, "selector string, db string, value string, prefix boolean, ok boolean", rows)


@query(f"""
WITH o AS (SELECT *, CASE WHEN key LIKE 'database:%' THEN split_part(key, ':', 2) ELSE regexp_extract(key, '^table:([^.]+)\\.', 1) END AS db, regexp_extract(key, '^table:[^.]+\\.([^:]+)', 1) AS tb FROM {_OPS_SQL}),
h AS (SELECT * FROM o WHERE tb LIKE 'events%')
SELECT type, key, risk FROM h UNION ALL SELECT type, key, risk FROM o WHERE key LIKE 'database:%' AND db IN (SELECT db FROM h)
""")
def scope_filter(spark, d):
    known = [Table("app", "a", ()), Table("app", "b", ()), Table("log", "events_raw", ()), Table("log", "events_old", ()), View("log", "events_view", "SELECT 1")]
    plan = scope.filter_plan(planner.Plan(_operations()), scope.resolve(scope.parse_selector("events*"), known[:2], known[2:]))
    return _rows(spark, "type string, key string, risk string", [(o.type, o.key, o.risk) for o in plan.operations])


@query(values("step, value", ("snapshot", "table:app.e>Int64"), ("snapshot", "table:app.f>UInt8"), ("snapshot", "view:app.v>SELECT 1"), ("pending", "1.sql"), ("pending", "3.sql")))
def scoped_state(spark, d):
    t = lambda n, k: Table("app", n, (Column("id", k),))
    old, new = [t("e", "UInt8"), t("f", "UInt8"), t("g", "UInt8"), View("app", "v", "SELECT 1")], [t("e", "Int64"), t("f", "Int64"), View("app", "v", "SELECT 2")]
    inside = [("app", "e"), ("app", "g")]
    shown = [("snapshot", f"{model.key_of(x)}>{x.columns[0].type if isinstance(x, Table) else x.query}") for x in scope.scoped_snapshot(old, new, inside)]
    op = lambda key: [planner.Operation("alter_table_add_column", key, "safe", "")]
    waiting = scope.pending_in_scope({"1.sql": op("table:app.e:column:x"), "2.sql": op("table:app.f:ttl"), "3.sql": op("table:app.g"), "4.sql": op("view:app.e")}, inside)
    return _rows(spark, "step string, value string", shown + [("pending", n) for n in waiting])


# --- statements ----------------------------------------------------------------------------------------------------------

_KITCHEN = Table(
    "app", "users", (Column("id", "UInt64"), Column("mail", "String", True), Column("src", "String", default="it's"), Column("at", "DateTime", default="fn:now()", comment="when")), "ReplacingMergeTree(at)", ("id",), ("id", "at"), ("id",),
    "toYYYYMM(at)", "at + INTERVAL 365 DAY", {"index_granularity": 8192}, (SkipIndex("i", "lower(mail)", "set", 4, "100"),), (Projection("p", "SELECT id ORDER BY at"),), "who",
)
_DDL = (
    ("table", "CREATE TABLE IF NOT EXISTS app.users (\n  `id` UInt64,\n  `mail` Nullable(String),\n  `src` String DEFAULT 'it''s',\n  `at` DateTime DEFAULT now() COMMENT 'when',\n  INDEX `i` (lower(mail)) TYPE set(100) GRANULARITY 4,\n  PROJECTION `p` (SELECT id ORDER BY at)\n) ENGINE = ReplacingMergeTree(at)\nPARTITION BY toYYYYMM(at)\nPRIMARY KEY (`id`)\nORDER BY (`id`, `at`)\nUNIQUE KEY (`id`)\nTTL at + INTERVAL 365 DAY\nSETTINGS index_granularity = 8192\nCOMMENT 'who';"),
    ("view", "CREATE VIEW IF NOT EXISTS app.v AS\nSELECT 1;"),
    ("materialized view", "CREATE MATERIALIZED VIEW IF NOT EXISTS app.m TO app.t AS\nSELECT 1;"),
    ("database", "CREATE DATABASE IF NOT EXISTS app;"),
    ("drop table", "DROP TABLE IF EXISTS app.users SYNC;"),
    ("drop view", "DROP VIEW IF EXISTS app.v SYNC;"),
    ("drop materialized view", "DROP TABLE IF EXISTS app.m SYNC;"),
    ("add column", "ALTER TABLE app.users ADD COLUMN IF NOT EXISTS `mail` Nullable(String);"),
    ("modify column", "ALTER TABLE app.users MODIFY COLUMN `at` DateTime DEFAULT now() COMMENT 'when';"),
    ("drop column", "ALTER TABLE app.users DROP COLUMN IF EXISTS `x`;"),
    ("rename column", "ALTER TABLE app.users RENAME COLUMN `x` TO `y`;"),
    ("add index", "ALTER TABLE app.users ADD INDEX IF NOT EXISTS `i` (lower(mail)) TYPE set(100) GRANULARITY 4;"),
    ("drop index", "ALTER TABLE app.users DROP INDEX IF EXISTS `i`;"),
    ("add projection", "ALTER TABLE app.users ADD PROJECTION IF NOT EXISTS `p` (SELECT id ORDER BY at);"),
    ("drop projection", "ALTER TABLE app.users DROP PROJECTION IF EXISTS `p`;"),
    ("modify setting", "ALTER TABLE app.users MODIFY SETTING s = 1;"),
    ("reset setting", "ALTER TABLE app.users RESET SETTING s;"),
    ("modify ttl", "ALTER TABLE app.users MODIFY TTL at + INTERVAL 365 DAY;"),
    ("remove ttl", "ALTER TABLE app.users REMOVE TTL;"),
    ("rename table", "RENAME TABLE a.b TO c.d;"),
)


@query(values("name, sql", *_DDL))
def statements_rendered(spark, d):
    t, v, m = _KITCHEN, View("app", "v", "SELECT 1"), MaterializedView("app", "m", "SELECT 1", ("app", "t"))
    made = (
        ddl.create(t), ddl.create(v), ddl.create(m), ddl.create_database("app"), ddl.drop(t), ddl.drop(v), ddl.drop(m), ddl.add_column(t, t.columns[1]), ddl.modify_column(t, t.columns[3]),
        ddl.drop_column(t, "x"), ddl.rename_column(t, "x", "y"), ddl.add_index(t, t.indexes[0]), ddl.drop_index(t, "i"), ddl.add_projection(t, t.projections[0]), ddl.drop_projection(t, "p"),
        ddl.modify_setting(t, "s", 1), ddl.reset_setting(t, "s"), ddl.modify_ttl(t), ddl.modify_ttl(replace(t, ttl=None)), ddl.rename_table("a", "b", "c", "d"),
    )
    return _rows(spark, "name string, sql string", zip((n for n, _ in _DDL), made, strict=True))


_CREATE = (
    "CREATE TABLE app.users (`id` UInt64, mail Nullable(String) DEFAULT 'x' COMMENT 'm', INDEX i (lower(mail)) TYPE set(100) GRANULARITY 4, PROJECTION p (SELECT id ORDER BY mail)) "
    "ENGINE = SharedReplacingMergeTree(id) PARTITION BY toYYYYMM(at) PRIMARY KEY (id) ORDER BY (id, lower(mail)) UNIQUE KEY id TTL at + INTERVAL 1 DAY SETTINGS b = 2, a = 'x'"
)


@query(values("clause, value", ("engine", "ReplacingMergeTree(id)"), ("primary key", "id"), ("order by", "id;lower(mail)"), ("unique key", "id"), ("partition by", "toYYYYMM(at)"), ("ttl", "at + INTERVAL 1 DAY"), ("settings", "a=x;b=2"), ("projection", "p:SELECT id ORDER BY mail"), ("column", "id UInt64 false None None"), ("column", "mail String true x m"), ("index", "i lower(mail) set 4 100"), ("body", "4")))
def create_parsed(spark, d):
    t = parser.table_from_create(_CREATE)
    rows = [("engine", parser.engine(_CREATE)), *((w.lower(), ";".join(parser.key(_CREATE, w))) for w in ("PRIMARY KEY", "ORDER BY", "UNIQUE KEY")), ("partition by", parser.partition_by(_CREATE)), ("ttl", parser.ttl(_CREATE))]
    rows += [("settings", ";".join(f"{k}={v}" for k, v in parser.settings(_CREATE).items())), *(("projection", f"{p.name}:{p.query}") for p in parser.projections(_CREATE)), ("body", str(len(parser.parse_create(_CREATE).body)))]
    rows += [("column", f"{c.name} {c.type} {str(c.nullable).lower()} {c.default} {c.comment}") for c in t.columns] + [("index", f"{i.name} {i.expression} {i.type} {i.granularity} {i.type_args}") for i in t.indexes]
    return _rows(spark, "clause string, value string", rows)


@query(values("name, value", ("View", "view"), ("MaterializedView", "materialized_view"), ("Dictionary", None), ("MergeTree", "table"), ("view", "v: SELECT 1 AS x FROM t"), ("target", "app.t"), ("no target", "error")))
def views_parsed(spark, d):
    kinds = [(n, parser.kind_of_engine(n)) for n in ("View", "MaterializedView", "Dictionary", "MergeTree")]
    v, m = parser.view_from_create("CREATE VIEW app.v AS SELECT  1 AS x\nFROM t"), parser.view_from_create("CREATE MATERIALIZED VIEW app.m TO app.t AS SELECT 1")
    lost = "error" if _fails(parser.view_from_create, "CREATE MATERIALIZED VIEW app.m AS SELECT 1") else "found"
    return _rows(spark, "name string, value string", [*kinds, ("view", f"{v.name}: {v.query}"), ("target", ".".join(m.to)), ("no target", lost)])


_BATCH = "-- first\nSELECT ';' AS a; /* one; two */ SELECT `b;c`;\n\n-- last; one\nSELECT \"d;e\" FROM t"


@query(values("seq, statement", (1, "SELECT ';' AS a"), (2, "/* one; two */ SELECT `b;c`"), (3, 'SELECT "d;e" FROM t')))
def statements_split(spark, d):
    return _rows(spark, "seq int, statement string", enumerate(text.split_statements(_BATCH), 1))


@query(values("name, value", ("auto", "20260102030405_auto.sql"), ("named", "20260102030405_drop_it_.sql"), ("id", "ab_x.sql"), ("operations", "23"), ("statements", "23"), ("warnings", "drop_column_irreversible,drop_table_data_loss,drop_table_data_loss"), ("round trip", "true")))
def migration_files(spark, d):
    from ..sources import files

    now = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    plan = planner.plan_changes(_PLAN_OLD, _PLAN_NEW)
    sql = files.render_migration(plan, len(_PLAN_NEW), "1", now)
    rows = [("auto", files.migration_name(None, None, now)), ("named", files.migration_name("Drop It!", None, now)), ("id", files.migration_name("x", "a/b", now))]
    rows += [("operations", str(len(files.operations_in(sql)))), ("statements", str(len(files.statements(sql)))), ("warnings", ",".join(sorted(w.code for w in files.destructive("m", sql))))]
    return _rows(spark, "name string, value string", [*rows, ("round trip", str(files.operations_in(sql) == plan.operations).lower())])


@query(values("step, value", ("schema", "table:app.t"), ("schema", "view:app.v"), ("schema", "view:app.w"), ("none", "error"), ("snapshot", "table:app.t"), ("snapshot", "view:app.v"), ("snapshot", "view:app.w"), ("migration", "001_auto.sql"), ("own snapshot", "3"), ("again", "none"), ("missing snapshot", "none"), ("broken snapshot", "error"), ("left over", "0")))
def schema_and_artifacts(spark, d):
    from ..sources import files

    with _folder() as base:
        files.write_atomically(f"{base}/s/a.py", "from strataflow.plans.model import *\n_hidden = View('app', 'h', 'SELECT 1')\nt = [[Table('app', 't', (Column('id', 'Int8'),))], View('app', 'v', 'SELECT 1')]\n")
        files.write_atomically(f"{base}/s/b.json", '[{"kind": "view", "database": "app", "name": "w", "query": "SELECT 2"}, {"kind": "other"}]')
        found = files.load_schema(["s/*.py", "s/*.json"], base)
        rows = [("schema", model.key_of(x)) for x in found] + [("none", "error" if _fails(files.load_schema, ["x/*"], base) else "found")]
        made = files.write_artifacts(planner.plan_changes([], found), found, f"{base}/m", f"{base}/meta", None, "001")
        rows += [("snapshot", model.key_of(x)) for x in model.read_snapshot(made["snapshot"])] + [("migration", os.path.basename(made["migration"]))]
        rows += [("own snapshot", str(len(model.read_snapshot(files.snapshot_of(f"{base}/meta", made["migration"])))))]
        rows += [("again", str(files.write_artifacts(planner.Plan(), found, f"{base}/m", f"{base}/meta")["migration"]).lower()), ("missing snapshot", str(model.read_snapshot(f"{base}/no.json")).lower())]
        files.write_atomically(f"{base}/bad.json", "{")
        rows += [("broken snapshot", "error" if _fails(model.read_snapshot, f"{base}/bad.json") else "read"), ("left over", str(sum(n.startswith(".tmp") for _, _, ns in os.walk(base) for n in ns)))]
    return _rows(spark, "step string, value string", rows)


# --- drift ---------------------------------------------------------------------------------------------------------------


@query("""
SELECT coalesce(a.o, b.o) AS object, CASE WHEN b.o IS NULL THEN 'missing_object' WHEN a.o IS NULL THEN 'extra_object' ELSE 'kind_mismatch' END AS code
FROM (VALUES ('a.x', 'table'), ('a.y', 'view'), ('a.z', 'table'), ('a.m', 'materialized_view')) AS a(o, k) FULL JOIN (VALUES ('a.x', 'table'), ('a.y', 'table'), ('a.w', 'view'), ('a.m', 'materialized_view')) AS b(o, k) ON a.o = b.o WHERE a.k IS DISTINCT FROM b.k
""")
def object_drift(spark, d):
    make = lambda n, k: Table("a", n, ()) if k == "table" else View("a", n, "SELECT 1") if k == "view" else MaterializedView("a", n, "SELECT 1", ("a", "x"))
    want = [make(*x) for x in (("x", "table"), ("y", "view"), ("z", "table"), ("m", "materialized_view"))]
    have = [make(*x) for x in (("x", "table"), ("y", "table"), ("w", "view"), ("m", "materialized_view"))]
    return _rows(spark, "code string, object string", drift.compare(want, [*have, Table("elsewhere", "q", ())]).objects)


_WANT = (("a.x", "column", "id", "UInt64"), ("a.x", "column", "m", "String"), ("a.x", "setting", "g", "8192"), ("a.x", "ttl", "", "ts+1"), ("a.y", "column", "id", "Int8"), ("a.y", "engine", "", "Log()"), ("a.y", "order_by", "", "id"))
_HAVE = (("a.x", "column", "id", "UInt32"), ("a.x", "column", "q", "String"), ("a.x", "setting", "g", "1"), ("a.x", "setting", "other", "1"), ("a.x", "ttl", "", "ts+1"), ("a.y", "column", "id", "Int8"), ("a.y", "index", "i", "minmax"), ("a.y", "projection", "p", "SELECT 1"), ("a.y", "engine", "", "Log()"), ("a.y", "order_by", "", "id2"))
_DRIFT = f"""
SELECT object, CASE WHEN facet <> 'column' THEN facet || '_mismatch' WHEN h IS NULL THEN 'missing_column' WHEN w IS NULL THEN 'extra_column' ELSE 'changed_column' END AS code, count(*) AS n
FROM (SELECT coalesce(a.o, b.o) AS object, coalesce(a.f, b.f) AS facet, a.s AS w, b.s AS h
 FROM (VALUES {", ".join(map(str, _WANT))}) AS a(o, f, n, s) FULL JOIN (VALUES {", ".join(map(str, _HAVE))}) AS b(o, f, n, s) ON a.o = b.o AND a.f = b.f AND a.n = b.n)
WHERE w IS DISTINCT FROM h AND (facet <> 'setting' OR w IS NOT NULL) GROUP BY 1, 2
"""


def _from_facts(facts) -> list[Table]:
    out = []
    for o in sorted({f[0] for f in facts}):
        mine = lambda facet: [(n, s) for x, f, n, s in facts if (x, f) == (o, facet)]  # noqa: E731, B023
        one = lambda facet, other=None: next((s for _, s in mine(facet)), other)  # noqa: E731, B023
        out.append(Table("a", o[2:], tuple(Column(*c) for c in mine("column")), one("engine", "MergeTree()"), order_by=tuple(s for _, s in mine("order_by")), ttl=one("ttl"), settings=dict(mine("setting")),
                         indexes=tuple(SkipIndex(n, "x", s) for n, s in mine("index")), projections=tuple(Projection(*p) for p in mine("projection"))))
    return out


def _drifted() -> drift.DriftReport:
    return drift.compare(_from_facts(_WANT), _from_facts(_HAVE))


@query(_DRIFT)
def table_drift_reasons(spark, d):
    rows = []
    for t in _drifted().tables:
        many = {"missing_column": t.missing_columns, "extra_column": t.extra_columns, "changed_column": t.changed_columns, "setting_mismatch": t.settings, "index_mismatch": t.indexes, "projection_mismatch": t.projections}
        rows += [(t.table, code, len(many.get(code, "1"))) for code in t.reasons]
    return _rows(spark, "object string, code string, n long", rows)


@query(f"SELECT code, count(DISTINCT object) AS n FROM ({_DRIFT}) GROUP BY 1")
def drift_summary(spark, d):
    return _rows(spark, "code string, n long", _drifted().summary().items())


@query(values("shape, same", ("default", True), ("nullable", True), ("type", False), ("comment", False), ("key", True), ("index", True), ("projection", True)))
def shapes_compared(spark, d):
    c = drift.column_shape
    rows = [
        ("default", c(Column("a", "String", default="x")) == c(Column("a", "String", default="fn:'x'"))), ("nullable", c(Column("a", "Nullable(Int8)")) == c(Column("a", "Int8", True))),
        ("type", c(Column("a", "Int8")) == c(Column("a", "Int16"))), ("comment", c(Column("a", "Int8", comment="x")) == c(Column("a", "Int8"))),
        ("key", text.normalize_clause("( `a`,  b )") == text.normalize_clause("a, b")), ("index", drift.index_shape(SkipIndex("i", "(a)", "set", 1, "3")) == drift.index_shape(SkipIndex("j", "a", "set", 1, "3"))),
        ("projection", drift.projection_shape(Projection("p", "SELECT  a")) == drift.projection_shape(Projection("q", " SELECT a"))),
    ]
    return _rows(spark, "shape string, same boolean", rows)


# --- journal -------------------------------------------------------------------------------------------------------------


@query(values("step, value", ("blocked", "table:app.users"), ("ran", "none"), ("applied", "1.sql"), ("ran", "A;B"), ("status", "2,1,1,0"), ("changed", "1.sql"), ("failed", "1.sql"), ("approved", "2.sql")))
def migrations_applied(spark, d):
    from ..sources import files, journal

    log = journal.Journal(spark, shared_folder(spark, "journal"))
    drop = files.render_migration(planner.plan_changes([replace(_KITCHEN, indexes=(), projections=())], []), 0, "1", dt.datetime.now(dt.UTC))
    contents, ran, rows = {"1.sql": "A; B", "2.sql": drop}, [], []
    try:
        journal.apply_migrations(log, contents, ran.append)
    except journal.DestructiveBlocked as e:
        rows += [("blocked", e.warnings[0].key), ("ran", ";".join(ran) or "none")]
    rows += [("applied", x) for x in journal.apply_migrations(log, contents, ran.append, only={"1.sql"})] + [("ran", ";".join(ran))]
    table = _rows(spark, "name string, content string, checksum string", [(n, c, files.checksum(c)) for n, c in contents.items()])
    s = journal.status(table, log.read())
    rows.append(("status", f"{s.total},{s.applied},{s.pending},{s.mismatches}"))
    try:
        journal.apply_migrations(log, {"1.sql": "other"}, ran.append)
    except journal.ChecksumMismatch as e:
        rows.append(("changed", str(e)))

    def fail(statement):
        raise RuntimeError(statement)

    if _fails(journal.apply_migrations, log, {**contents, "3.sql": "C"}, fail, only={"3.sql"}):
        rows.append(("failed", ",".join(r.name for r in log.read().collect())))
    rows += [("approved", x) for x in journal.apply_migrations(log, contents, ran.append, allow_destructive=True)]
    return _rows(spark, "step string, value string", rows)


@query("""
SELECT id, array_to_string(list_filter([CASE WHEN pending > 0 AND (strict OR fail_all) THEN 'pending_migrations' END, CASE WHEN changed > 0 THEN 'checksum_mismatch' END,
 CASE WHEN drifted AND (strict OR fail_all) THEN 'schema_drift' END, CASE WHEN severity = 'error' THEN 'plugin:p' END], lambda x: x IS NOT NULL), ',') AS failed
FROM (VALUES (1, 0, 0, false, 'warn', false, true), (2, 2, 1, true, 'error', false, true), (3, 2, 1, true, 'warn', false, false), (4, 2, 0, true, 'warn', true, false), (5, 1, 0, NULL, 'warn', true, true)) AS t(id, pending, changed, drifted, severity, strict, fail_all)
""")
def check_policy(spark, d):
    from ..sources import journal

    cases = ((1, 0, 0, False, "warn", False, True), (2, 2, 1, True, "error", False, True), (3, 2, 1, True, "warn", False, False), (4, 2, 0, True, "warn", True, False), (5, 1, 0, None, "warn", True, True))
    rows = []
    for i, waiting, changed, drifted, severity, strict, every in cases:
        fail_on = tuple(journal.CHECKS) if every else ("checksum",)
        rows.append((i, ",".join(journal.check_findings(journal.Status(9, 0, waiting, changed), drifted, {"p": [plugins.Finding("x", severity)]}, strict, fail_on))))
    return _rows(spark, "id int, failed string", rows)


# --- replay plans and runs -----------------------------------------------------------------------------------------------

START, END = "2024-01-01", "2024-01-31"
_GRID = "SELECT CAST(k AS BIGINT) AS chunk FROM range(120) AS t(k)"


def _never(seconds: float) -> None:
    """In place of waiting."""


@contextmanager
def _planned(options: runstate.Options = runstate.Options(max_attempts=2), start: str = START, end: str = END, target: str = "app.t"):
    with _folder() as base:
        store = runstate.Store(base)
        plan = runstate.make_plan(store, target, start, end, "ts", "view", options)
        yield store, plan, {c.id: k for k, c in enumerate(runstate.plan_chunks(plan))}


@query("SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 432000) AS BIGINT) AS chunk, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1")
def replay_idempotent(spark, d):
    """Chunks applied to a target three times over: the second pass finds their tokens, the third is forced and exchanges them."""
    events, target = spark.read.parquet(f"{d}/events.parquet"), replay.Target(spark, shared_folder(spark, "target"), spark.range(0).selectExpr("id AS chunk", "id AS event_id").schema)
    grid = replay.chunks("p1", replay.parse_time(START), replay.parse_time(END), dt.timedelta(days=5))
    for force in (False, False, True):
        for k, c in enumerate(grid):
            rows = replay.in_window(events, "ts", c.start, c.end).select(F.lit(k).cast("long").alias("chunk"), "event_id")
            target.apply(c.token, rows, force)
    return target.read().groupBy("chunk").agg(F.count("*").alias("n"))


@query("""
SELECT id, hours > 0 AND (hours <= 720 OR forced) AND chunk_minutes >= 15 AS allowed
FROM (SELECT id, (epoch(b) - epoch(a)) / 3600 AS hours, chunk_minutes, forced FROM (VALUES (1, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', 360, false), (2, TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', 360, false),
 (3, TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-01', 60, true), (4, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', 5, true), (5, TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', 15, true)) AS t(id, a, b, chunk_minutes, forced))
""")
def window_guard_report(spark, d):
    cases = ((1, START, END, 360, False), (2, START, "2024-03-01", 360, False), (3, "2024-01-02", START, 60, True), (4, START, "2024-01-02", 5, True), (5, START, "2024-03-01", 15, True))
    ok = lambda a, b, m, force: not _fails(replay.check_window, replay.parse_time(a), replay.parse_time(b), dt.timedelta(minutes=m), force=force)
    return _rows(spark, "id int, allowed boolean", [(i, ok(*c)) for i, *c in cases])


@query(f"""
SELECT CAST(count(*) FILTER (chunk % 5 <> 0) AS BIGINT) AS done, CAST(count(*) FILTER (chunk % 5 = 0) AS BIGINT) AS failed, CAST(0 AS BIGINT) AS pending,
 CAST(sum(CASE WHEN chunk % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS attempts, CAST(sum(chunk * 10) FILTER (chunk % 5 <> 0) AS BIGINT) AS written, 'failed' AS status FROM ({_GRID})
""")
def run_status_summary(spark, d):
    """Every fifth chunk fails at each of its two attempts."""
    with _planned() as (store, plan, order):

        def execute(chunk):
            if order[chunk.id] % 5 == 0:
                raise RuntimeError("lost")
            return order[chunk.id] * 10

        runstate.execute_run(store, plan.id, execute, plan.run_options(), sleep=_never)
        s = runstate.status(store, plan.id)
    return _rows(spark, "done long, failed long, pending long, attempts long, written long, status string", [(s.counts["done"], s.counts["failed"], s.counts["pending"], s.attempts, s.rows, s.status)])


@query(values("step, status, done, failed, attempts, issue", ("planned", "planned", 0, 0, 0, "backfill_plan_missing"), ("run", "failed", 2, 1, 5, "backfill_chunk_failed_retry_exhausted"), ("resume", "completed", 3, 0, 3, None), ("stopped", "paused", 1, 0, 1, "backfill_required_pending"), ("cancelled", "cancelled", 1, 0, 1, "backfill_required_pending")))
def run_and_resume(spark, d):
    """Three chunks, of which the second fails three times; then another plan that is stopped after a chunk and cancelled."""
    rows, lost = [], [3]
    with _planned(runstate.Options(), end="2024-01-01T18:00:00Z") as (store, plan, order):

        def note(step, id_):
            s = runstate.status(store, id_)
            rows.append((step, s.status, s.counts["done"], s.counts["failed"], s.attempts, (runstate.doctor(store, id_)["issues"] or [None])[0]))

        def execute(chunk):
            if order.get(chunk.id) == 1 and lost[0]:
                lost[0] -= 1
                raise RuntimeError("lost")
            return 1

        note("planned", plan.id)
        runstate.execute_run(store, plan.id, execute, sleep=_never)
        note("run", plan.id)
        runstate.execute_run(store, plan.id, execute, resume=True, sleep=_never)
        note("resume", plan.id)
        other, calls = runstate.make_plan(store, "app.u", START, "2024-01-01T18:00:00Z", "ts", "table"), []
        runstate.execute_run(store, other.id, lambda c: calls.append(c) or 1, stop=lambda: len(calls) >= 1)
        note("stopped", other.id)
        runstate.cancel(store, other.id)
        note("cancelled", other.id)
    return _rows(spark, "step string, status string, done int, failed int, attempts int, issue string", rows)


_RUNS = (("p1", "app.a", "running"), ("p2", "app.a", "running"), ("p3", "app.a", "failed"), ("p4", "app.b", "running"), ("p5", "app.c", "failed"), ("p6", "app.c", "completed"))


@query(f"WITH r AS (SELECT * FROM (VALUES {', '.join(map(str, _RUNS))}) AS t(plan, target, status)) SELECT plan, EXISTS (SELECT 1 FROM r b WHERE b.target = a.target AND b.plan <> a.plan AND b.status = 'running') AS blocked FROM r a WHERE status <> 'completed'")
def run_overlap_report(spark, d):
    rows = []
    for tried, _, status in _RUNS:
        if status == "completed":
            continue
        with _folder() as base:
            store, plans = runstate.Store(base), {}
            for k, (name, target, state) in enumerate(_RUNS):
                plans[name] = runstate.make_plan(store, target, START, f"2024-01-{2 + k:02d}", "ts", "view")
                run = runstate.execute_run(store, plans[name].id, lambda c: 0, force_overlap=True, stop=lambda: True)
                run.status = state
                store.save(run, "test")
            rows.append((tried, _fails(runstate.execute_run, store, plans[tried].id, lambda c: 0)))
    return _rows(spark, "plan string, blocked boolean", rows)


@query(values("policy, code, severity", ("strict", "backfill_required_pending", "error"), ("strict", "backfill_chunk_failed_retry_exhausted", "error"), ("relaxed", "backfill_required_pending", "warn"), ("relaxed", "backfill_chunk_failed_retry_exhausted", "error"), ("relaxed", "backfill_policy_relaxed", "warn")))
def backfill_required(spark, d):
    """One completed run, one failed, one plan that was never run; and a folder without plans, which has no findings."""
    with _planned(runstate.Options(max_attempts=1)) as (store, plan, _):
        runstate.execute_run(store, plan.id, lambda c: 1 / 0, plan.run_options(), sleep=_never)
        done = runstate.make_plan(store, "app.u", START, "2024-01-02", "ts", "view")
        runstate.execute_run(store, done.id, lambda c: 1)
        runstate.make_plan(store, "app.v", START, "2024-01-02", "ts", "view")
        rows = [(name, f.code, f.severity) for name, required in (("strict", True), ("relaxed", False)) for f in runstate.check(store, required)]
        rows += [("empty", f.code, f.severity) for f in runstate.check(runstate.Store(f"{store.folder}/none"))]
    return _rows(spark, "policy string, code string, severity string", rows)


@query(values("rule, refused", ("same plan again", False), ("other plan of the same id", True), ("other plan, forced", False), ("other environment", True), ("environment forced", False), ("resume without a run", True), ("other options", True), ("options forced", False), ("plan id outside of the folder", True), ("cancel a completed run", True), ("a cancelled run", True)))
def run_rules(spark, d):
    rows, options = [], runstate.Options(max_attempts=1)
    with _planned(options) as (store, plan, _):
        make = lambda strategy, **kw: runstate.make_plan(store, "app.t", START, END, "ts", strategy, options, **kw)
        go = lambda **kw: runstate.execute_run(store, plan.id, lambda c: 1, **{"options": options, **kw})
        stop = {"stop": lambda: True}
        rows += [("same plan again", _fails(make, "view")), ("other plan of the same id", _fails(make, "table")), ("other plan, forced", _fails(make, "table", force=True))]
        rows += [("other environment", _fails(go, environment="x")), ("resume without a run", _fails(go, resume=True)), ("environment forced", _fails(go, environment="x", force_environment=True, **stop))]
        other = runstate.Options(max_attempts=7)
        rows += [("other options", _fails(go, options=other)), ("options forced", _fails(go, options=other, force_compatibility=True)), ("plan id outside of the folder", _fails(store.plan, "../../etc"))]
        rows.append(("cancel a completed run", _fails(runstate.cancel, store, plan.id)))
        second = runstate.make_plan(store, "app.u", START, "2024-01-02", "ts", "view")
        runstate.cancel(store, second.id)
        rows.append(("a cancelled run", _fails(runstate.execute_run, store, second.id, lambda c: 1)))
    return _rows(spark, "rule string, refused boolean", rows)


_EVENTS = Table("app", "events", (Column("id", "UInt64"), Column("created_at", "DateTime"), Column("ts", "DateTime64(3)")), order_by=("id", "ts"))
_HOURLY = Table("app", "hourly", (Column("hour", "DateTime"), Column("n", "Int64")), "SummingMergeTree(n)", order_by=("hour",))
_MV = MaterializedView("app", "mv", "SELECT toStartOfHour(ts) AS hour, count() AS n FROM app.events GROUP BY hour", ("app", "hourly"))


@query(values("name, value", ("flag", "x"), ("declared", "q"), ("default", "z"), ("found", "ts"), ("none", "error"), ("view", "mv"), ("no view", "none"), ("source of the view", "events"), ("source of a table", "events"), ("target", "app.t"), ("bad target", "error"), ("time", "2026-01-01T00:00:00+00:00"), ("time with a zone", "2026-01-01T10:00:00+00:00"), ("table into itself", "error"), ("replacing table into itself", "ok")))
def replay_arguments(spark, d):
    every = [_EVENTS, _HOURLY, _MV]
    own = Table("a", "b", (), plugins={"backfill": {"time_column": "q"}})
    view = lambda t: getattr(replay.view_for(every, t), "name", "none")
    rows = [("flag", replay.time_column(_EVENTS, "x")), ("declared", replay.time_column(own, None, "z")), ("default", replay.time_column(_EVENTS, None, "z")), ("found", replay.time_column(_EVENTS)), ("none", "error" if _fails(replay.time_column, None) else "ok")]
    rows += [("view", view(("app", "hourly"))), ("no view", view(("app", "events"))), ("source of the view", replay.source_table(every, ("app", "hourly")).name), ("source of a table", replay.source_table(every, ("app", "events")).name)]
    rows += [("target", ".".join(replay.parse_target(" app.t "))), ("bad target", "error" if _fails(replay.parse_target, "a.b.c") else "ok")]
    rows += [("time", replay.parse_time("2026-01-01").isoformat()), ("time with a zone", replay.parse_time("2026-01-01T12:00:00+02:00").isoformat())]
    one = spark.sql("SELECT timestamp'2024-01-01' AS ts")
    into = lambda t: "error" if _fails(replay.self_replay, one, t, "ts", START, END) else "ok"
    return _rows(spark, "name string, value string", [*rows, ("table into itself", into(_EVENTS)), ("replacing table into itself", into(replace(_EVENTS, engine="ReplacingMergeTree(ts)")))])


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY 1")
def streamed_view(spark, d):
    """The materialized view kept up by a stream over the events, twice: the second start finds nothing new."""
    folder = shared_folder(spark, "stream")
    events = spark.read.parquet(f"{d}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{folder}/in")
    target = replay.Target(spark, f"{folder}/out", spark.createDataFrame([], "hour timestamp_ntz, n long").schema)
    view = lambda df: df.groupBy(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        maintain(stream, view, target, "hourly", f"{folder}/check").awaitTermination(300)
    return merge.final(target.read(), _HOURLY)


# --- types and generated code --------------------------------------------------------------------------------------------

_TYPES = (
    ("UInt8", "smallint"), ("Int64", "bigint"), ("UInt64", "decimal(20,0)"), ("Float32", "float"), ("Bool", "boolean"), ("String", "string"), ("FixedString(10)", "string"), ("Date", "date"), ("DateTime('UTC')", "timestamp"),
    ("Decimal(18, 4)", "decimal(18,4)"), ("Decimal64(3)", "decimal(18,3)"), ("Nullable(Int32)", "int"), ("LowCardinality(Nullable(String))", "string"), ("Array(Array(Int32))", "array<array<int>>"),
    ("Map(String, Float64)", "map<string,double>"), ("Tuple(a Int32, b Array(String))", "struct<a:int,b:array<string>>"), ("Enum8('a' = 1, 'b' = 2)", "string"), ("SimpleAggregateFunction(sum, Float64)", "double"),
    ("Nope", None), ("Array(Int32", None), ("Nullable(Array(Int8))", None), ("Decimal(3, 4)", None),
)


@query(values("declared, spark", *_TYPES))
def types_mapped(spark, d):
    return _rows(spark, "declared string, spark string", [(t, None if _fails(types.map_type, t) else types.map_type(t).spark.simpleString()) for t, _ in _TYPES])


@query(values("declared, base, args", ("Map(String, Array(Int8))", "Map", "String|Array(Int8)"), ("Enum8('a,b' = 1, 'c' = 2)", "Enum8", "'a,b' = 1|'c' = 2"), ("Date", "Date", "")))
def types_parsed(spark, d):
    return _rows(spark, "declared string, base string, args string", [(t, types.parse_type(t).base, "|".join(types.parse_type(t).args)) for t in ("Map(String, Array(Int8))", "Enum8('a,b' = 1, 'c' = 2)", "Date")])


@query(values("name, value", ("pascal", "AppUserEvents"), ("camel", "appUserEvents"), ("raw", "app_user_events"), ("digit", "T1X"), ("repeated", "AppA,AppA_2"), ("missing", "missing"), ("fresh", "fresh"), ("stale", "stale"), ("columns", "id:bigint:false,tags:array<string>:false"), ("strict", "error"), ("lenient", "app.b.x"), ("skipped", "dictionary=1,view=1"), ("file", "table:app.t,view:app.v"), ("unshared", "MergeTree()")))
def generated_code(spark, d):
    from ..sources import files

    t = Table("app", "t", (Column("id", "Int64"), Column("tags", "Array(String)")), "SharedMergeTree")
    bad = Table("app", "b", (Column("x", "Nope"),))
    code, _ = codegen.render_schemas([t, View("app", "v", "SELECT 1")])
    made: dict = {}
    exec(code, made)
    rows = [(s, codegen.type_name("app", "user_events", s)) for s in codegen.STYLES] + [("digit", codegen.type_name("1", "x")), ("repeated", ",".join(codegen.unique_names([Table("app", "a", ()), Table("app", "a_", ())]).values()))]
    with _folder() as base:
        path = f"{base}/g.py"
        rows.append(("missing", codegen.freshness(path, code)))
        files.write_atomically(path, code)
        rows += [("fresh", codegen.freshness(path, code)), ("stale", codegen.freshness(path, code + "#"))]
        files.write_atomically(f"{base}/p.json", codegen.render_schema_file([View("app", "v", "SELECT 1"), t]))
        rows.append(("file", ",".join(model.key_of(x) for x in files.load_schema(["p.json"], base))))
    rows.append(("columns", ",".join(f"{f.name}:{f.dataType.simpleString()}:{str(f.nullable).lower()}" for f in made["AppT"])))
    rows += [("strict", "error" if _fails(codegen.render_schemas, [bad]) else "ok"), ("lenient", codegen.render_schemas([bad], strict=False)[1][0].split(":")[0])]
    rows.append(("skipped", ",".join(f"{k}={n}" for k, n in codegen.skipped([("app", "t", "table"), ("app", "w", "view"), ("app", "d", "dictionary")], [t]).items())))
    return _rows(spark, "name string, value string", [*rows, ("unshared", plugins.unshare([t])[0].engine)])


@query("SELECT k AS kind, count(*) AS n FROM (VALUES ('a.x', 'table'), ('a.y', 'view'), ('a.z', 'view'), ('a.w', 'dictionary')) AS t(o, k) WHERE o NOT IN ('a.x', 'a.y') GROUP BY 1")
def skipped_objects(spark, d):
    objects = [("a", "x", "table"), ("a", "y", "view"), ("a", "z", "view"), ("a", "w", "dictionary")]
    return _rows(spark, "kind string, n long", codegen.skipped(objects, [Table("a", "x", ()), View("a", "y", "SELECT 1")]).items())


@query(values("step, value", ("schema", "t,more"), ("statements", "A,x"), ("order", "one,two"), ("command", "2"), ("findings", "one:soft:warn"), ("findings", "two:check_failed:error"), ("hook fails", "two.plan"), ("given twice", "error"), ("other api", "error"), ("newer version", "error"), ("unknown command", "error")))
def plugin_hooks(spark, d):
    seen: list[str] = []
    one = plugins.Plugin("one", init=lambda c: seen.append("one"), schema=lambda x: [*x, replace(_T, name="more")], before_apply=lambda n, s: [*s, "x"], check=lambda c: [plugins.Finding("soft", "warn")], commands={"go": len})
    two = plugins.Plugin("two", init=lambda c: seen.append("two"), plan=lambda p: 1 / 0, check=lambda c: 1 / 0)
    r = plugins.Runtime([one, two])
    r.notify("init", {})
    rows = [("schema", ",".join(x.name for x in r.fold("schema", [replace(_T, name="t")]))), ("statements", ",".join(r.before_apply("m", ["A"]))), ("order", ",".join(seen)), ("command", str(r.command("one", "go", ["a", "b"])))]
    rows += [("findings", f"{n}:{f.code}:{f.severity}") for n, fs in r.findings({}).items() for f in fs]
    try:
        r.fold("plan", planner.Plan())
    except plugins.PluginError as e:
        rows.append(("hook fails", str(e).split(":")[0]))
    bad = {"given twice": [one, one], "other api": [plugins.Plugin("x", api_version=9)], "newer version": [plugins.Plugin("x", needs_version="99.1")]}
    rows += [(k, "error" if _fails(plugins.Runtime, v) else "ok") for k, v in bad.items()]
    return _rows(spark, "step string, value string", [*rows, ("unknown command", "error" if _fails(r.command, "one", "nope", []) else "ok")])


# --- catalog -------------------------------------------------------------------------------------------------------------


@contextmanager
def _database(spark: SparkSession):
    name = f"strataflow_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


@query("""
SELECT c_custkey AS id, upper(c_name) AS title, CAST('web' AS VARCHAR) AS src, CAST(c_nationkey AS BIGINT) AS nation FROM customer
""")
def table_altered(spark, d):
    """A table through creation, an added, a renamed, a dropped and a changed column and a rename, with its rows."""
    from ..sources import catalog

    with _database(spark) as db:
        t = Table(db, "c", (Column("id", "Int64"), Column("name", "String"), Column("nation", "Int32"), Column("url_token", "Float64")), order_by=("id",))
        catalog.create(spark, t)
        rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
        catalog.insert(rows, f"{db}.c")
        assert model.canonical(catalog.describe(spark, db, "c")) == model.canonical(t)
        new = replace(t, columns=(Column("id", "Int64"), Column("title", "String"), Column("src", "String", default="web"), Column("nation", "Int64")))
        catalog.alter(spark, catalog.describe(spark, db, "c"), new, {"name": "title"})
        assert model.canonical(catalog.describe(spark, db, "c")) == model.canonical(new)
        catalog.rename_table(spark, (db, "c"), (db, "people"))
        out = spark.table(f"{db}.people").collect()  # the table goes with its database; customers are few here
    return spark.createDataFrame(out, "id long, title string, src string, nation long")


@query(values("name, kind, facts", ("t", "table", "id Int64,at DateTime|MergeTree()|id|8192|i|p"), ("v", "view", "SELECT toDate(at) AS day FROM DB.t"), ("m", "materialized_view", "SELECT count() AS n FROM DB.t>DB.t")))
def objects_pulled(spark, d):
    """Declared objects as the catalog tells them again, and no drift between the two."""
    from ..sources import catalog

    with _database(spark) as db:
        t = Table(db, "t", (Column("id", "Int64"), Column("at", "DateTime")), order_by=("id",), settings={"index_granularity": "8192"}, indexes=(SkipIndex("i", "id", "minmax"),), projections=(Projection("p", "SELECT id ORDER BY at"),))
        declared = [t, View(db, "v", f"SELECT toDate(at) AS day FROM {db}.t"), MaterializedView(db, "m", f"SELECT count() AS n FROM {db}.t", (db, "t"))]
        for x in declared:
            catalog.create(spark, x)
        rows, found = [], catalog.describe_all(spark, [db])
        for x in found:
            if isinstance(x, Table):
                facts = "|".join((",".join(f"{c.name} {c.type}" for c in x.columns), x.engine, ",".join(x.order_by), x.settings["index_granularity"], x.indexes[0].name, x.projections[0].name))
            else:
                facts = x.query + (">" + ".".join(x.to) if isinstance(x, MaterializedView) else "")
            rows.append((x.name, x.kind, facts.replace(db, "DB")))
        assert not drift.compare(declared, found).drifted and {(r.name, r.kind) for r in catalog.objects(spark, [db]).collect()} == {(x.name, x.kind) for x in declared}
    return _rows(spark, "name string, kind string, facts string", rows)


# --- reads and writes ----------------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def plain_and_shared_engines(spark, d):
    """A plain engine returns every row; the Shared name of a merging one merges as the engine it shares."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "user_id")
    plain = merge.final(e, replace(_T, engine="SharedMergeTree", order_by=("event_type",))).groupBy("event_type").agg(F.count("*").alias("n"))
    one = merge.final(e.withColumn("v", F.lit(1)), replace(_T, engine="SharedReplacingMergeTree(v)", order_by=("event_type", "user_id")))
    return plain.join(one.groupBy("event_type").agg(F.count("*").alias("users")), "event_type").select("event_type", "n", "users")


@query("SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-10' AND o_orderdate < TIMESTAMP '1995-06-01' GROUP BY 1")
def month_partitions_pruned(spark, d):
    """Orders written by month and sorted by key, and a range that reads the folders of its months only."""
    path = f"{shared_folder(spark, 'orders')}/t"
    t = Table("app", "o", (), order_by=("o_custkey", "o_orderkey"), partition_by="toYYYYMM(o_orderdate)")
    merge.write_partitioned(spark.read.parquet(f"{d}/orders.parquet").repartition(4, "o_orderkey"), path, t)
    stored = spark.read.parquet(path)
    hit = stored.where(merge.month_range("o_orderdate", "_p0", "1995-02-10", "1995-06-01"))
    return hit.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 7")
def bloom_filtered(spark, d):
    """Events written with a bloom filter on the user, which the scan's pushed filter uses."""
    from ..operators.granules import write_with_bloom

    path = f"{shared_folder(spark, 'bloom')}/t"
    write_with_bloom(spark.read.parquet(f"{d}/events.parquet"), path, {"user_id": 1000})
    return spark.read.parquet(path).where("user_id = 7").select("event_id", "event_type")


# --- vocabulary ----------------------------------------------------------------------------------------------------------


def _view(spark, d, sql: str, table: str = "events") -> DataFrame:
    return replay.view_function(spark, sql, f"app.{table}")(spark.read.parquet(f"{d}/{table}.parquet"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1")
def day_starts(spark, d):
    out = _view(spark, d, "SELECT toStartOfDay(ts) AS day, count() AS n FROM app.events WHERE ts >= toDateTime('2024-01-05 12:00:00') GROUP BY day")
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT event_id, CAST(user_id AS DECIMAL(20,0)) AS user FROM events WHERE ts > TIMESTAMP '2024-01-20 06:00:00'")
def parsed_times(spark, d):
    return _view(spark, d, "SELECT event_id, toUInt64(user_id) AS user FROM app.events WHERE ts > parseDateTimeBestEffort('2024-01-20 06:00:00') AND ts < now() AND ts < now64()")


@query("SELECT event_type, round(sum(value) * 2, 4) AS twice FROM events WHERE value > 1 GROUP BY 1")
def named_expressions(spark, d):
    return _view(spark, d, "WITH value * 2 AS double_value, big AS (SELECT * FROM app.events WHERE value > 1) SELECT event_type, round(sum(double_value), 4) AS twice FROM big GROUP BY event_type")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def qualified_rows(spark, d):
    return _view(spark, d, "SELECT user_id, event_id FROM app.events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")


@query('SELECT event_type AS "order", count(*) AS "select" FROM events GROUP BY 1')
def reserved_names(spark, d):
    return _view(spark, d, "SELECT event_type AS `order`, count() AS `select` FROM app.events GROUP BY `order`")


# --- command line --------------------------------------------------------------------------------------------------------


@query(values("command, code, value", ("generate", 0, "001_auto.sql"), ("status", 0, "1,0,1"), ("check", 1, "pending_migrations"), ("bad setting", 2, "ConfigError"), ("bad selector", 2, "SelectorError"), ("plugin", 0, "backfill"), ("codegen check", 1, "missing"), ("codegen", 0, "missing"), ("codegen check again", 0, "fresh")))
def command_line(spark, d):
    """Commands on a folder of their own: exit code and what their JSON object says."""
    import contextlib
    import io
    import json

    from .. import cli

    with _folder() as base, _database(spark) as db:
        os.makedirs(f"{base}/schema")
        with open(f"{base}/schema/s.py", "w") as f:
            f.write(f"from strataflow.plans.model import *\nt = Table('{db}', 'e', (Column('id', 'Int64'),), order_by=('id',))\n")
        settings = {"schema": [f"{base}/schema/*.py"], "migrations": f"{base}/m", "meta": f"{base}/meta", "journal": f"{shared_folder(spark, 'journal')}/j", "warehouse": f"{base}/w", "generated": f"{base}/g.py", "fail_on": ["pending", "checksum"]}
        for name, content in (("c", settings), ("bad", {"nope": 1})):
            with open(f"{base}/{name}.json", "w") as f:
                json.dump(content, f)

        def run(*argv, config="c"):
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                code = cli.Cli().main(["--json", "--config", f"{base}/{config}.json", *argv])
            found = json.loads(out.getvalue().strip().split("\n")[-1])
            assert found["schema_version"] == 1 and found["command"]
            return code, found

        rows = []
        code, out = run("generate", "--migration-id", "001")
        rows.append(("generate", code, os.path.basename(out["migration"])))
        code, out = run("status")
        rows.append(("status", code, f"{out['total']},{out['applied']},{out['pending']}"))
        code, out = run("check")
        rows.append(("check", code, ",".join(out["failed"])))
        code, out = run("status", config="bad")
        rows.append(("bad setting", code, out["error"]))
        code, out = run("--table", "*", "generate")
        rows.append(("bad selector", code, out["error"]))
        code, out = run("plugin")
        rows.append(("plugin", code, ",".join(out["plugins"])))
        for name, argv, key in (("codegen check", ["codegen", "--check"], "state"), ("codegen", ["codegen"], "was"), ("codegen check again", ["codegen", "--check"], "state")):
            code, out = run(*argv)
            rows.append((name, code, out[key]))
    return _rows(spark, "command string, code int, value string", rows)
