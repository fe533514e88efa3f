import json
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.plans import codegen, ddl, drift, parser, planner, plugins, renames, scope
from strataflow.plans.model import Column, MaterializedView, Projection, SkipIndex, Table, ValidationError, View, canonical, canonical_all, from_dict, read_snapshot, snapshot, to_dict, validate


def users(**more):
    return Table(**{"database": "app", "name": "users", "columns": (Column("id", "UInt64"), Column("email", "String")), "primary_key": ("id",), "order_by": ("id",), **more})


SINK = Table(
    "app", "sink",
    (Column("id", "UInt64"), Column("tenant", "UInt32"), Column("email", "String", True), Column("status", "Enum8('a' = 1, 'b' = 2)", default="a"), Column("tags", "Array(String)"),
     Column("meta", "Map(String, String)"), Column("at", "DateTime", default="fn:now()"), Column("amount", "Decimal(18, 4)", comment="it's")),
    "MergeTree()", ("id",), ("tenant", "id"), (), "toYYYYMM(at)", "at + INTERVAL 365 DAY", {"index_granularity": "8192"},
    (SkipIndex("by_email", "lower(email)", "bloom_filter", 4, "0.01"), SkipIndex("by_at", "at", "minmax", 1)), (Projection("recent", "SELECT id ORDER BY at DESC LIMIT 10"),), "all of it",
)


def test_canonical_last_wins_and_sorts():
    a, b = users(), users(comment="second")
    out = canonical_all([View("app", "v", "select  1"), a, MaterializedView("app", "m", "select 1", ("app", "t")), b])
    assert [d.kind for d in out] == ["table", "view", "materialized_view"] and out[0].comment == "second" and out[1].query == "select 1"


def test_canonical_keys_engine_parts():
    c = canonical(users(engine="SharedMergeTree", order_by=("id, email",), indexes=(SkipIndex("b", " x ", "set"), SkipIndex("a", "y", "minmax"))))
    assert c.engine == "MergeTree()" and c.order_by == ("id", "email") and [i.name for i in c.indexes] == ["a", "b"]


def test_validation_codes():
    t = users(columns=(Column("id", "UInt64"), Column("id", "String")), primary_key=("x",), order_by=("y",), indexes=(SkipIndex("i", "id", "set"),) * 2, projections=(Projection("p", "SELECT id"),) * 2)
    codes = [i.code for i in validate([t, t])]
    assert set(codes) == {"duplicate_object_name", "duplicate_column_name", "duplicate_index_name", "duplicate_projection_name", "primary_key_missing_column", "order_by_missing_column"}
    with pytest.raises(ValidationError):
        planner.plan_changes([], [t])


def test_snapshot_roundtrip(tmp_path):
    path = tmp_path / "snapshot.json"
    assert read_snapshot(str(path)) is None
    path.write_text(json.dumps(snapshot([SINK, View("app", "v", "SELECT 1")])))
    assert read_snapshot(str(path)) == canonical_all([SINK, View("app", "v", "SELECT 1")])
    path.write_text("{")
    with pytest.raises(ValueError):
        read_snapshot(str(path))


def test_create_statement_parses_back():
    assert canonical(parser.table_from_create(ddl.create(canonical(SINK)))) == canonical(SINK)
    assert from_dict(json.loads(json.dumps(to_dict(SINK)))) == SINK


def test_parser_is_not_misled_by_projections_and_strings():
    sql = "CREATE TABLE a.t (`x` UInt8 DEFAULT 'ORDER BY y', PROJECTION p (SELECT x ORDER BY x)) ENGINE = MergeTree PARTITION BY tuple() ORDER BY (x) TTL x + INTERVAL 1 DAY SETTINGS s = 'a,b', z = 1"
    assert parser.key(sql, "ORDER BY") == ["x"] and parser.settings(sql) == {"s": "a,b", "z": "1"} and parser.ttl(sql) == "x + INTERVAL 1 DAY"
    assert parser.engine(sql) == "MergeTree()" and parser.projections(sql)[0].query == "SELECT x ORDER BY x" and parser.key(sql, "PRIMARY KEY") == []
    assert parser.kind_of_engine("Dictionary") is None and parser.kind_of_engine("MaterializedView") == "materialized_view"
    with pytest.raises(ValueError):
        parser.index_from_row("i", "x", "hnsw(3)", 1)


def test_view_parsing():
    assert parser.view_from_create("CREATE VIEW IF NOT EXISTS a.v AS SELECT\n 1;") == View("a", "v", "SELECT 1")
    assert parser.view_from_create(ddl.create(MaterializedView("a", "m", "SELECT 1", ("b", "t")))) == MaterializedView("a", "m", "SELECT 1", ("b", "t"))


def types_of(plan):
    return [o.type for o in plan.operations]


def test_add_column_is_safe_and_drop_is_dangerous():
    plan = planner.plan_changes([users()], [users(columns=(Column("id", "UInt64"), Column("src", "UInt8")))])
    assert types_of(plan) == ["alter_table_add_column", "alter_table_drop_column"] and plan.risks == {"safe": 1, "caution": 0, "danger": 1} and not plan.suggestions


def test_structural_change_recreates():
    plan = planner.plan_changes([users()], [users(order_by=("email",))])
    assert types_of(plan) == ["drop_table", "create_database", "create_table"] and plan.operations[0].risk == "danger"


def test_settings_ttl_indexes_projections():
    old = users(settings={"a": 1, "b": 2}, ttl="x", indexes=(SkipIndex("i", "id", "minmax"), SkipIndex("j", "id", "set")), projections=(Projection("p", "SELECT id"),))
    new = users(settings={"b": 3}, indexes=(SkipIndex("i", "email", "minmax"), SkipIndex("k", "id", "set")))
    ops = types_of(planner.plan_changes([old], [new]))
    assert sorted(ops) == sorted(["alter_table_reset_setting", "alter_table_modify_setting", "alter_table_modify_ttl", "alter_table_drop_index", "alter_table_drop_index", "alter_table_add_index", "alter_table_add_index", "alter_table_drop_projection"])
    assert max(i for i, o in enumerate(ops) if "drop_index" in o) < min(i for i, o in enumerate(ops) if "add_index" in o)


def test_drops_that_depend_on_a_column_come_before_it():
    old = users(indexes=(SkipIndex("i", "email", "minmax"),))
    new = users(columns=(Column("id", "UInt64"),))
    assert types_of(planner.plan_changes([old], [new])) == ["alter_table_drop_index", "alter_table_drop_column"]


def test_rename_suggestion_only_if_unique():
    one = planner.plan_changes([users()], [users(columns=(Column("id", "UInt64"), Column("mail", "String")))])
    assert [(s.source, s.target) for s in one.suggestions] == [("email", "mail")]
    two = planner.plan_changes([users()], [users(columns=(Column("id", "UInt64"), Column("mail", "String"), Column("post", "String")))])
    assert two.suggestions == []


def test_view_changes_recreate_at_caution():
    plan = planner.plan_changes([MaterializedView("a", "m", "SELECT 1", ("a", "t"))], [MaterializedView("a", "m", "SELECT 1", ("a", "u"))])
    assert types_of(plan) == ["drop_materialized_view", "create_database", "create_materialized_view"] and plan.risks["caution"] == 2


@settings(max_examples=40, deadline=None)
@given(st.randoms(use_true_random=False))
def test_plan_does_not_depend_on_order_and_second_plan_is_empty(rnd: random.Random):
    definitions = [users(), SINK, users(name="events"), View("app", "v", "SELECT 1"), MaterializedView("app", "m", "SELECT 1", ("app", "sink"))]
    shuffled = list(definitions)
    rnd.shuffle(shuffled)
    assert planner.plan_changes([], shuffled).operations == planner.plan_changes([], definitions).operations
    assert planner.plan_changes(shuffled, definitions).operations == []


def test_explicit_column_rename_replaces_pair():
    new = [users(columns=(Column("id", "UInt64"), Column("mail", "String", renamed_from="email")))]
    tables, columns = renames.from_schema(new)
    plan = renames.apply_column_renames(planner.plan_changes([users()], new), renames.active(columns, [users()], new), new)
    assert types_of(plan) == ["alter_table_rename_column"] and plan.risks["caution"] == 1 and plan.suggestions == []


def test_explicit_table_rename():
    new = [users(name="people", renamed_from="users")]
    tables, _ = renames.from_schema(new)
    plan = planner.plan_changes(renames.remap([users()], tables), new)
    plan = renames.apply_table_renames(plan, tables, {"app"})
    assert types_of(plan) == ["alter_table_rename_table"] and "app.users TO app.people" in plan.operations[0].sql


def test_rename_parsing_merging_conflicts():
    a, b = renames.parse_table_rename("x.a=x.b"), renames.parse_column_rename("x.t.c=d")
    assert a.old == ("x", "a") and b.table == ("x", "t") and b.new == "d"
    assert renames.merge([a], [renames.TableRename(("x", "a"), ("x", "z")), renames.TableRename(("x", "q"), ("x", "r"))]) == [a, renames.TableRename(("x", "q"), ("x", "r"))]
    assert renames.conflicts([a, renames.TableRename(("x", "b"), ("x", "c"))]) and renames.conflicts([a, renames.TableRename(("x", "a"), ("x", "c"))]) and not renames.conflicts([a])
    assert renames.unresolved([a], [], []) and not renames.unresolved([renames.TableRename(("app", "users"), ("app", "p"))], [users()], [users(name="p")])
    for bad in ("a=b", "x.a", "x.a=", "=x.b"):
        with pytest.raises(renames.RenameError):
            renames.parse_table_rename(bad)


@pytest.mark.parametrize("text, ok", [("t", True), ("t*", True), ("d.t", True), ("d.t*", True), ("*", False), ("d.*", False), ("a*b", False), ("*.t", False), ("d*.t", False), ("", False), (".t", False)])
def test_selectors(text, ok):
    if ok:
        scope.parse_selector(text)
    else:
        with pytest.raises(scope.SelectorError):
            scope.parse_selector(text)


def test_scope_filters_plan_and_snapshot():
    old, new = [users()], [users(columns=(Column("id", "UInt64"),)), users(name="events"), View("app", "v", "SELECT 1")]
    inside = scope.resolve(scope.parse_selector("app.ev*"), old, new)
    plan = scope.filter_plan(planner.plan_changes(old, new), inside)
    assert types_of(plan) == ["create_database", "create_table"] and plan.risks["danger"] == 0
    assert [d.name for d in scope.scoped_snapshot(old, new, inside)] == ["events", "users"]
    assert scope.pending_in_scope({"1": planner.plan_changes([], new).operations, "2": []}, inside) == ["1"]


def test_drift_codes():
    other = replace(
        SINK, columns=(*SINK.columns[1:], Column("more", "String")), engine="SharedReplacingMergeTree", primary_key=("tenant",), order_by=("tenant",), unique_key=("id",), partition_by=None, ttl=None,
        settings={}, indexes=(), projections=(),
    )
    found = drift.compare([SINK], [other])
    assert set(found.tables[0].reasons) == set(drift.TABLE_CODES) - {"changed_column"}
    assert drift.compare([SINK], [replace(SINK, settings={**SINK.settings, "other": 1})]).drifted is False
    quoted = drift.column_shape(Column("a", "Nullable(String)", default="fn:'x'")) == drift.column_shape(Column("a", "String", True, default="x"))
    report = drift.compare([users(), View("app", "v", "SELECT 1")], [View("app", "users", "SELECT 1"), users(name="z"), users(database="elsewhere")])
    assert quoted and report.summary() == {"extra_object": 1, "kind_mismatch": 1, "missing_object": 1}


def test_codegen_names_schemas_and_freshness(tmp_path):
    tables = [users(), Table("ap", "p_users", (Column("x", "Foo"),)), Table("app", "us_ers", (Column("x", "UInt8"),))]
    with pytest.raises(ValueError):
        codegen.render_schemas(tables)
    text, findings = codegen.render_schemas(tables, strict=False, ingest=True)
    assert len(findings) == 1 and codegen.unique_names([users(), users()])["app.users"] == "AppUsers_2"
    space: dict = {}
    exec(compile(text, "generated", "exec"), space)
    assert space["AppUsers"] == users().spark_schema() and callable(space["ingest_AppUsers"])
    path = str(tmp_path / "g.py")
    assert codegen.freshness(path, text) == "missing"
    (tmp_path / "g.py").write_text(text)
    assert codegen.freshness(path, text) == "fresh" and codegen.freshness(path, text + "#") == "stale"
    assert codegen.skipped([("app", "users", "table"), ("app", "d", "dictionary")], [users()]) == {"dictionary": 1}
    assert [codegen.type_name("a_b", "c d", s) for s in codegen.STYLES] == ["ABCD", "aBCD", "a_b_c_d"]


def test_plugins_fold_and_fail_by_name():
    seen = []
    add = plugins.Plugin("add", schema=lambda d: [*d, users(name="more")], before_apply=lambda n, s: [*s, "x"], init=lambda c: seen.append(c), check=lambda c: ["finding"], commands={"go": lambda a: len(a)})
    bad = plugins.Plugin("bad", plan=lambda p: 1 / 0, check=lambda c: 1 / 0)
    r = plugins.Runtime([add, plugins.Plugin("unshare", schema=plugins.unshare), bad])
    assert [d.engine for d in r.fold("schema", [users(engine="SharedMergeTree")])] == ["MergeTree()", "MergeTree()"]
    assert r.before_apply("m", ["a"]) == ["a", "x"] and r.command("add", "go", ["1", "2"]) == 2
    r.notify("init", {"a": 1})
    assert seen == [{"a": 1}] and r.findings({})["add"] == [plugins.Finding("finding")] and r.findings({})["bad"][0].code == "check_failed"
    with pytest.raises(plugins.PluginError, match="bad.plan"):
        r.fold("plan", None)
    with pytest.raises(plugins.PluginError):
        plugins.Runtime([add, add])
    with pytest.raises(plugins.PluginError):
        plugins.Runtime([plugins.Plugin("old", api_version=0)])


def test_plugins_are_loaded_by_name(tmp_path):
    (tmp_path / "mine.py").write_text("from strataflow.plans.plugins import Plugin\nplugin = Plugin('one')\ndef make():\n    return Plugin('two', needs_version='0.1')\nold = Plugin('old', needs_version='99.0')\n")
    assert plugins.load("mine.py", str(tmp_path)).name == "one" and plugins.load("mine.py:make", str(tmp_path)).name == "two"
    for entry in ("mine.py:nope", "gone.py", "no_such_module:x"):
        with pytest.raises(plugins.PluginError):
            plugins.load(entry, str(tmp_path))
    with pytest.raises(plugins.PluginError, match="99.0"):
        plugins.Runtime([plugins.load("mine.py:old", str(tmp_path))])
