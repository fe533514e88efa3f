import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strataflow import cli
from strataflow.plans import ddl, planner
from strataflow.plans.model import Column, Projection, SkipIndex, Table, View, canonical
from strataflow.plans.plugins import Finding, Plugin
from strataflow.sources import catalog, files, journal

USERS = Table("app_t", "users", (Column("id", "UInt64"), Column("email", "String")), primary_key=("id",), order_by=("id",))


def test_schema_files(tmp_path):
    (tmp_path / "a.py").write_text("from strataflow.plans.model import *\n_hidden = View('x', 'h', 'SELECT 1')\nnested = [[View('x', 'v', 'SELECT 1')]]\n")
    (tmp_path / "b.json").write_text(json.dumps([{"kind": "view", "database": "x", "name": "w", "query": "SELECT 2"}, {"kind": "other"}]))
    assert [d.name for d in files.load_schema(["*.py", "*.json"], str(tmp_path))] == ["v", "w"]
    with pytest.raises(files.SchemaNotFound):
        files.load_schema(["*.nope"], str(tmp_path))


def test_migration_files_roundtrip(tmp_path):
    now = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    plan = planner.plan_changes([USERS], [])
    out = files.write_artifacts(plan, [], str(tmp_path / "m"), str(tmp_path / "meta"), "Drop It!", now=now)
    assert out["migration"].endswith("20260102030405_drop_it_.sql")
    text = files.list_migrations(str(tmp_path / "m"))["20260102030405_drop_it_.sql"]
    assert files.operations_in(text) == plan.operations and [w.code for w in files.destructive("m", text)] == ["drop_table_data_loss"] and len(files.statements(text)) == 1
    assert files.write_artifacts(planner.Plan(), [], str(tmp_path / "m"), str(tmp_path / "meta"))["migration"] is None
    assert files.migration_name(None, "a/b", now) == "ab_auto.sql"


def test_atomic_write_leaves_nothing_behind(tmp_path):
    path = tmp_path / "x" / "f.txt"
    files.write_atomically(str(path), "1")
    with pytest.raises(TypeError):
        files.write_atomically(str(path), 5)
    assert path.read_text() == "1" and [p.name for p in path.parent.iterdir()] == ["f.txt"]


def test_journal_apply_status_and_gates(spark, tmp_path):
    log = journal.Journal(spark, str(tmp_path / "journal"))
    drop = files.render_migration(planner.plan_changes([USERS], []), 0, "1", dt.datetime.now(dt.UTC))
    contents, ran = {"1.sql": "A; B", "2.sql": drop}, []
    with pytest.raises(journal.DestructiveBlocked) as e:
        journal.apply_migrations(log, contents, ran.append)
    assert e.value.warnings[0].key == "table:app_t.users" and ran == []
    assert journal.apply_migrations(log, contents, ran.append, only={"1.sql"}) == ["1.sql"] and ran == ["A", "B"]
    (tmp_path / "m").mkdir()
    for name, text in contents.items():
        (tmp_path / "m" / name).write_text(text)
    table = files.migration_table(spark, str(tmp_path / "m"))
    assert journal.status(table, log.read()) == journal.Status(2, 1, 1, 0)
    (tmp_path / "m" / "1.sql").write_text("changed")
    state = journal.status(files.migration_table(spark, str(tmp_path / "m")), log.read())
    assert state.mismatches == 1 and journal.check_findings(state, True, {"p": [Finding("x")], "q": [Finding("y", "warn")]}, False, ("checksum",)) == ["checksum_mismatch", "plugin:p"]
    assert journal.check_findings(state, True, {}, True) == ["pending_migrations", "checksum_mismatch", "schema_drift"] and journal.check_findings(state, None, {}, True) == ["pending_migrations", "checksum_mismatch"]
    with pytest.raises(journal.ChecksumMismatch):
        journal.apply_migrations(log, {"1.sql": "changed"}, ran.append)

    def fail(statement):
        raise RuntimeError(statement)

    with pytest.raises(RuntimeError):
        journal.apply_migrations(log, {"1.sql": "A; B", "3.sql": "C"}, fail)
    assert {r.name for r in log.read().collect()} == {"1.sql"}


def test_catalog_copy_and_swap(spark):
    catalog.create(spark, USERS)
    spark.sql("INSERT INTO app_t.users VALUES (1, 'a'), (2, 'b')")
    assert canonical(catalog.describe(spark, "app_t", "users")) == canonical(USERS)
    more = Table("app_t", "users", (*USERS.columns, Column("age", "UInt8", True)), primary_key=("id",), order_by=("id",), ttl="t + INTERVAL 1 DAY", indexes=(SkipIndex("i", "email", "set", 1, "10"),))
    assert catalog.alter(spark, USERS, more) == "columns"
    assert canonical(catalog.describe(spark, "app_t", "users")) == canonical(more)
    other = Table("app_t", "users", (Column("mail", "String"), Column("id", "Int64"), Column("src", "String", default="web")), order_by=("id",))
    assert catalog.alter(spark, more, other, {"email": "mail"}) == "rewrite"
    assert sorted(map(tuple, spark.table("app_t.users").collect())) == [("a", 1, "web"), ("b", 2, "web")]
    assert canonical(catalog.describe(spark, "app_t", "users")) == canonical(other)
    spark.sql("ALTER TABLE app_t.users RENAME TO app_t.users__previous")  # as if interrupted between the two renames
    catalog.recover(spark, "app_t", "users")
    assert spark.table("app_t.users").count() == 2
    catalog.rename_table(spark, ("app_t", "users"), ("app_t2", "people")) if spark.sql("CREATE DATABASE IF NOT EXISTS app_t2") is not None else None
    assert spark.table("app_t2.people").count() == 2 and not spark.catalog.tableExists("app_t.users")
    catalog.create(spark, View("app_t2", "v", "SELECT toDate('2024-01-01') AS d FROM app_t2.people"))
    assert {(r.name, r.kind) for r in catalog.objects(spark, ["app_t2"]).collect()} == {("people", "table"), ("v", "view")}
    assert [r.name for r in catalog.views(spark, ["app_t2"]).collect()] == ["v"] and {d.kind for d in catalog.describe_all(spark, ["app_t2"])} == {"table", "view"}
    catalog.insert(spark.createDataFrame([(9,)], "id int"), "app_t2.people")
    assert spark.table("app_t2.people").where("id = 9 and mail is null").count() == 1


def test_indexes_projections_and_ttl_do_something(spark):
    t = Table("ix_t", "e", (Column("id", "Int64"), Column("user", "Int64"), Column("at", "DateTime")), order_by=("id",), projections=(Projection("Per_user", "SELECT user, count() AS n GROUP BY user"),), ttl="at + INTERVAL 1 DAY")
    catalog.create(spark, t)
    rows = spark.range(1000).select((1000 - F.col("id")).alias("id"), (F.col("id") % 10).alias("user"), F.when(F.col("id") < 300, F.lit("2020-01-01")).otherwise(F.lit("2999-01-01")).cast("timestamp").alias("at"))
    catalog.insert(rows.coalesce(1), "ix_t.e")
    assert [r.id for r in spark.table("ix_t.e").limit(3).collect()] == [1, 2, 3]  # sorted by the key in its file
    (companion,) = catalog.refresh_projections(spark, t)
    assert {r.n for r in spark.table(companion).collect()} == {100} and {r.name for r in catalog.objects(spark, ["ix_t"]).collect()} == {"e"}
    more = replace(t, indexes=(SkipIndex("b", "id", "bloom_filter", 1, "0.02"),), projections=())
    assert catalog.alter(spark, catalog.describe(spark, "ix_t", "e"), more) == "properties" and not spark.catalog.tableExists(companion)
    assert canonical(catalog.describe(spark, "ix_t", "e")) == canonical(more)
    catalog.insert(spark.range(5000, 300_000).select(F.xxhash64("id").alias("id"), F.lit(77).alias("user"), F.lit("2999-01-01").cast("timestamp").alias("at")).coalesce(1), "ix_t.e")
    jvm, sizes = spark._jvm, []
    for path in spark.table("ix_t.e").inputFiles():
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
        group = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source).getRowGroups().get(0)
        sizes.append((group.getRowCount() > 1000, group.getColumns().get(0).getBloomFilterOffset() > 0))
    assert sorted(sizes) == [(False, False), (True, True)]  # files written after the index have its filter
    without = replace(more, indexes=())
    assert catalog.alter(spark, more, without) == "properties" and ddl.file_options(without) == {} and catalog._pairs(catalog._metadata(spark, "ix_t.e").storage().properties())["parquet.bloom.filter.enabled#id"] == "false"
    assert catalog.expire(spark, "ix_t", "e") == 300 and spark.table("ix_t.e").where("user < 10").count() == 700 and catalog.expire(spark, "ix_t", "e") == 0
    catalog.drop(spark, more)
    assert not spark.catalog.tableExists("ix_t.e")


def run(capsys, *argv, plugins=()):
    code = cli.Cli(list(plugins)).main(["--json", *argv])
    return code, json.loads(capsys.readouterr().out.strip().split("\n")[-1])


def test_command_line_end_to_end(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert run(capsys, "init")[1]["created"] == ["strataflow.json", "schema/example.py"]
    schema = tmp_path / "schema" / "example.py"
    head = "from strataflow.plans.model import *\n"
    schema.write_text(head + "t = Table('cli_t', 'ev', (Column('id', 'Int64'), Column('at', 'DateTime')), order_by=('id',))\nu = Table('cli_t', 'ev_b', (Column('id', 'Int64'),))\n")
    code, out = run(capsys, "generate", "--dryrun")
    assert code == 0 and out["risks"]["safe"] == 3 and out["schema_version"] == 1
    assert run(capsys, "--table", "nothing*", "generate")[1]["operations"] == []
    assert run(capsys, "--table", "*", "generate")[0] == 2
    run(capsys, "generate", "--migration-id", "001")
    assert run(capsys, "generate", "--migration-id", "002")[1]["migration"] is None
    assert run(capsys, "migrate")[1]["pending"] == ["001_auto.sql"] and run(capsys, "check")[0] == 1
    assert run(capsys, "migrate", "--apply")[1]["applied"] == ["001_auto.sql"]
    assert run(capsys, "status")[1]["applied"] == 1 and run(capsys, "drift")[1]["drifted"] is False and run(capsys, "check", "--strict")[0] == 0
    spark.sql("INSERT INTO cli_t.ev VALUES (1, timestamp'2024-01-01 05:00:00'), (2, timestamp'2024-01-01 09:00:00')")
    schema.write_text(head + "t = Table('cli_t', 'ev', (Column('key', 'Int64'), Column('at', 'DateTime'), Column('n', 'UInt8', True)), order_by=('key',))\n")
    code, out = run(capsys, "generate", "--migration-id", "003", "--rename-column", "cli_t.ev.id=key")
    assert code == 0 and {o["type"] for o in out["operations"]} >= {"drop_table"}
    assert run(capsys, "migrate", "--apply")[0] == 3
    assert run(capsys, "generate", "--rename-table", "a.b=c.d")[0] == 2
    assert run(capsys, "migrate", "--apply", "--allow-destructive")[0] == 0 and run(capsys, "drift")[1]["drifted"] is False
    assert run(capsys, "codegen", "--check")[0] == 1 and run(capsys, "codegen", "--emit-ingest")[0] == 0 and run(capsys, "codegen", "--check", "--emit-ingest")[0] == 0
    code, out = run(capsys, "pull", "--dryrun", "--database", "cli_t")
    assert code == 0 and [d["name"] for d in json.loads(out["content"])] == ["ev"]
    assert run(capsys, "pull", "--database", "cli_t")[0] == 0 and run(capsys, "pull", "--database", "cli_t")[0] == 1
    hello = Plugin("hello", commands={"go": lambda args: 7}, check=lambda c: ["bad"])
    assert run(capsys, "plugin", "hello", "go", plugins=[hello])[0] == 7 and run(capsys, "check", plugins=[hello])[0] == 1
    (tmp_path / "schema" / "pulled.json").unlink()
    blocked = cli.Cli(confirm=lambda q: False)
    schema.write_text(head + "t = Table('cli_t', 'ev', (Column('key', 'Int64'), Column('at', 'DateTime')), order_by=('key',))\n")
    assert [o["type"] for o in run(capsys, "generate", "--migration-id", "004")[1]["operations"]] == ["alter_table_drop_column"]
    assert blocked.main(["migrate", "--apply"]) == 3 and cli.Cli(confirm=lambda q: "`n`" not in q and "drop_column" in q).main(["migrate", "--apply"]) == 0
    capsys.readouterr()
    (tmp_path / "more.py").write_text("from strataflow.plans.plugins import Plugin, Finding\nplugin = Plugin('more', check=lambda c: [Finding('soft', 'warn')], commands={'n': lambda a: 5})\n")
    (tmp_path / "strataflow_config.py").write_text("def config(env):\n    return {'plugins': ['more.py'], 'migrations': env.get('MY_MIGRATIONS', 'migrations')}\n")
    (tmp_path / "strataflow.json").unlink()
    code, out = run(capsys, "check")
    assert code == 0 and out["plugins"]["more"]["findings"][0]["code"] == "soft" and out["plugins"]["backfill"]["ok"] and out["drift_evaluated"]
    assert run(capsys, "plugin", "more", "n")[0] == 5 and run(capsys, "--config", "none.json", "status")[0] == 2
    monkeypatch.setenv("MY_MIGRATIONS", "elsewhere")
    assert run(capsys, "status")[1]["total"] == 0
    (tmp_path / "strataflow.json").write_text('{"nope": 1}')
    assert run(capsys, "status")[0] == 2


def test_command_line_backfill(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "schema").mkdir()
    (tmp_path / "schema" / "s.py").write_text(
        "from strataflow.plans.model import *\n"
        "e = Table('bf_t', 'events', (Column('id', 'Int64'), Column('ts', 'DateTime')), order_by=('ts',))\n"
        "h = Table('bf_t', 'hourly', (Column('n', 'Int64'), Column('hour', 'DateTime')), engine='SummingMergeTree(n)', order_by=('hour',))\n"
        "m = MaterializedView('bf_t', 'mv', 'SELECT toStartOfHour(ts) AS hour, count() AS n FROM bf_t.events GROUP BY hour', ('bf_t', 'hourly'))\n"
    )
    spark.sql("CREATE DATABASE IF NOT EXISTS bf_t")
    spark.sql("CREATE TABLE bf_t.events USING parquet AS SELECT id, timestamp'2024-01-01 00:30:00' + make_dt_interval(0, CAST(id AS INT)) AS ts FROM range(10)")
    code, plan = run(capsys, "backfill", "plan", "--target", "bf_t.hourly", "--from", "2024-01-01", "--to", "2024-01-01T10:00:00Z", "--chunk-hours", "4")
    assert code == 0 and plan["chunks"] == 3 and plan["strategy"] == "view" and plan["column"] == "ts"
    code, out = run(capsys, "backfill", "run", "--plan-id", plan["id"], "--simulate-fail-chunk", "1", "--simulate-fail-count", "1")
    assert code == 0 and out["rows"] == 10 and out["attempts"] == 4
    assert run(capsys, "backfill", "status", "--plan-id", plan["id"])[1]["status"] == "completed" and run(capsys, "backfill", "doctor", "--plan-id", plan["id"])[0] == 0
    assert run(capsys, "backfill", "cancel", "--plan-id", plan["id"])[0] == 1 and run(capsys, "backfill", "resume", "--plan-id", plan["id"])[0] == 0
    assert run(capsys, "backfill", "plan", "--target", "x", "--from", "2024-01-01", "--to", "2024-01-02")[0] == 2


def test_each_file_goes_to_its_own_state(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "schema").mkdir()
    schema = tmp_path / "schema" / "s.py"
    columns = lambda *names: schema.write_text("from strataflow.plans.model import *\nt = Table('pf_t', 'ev', (" + "".join(f"Column('{n}', 'Int64')," for n in names) + "), order_by=('id',))\n")
    for number, names in (("001", ("id", "a")), ("002", ("id", "a", "b")), ("003", ("id", "b"))):
        columns(*names)
        run(capsys, "generate", "--migration-id", number)
    late = (tmp_path / "migrations" / "003_auto.sql").rename(tmp_path / "late.sql")
    assert run(capsys, "migrate", "--apply")[1]["applied"] == ["001_auto.sql", "002_auto.sql"] and spark.table("pf_t.ev").columns == ["id", "a", "b"]
    spark.sql("INSERT INTO pf_t.ev VALUES (1, 2, 3)")
    late.rename(tmp_path / "migrations" / "003_auto.sql")
    assert run(capsys, "migrate", "--apply")[0] == 3 and spark.table("pf_t.ev").columns == ["id", "a", "b"]
    assert run(capsys, "migrate", "--apply", "--allow-destructive")[0] == 0 and [tuple(r) for r in spark.table("pf_t.ev").collect()] == [(1, 3)]


def test_materialized_views_end_to_end(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "schema").mkdir()
    schema = tmp_path / "schema" / "s.py"
    tables = (
        "from strataflow.plans.model import *\n"
        "e = Table('mv_t', 'events', (Column('id', 'Int64'), Column('ts', 'DateTime')), order_by=('ts',))\n"
        "h = Table('mv_t', 'hourly', (Column('hour', 'DateTime'), Column('n', 'Int64')), engine='SummingMergeTree(n)', order_by=('hour',))\n"
        "v = View('mv_t', 'late', 'SELECT id, toDate(ts) AS day FROM mv_t.events')\n"
    )
    view = "m = MaterializedView('mv_t', 'mv', 'SELECT toStartOfHour(ts) AS hour, count() AS n FROM mv_t.events GROUP BY hour', ('mv_t', 'hourly'))\n"
    schema.write_text(tables + view)
    run(capsys, "generate", "--migration-id", "001")
    assert run(capsys, "migrate", "--apply")[0] == 0 and run(capsys, "drift")[1]["drifted"] is False and run(capsys, "check", "--strict")[0] == 0
    assert {(r.name, r.kind) for r in catalog.objects(spark, ["mv_t"]).collect()} >= {("mv", "materialized_view"), ("late", "view")}
    code, out = run(capsys, "pull", "--dryrun", "--database", "mv_t")
    pulled = {d["name"]: d for d in json.loads(out["content"])}
    assert pulled["mv"]["kind"] == "materialized_view" and list(pulled["mv"]["to"]) == ["mv_t", "hourly"] and "toStartOfHour" in pulled["mv"]["query"] and out["skipped"] == {}
    (tmp_path / "pulled.json").write_text(out["content"])
    assert planner.plan_changes(files.load_schema(["pulled.json"], str(tmp_path)), files.load_schema(["schema/s.py"], str(tmp_path))).operations == []
    assert run(capsys, "codegen", "--include-views", "--style", "camel", "--emit-ingest", "--ingest-out-file", "ingest.py")[0] == 0
    made = {}
    exec((tmp_path / "generated_schemas.py").read_text(), made)
    assert made["read_mvTLate"](spark).columns == ["id", "day"] and "def ingest_" in (tmp_path / "ingest.py").read_text() and "def ingest_" not in (tmp_path / "generated_schemas.py").read_text()
    schema.write_text(tables)
    run(capsys, "generate", "--migration-id", "002")
    assert run(capsys, "migrate", "--apply", "--allow-destructive")[0] == 0 and run(capsys, "drift")[1]["drifted"] is False
    assert "mv" not in {r.name for r in catalog.objects(spark, ["mv_t"]).collect()} and spark.catalog.tableExists("mv_t.hourly")
