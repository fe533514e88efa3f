"""Command line: ``python -m strataflow.cli COMMAND``. ``--json`` prints one object with ``schema_version`` 1.

Exit codes: 0 done, 1 failed or a finding, 2 wrong configuration or arguments, 3 a dangerous operation was blocked.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import runpy
import sys
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession

from .plans import codegen, drift, planner, renames, replay, runstate, scope
from .plans.model import Definition, read_snapshot
from .plans.plugins import Plugin, PluginError, Runtime, load
from .sources import catalog, files, journal

CONFIG = "strataflow.json"
CONFIGS = (CONFIG, "strataflow_config.py")


@dataclass
class Config:
    schema: tuple[str, ...] = ("schema/**/*.py", "schema/**/*.json")
    migrations: str = "migrations"
    meta: str = "meta"
    journal: str = "meta/journal"
    warehouse: str = "warehouse"
    allow_destructive: bool = False
    fail_on: tuple[str, ...] = ("pending", "checksum", "drift")
    generated: str = "generated_schemas.py"
    ingest_file: str | None = None
    plugins: tuple[str, ...] = ()
    backfill_required: bool = True


class ConfigError(ValueError):
    """A configuration file that cannot be used."""


def load_config(path: str | None, environment: Mapping[str, str] = os.environ) -> Config:
    """Settings from a JSON file, or from ``config`` in a Python file: a dictionary, or a function of the environment that
    returns one. A file that is named must be there."""
    given, path = path, path or next((p for p in CONFIGS if os.path.exists(p)), CONFIGS[0])
    if not os.path.exists(path):
        if given:
            raise ConfigError(f"{path} is not there")
        return Config()
    if path.endswith(".py"):
        raw = runpy.run_path(path).get("config")
        raw = raw(dict(environment)) if callable(raw) else raw
    else:
        with open(path) as f:
            raw = json.load(f)
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} has no settings")
    unknown = set(raw) - {f.name for f in fields(Config)}
    if unknown:
        raise ConfigError(f"unknown settings {sorted(unknown)}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def _ask(question: str) -> bool:
    """False without asking where there is no terminal."""
    return sys.stdin.isatty() and not os.environ.get("CI") and input(question).strip().lower() in ("y", "yes")


def _session(config: Config) -> SparkSession:
    return SparkSession.builder.config("spark.sql.warehouse.dir", os.path.abspath(config.warehouse)).config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Cli:
    """``plugins`` come before those that the configuration names, of which one with a name that is taken is left out; ``confirm``
    answers whether dangerous operations may run, where somebody is there to ask."""

    def __init__(self, plugins: list[Plugin] | None = None, confirm: Callable[[str], bool] | None = None):
        self.given, self.runtime, self.confirm = list(plugins or []), Runtime([]), confirm or _ask

    def parser(self) -> argparse.ArgumentParser:
        p = argparse.ArgumentParser(prog="strataflow")
        p.add_argument("--config")
        p.add_argument("--json", action="store_true")
        p.add_argument("--table")
        sub = p.add_subparsers(dest="command", required=True)
        add = lambda name: sub.add_parser(name)
        many = lambda text: [x for x in text.split(",") if x]
        add("init")
        g = add("generate")
        g.add_argument("--name")
        g.add_argument("--migration-id")
        g.add_argument("--rename-table", type=many, default=[])
        g.add_argument("--rename-column", type=many, default=[])
        g.add_argument("--dryrun", action="store_true")
        m = add("migrate")
        for flag in ("--apply", "--execute", "--allow-destructive"):
            m.add_argument(flag, action="store_true")
        add("status")
        add("drift")
        add("check").add_argument("--strict", action=argparse.BooleanOptionalAction, default=False)
        x = add("plugin")
        x.add_argument("name", nargs="?")
        x.add_argument("plugin_command", nargs="?")
        x.add_argument("rest", nargs=argparse.REMAINDER)
        c = add("codegen")
        c.add_argument("--check", action="store_true")
        c.add_argument("--out-file")
        c.add_argument("--emit-ingest", action="store_true")
        c.add_argument("--ingest-out-file")
        c.add_argument("--include-views", action="store_true")
        c.add_argument("--style", choices=codegen.STYLES, default="pascal")
        c.add_argument("--integers", choices=("exact", "long"), default="exact")
        c.add_argument("--lenient", action="store_true")
        u = add("pull")
        u.add_argument("--dryrun", action="store_true")
        u.add_argument("--force", "--overwrite", action="store_true")
        u.add_argument("--out-file", default="schema/pulled.json")
        u.add_argument("--database", action="append")
        b = add("backfill").add_subparsers(dest="action", required=True)
        bp = b.add_parser("plan")
        for flag, name in (("--target", "target"), ("--from", "start"), ("--to", "end")):
            bp.add_argument(flag, required=True, dest=name)
        bp.add_argument("--chunk-hours", type=float, default=6)
        bp.add_argument("--time-column")
        bp.add_argument("--max-parallel", type=int, default=1)
        bp.add_argument("--max-attempts", type=int, default=3)
        bp.add_argument("--force-large-window", action="store_true")
        bp.add_argument("--force", action="store_true")
        for name in ("run", "resume"):
            r = b.add_parser(name)
            r.add_argument("--plan-id", required=True)
            r.add_argument("--max-attempts", type=int)
            for flag in ("--replay-done", "--replay-failed", "--force-overlap", "--force-compatibility", "--force-environment"):
                r.add_argument(flag, action="store_true")
            if name == "run":
                r.add_argument("--simulate-fail-chunk", type=int)
                r.add_argument("--simulate-fail-count", type=int, default=1)
        for name in ("status", "cancel", "doctor"):
            b.add_parser(name).add_argument("--plan-id", required=True)
        return p

    def main(self, argv: list[str]) -> int:
        args = self.parser().parse_args(argv)
        try:
            config = load_config(args.config)
            self.runtime = self._plugins(args, config)
            self.runtime.notify("init", {"command": args.command})
            self.runtime.notify("config", asdict(config))
            name = args.command if args.command != "backfill" else f"backfill_{args.action}"
            code, payload = getattr(self, f"do_{name}")(args, config)
            self.runtime.notify("complete", {"command": args.command, "code": code})
        except journal.DestructiveBlocked as e:
            code, payload = 3, {"error": "destructive_blocked", "operations": [asdict(w) for w in e.warnings]}
        except (ConfigError, PluginError, scope.SelectorError, renames.RenameError, replay.ReplayError) as e:
            code, payload = 2, {"error": type(e).__name__, "message": str(e)}
        except (journal.ChecksumMismatch, runstate.StateError, files.SchemaNotFound, ValueError) as e:
            code, payload = 1, {"error": type(e).__name__, "message": str(e)}
        if args.json:
            print(json.dumps({"schema_version": 1, "command": args.command, **payload}, default=str))
        else:
            for k, v in payload.items():
                print(f"{k}: {v}")
        return code

    def _plugins(self, args, config: Config) -> Runtime:
        folder = os.path.dirname(os.path.abspath(args.config or CONFIG))
        names = {p.name for p in self.given}
        loaded = [p for p in (load(entry, folder) for entry in config.plugins) if p.name not in names]
        own = Plugin("backfill", check=lambda context: runstate.check(self._store(config), config.backfill_required))
        return Runtime([*self.given, *loaded, *([own] if "backfill" not in names | {p.name for p in loaded} else [])])

    def _definitions(self, config: Config) -> list:
        return self.runtime.fold("schema", files.load_schema(config.schema))

    def _scope(self, args, *sources) -> list[tuple[str, str]] | None:
        return scope.resolve(scope.parse_selector(args.table), *sources) if args.table else None

    def do_init(self, args, config: Config):
        made = []
        if not os.path.exists(CONFIG):
            files.write_atomically(CONFIG, json.dumps(asdict(config), indent=2) + "\n")
            made.append(CONFIG)
        example = "schema/example.py"
        if not os.path.exists(example):
            text = 'from strataflow.plans.model import Column, Table\n\nevents = Table("app", "events", (Column("id", "Int64"), Column("at", "DateTime")), order_by=("id",))\n'
            files.write_atomically(example, text)
            made.append(example)
        return 0, {"created": made}

    def do_generate(self, args, config: Config):
        new = self._definitions(config)
        old = read_snapshot(os.path.join(config.meta, "snapshot.json")) or []
        tables, columns = renames.from_schema(new)
        given_t, given_c = [renames.parse_table_rename(x) for x in args.rename_table], [renames.parse_column_rename(x) for x in args.rename_column]
        if errors := renames.unresolved(given_t, old, new):
            raise renames.RenameError("; ".join(errors))
        tables = renames.active(renames.merge(given_t, tables), old, new)
        if errors := renames.conflicts(tables):
            raise renames.RenameError("; ".join(errors))
        moved = renames.remap(old, tables)
        if errors := renames.unresolved(given_c, moved, new):
            raise renames.RenameError("; ".join(errors))
        columns = renames.active(renames.merge(given_c, columns), moved, new)
        if errors := renames.conflicts(columns):
            raise renames.RenameError("; ".join(errors))
        inside = self._scope(args, old, new)
        if inside is not None and not inside:
            return 0, {"operations": [], "scope": []}
        plan = planner.plan_changes(moved, new)
        plan = renames.apply_table_renames(plan, tables, {d.database for d in old})
        plan = renames.apply_column_renames(plan, columns, new)
        plan = self.runtime.fold("plan", plan)
        target = new
        if inside is not None:
            plan = scope.filter_plan(plan, inside, tables)
            target = scope.scoped_snapshot(moved, new, inside)
        payload = {"operations": [asdict(o) for o in plan.operations], "risks": plan.risks, "rename_suggestions": [asdict(s) for s in plan.suggestions]}
        if not args.dryrun:
            payload |= files.write_artifacts(plan, target, config.migrations, config.meta, args.name, args.migration_id)
        return 0, payload

    def do_migrate(self, args, config: Config):
        spark, contents = _session(config), files.list_migrations(config.migrations)
        log = journal.Journal(spark, config.journal)
        only = None
        if args.table:
            new = self._definitions(config)
            old = read_snapshot(os.path.join(config.meta, "snapshot.json")) or []
            only = set(scope.pending_in_scope({n: files.operations_in(c) for n, c in contents.items()}, self._scope(args, old, new)))
        if not (args.apply or args.execute):
            done = {r.name for r in log.read().collect()}
            waiting = [n for n in contents if n not in done and (only is None or n in only)]
            return 0, {"mode": "plan", "pending": waiting}
        # Files hold the declared dialect; Spark gets to the same state object by object, from the definitions that each file leads to.
        apply = Applier(spark, config.meta, contents)
        allowed = args.allow_destructive or config.allow_destructive
        while True:
            try:
                done = journal.apply_migrations(
                    log, contents, apply.statement, allowed, lambda n, s: apply.begin(n, self.runtime.before_apply(n, s)),
                    lambda n, s: self.runtime.notify("after_apply", n, s), only=only,
                )
                return 0, {"mode": "apply", "applied": done}
            except journal.DestructiveBlocked as e:  # raised before anything is applied
                lines = [f"{w.migration}: {w.type} {w.key}: {w.reason}; {w.impact}; {w.advice}" for w in e.warnings]
                if args.json or not self.confirm("\n".join([*lines, "Apply all the same? [y/N] "])):
                    raise
                allowed = True

    def _state(self, spark: SparkSession, config: Config) -> journal.Status:
        contents = files.list_migrations(config.migrations)
        rows = spark.createDataFrame([(n, c, files.checksum(c)) for n, c in contents.items()], "name string, content string, checksum string")
        return journal.status(rows, journal.Journal(spark, config.journal).read())

    def do_status(self, args, config: Config):
        return 0, asdict(self._state(_session(config), config))

    def _drift(self, args, config: Config) -> drift.DriftReport:
        expected = read_snapshot(os.path.join(config.meta, "snapshot.json")) or []
        inside = self._scope(args, expected)
        if inside is not None:
            expected = [d for d in expected if (d.database, d.name) in set(inside)]
        spark = _session(config)
        actual = catalog.describe_all(spark, {d.database for d in expected})
        if inside is not None:
            actual = [d for d in actual if (d.database, d.name) in set(inside)]
        return drift.compare(expected, actual)

    def do_drift(self, args, config: Config):
        r = self._drift(args, config)
        return 0, {"drifted": r.drifted, "objects": r.objects, "tables": [asdict(t) for t in r.tables], "summary": r.summary()}

    def do_check(self, args, config: Config):
        state = self._state(_session(config), config)
        known = os.path.exists(os.path.join(config.meta, "snapshot.json"))
        r = self._drift(args, config) if known else None
        found = self.runtime.findings({"status": asdict(state), "drift": r})
        self.runtime.notify("report", asdict(state), [x for v in found.values() for x in v])
        failed = journal.check_findings(state, r.drifted if r else None, found, args.strict, config.fail_on)
        codes = {name: {"ok": f"plugin:{name}" not in failed, "findings": [asdict(x) for x in v]} for name, v in found.items()}
        payload = {"ok": not failed, "failed": failed, "status": asdict(state), "drifted": bool(r and r.drifted), "drift_evaluated": known}
        return int(bool(failed)), {**payload, "drift": r.summary() if r else {}, "plugins": codes}

    def do_plugin(self, args, config: Config):
        if not args.name:
            return 0, {"plugins": {p.name: sorted(p.commands) for p in self.runtime.plugins}}
        return self.runtime.command(args.name, args.plugin_command, args.rest), {"plugin": args.name, "command": args.plugin_command}

    def do_codegen(self, args, config: Config):
        definitions, apart = self._definitions(config), args.ingest_out_file or config.ingest_file
        make = lambda ingest: codegen.render_schemas(definitions, args.style, args.integers, not args.lenient, ingest, args.include_views)
        text, findings = make(args.emit_ingest and not apart)
        files_ = {args.out_file or config.generated: text}
        if args.emit_ingest and apart:
            files_[apart] = make(True)[0]
        states = {path: codegen.freshness(path, t) for path, t in files_.items()}
        payload = {"file": next(iter(files_)), "findings": findings, "files": states}
        if args.check:
            stale = [p for p, s in states.items() if s != "fresh"]
            return int(bool(stale)), {**payload, "state": states[stale[0]] if stale else "fresh"}
        for path, t in files_.items():
            files.write_atomically(path, t)
        return 0, {**payload, "was": states[payload["file"]]}

    def do_pull(self, args, config: Config):
        spark = _session(config)
        found = catalog.describe_all(spark, args.database)
        text = codegen.render_schema_file(found)
        objects = [(r.database, r.name, r.kind) for r in catalog.objects(spark, args.database).collect()]
        payload = {"objects": len(found), "skipped": codegen.skipped(objects, found)}
        if args.dryrun:
            return 0, {**payload, "content": text}
        if os.path.exists(args.out_file) and not args.force:
            return 1, {**payload, "error": "exists", "message": f"{args.out_file} exists; force to overwrite"}
        files.write_atomically(args.out_file, text)
        return 0, {**payload, "file": args.out_file}

    def _store(self, config: Config) -> runstate.Store:
        return runstate.Store(os.path.join(config.meta, "backfill"))

    def do_backfill_plan(self, args, config: Config):
        definitions, target = self._definitions(config), replay.parse_target(args.target)
        source = replay.source_table(definitions, target)
        view = replay.view_for(definitions, target)
        column = replay.time_column(source, args.time_column)
        plan = runstate.make_plan(
            self._store(config), args.target, args.start, args.end, column, "view" if view else "table", runstate.Options(args.chunk_hours, args.max_parallel, args.max_attempts),
            os.path.abspath(config.warehouse), args.force_large_window, args.force,
        )
        return 0, {**asdict(plan), "chunks": len(runstate.plan_chunks(plan))}

    def _execute(self, config: Config, plan: runstate.Plan, fail_chunk: int | None = None, fail_count: int = 0):
        spark, definitions, target = _session(config), self._definitions(config), replay.parse_target(plan.target)
        view, source = replay.view_for(definitions, target), replay.source_table(definitions, target)
        table = next(d for d in definitions if d.kind == "table" and (d.database, d.name) == target)
        out = replay.Target(spark, os.path.join(os.path.abspath(config.warehouse), "replay", plan.target), table.spark_schema())
        left = {fail_chunk: fail_count}
        order = {c.id: k for k, c in enumerate(runstate.plan_chunks(plan))}

        def execute(chunk: replay.Chunk) -> int:
            k = order[chunk.id]
            if left.get(k, 0) > 0:
                left[k] -= 1
                raise RuntimeError("simulated failure")
            rows = spark.table(f"{source.database}.{source.name}")
            names = [c.name for c in table.columns]
            if view:
                fn = replay.view_function(spark, view.query, f"{source.database}.{source.name}")
                return out.apply(chunk.token, replay.replay(rows, fn, plan.column, chunk.start, chunk.end, names), chunk.force)
            return out.apply(chunk.token, replay.self_replay(rows, table, plan.column, chunk.start, chunk.end), chunk.force)

        return execute

    def _run(self, args, config: Config, resume: bool):
        store = self._store(config)
        plan = store.plan(args.plan_id)
        options = plan.run_options()
        if args.max_attempts:
            options = replace(options, max_attempts=args.max_attempts)
        execute = self._execute(config, plan, getattr(args, "simulate_fail_chunk", None), getattr(args, "simulate_fail_count", 0))
        run = runstate.execute_run(
            store, plan.id, execute, options, resume, args.replay_done, args.replay_failed, args.force_overlap, args.force_compatibility,
            args.force_environment, os.path.abspath(config.warehouse),
        )
        return int(run.status != "completed"), asdict(runstate.status(store, plan.id))

    def do_backfill_run(self, args, config: Config):
        return self._run(args, config, False)

    def do_backfill_resume(self, args, config: Config):
        return self._run(args, config, True)

    def do_backfill_status(self, args, config: Config):
        s = runstate.status(self._store(config), args.plan_id)
        return int(s.status == "failed"), asdict(s)

    def do_backfill_cancel(self, args, config: Config):
        return 0, {"status": runstate.cancel(self._store(config), args.plan_id).status}

    def do_backfill_doctor(self, args, config: Config):
        report = runstate.doctor(self._store(config), args.plan_id)
        return int(bool(report["issues"])), report


class Applier:
    """Applies the operations of migration files to Spark's catalog, one by one in their order.

    Alterations of one table in one file are applied together, at the first of them: the table goes to the state in the
    snapshot of that file, which the file's operations lead to (files without one of their own use the last snapshot). What later
    files change stays as it is until they are applied. Renames of columns in the file carry their values over.
    """

    def __init__(self, spark: SparkSession, meta: str, contents: dict[str, str]):
        self.spark, self.meta, self.contents = spark, meta, contents
        self.state: dict[tuple[str, str], Definition] = {}
        self.by_sql: dict[str, planner.Operation] = {}
        self.altered: set[tuple[str, str]] = set()
        self.renamed: dict[tuple[str, str], dict[str, str]] = {}

    def begin(self, name: str, statements: list[str]) -> list[str]:
        found = read_snapshot(files.snapshot_of(self.meta, name))
        if found is None:
            found = read_snapshot(os.path.join(self.meta, "snapshot.json")) or []
        self.state = {(d.database, d.name): d for d in found}
        clean = lambda s: s.rstrip().rstrip(";").strip()
        ops = files.operations_in(self.contents[name])
        self.by_sql = {clean(o.sql): o for o in ops}
        self.altered, self.renamed = set(), {}
        for o in ops:
            if o.type == "alter_table_rename_column" and (m := re.search(r"RENAME COLUMN `(.+?)` TO `(.+?)`", o.sql)):
                self.renamed.setdefault(scope.table_of(o.key), {})[m[1]] = m[2]
        return [clean(s) for s in statements]

    def statement(self, sql: str) -> None:
        o = self.by_sql.get(sql)
        if o is None:
            catalog.run(self.spark, sql)  # a statement that a plugin added is Spark SQL
            return
        kind, _, place = o.key.partition(":")
        if o.type == "create_database":
            catalog.run(self.spark, f"CREATE DATABASE IF NOT EXISTS {place}")
            return
        database, _, name = place.split(":")[0].partition(".")
        d = self.state.get((database, name))
        if o.type.startswith("drop_"):
            catalog.drop_named(self.spark, database, name, o.type == "drop_table")
        elif o.type == "alter_table_rename_table":
            old, new = (tuple(x.split(".")) for x in sql.removeprefix("RENAME TABLE ").split(" TO "))
            catalog.run(self.spark, f"CREATE DATABASE IF NOT EXISTS {new[0]}")
            catalog.rename_table(self.spark, old, new)
        elif o.type.startswith("create_"):
            if d is not None:
                catalog.create(self.spark, d)
        elif d is not None and (database, name) not in self.altered:
            catalog.alter(self.spark, catalog.describe(self.spark, database, name), d, self.renamed.get((database, name)))
            self.altered.add((database, name))


def main() -> None:
    sys.exit(Cli().main(sys.argv[1:]))


if __name__ == "__main__":
    main()
