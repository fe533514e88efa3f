"""Schema modules, migration files and snapshots on disk, and the statements and markers inside them."""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import importlib.util
import json
import os
import re
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_statements
from ..plans.model import Definition, MaterializedView, Table, View, canonical_all, from_dict, snapshot
from ..plans.planner import Operation, Plan

MARK = "-- operation: "


class SchemaNotFound(FileNotFoundError):
    """No file matches the schema patterns."""


def collect_definitions(value: Any) -> list[Definition]:
    """Definitions in a value, in nested lists and tuples, or as dictionaries with a known kind."""
    if isinstance(value, (Table, View, MaterializedView)):
        return [value]
    if isinstance(value, dict) and value.get("kind") in ("table", "view", "materialized_view"):
        return [from_dict(value)]
    if isinstance(value, (list, tuple)):
        return [d for x in value for d in collect_definitions(x)]
    return []


def load_schema(patterns: Iterable[str], root: str = ".") -> list[Definition]:
    """Definitions of all files that match: public names of Python modules, or lists in JSON files."""
    paths = sorted({p for pattern in patterns for p in glob.glob(os.path.join(root, pattern), recursive=True)})
    if not paths:
        raise SchemaNotFound(f"no schema file matches {list(patterns)}")
    out: list[Definition] = []
    for path in paths:
        if path.endswith(".json"):
            with open(path) as f:
                out += collect_definitions(json.load(f))
            continue
        spec = importlib.util.spec_from_file_location(f"schema_{hashlib.sha256(path.encode()).hexdigest()[:12]}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        for name, value in vars(module).items():
            if not name.startswith("_"):
                out += collect_definitions(value)
    return canonical_all(out)


def write_atomically(path: str, text: str) -> None:
    """A temporary file beside the target, then a rename: readers see the old or the new file, never half of one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=".tmp-")
    try:
        with os.fdopen(handle, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def migration_name(name: str | None, id_: str | None, now: dt.datetime) -> str:
    """``<stamp or id>_<name>.sql`` in characters that are safe everywhere."""
    stamp = re.sub(r"[^A-Za-z0-9_-]", "", id_) if id_ else now.strftime("%Y%m%d%H%M%S")
    return f"{stamp}_{re.sub(r'[^A-Za-z0-9_-]', '_', name or 'auto').lower()}.sql"


def render_migration(plan: Plan, definitions: int, version: str, now: dt.datetime) -> str:
    risks = ", ".join(f"{k}={n}" for k, n in plan.risks.items())
    head = [
        "-- migration-format: v1",
        f"-- generated-at: {now.isoformat()}",
        f"-- version: {version}",
        f"-- definition-count: {definitions}",
        f"-- operation-count: {len(plan.operations)}",
        f"-- risk-summary: {risks}",
        *(f"-- rename-suggestion: table={s.database}.{s.table} from={s.source} to={s.target}" for s in plan.suggestions),
    ]
    return "\n\n".join(["\n".join(head), *(f"{MARK}{o.type} key={o.key} risk={o.risk}\n{o.sql}" for o in plan.operations)]) + "\n"


def write_artifacts(plan: Plan, definitions: list[Definition], migrations: str, meta: str, name: str | None = None, id_: str | None = None, version: str = "1", now: dt.datetime | None = None) -> dict[str, str | None]:
    """The migration file and the snapshot that it leads to, if there is any operation, and the last snapshot, always."""
    now = now or dt.datetime.now(dt.UTC)
    path, held = None, json.dumps(snapshot(definitions, now), indent=2) + "\n"
    if plan.operations:
        path = os.path.join(migrations, migration_name(name, id_, now))
        write_atomically(snapshot_of(meta, path), held)
        write_atomically(path, render_migration(plan, len(definitions), version, now))
    target = os.path.join(meta, "snapshot.json")
    write_atomically(target, held)
    return {"migration": path, "snapshot": target}


def snapshot_of(meta: str, migration: str) -> str:
    """Where the definitions lie that a migration file leads to."""
    return os.path.join(meta, "snapshots", os.path.basename(migration).removesuffix(".sql") + ".json")


def operations_in(text: str) -> list[Operation]:
    """Operation markers of a migration, with the statements below each."""
    out, mark, body = [], None, []

    def flush() -> None:
        if mark:
            out.append(Operation(*mark, "\n".join(body).strip()))

    for line in text.split("\n"):
        m = re.match(r"--\s*operation:\s*(\S+)\s+key=(\S+)\s+risk=(\S+)\s*$", line.strip())
        if m:
            flush()
            mark, body = (m[1], m[2], m[3]), []
        elif mark:
            body.append(line)
    flush()
    return out


@dataclass(frozen=True)
class Warning_:
    migration: str
    type: str
    key: str
    code: str
    reason: str
    impact: str
    advice: str


# The warning codes. The texts say what the operation does in Spark's catalog: (code, what is done, who notices, what to look at).
_WARNINGS = {
    "drop_table": (
        "drop_table_data_loss",
        "DROP TABLE deletes the table's folder in the warehouse with every Parquet file in it",
        "running scans fail on files that are not there any more; views over the table stay and fail when they are read",
        "DESCRIBE EXTENDED shows the folder: copy it, or rename the table for a while instead",
    ),
    "alter_table_drop_column": (
        "drop_column_irreversible",
        "the table is copied without the column and exchanged for the copy, after which the old files are deleted",
        "queries and views that name the column no longer resolve; SELECT * has one column less",
        "search the declared views and projections for the name, and save the column beside its key if it may be wanted again",
    ),
    "drop_view": (
        "drop_view_dependency_break",
        "the catalog entry with the query text is deleted; no rows are",
        "a view or job that reads it fails at its next analysis",
        "see that the same migration creates its successor, or that no declared view names it",
    ),
    "drop_materialized_view": (
        "drop_view_dependency_break",
        "the catalog entry is deleted, and streams that maintain the target have no query to start from; the target's rows stay",
        "the target keeps what it has while its source goes on",
        "note when the stream stops: a replay of that window fills the gap",
    ),
}
_OTHER = (
    "destructive_operation_review_required",
    "the statement was planned with risk danger and has no rule of its own here",
    "unknown",
    "run the migration on a copy of the warehouse first",
)


def destructive(migration: str, text: str) -> list[Warning_]:
    return [Warning_(migration, o.type, o.key, *_WARNINGS.get(o.type, _OTHER)) for o in operations_in(text) if o.risk == "danger"]


def statements(text: str) -> list[str]:
    return split_statements(text)


def migration_table(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content, checksum) of every migration, by name."""
    files = spark.read.text(os.path.join(folder, "*.sql"), wholetext=True).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return files.select("name", F.col("value").alias("content"), F.sha2("value", 256).alias("checksum")).orderBy("name")


def list_migrations(folder: str) -> dict[str, str]:
    """Contents by name, sorted."""
    if not os.path.isdir(folder):
        return {}
    out = {}
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".sql")):
        with open(os.path.join(folder, name)) as f:
            out[name] = f.read()
    return out


def checksum(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
