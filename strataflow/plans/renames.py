"""Explicit renames: from flags or from the schema, checked, and folded into a plan."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from . import ddl
from .model import Definition, Table
from .planner import Operation, Plan


class RenameError(ValueError):
    """A mapping that cannot be read or applied."""


@dataclass(frozen=True)
class TableRename:
    old: tuple[str, str]
    new: tuple[str, str]


@dataclass(frozen=True)
class ColumnRename:
    table: tuple[str, str]
    old: str
    new: str


def _name(text: str) -> tuple[str, str]:
    parts = [p.strip() for p in text.split(".")]
    if len(parts) != 2 or not all(parts):
        raise RenameError(f"expected database.table, not {text!r}")
    return parts[0], parts[1]


def parse_table_rename(text: str) -> TableRename:
    """``old_db.old=new_db.new``"""
    left, sign, right = text.partition("=")
    if not sign:
        raise RenameError(f"expected old_db.old=new_db.new, not {text!r}")
    return TableRename(_name(left), _name(right))


def parse_column_rename(text: str) -> ColumnRename:
    """``db.table.old=new``"""
    left, sign, new = text.partition("=")
    parts = [p.strip() for p in left.split(".")]
    if not sign or len(parts) != 3 or not all(parts) or not new.strip():
        raise RenameError(f"expected db.table.old=new, not {text!r}")
    return ColumnRename((parts[0], parts[1]), parts[2], new.strip())


def from_schema(definitions: list[Definition]) -> tuple[list[TableRename], list[ColumnRename]]:
    """Renames that tables and columns declare."""
    tables, columns = [], []
    for d in definitions:
        if not isinstance(d, Table):
            continue
        here = (d.database, d.name)
        if d.renamed_from:
            old = _name(d.renamed_from) if "." in d.renamed_from else (d.database, d.renamed_from)
            tables.append(TableRename(old, here))
        columns += [ColumnRename(here, c.renamed_from, c.name) for c in d.columns if c.renamed_from]
    return tables, columns


def merge(given: list, declared: list) -> list:
    """Given renames win over declared ones that share a source or a target (inside the same table, for columns)."""
    scope = lambda r: getattr(r, "table", None)
    taken = {(scope(r), "old", r.old) for r in given} | {(scope(r), "new", r.new) for r in given}
    return given + [r for r in declared if (scope(r), "old", r.old) not in taken and (scope(r), "new", r.new) not in taken]


def _columns(definitions: list[Definition]) -> dict[tuple[str, str], set[str]]:
    return {(d.database, d.name): {c.name for c in d.columns} for d in definitions if isinstance(d, Table)}


def active(renames: list, old: list[Definition], new: list[Definition]) -> list:
    """Renames with a source in the old and a target in the new definitions."""
    before, after = _columns(old), _columns(new)
    out = []
    for r in renames:
        if isinstance(r, TableRename):
            keep = r.old in before and r.new in after
        else:
            keep = r.old in before.get(r.table, ()) and r.new in after.get(r.table, ())
        out += [r] if keep else []
    return out


def conflicts(renames: list) -> list[str]:
    """One source to several targets, several sources to one target, and chains or cycles of tables."""
    targets, sources = defaultdict(set), defaultdict(set)
    for r in renames:
        scope = getattr(r, "table", None)
        targets[scope, r.old].add(r.new)
        sources[scope, r.new].add(r.old)
    out = [f"{old} is renamed to several: {sorted(map(str, n))}" for (_, old), n in targets.items() if len(n) > 1]
    out += [f"several are renamed to {new}: {sorted(map(str, n))}" for (_, new), n in sources.items() if len(n) > 1]
    out += [f"{old} is both source and target" for (scope, old) in targets if scope is None and (scope, old) in sources]
    return sorted(out)


def unresolved(renames: list, old: list[Definition], new: list[Definition]) -> list[str]:
    """Why given renames cannot be applied."""
    before, after = _columns(old), _columns(new)
    out = []
    for r in renames:
        if isinstance(r, TableRename):
            out += [] if r.old in before else [f"source table {'.'.join(r.old)} is not in the previous schema"]
            out += [] if r.new in after else [f"target table {'.'.join(r.new)} is not in the new schema"]
        else:
            place = ".".join(r.table)
            out += [] if r.old in before.get(r.table, ()) else [f"source column {place}.{r.old} is not in the previous schema"]
            out += [] if r.new in after.get(r.table, ()) else [f"target column {place}.{r.new} is not in the new schema"]
    return out


def remap(old: list[Definition], tables: list[TableRename]) -> list[Definition]:
    """Old tables under their new names, so that the diff sees one table and not a drop and a creation."""
    to = {r.old: r.new for r in tables}
    return [replace(d, database=to[d.database, d.name][0], name=to[d.database, d.name][1]) if isinstance(d, Table) and (d.database, d.name) in to else d for d in old]


def apply_table_renames(plan: Plan, tables: list[TableRename], known: set[str]) -> Plan:
    """Drops and creations of whole renamed tables become RENAME TABLE; ``known``: databases that exist."""
    gone = {f"table:{a}.{b}" for r in tables for a, b in (r.old, r.new)}
    ops = [o for o in plan.operations if not (o.key in gone and o.type in ("drop_table", "create_table"))]
    for r in tables:
        ops.append(Operation("alter_table_rename_table", f"table:{'.'.join(r.new)}", "caution", ddl.rename_table(*r.old, *r.new)))
        key = f"database:{r.new[0]}"
        if r.new[0] not in known and all(o.key != key for o in ops):
            ops.append(Operation("create_database", key, "safe", ddl.create_database(r.new[0])))
    return Plan(pipeline_order(ops), plan.suggestions)


def apply_column_renames(plan: Plan, columns: list[ColumnRename], definitions: list[Definition]) -> Plan:
    """A dropped and an added column become RENAME COLUMN; other changes of the new column stay."""
    tables = {(d.database, d.name): d for d in definitions if isinstance(d, Table)}
    ops, used = list(plan.operations), set()
    for r in columns:
        base = f"table:{'.'.join(r.table)}"
        drop, add = f"{base}:column:{r.old}", f"{base}:column:{r.new}"
        types = {(o.type, o.key) for o in ops}
        if ("alter_table_drop_column", drop) in types and ("alter_table_add_column", add) in types:
            ops = [o for o in ops if (o.type, o.key) not in {("alter_table_drop_column", drop), ("alter_table_add_column", add)}]
            ops.append(Operation("alter_table_rename_column", add, "caution", ddl.rename_column(tables[r.table], r.old, r.new)))
            used.add((drop, add))
    kept = [s for s in plan.suggestions if all(s.drop_key != d and s.add_key != a for d, a in used)]
    return Plan(pipeline_order(ops), kept)


def pipeline_rank(o: Operation) -> int:
    if o.type.startswith("drop_"):
        return 0
    fixed = {"create_database": 1, "alter_table_rename_table": 2, "create_table": 4, "create_view": 5, "create_materialized_view": 6}
    return fixed.get(o.type, 3)


def pipeline_order(operations: list[Operation]) -> list[Operation]:
    """Databases and table renames come before other alterations; ties keep the order they have."""
    return [o for _, o in sorted(enumerate(operations), key=lambda x: (pipeline_rank(x[1]), x[1].key if pipeline_rank(x[1]) != 3 else "", x[0]))]


