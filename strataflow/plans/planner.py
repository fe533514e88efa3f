"""Changes between two sets of definitions: operations with a risk, in an order that can be applied.

Unlike a purely textual order, index and projection drops come before the column drops they may depend on.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from . import ddl
from .model import Column, Definition, MaterializedView, Table, assert_valid, canonical_all, key_of

RISKS = ("safe", "caution", "danger")
_CREATE = {"table": "create_table", "view": "create_view", "materialized_view": "create_materialized_view"}
_DROP = {"table": "drop_table", "view": "drop_view", "materialized_view": "drop_materialized_view"}


@dataclass(frozen=True)
class Operation:
    type: str
    key: str
    risk: str
    sql: str


@dataclass(frozen=True)
class Suggestion:
    """A dropped and an added column that differ by name only."""

    database: str
    table: str
    source: str
    target: str
    drop_key: str
    add_key: str
    sql: str
    confidence: str = "high"


@dataclass
class Plan:
    operations: list[Operation] = field(default_factory=list)
    suggestions: list[Suggestion] = field(default_factory=list)

    @property
    def risks(self) -> dict[str, int]:
        n = Counter(o.risk for o in self.operations)
        return {r: n[r] for r in RISKS}


def diff_named(old: Iterable[Any], new: Iterable[Any], same: Callable[[Any, Any], bool]) -> tuple[list, list, list[tuple]]:
    """(added, removed, changed pairs) of named things."""
    before, after = {x.name: x for x in old}, {x.name: x for x in new}
    added = [x for n, x in after.items() if n not in before]
    removed = [x for n, x in before.items() if n not in after]
    return added, removed, [(before[n], x) for n, x in after.items() if n in before and not same(before[n], x)]


def diff_settings(old: dict[str, Any], new: dict[str, Any]) -> list[tuple[str, str, Any]]:
    """(reset or modify, name, value) by name."""
    out = []
    for k in sorted(old.keys() | new.keys()):
        if k not in new:
            out.append(("reset", k, None))
        elif old.get(k) != new[k]:
            out.append(("modify", k, new[k]))
    return out


def needs_recreate(old: Table, new: Table) -> bool:
    return any(getattr(old, k) != getattr(new, k) for k in ("engine", "primary_key", "order_by", "partition_by", "unique_key"))


def suggest_renames(table: Table, added: list[Column], dropped: list[Column]) -> list[Suggestion]:
    """One suggestion where exactly one added column has the dropped one's signature; each is used once."""
    by_signature: dict[tuple, list[Column]] = defaultdict(list)
    for c in added:
        by_signature[c.signature()].append(c)
    out = []
    base = f"table:{table.database}.{table.name}"
    for c in dropped:
        found = by_signature.get(c.signature(), [])
        if len(found) == 1:
            new = by_signature.pop(c.signature())[0]
            sql = ddl.rename_column(table, c.name, new.name)
            out.append(Suggestion(table.database, table.name, c.name, new.name, f"{base}:column:{c.name}", f"{base}:column:{new.name}", sql))
    return sorted(out, key=lambda s: (s.source, s.target))


def diff_tables(old: Table, new: Table) -> Plan:
    """What turns one table into the other: a new table if its storage layout differs, else single changes."""
    base = f"table:{new.database}.{new.name}"
    plan = Plan()

    def add(type_: str, key: str, risk: str, sql: str) -> None:
        plan.operations.append(Operation(type_, key, risk, sql))

    if needs_recreate(old, new):
        add("drop_table", base, "danger", ddl.drop(old))
        add("create_table", base, "safe", ddl.create(new))
        return plan
    added, dropped, changed = diff_named(old.columns, new.columns, lambda a, b: a.signature() == b.signature())
    for c in added:
        add("alter_table_add_column", f"{base}:column:{c.name}", "safe", ddl.add_column(new, c))
    for _, c in changed:
        add("alter_table_modify_column", f"{base}:column:{c.name}", "caution", ddl.modify_column(new, c))
    for c in dropped:
        add("alter_table_drop_column", f"{base}:column:{c.name}", "danger", ddl.drop_column(new, c.name))
    for what in ("index", "projection"):
        many = "indexes" if what == "index" else "projections"
        more, gone, other = diff_named(getattr(old, many), getattr(new, many), lambda a, b: a == b)
        make, remove = (ddl.add_index, ddl.drop_index) if what == "index" else (ddl.add_projection, ddl.drop_projection)
        for x in [*gone, *(a for a, _ in other)]:
            add(f"alter_table_drop_{what}", f"{base}:{what}:{x.name}", "caution", remove(new, x.name))
        for x in [*more, *(b for _, b in other)]:
            add(f"alter_table_add_{what}", f"{base}:{what}:{x.name}", "caution", make(new, x))
    for how, name, value in diff_settings(old.settings, new.settings):
        sql = ddl.modify_setting(new, name, value) if how == "modify" else ddl.reset_setting(new, name)
        add(f"alter_table_{how}_setting", f"{base}:setting:{name}", "caution", sql)
    if old.ttl != new.ttl:
        add("alter_table_modify_ttl", f"{base}:ttl", "caution", ddl.modify_ttl(new))
    plan.suggestions = suggest_renames(new, added, dropped)
    return plan


_LATE_DROPS = ("alter_table_drop_column",)


def rank(operation: Operation) -> int:
    t = operation.type
    if t.startswith("drop_"):
        return 0
    if t.startswith("alter_"):
        return 1
    return {"create_database": 2, "create_table": 3, "create_view": 4, "create_materialized_view": 5}[t]


def ordered(operations: list[Operation]) -> list[Operation]:
    """By rank and key. Inside a table, drops of indexes and projections go first and drops of columns last."""

    def order(item: tuple[int, Operation]):
        seq, o = item
        if rank(o) != 1:
            return rank(o), o.key, 0, o.key, seq
        step = 0 if o.type in ("alter_table_drop_index", "alter_table_drop_projection") else 2 if o.type in _LATE_DROPS else 1
        return 1, ":".join(o.key.split(":")[:2]), step, o.key, seq

    return [o for _, o in sorted(enumerate(operations), key=order)]


def plan_changes(old: list[Definition], new: list[Definition]) -> Plan:
    """The plan from old to new definitions; the new ones must be valid."""
    assert_valid(new)
    before = {key_of(d): d for d in canonical_all(old)}
    after = {key_of(d): d for d in canonical_all(new)}
    plan = Plan()
    ops = plan.operations
    for k, d in before.items():
        if k not in after:
            ops.append(Operation(_DROP[d.kind], k, "danger", ddl.drop(d)))
    databases: set[str] = set()
    for k, d in after.items():
        o = before.get(k)
        if o is None:
            ops.append(Operation(_CREATE[d.kind], k, "safe", ddl.create(d)))
            databases.add(d.database)
        elif isinstance(d, Table):
            part = diff_tables(o, d)
            ops += part.operations
            plan.suggestions += part.suggestions
            if any(x.type == "create_table" for x in part.operations):
                databases.add(d.database)
        elif (o.query, o.comment) != (d.query, d.comment) or (isinstance(d, MaterializedView) and o.to != d.to):
            ops.append(Operation(_DROP[d.kind], k, "caution", ddl.drop(o)))
            ops.append(Operation(_CREATE[d.kind], k, "caution", ddl.create(d)))
            databases.add(d.database)
    for db in sorted(databases):
        ops.append(Operation("create_database", f"database:{db}", "safe", ddl.create_database(db)))
    plan.operations = ordered(ops)
    plan.suggestions.sort(key=lambda s: (s.database, s.table, s.source, s.target))
    return plan
