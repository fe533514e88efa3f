"""Table selectors, and plans, snapshots and migrations restricted to them."""

from __future__ import annotations

from dataclasses import dataclass

from .model import Definition, Table, canonical_all, key_of
from .planner import Operation, Plan
from .renames import TableRename


class SelectorError(ValueError):
    """A selector other than table, table_prefix*, db.table or db.table_prefix*."""


@dataclass(frozen=True)
class Selector:
    database: str | None
    value: str
    prefix: bool

    def matches(self, database: str, table: str) -> bool:
        return self.database in (None, database) and (table.startswith(self.value) if self.prefix else table == self.value)


def parse_selector(text: str) -> Selector:
    text = text.strip()
    left, dot, right = text.partition(".")
    database, table = (left.strip(), right.strip()) if dot else (None, text)
    prefix = table.endswith("*")
    value = table[:-1] if prefix else table
    if not value or "*" in value or (database is not None and (not database or "*" in database)):
        raise SelectorError(f"selector {text!r}: expected table, table_prefix*, db.table or db.table_prefix*")
    return Selector(database, value, prefix)


def resolve(selector: Selector, *sources: list[Definition]) -> list[tuple[str, str]]:
    """The tables of any source that match, sorted."""
    return sorted({(d.database, d.name) for s in sources for d in s if isinstance(d, Table) and selector.matches(d.database, d.name)})


def table_of(key: str) -> tuple[str, str] | None:
    """Database and table in an operation's key, if it is one of a table."""
    parts = key.split(":")
    if parts[0] != "table" or len(parts) < 2 or "." not in parts[1]:
        return None
    database, _, name = parts[1].partition(".")
    return database, name


def _closed(tables: set[tuple[str, str]], renames: list[TableRename]) -> set[tuple[str, str]]:
    out = set(tables)
    while True:
        more = {x for r in renames if r.old in out or r.new in out for x in (r.old, r.new)} - out
        if not more:
            return out
        out |= more


def filter_plan(plan: Plan, tables: list[tuple[str, str]], renames: list[TableRename] = ()) -> Plan:
    """Operations of the tables (and of those they are renamed from or to) and of their databases; views go."""
    inside = _closed(set(tables), list(renames))
    databases = {d for d, _ in inside}

    def keep(o: Operation) -> bool:
        if o.type == "create_database":
            return o.key.partition(":")[2] in databases
        return table_of(o.key) in inside

    return Plan([o for o in plan.operations if keep(o)], [s for s in plan.suggestions if (s.database, s.table) in inside])


def scoped_snapshot(old: list[Definition], new: list[Definition], tables: list[tuple[str, str]]) -> list[Definition]:
    """The old definitions, with the tables as they are in the new ones (or gone with them)."""
    inside = set(tables)
    is_in = lambda d: isinstance(d, Table) and (d.database, d.name) in inside
    return canonical_all([d for d in old if not is_in(d)] + [d for d in new if is_in(d)])


def pending_in_scope(files: dict[str, list[Operation]], tables: list[tuple[str, str]]) -> list[str]:
    """Names of migrations with at least one operation on the tables."""
    inside = set(tables)
    return sorted(name for name, ops in files.items() if any(table_of(o.key) in inside for o in ops))


def keys(definitions: list[Definition]) -> list[str]:
    return [key_of(d) for d in definitions]
