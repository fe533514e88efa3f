"""Expected definitions against what is there: missing, extra and differing objects."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from ..functions.text import normalize_clause, normalize_engine, normalize_fragment
from .ddl import default_value
from .model import Column, Definition, Projection, SkipIndex, Table, canonical_all

# Reason codes.
OBJECT_CODES = ("missing_object", "extra_object", "kind_mismatch")
TABLE_CODES = (
    "missing_column", "extra_column", "changed_column", "setting_mismatch", "index_mismatch", "ttl_mismatch", "engine_mismatch", "primary_key_mismatch",
    "order_by_mismatch", "unique_key_mismatch", "partition_by_mismatch", "projection_mismatch",
)


def column_shape(c: Column) -> tuple:
    """What decides whether columns differ; a default compares as its value, however it is written."""
    default = "" if c.default is None else normalize_fragment(default_value(c.default))
    if len(default) > 1 and default[0] == default[-1] == "'":
        default = default[1:-1].replace("''", "'")
    inner = c.type.strip()
    nullable = c.nullable or inner.startswith("Nullable(")
    inner = inner.removeprefix("Nullable(").removesuffix(")") if inner.startswith("Nullable(") else inner
    return inner, nullable, default, (c.comment or "").strip()


def index_shape(i: SkipIndex) -> tuple:
    return normalize_clause(i.expression), i.type, i.type_args, int(i.granularity)


def projection_shape(p: Projection) -> str:
    return normalize_fragment(p.query)


def differing(expected: dict, actual: dict) -> tuple[list, list, list]:
    """(missing, extra, changed) names, sorted."""
    missing = sorted(expected.keys() - actual.keys())
    extra = sorted(actual.keys() - expected.keys())
    return missing, extra, sorted(k for k in expected.keys() & actual.keys() if expected[k] != actual[k])


@dataclass
class TableDrift:
    table: str
    reasons: list[str] = field(default_factory=list)
    missing_columns: list[str] = field(default_factory=list)
    extra_columns: list[str] = field(default_factory=list)
    changed_columns: list[str] = field(default_factory=list)
    settings: list[str] = field(default_factory=list)
    indexes: list[str] = field(default_factory=list)
    projections: list[str] = field(default_factory=list)


def compare_tables(expected: Table, actual: Table) -> TableDrift | None:
    """None if they agree. Settings count only where they are expected; what else is set there is its own business."""
    d = TableDrift(f"{expected.database}.{expected.name}")
    shapes = lambda xs, f: {x.name: f(x) for x in xs}
    d.missing_columns, d.extra_columns, d.changed_columns = differing(shapes(expected.columns, column_shape), shapes(actual.columns, column_shape))
    d.settings = sorted(k for k, v in expected.settings.items() if str(actual.settings.get(k)) != str(v))
    d.indexes = sorted(x for part in differing(shapes(expected.indexes, index_shape), shapes(actual.indexes, index_shape)) for x in part)
    d.projections = sorted(x for part in differing(shapes(expected.projections, projection_shape), shapes(actual.projections, projection_shape)) for x in part)
    keys = lambda t, k: normalize_clause(", ".join(getattr(t, k)))
    found = {
        "missing_column": d.missing_columns,
        "extra_column": d.extra_columns,
        "changed_column": d.changed_columns,
        "setting_mismatch": d.settings,
        "index_mismatch": d.indexes,
        "ttl_mismatch": normalize_fragment(expected.ttl or "") != normalize_fragment(actual.ttl or ""),
        "engine_mismatch": normalize_engine(normalize_fragment(expected.engine)).lower() != normalize_engine(normalize_fragment(actual.engine)).lower(),
        "primary_key_mismatch": keys(expected, "primary_key") != keys(actual, "primary_key"),
        "order_by_mismatch": keys(expected, "order_by") != keys(actual, "order_by"),
        "unique_key_mismatch": keys(expected, "unique_key") != keys(actual, "unique_key"),
        "partition_by_mismatch": normalize_clause(expected.partition_by) != normalize_clause(actual.partition_by),
        "projection_mismatch": d.projections,
    }
    d.reasons = [code for code in TABLE_CODES if found[code]]
    return d if d.reasons else None


@dataclass
class DriftReport:
    objects: list[tuple[str, str]]  # (code, database.name)
    tables: list[TableDrift]

    @property
    def drifted(self) -> bool:
        return bool(self.objects or self.tables)

    def summary(self) -> dict[str, int]:
        """How often each code was found."""
        n = Counter(code for code, _ in self.objects) + Counter(code for t in self.tables for code in t.reasons)
        return dict(sorted(n.items()))


def compare(expected: list[Definition], actual: list[Definition]) -> DriftReport:
    """Actual objects of other databases than the expected ones don't count as extra."""
    name = lambda d: f"{d.database}.{d.name}"
    want = {name(d): d for d in canonical_all(expected)}
    databases = {d.database for d in want.values()}
    have = {name(d): d for d in canonical_all(actual) if d.database in databases}
    objects, tables = [], []
    for k, d in want.items():
        other = have.get(k)
        if other is None:
            objects.append(("missing_object", k))
        elif other.kind != d.kind:
            objects.append(("kind_mismatch", k))
        elif isinstance(d, Table) and isinstance(other, Table) and (found := compare_tables(d, other)):
            tables.append(found)
    objects += [("extra_object", k) for k in have if k not in want]
    return DriftReport(sorted(objects, key=lambda x: (x[1], x[0])), sorted(tables, key=lambda t: t.table))
