"""Declared objects: tables, views, materialized views; their normal form, checks and snapshots."""

from __future__ import annotations

import datetime as dt
import json
import os
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..functions.text import key_columns, normalize_engine, normalize_fragment
from ..functions.types import struct_field

KINDS = ("table", "view", "materialized_view")
# Skip index types and validation codes.
INDEX_TYPES = ("minmax", "set", "bloom_filter", "tokenbf_v1", "ngrambf_v1")
ISSUE_CODES = (
    "duplicate_object_name", "duplicate_column_name", "duplicate_index_name", "duplicate_projection_name",
    "primary_key_missing_column", "order_by_missing_column",
)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False
    default: str | int | float | bool | None = None
    comment: str | None = None
    renamed_from: str | None = None

    def signature(self) -> tuple:
        """All that describes the column but its name."""
        return self.type, self.nullable, self.default, self.comment


@dataclass(frozen=True)
class SkipIndex:
    name: str
    expression: str
    type: str
    granularity: int = 1
    type_args: str | None = None


@dataclass(frozen=True)
class Projection:
    name: str
    query: str


@dataclass(frozen=True)
class Table:
    database: str
    name: str
    columns: tuple[Column, ...]
    engine: str = "MergeTree()"
    primary_key: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    unique_key: tuple[str, ...] = ()
    partition_by: str | None = None
    ttl: str | None = None
    settings: dict[str, Any] = field(default_factory=dict, hash=False)
    indexes: tuple[SkipIndex, ...] = ()
    projections: tuple[Projection, ...] = ()
    comment: str | None = None
    plugins: dict[str, Any] = field(default_factory=dict, hash=False)
    renamed_from: str | None = None
    kind: str = field(default="table", init=False)

    def spark_schema(self, integers: str = "exact") -> T.StructType:
        return T.StructType([struct_field(c.name, c.type, c.nullable, integers, default=c.default, comment=c.comment, renamed_from=c.renamed_from) for c in self.columns])


@dataclass(frozen=True)
class View:
    database: str
    name: str
    query: str
    comment: str | None = None
    kind: str = field(default="view", init=False)


@dataclass(frozen=True)
class MaterializedView:
    database: str
    name: str
    query: str
    to: tuple[str, str] = ("", "")
    comment: str | None = None
    kind: str = field(default="materialized_view", init=False)


Definition = Table | View | MaterializedView


def key_of(d: Definition) -> str:
    return f"{d.kind}:{d.database}.{d.name}"


def canonical(d: Definition) -> Definition:
    """Trimmed names, normal SQL fragments and engines, split keys, named parts by name (columns keep their order)."""
    clean = lambda x: normalize_fragment(x) if x is not None else None
    strip = lambda x: x.strip() if isinstance(x, str) else x
    base = {"database": d.database.strip(), "name": d.name.strip(), "comment": strip(d.comment)}
    if not isinstance(d, Table):
        more = {"to": tuple(x.strip() for x in d.to)} if isinstance(d, MaterializedView) else {}
        return replace(d, **base, query=clean(d.query), **more)
    return replace(
        d,
        **base,
        columns=tuple(replace(c, name=c.name.strip(), type=c.type.strip(), default=strip(c.default), comment=strip(c.comment)) for c in d.columns),
        engine=normalize_engine(d.engine),
        primary_key=tuple(key_columns(list(d.primary_key))),
        order_by=tuple(key_columns(list(d.order_by))),
        unique_key=tuple(key_columns(list(d.unique_key))),
        partition_by=clean(d.partition_by),
        ttl=clean(d.ttl),
        settings=dict(sorted(d.settings.items())),
        indexes=tuple(sorted((replace(i, name=i.name.strip(), expression=clean(i.expression)) for i in d.indexes), key=lambda i: i.name)),
        projections=tuple(sorted((replace(p, name=p.name.strip(), query=clean(p.query)) for p in d.projections), key=lambda p: p.name)),
    )


def canonical_all(definitions: list[Definition]) -> list[Definition]:
    """Normal forms, the last of each key, in order of kind, database and name (code points)."""
    last = {key_of(c): c for c in map(canonical, definitions)}
    return sorted(last.values(), key=lambda d: (KINDS.index(d.kind), d.database, d.name))


@dataclass(frozen=True)
class Issue:
    code: str
    kind: str
    database: str
    name: str
    message: str


class ValidationError(ValueError):
    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(f"{i.code}: {i.message}" for i in issues))
        self.issues = issues


def validate(definitions: list[Definition]) -> list[Issue]:
    """Repeated names and keys on missing columns. Takes definitions as declared: once ``canonical_all`` has
    dropped repeated objects they can no longer be reported."""
    issues: list[Issue] = []
    seen: set[str] = set()
    for d in definitions:

        def add(code: str, message: str, d=d) -> None:
            issues.append(Issue(code, d.kind, d.database, d.name, message))

        place = f"{d.database}.{d.name}"
        if key_of(d) in seen:
            add("duplicate_object_name", f"{d.kind} {place} is declared more than once")
        seen.add(key_of(d))
        if not isinstance(d, Table):
            continue
        for code, what, names in (
            ("duplicate_column_name", "column", [c.name for c in d.columns]),
            ("duplicate_index_name", "index", [i.name for i in d.indexes]),
            ("duplicate_projection_name", "projection", [p.name for p in d.projections]),
        ):
            met: set[str] = set()
            for n in names:
                if n in met:
                    add(code, f"{what} {n} of {place} is declared more than once")
                met.add(n)
        have = {c.name for c in d.columns}
        for code, what, keys in (("primary_key_missing_column", "primary key", d.primary_key), ("order_by_missing_column", "sort key", d.order_by)):
            for k in key_columns(list(keys)):
                if k not in have:
                    add(code, f"{what} of {place} names {k}, which is no column")
    return issues


def assert_valid(definitions: list[Definition]) -> None:
    if issues := validate(definitions):
        raise ValidationError(issues)


def to_dict(d: Definition) -> dict[str, Any]:
    return {"kind": d.kind, **{k: v for k, v in asdict(d).items() if k != "kind"}}


def from_dict(raw: dict[str, Any]) -> Definition:
    raw = dict(raw)
    kind = raw.pop("kind", None)
    if kind == "table":
        raw["columns"] = tuple(Column(**c) for c in raw["columns"])
        raw["indexes"] = tuple(SkipIndex(**i) for i in raw.get("indexes", ()))
        raw["projections"] = tuple(Projection(**p) for p in raw.get("projections", ()))
        for k in ("primary_key", "order_by", "unique_key"):
            raw[k] = tuple(raw.get(k, ()))
        return Table(**raw)
    if kind == "view":
        return View(**raw)
    if kind == "materialized_view":
        raw["to"] = tuple(raw["to"])
        return MaterializedView(**raw)
    raise ValueError(f"unknown kind {kind!r}")


def snapshot(definitions: list[Definition], now: dt.datetime | None = None) -> dict[str, Any]:
    now = now or dt.datetime.now(dt.UTC)
    return {"version": 1, "generated_at": now.isoformat(), "definitions": [to_dict(d) for d in canonical_all(definitions)]}


class SnapshotError(ValueError):
    """A snapshot file that cannot be read."""


def read_snapshot(path: str) -> list[Definition] | None:
    """The definitions of a snapshot file; None if there is none."""
    if not os.path.exists(path):
        return None
    try:
        with open(path) as f:
            raw = json.load(f)
        return canonical_all([from_dict(x) for x in raw["definitions"]])
    except (ValueError, KeyError, TypeError) as e:
        raise SnapshotError(f"{path}: {e}") from e
