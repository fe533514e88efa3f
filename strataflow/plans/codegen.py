"""Generated Python for declared tables: schemas, row checks and ingest functions; and schema files for pulled objects."""

from __future__ import annotations

import json
import os
import re
from pprint import pformat

from ..functions.types import TypeMappingError, struct_field
from ..functions.vocabulary import translate_query
from .model import Definition, Table, canonical_all, to_dict

STYLES = ("pascal", "camel", "raw")
HEADER = "# Generated from the declared schema; changes are overwritten.\n"


def type_name(database: str, name: str, style: str = "pascal") -> str:
    """A Python name for an object."""
    words = [w for w in re.split(r"[^A-Za-z0-9]+", f"{database}_{name}") if w]
    if style == "raw":
        out = "_".join(words)
    else:
        out = "".join(w[:1].upper() + w[1:] for w in words)
        out = out[:1].lower() + out[1:] if style == "camel" else out
    return out if out[:1].isalpha() else f"T{out}"


def unique_names(definitions: list[Definition], style: str = "pascal") -> dict[str, str]:
    """Names by object; a name taken before gets _2, _3 and so on."""
    out, taken = {}, set()
    for d in definitions:
        base = name = type_name(d.database, d.name, style)
        k = 1
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        out[f"{d.database}.{d.name}"] = name
    return out


def render_schemas(
    definitions: list[Definition], style: str = "pascal", integers: str = "exact", strict: bool = True, ingest: bool = False, views: bool = False
) -> tuple[str, list[str]]:
    """(module text, findings). A column of an unknown type is an error, or when not strict a finding and a string. ``views`` adds a
    function for each view and materialized view, which runs its declared query and so has the types that Spark gives it."""
    shown = with_views(canonical_all(definitions), views)
    tables, others = [d for d in shown if isinstance(d, Table)], [d for d in shown if not isinstance(d, Table)]
    names, findings = unique_names([*tables, *others], style), []
    lines = [HEADER, "from pyspark.sql import types as T", ""]
    if ingest:
        lines = [HEADER, "from pyspark.sql import DataFrame", "from pyspark.sql import types as T", "", "from strataflow.operators.ingest import split", "from strataflow.plans.model import from_dict", ""]
    for t in tables:
        fields = []
        for c in t.columns:
            try:
                f = struct_field(c.name, c.type, c.nullable, integers, default=c.default, comment=c.comment)
            except TypeMappingError as e:
                if strict:
                    raise
                findings.append(f"{t.database}.{t.name}.{c.name}: {e}")
                f = struct_field(c.name, "String", True)
            fields.append(json.loads(f.json()) if isinstance(f.json(), str) else f.jsonValue())
        name = names[f"{t.database}.{t.name}"]
        lines += ["", f"{name} = T.StructType.fromJson(", *(f"    {x}" for x in pformat({"type": "struct", "fields": fields}, width=140, sort_dicts=True).split("\n")), ")"]
        if ingest:
            lines += ["", f"_{name} = from_dict(", *(f"    {x}" for x in pformat(to_dict(t), width=140, sort_dicts=True).split("\n")), ")", ""]
            lines += ["", f"def ingest_{name}(rows: DataFrame) -> tuple[DataFrame, DataFrame]:", '    """Valid rows in the table\'s types, and the others with their problems."""', f"    return split(rows, _{name})", ""]
    if others:
        lines = [x for x in lines if x != "from pyspark.sql import DataFrame"]
        lines.insert(1, "from pyspark.sql import DataFrame, SparkSession")
    for d in others:
        lines += ["", f"def read_{names[f'{d.database}.{d.name}']}(spark: SparkSession) -> DataFrame:", f'    """{d.kind} {d.database}.{d.name}"""', f"    return spark.sql({translate_query(d.query)!r})", ""]
    return "\n".join(lines) + "\n", findings


def freshness(path: str, text: str) -> str:
    """missing, stale or fresh."""
    if not os.path.exists(path):
        return "missing"
    with open(path) as f:
        return "fresh" if f.read() == text else "stale"


def render_schema_file(definitions: list[Definition]) -> str:
    """Pulled objects as a JSON schema file, which ``sources.files.load_schema`` reads."""
    return json.dumps([to_dict(d) for d in canonical_all(definitions)], indent=2, default=list) + "\n"


def skipped(objects: list[tuple[str, str, str]], definitions: list[Definition]) -> dict[str, int]:
    """Numbers, by kind, of (database, name, kind) objects without a definition."""
    have = {(d.database, d.name) for d in definitions}
    out: dict[str, int] = {}
    for database, name, kind in objects:
        if (database, name) not in have:
            out[kind] = out.get(kind, 0) + 1
    return dict(sorted(out.items()))


def with_views(definitions: list[Definition], include: bool) -> list[Definition]:
    return definitions if include else [d for d in definitions if isinstance(d, Table)]
