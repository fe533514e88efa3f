"""Column types: a strict parser of declared type strings, and what Spark stores for each.

Unsigned types widen to the next signed one that holds every value; what no numeric type of Spark holds is
kept as text. Nothing is narrowed silently. Range and membership checks for the widened types come as
predicates, used by ``operators.ingest``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import split_top_level


class TypeMappingError(ValueError):
    """A declared type that has no Spark counterpart here."""


@dataclass(frozen=True)
class Parsed:
    base: str
    args: tuple[str, ...] = ()


@dataclass(frozen=True)
class Mapped:
    """``spark``: the stored type. ``nullable``: from a Nullable wrapper at any outer level. ``metadata``: what Spark has no place for."""

    spark: T.DataType
    nullable: bool = False
    metadata: dict = field(default_factory=dict)


# Names of the declared types.
_SIMPLE: dict[str, T.DataType] = {
    "String": T.StringType(),
    "UInt8": T.ShortType(),
    "UInt16": T.IntegerType(),
    "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0),
    "UInt128": T.StringType(),
    "UInt256": T.StringType(),
    "Int8": T.ByteType(),
    "Int16": T.ShortType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "Int128": T.StringType(),
    "Int256": T.StringType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "BFloat16": T.FloatType(),
    "Bool": T.BooleanType(),
    "Boolean": T.BooleanType(),
    "Date": T.DateType(),
    "Date32": T.DateType(),
    "DateTime": T.TimestampType(),
    "DateTime64": T.TimestampType(),
    "UUID": T.StringType(),
    "IPv4": T.StringType(),
    "IPv6": T.StringType(),
    "JSON": T.VariantType(),
}
_BITS = re.compile(r"^(U?)Int(8|16|32|64|128|256)$")
_DECIMAL_DIGITS = {"Decimal32": 9, "Decimal64": 18, "Decimal128": 38, "Decimal256": 76}


def parse_type(text: str) -> Parsed:
    """``Base`` or ``Base(arg, ...)``; unbalanced or trailing text is an error."""
    text = text.strip()
    m = re.fullmatch(r"([A-Za-z][A-Za-z0-9_]*)\s*(?:\((.*)\))?", text, re.S)
    if not m:
        raise TypeMappingError(f"not a type: {text!r}")
    args = tuple(split_top_level(m[2])) if m[2] is not None else ()
    if m[2] is not None and (m[2].count("(") != m[2].count(")")):
        raise TypeMappingError(f"unbalanced type: {text!r}")
    return Parsed(m[1], args)


def is_time_type(text: str) -> bool:
    try:
        return parse_type(text).base in ("DateTime", "DateTime64")
    except TypeMappingError:
        return False


def _integer(text: str, what: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise TypeMappingError(f"{what} must be a number: {text!r}")
    return int(text)


def map_type(text: str, integers: str = "exact") -> Mapped:
    """The Spark type of a declared type. ``integers='long'`` stores UInt64 as bigint (an explicit choice)."""
    p = parse_type(text)
    inner = lambda k: map_type(p.args[k], integers)

    def arity(*allowed: int) -> None:
        if len(p.args) not in allowed:
            raise TypeMappingError(f"{p.base} takes {allowed} arguments: {text!r}")

    if p.base == "Nullable":
        arity(1)
        m = inner(0)
        if isinstance(m.spark, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeMappingError(f"composite types cannot be Nullable: {text!r}")
        return Mapped(m.spark, True, m.metadata)
    if p.base == "LowCardinality":
        arity(1)
        return inner(0)
    if p.base == "Array":
        arity(1)
        m = inner(0)
        return Mapped(T.ArrayType(m.spark, m.nullable), False, {"element": m.metadata} if m.metadata else {})
    if p.base == "Map":
        arity(2)
        k, v = inner(0), inner(1)
        if k.nullable:
            raise TypeMappingError(f"map keys cannot be Nullable: {text!r}")
        return Mapped(T.MapType(k.spark, v.spark, v.nullable))
    if p.base == "Tuple":
        if not p.args:
            raise TypeMappingError(f"empty tuple: {text!r}")
        fields = []
        for i, arg in enumerate(p.args, 1):
            named = re.fullmatch(r"(`[^`]+`|[A-Za-z_]\w*)\s+(\S.*)", arg, re.S)
            name, kind = (named[1].strip("`"), named[2]) if named else (f"_{i}", arg)
            m = map_type(kind, integers)
            fields.append(T.StructField(name, m.spark, m.nullable, m.metadata))
        return Mapped(T.StructType(fields))
    if p.base == "SimpleAggregateFunction":
        arity(2)
        m = inner(1)
        return Mapped(m.spark, m.nullable, {**m.metadata, "agg": p.args[0]})
    if p.base in ("Enum", "Enum8", "Enum16"):
        codes = {}
        for i, arg in enumerate(p.args, 1):
            m = re.fullmatch(r"'((?:[^'\\]|\\.|'')*)'\s*(?:=\s*(-?\d+))?", arg)
            if not m:
                raise TypeMappingError(f"enum entry {arg!r} in {text!r}")
            codes[m[1].replace("''", "'")] = int(m[2]) if m[2] else i
        if not codes:
            raise TypeMappingError(f"empty enum: {text!r}")
        return Mapped(T.StringType(), False, {"enum": codes})
    if p.base == "FixedString":
        arity(1)
        return Mapped(T.StringType(), False, {"length": _integer(p.args[0], "length")})
    if p.base in ("DateTime", "DateTime64"):
        meta: dict = {"precision": 0 if p.base == "DateTime" else 3}
        for arg in p.args:
            if arg.startswith("'"):
                meta["timezone"] = arg.strip("'")
            else:
                meta["precision"] = _integer(arg, "precision")
        return Mapped(T.TimestampType(), False, meta)
    if p.base == "Decimal" or p.base in _DECIMAL_DIGITS:
        if p.base == "Decimal":
            arity(1, 2)
            digits, scale = _integer(p.args[0], "precision"), _integer(p.args[1], "scale") if len(p.args) > 1 else 0
        else:
            arity(1)
            digits, scale = _DECIMAL_DIGITS[p.base], _integer(p.args[0], "scale")
        if scale > digits:
            raise TypeMappingError(f"scale over precision: {text!r}")
        if digits > 38:
            return Mapped(T.StringType(), False, {"decimal": [digits, scale]})
        return Mapped(T.DecimalType(digits, scale))
    if p.base == "UInt64" and integers == "long":
        return Mapped(T.LongType(), False, {"unsigned": 64})
    found = _SIMPLE.get(p.base)
    if found is None or p.args:
        raise TypeMappingError(f"unsupported type: {text!r}")
    return Mapped(found)


def struct_field(name: str, text: str, nullable: bool = False, integers: str = "exact", **metadata) -> T.StructField:
    """A field whose nullability comes from the flag, from a Nullable wrapper, or both."""
    m = map_type(text, integers)
    return T.StructField(name, m.spark, nullable or m.nullable, {"logical_type": text, **m.metadata, **{k: v for k, v in metadata.items() if v is not None}})


def value_check(column: Column, text: str) -> Column:
    """Whether a stored value is one of the declared type; null where the value is."""
    p = parse_type(text)
    while p.base in ("Nullable", "LowCardinality"):
        p = parse_type(p.args[0])
    m = _BITS.match(p.base)
    if m:
        bits = int(m[2])
        low, high = (0, 2**bits - 1) if m[1] else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
        if bits <= 64:
            value = column.cast("decimal(38,0)")
            return (value >= F.lit(str(low)).cast("decimal(38,0)")) & (value <= F.lit(str(high)).cast("decimal(38,0)"))
        digits = F.regexp_replace(column, "^-?0*(?=[0-9])", "")
        top = F.when(column.startswith("-"), F.lit(str(-low))).otherwise(F.lit(str(high)))
        short = F.length(digits) < F.length(top)
        inside = short | ((F.length(digits) == F.length(top)) & (digits <= top))
        return column.rlike(r"^[0-9]+$" if low == 0 else r"^-?[0-9]+$") & inside
    if p.base in ("Enum", "Enum8", "Enum16"):
        return column.isin(list(map_type(text).metadata["enum"]))
    if p.base == "FixedString":
        return F.octet_length(column) <= int(p.args[0])
    if p.base == "UUID":
        return column.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    if p.base == "IPv4":
        part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return column.rlike(f"^{part}(\\.{part}){{3}}$")
    return column.isNotNull() | F.lit(None).cast("boolean")


def enum_code(column: Column, text: str) -> Column:
    """The numeric code of an enum value; enums are ordered by it."""
    codes = map_type(text).metadata["enum"]
    return F.coalesce(*(F.when(column == k, F.lit(v)) for k, v in codes.items()))
