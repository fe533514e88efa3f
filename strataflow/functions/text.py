"""Normal forms of SQL fragments: white space, engine names, comma lists, statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTES = "'\"`"
_PIECE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|/\*.*?\*/|--[^\n]*|[()\[\]{},;]|[^'\"`/\-()\[\]{},;]+|.", re.S)


def pieces(sql: str) -> Iterator[tuple[str, int, str]]:
    """(text, depth, kind) of each lexical piece; kind is code, quote, comment, open, close, comma or semicolon.

    The depth of brackets is that around the piece itself. Unclosed quotes are single characters of code.
    """
    depth = 0
    for m in _PIECE.finditer(sql):
        x = m.group()
        if len(x) > 1 and x[0] in _QUOTES:
            yield x, depth, "quote"
        elif x.startswith("--") or x.startswith("/*") and len(x) > 3:
            yield x, depth, "comment"
        elif x in "([{":
            yield x, depth, "open"
            depth += 1
        elif x in ")]}":
            depth = max(0, depth - 1)
            yield x, depth, "close"
        else:
            yield x, depth, {",": "comma", ";": "semicolon"}.get(x, "code")


def split_top_level(text: str) -> list[str]:
    """Parts between commas outside of quotes and brackets, trimmed; empty parts go."""
    parts = [""]
    for x, depth, kind in pieces(text):
        if kind == "comma" and depth == 0:
            parts.append("")
        else:
            parts[-1] += x
    return [p.strip() for p in parts if p.strip()]


def key_columns(values: list[str]) -> list[str]:
    """Key lists in which one entry may hold several, comma separated."""
    return [part for value in values for part in split_top_level(value)]


def normalize_fragment(sql: str) -> str:
    """Trimmed, runs of white space as one blank; what stands in quotes is left as it is."""
    out = "".join(x if kind == "quote" else re.sub(r"\s+", " ", x) for x, _, kind in pieces(sql))
    return re.sub(r"^\s+|\s+$", "", out)


def normalize_engine(engine: str) -> str:
    """Without the Shared prefix, and with parentheses."""
    name = re.sub(r"^Shared(?=[A-Z])", "", engine.strip())
    return name if "(" in name else f"{name}()"


def engine_column(engine: Column) -> Column:
    """normalize_engine over a column of names."""
    name = F.regexp_replace(F.trim(engine), "^Shared(?=[A-Z])", "")
    return F.when(F.instr(name, "(") > 0, name).otherwise(F.concat(name, F.lit("()")))


def normalize_clause(clause: str | None) -> str:
    """Normal form for comparing keys: no backticks, no parentheses around the whole."""
    text = normalize_fragment(clause or "").replace("`", "")
    while text.startswith("(") and text.endswith(")"):
        depths = [depth for x, depth, kind in pieces(text) if kind == "close"]
        if depths.count(0) != 1:
            break
        text = normalize_fragment(text[1:-1])
    return text


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons outside of quotes and comments; whole-line comments go first."""
    lines = "\n".join(line for line in sql.split("\n") if not line.lstrip().startswith("--"))
    parts = [""]
    for x, _, kind in pieces(lines):
        if kind == "semicolon":
            parts.append("")
        else:
            parts[-1] += x
    out = []
    for part in parts:
        if any(kind != "comment" and x.strip() for x, _, kind in pieces(part)):
            out.append(part.strip())
    return out


def quote_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
