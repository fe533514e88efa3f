"""Extensions: hooks that see or change definitions, plans and statements, and commands of their own."""

from __future__ import annotations

import importlib
import os
import runpy
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from .. import __version__
from ..functions.text import normalize_engine
from .model import Definition, Table
from .planner import Plan

API_VERSION = 1


class PluginError(RuntimeError):
    """A plugin that cannot be loaded or whose hook failed; names the plugin and the hook."""


@dataclass(frozen=True)
class Finding:
    """What a check found; only errors fail it."""

    code: str
    severity: str = "error"
    message: str = ""


@dataclass
class Plugin:
    """Hooks are optional. ``schema``, ``plan`` and ``before_apply`` return what goes on; the others only look on."""

    name: str
    api_version: int = API_VERSION
    init: Callable[[dict], None] | None = None
    config: Callable[[dict], None] | None = None
    schema: Callable[[list[Definition]], list[Definition]] | None = None
    plan: Callable[[Plan], Plan] | None = None
    before_apply: Callable[[str, list[str]], list[str]] | None = None
    after_apply: Callable[[str, list[str]], None] | None = None
    check: Callable[[dict], list[Finding | str]] | None = None
    report: Callable[[dict, list[Finding]], None] | None = None
    complete: Callable[[dict], None] | None = None
    commands: dict[str, Callable[[list[str]], int]] = field(default_factory=dict)
    needs_version: str | None = None  # of this package, at least


class Runtime:
    """Plugins in their order; each transform's result is the next one's input."""

    def __init__(self, plugins: list[Plugin]):
        seen: set[str] = set()
        for p in plugins:
            if p.api_version != API_VERSION:
                raise PluginError(f"{p.name}: api version {p.api_version}, here {API_VERSION}")
            if p.needs_version and _numbers(p.needs_version) > _numbers(__version__):
                raise PluginError(f"{p.name}: needs version {p.needs_version}, here {__version__}")
            if p.name in seen:
                raise PluginError(f"{p.name} is given twice")
            seen.add(p.name)
        self.plugins = plugins

    def _call(self, p: Plugin, hook: str, *args: Any) -> Any:
        try:
            return getattr(p, hook)(*args)
        except Exception as e:
            raise PluginError(f"{p.name}.{hook}: {e}") from e

    def _with(self, hook: str) -> list[Plugin]:
        return [p for p in self.plugins if getattr(p, hook)]

    def notify(self, hook: str, *args: Any) -> None:
        for p in self._with(hook):
            self._call(p, hook, *args)

    def fold(self, hook: str, value: Any) -> Any:
        return reduce(lambda v, p: self._call(p, hook, v), self._with(hook), value)

    def before_apply(self, name: str, statements: list[str]) -> list[str]:
        return reduce(lambda s, p: self._call(p, "before_apply", name, s), self._with("before_apply"), statements)

    def findings(self, context: dict) -> dict[str, list[Finding]]:
        """What each plugin's check found; a plain text is an error, and so is a check that fails."""
        out = {}
        for p in self._with("check"):
            try:
                out[p.name] = [f if isinstance(f, Finding) else Finding(f) for f in p.check(context)]
            except Exception as e:
                out[p.name] = [Finding("check_failed", "error", str(e))]
        return out

    def command(self, plugin: str, name: str, args: list[str]) -> int:
        p = next((p for p in self.plugins if p.name == plugin), None)
        if p is None or name not in p.commands:
            raise PluginError(f"no command {plugin} {name}")
        return p.commands[name](args)


def _numbers(version: str) -> tuple[int, ...]:
    return tuple(int(x) for x in version.split("."))


def load(entry: str, folder: str = ".") -> Plugin:
    """The plugin that ``module:name`` or ``file.py:name`` (``plugin`` without a name) stands for; paths are relative to ``folder``."""
    place, _, name = entry.rpartition(":") if ":" in entry else (entry, "", "plugin")
    try:
        found = runpy.run_path(os.path.join(folder, place)) if place.endswith(".py") else vars(importlib.import_module(place))
    except Exception as e:
        raise PluginError(f"{entry}: {e}") from e
    found = found.get(name)
    if callable(found) and not isinstance(found, Plugin):
        found = found()
    if not isinstance(found, Plugin):
        raise PluginError(f"{entry}: no plugin named {name}")
    return found


def unshare(definitions: list[Definition]) -> list[Definition]:
    """Shared engines as the plain ones they share: a schema hook for catalogs without shared storage."""
    return [replace(d, engine=normalize_engine(d.engine)) if isinstance(d, Table) else d for d in definitions]
