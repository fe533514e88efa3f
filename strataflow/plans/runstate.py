"""Replay plans and runs on disk: identity, chunk states with retries, status, doctor, checks.

Plans never change once written. Every transition rewrites the run's file by an atomic replace and appends an event.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import time
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from threading import Lock
from typing import Any

from ..sources.files import write_atomically
from .plugins import Finding
from .replay import Chunk, Limits, ReplayError, check_window, chunks, parse_time, plan_id

CHUNK_STATES = ("pending", "running", "done", "failed")
RUN_STATES = ("planned", "running", "completed", "failed", "paused", "cancelled")


class StateError(RuntimeError):
    """A transition, plan or environment that does not fit."""


@dataclass(frozen=True)
class Options:
    chunk_hours: float = 6
    max_parallel: int = 1
    max_attempts: int = 3
    retry_delay_s: float = 1.0
    limits: Limits = Limits()
    block_overlap: bool = True

    def compatibility(self) -> dict[str, Any]:
        """What a resumed run must agree on; waiting times and parallelism are not part of it."""
        return {"max_attempts": self.max_attempts, "limits": asdict(self.limits), "block_overlap": self.block_overlap}


@dataclass
class Plan:
    id: str
    target: str
    start: str
    end: str
    chunk_seconds: int
    column: str
    strategy: str
    environment: str = ""
    options: dict[str, Any] = field(default_factory=dict)

    def run_options(self) -> Options:
        """The options that the plan was made with."""
        raw = dict(self.options)
        return Options(**{**raw, "limits": Limits(**raw["limits"])}) if raw else Options()


@dataclass
class ChunkState:
    id: str
    token: str
    start: str
    end: str
    status: str = "pending"
    attempts: int = 0
    rows: int = 0
    error: str | None = None
    again: bool = False  # done before, and to be replayed all the same


@dataclass
class Run:
    plan_id: str
    target: str
    status: str = "running"
    compatibility: str = ""
    chunks: list[ChunkState] = field(default_factory=list)


def stable(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def digest(value: Any) -> str:
    return hashlib.sha256(stable(value).encode()).hexdigest()


class Store:
    """Plans, runs and events below one folder."""

    def __init__(self, folder: str):
        self.folder, self._lock = folder, Lock()

    def _path(self, kind: str, id_: str, end: str = "json") -> str:
        if not (len(id_) == 16 and all(c in "0123456789abcdef" for c in id_)):
            raise StateError(f"plan id {id_!r}: expected 16 hex digits")
        return os.path.join(self.folder, kind, f"{id_}.{end}")

    def _read(self, path: str) -> dict[str, Any] | None:
        if not os.path.exists(path):
            return None
        with open(path) as f:
            return json.load(f)

    def plan(self, id_: str) -> Plan:
        raw = self._read(self._path("plans", id_))
        if raw is None:
            raise StateError(f"no plan {id_}")
        return Plan(**raw)

    def plan_ids(self) -> list[str]:
        folder = os.path.join(self.folder, "plans")
        return sorted(n[:-5] for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []

    def run(self, id_: str) -> Run | None:
        raw = self._read(self._path("runs", id_))
        return Run(**{**raw, "chunks": [ChunkState(**c) for c in raw["chunks"]]}) if raw else None

    def runs(self) -> list[Run]:
        return [r for r in map(self.run, self.plan_ids()) if r]

    def save_plan(self, plan: Plan, force: bool = False) -> Plan:
        """The same plan again is that plan; a different one under its id is an error unless forced."""
        path = self._path("plans", plan.id)
        old = self._read(path)
        if old is not None and stable(old) == stable(asdict(plan)):
            return plan
        if old is not None and not force:
            raise StateError(f"plan {plan.id} exists and differs")
        if force:
            for kind, end in (("runs", "json"), ("events", "ndjson")):
                if os.path.exists(p := self._path(kind, plan.id, end)):
                    os.unlink(p)
        write_atomically(path, json.dumps(asdict(plan), indent=2))
        return plan

    def save(self, run: Run, event: str, **more: Any) -> None:
        with self._lock:
            write_atomically(self._path("runs", run.plan_id), json.dumps(asdict(run), indent=2))
            path = self._path("events", run.plan_id, "ndjson")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "a") as f:
                f.write(stable({"at": dt.datetime.now(dt.UTC).isoformat(), "type": event, "plan_id": run.plan_id, **more}) + "\n")

    def events(self, id_: str) -> list[dict[str, Any]]:
        path = self._path("events", id_, "ndjson")
        if not os.path.exists(path):
            return []
        with open(path) as f:
            return [json.loads(line) for line in f if line.strip()]


def make_plan(store: Store, target: str, start: str, end: str, column: str, strategy: str, options: Options = Options(), environment: str = "", force_window: bool = False, force: bool = False) -> Plan:
    a, b, step = parse_time(start), parse_time(end), dt.timedelta(hours=options.chunk_hours)
    check_window(a, b, step, options.limits, force_window)
    name = target.split(".")
    plan = Plan(plan_id((name[0], name[1]), a, b, step, column), target, a.isoformat(), b.isoformat(), int(step.total_seconds()), column, strategy, environment, asdict(options))
    return store.save_plan(plan, force)


def plan_chunks(plan: Plan) -> list[Chunk]:
    return chunks(plan.id, parse_time(plan.start), parse_time(plan.end), dt.timedelta(seconds=plan.chunk_seconds))


Execute = Callable[[Chunk], int]


def _attempt(store: Store, run: Run, state: ChunkState, chunk: Chunk, execute: Execute, options: Options, sleep: Callable[[float], None]) -> None:
    while state.attempts < options.max_attempts:
        state.attempts += 1
        state.status = "running"
        store.save(run, "chunk_started", chunk=state.id, attempt=state.attempts)
        try:
            state.rows = int(execute(replace(chunk, force=state.again)))
        except Exception as e:
            state.error = str(e)[:500]
            if state.attempts < options.max_attempts:
                store.save(run, "chunk_retry", chunk=state.id, error=state.error)
                sleep(options.retry_delay_s * 2 ** (state.attempts - 1))
                continue
            state.status = "failed"
            store.save(run, "chunk_failed", chunk=state.id, error=state.error)
            return
        state.status, state.error, state.again = "done", None, False
        store.save(run, "chunk_done", chunk=state.id, rows=state.rows)
        return


def execute_run(
    store: Store,
    id_: str,
    execute: Execute,
    options: Options = Options(),
    resume: bool = False,
    replay_done: bool = False,
    replay_failed: bool = False,
    force_overlap: bool = False,
    force_compatibility: bool = False,
    force_environment: bool = False,
    environment: str = "",
    sleep: Callable[[float], None] = time.sleep,
    stop: Callable[[], bool] = lambda: False,
) -> Run:
    """Runs what is not done. Failed chunks don't stop the others. Up to ``max_parallel`` chunks run at once, each a Spark
    job of its own; ``execute`` must be idempotent for a chunk's token, as ``replay.Target.apply`` is, unless the chunk says ``force``:
    then it was done before and ``replay_done`` asks for it again."""
    plan, run = store.plan(id_), store.run(id_)
    if plan.environment != environment and not force_environment:
        raise StateError("the plan belongs to another environment")
    mark = digest({"plan": asdict(plan), "options": options.compatibility()})
    if run and run.status == "cancelled":
        raise StateError("the run was cancelled")
    if run and run.status == "completed" and not replay_done:
        return run
    if resume and not run:
        raise StateError("there is no run to resume")
    if run and run.compatibility != mark and not force_compatibility:
        raise StateError("the run was started with other options")
    if options.block_overlap and not force_overlap and any(r.plan_id != id_ and r.status == "running" and r.target == plan.target for r in store.runs()):
        raise StateError("another run writes to the target")
    todo = plan_chunks(plan)
    if run is None:
        run = Run(id_, plan.target, chunks=[ChunkState(c.id, c.token, c.start.isoformat(), c.end.isoformat()) for c in todo])
    run.status, run.compatibility = "running", mark
    replay_failed = replay_failed or resume
    for s in run.chunks:
        if s.status == "running" or (s.status == "failed" and replay_failed) or (s.status == "done" and replay_done):
            s.again = s.again or replay_done
            s.status, s.attempts = "pending", 0
    store.save(run, "run_started")
    waiting = [(s, c) for s, c in zip(run.chunks, todo, strict=True) if s.status == "pending"]

    def work(pair: tuple[ChunkState, Chunk]) -> None:
        if not stop():
            _attempt(store, run, *pair, execute, options, sleep)

    if options.max_parallel > 1:
        with ThreadPoolExecutor(options.max_parallel) as pool:
            list(pool.map(work, waiting))
    else:
        for pair in waiting:
            work(pair)
    states = Counter(s.status for s in run.chunks)
    run.status = "paused" if states["pending"] else "failed" if states["failed"] else "completed"
    store.save(run, f"run_{run.status}")
    return run


@dataclass
class Status:
    plan_id: str
    status: str
    counts: dict[str, int]
    attempts: int
    rows: int
    last_error: str | None


def status(store: Store, id_: str) -> Status:
    plan, run = store.plan(id_), store.run(id_)
    if run is None:
        n = len(plan_chunks(plan))
        return Status(id_, "planned", {**dict.fromkeys(CHUNK_STATES, 0), "pending": n}, 0, 0, None)
    states = Counter(s.status for s in run.chunks)
    error = next((s.error for s in reversed(run.chunks) if s.error), None)
    return Status(id_, run.status, {k: states[k] for k in CHUNK_STATES}, sum(s.attempts for s in run.chunks), sum(s.rows for s in run.chunks), error)


def cancel(store: Store, id_: str) -> Run:
    run = store.run(id_) or Run(id_, store.plan(id_).target)
    if run.status == "completed":
        raise StateError("a completed run cannot be cancelled")
    run.status = "cancelled"
    for s in run.chunks:
        s.status = "pending" if s.status == "running" else s.status
    store.save(run, "run_cancelled")
    return run


def doctor(store: Store, id_: str) -> dict[str, Any]:
    """Issue codes and what to do. A cancelled run cannot be resumed, so the advice is a new plan."""
    s, run = status(store, id_), store.run(id_)
    codes = {
        "planned": ("backfill_plan_missing", "run the plan"),
        "failed": ("backfill_chunk_failed_retry_exhausted", "look at the last error, then resume"),
        "cancelled": ("backfill_required_pending", "make the plan again with force, then run it"),
        "running": ("backfill_required_pending", "watch the status; resume if the run is gone"),
        "paused": ("backfill_required_pending", "resume"),
    }
    found = codes.get(s.status)
    return {
        "plan_id": id_,
        "status": s.status,
        "issues": [found[0]] if found else [],
        "advice": [found[1]] if found else ["nothing to do"],
        "failed_chunks": [c.id for c in (run.chunks if run else []) if c.status == "failed"],
    }


def check(store: Store, required: bool = True) -> list[Finding]:
    """Plans without a completed run, and runs that failed. ``required``: whether the former are errors."""
    runs = {id_: store.run(id_) for id_ in store.plan_ids()}
    waiting = [id_ for id_, r in runs.items() if r is None or r.status != "completed"]
    failed = [id_ for id_, r in runs.items() if r is not None and r.status == "failed"]
    out = []
    if waiting:
        out.append(Finding("backfill_required_pending", "error" if required else "warn", f"{len(waiting)} plans without a completed run: {', '.join(waiting)}"))
    if failed:
        out.append(Finding("backfill_chunk_failed_retry_exhausted", "error", f"{len(failed)} runs with chunks that failed at each attempt: {', '.join(failed)}"))
    if waiting and not required:
        out.append(Finding("backfill_policy_relaxed", "warn", "open plans do not fail the check"))
    return out


__all__ = ["ChunkState", "Options", "Plan", "ReplayError", "Run", "StateError", "Status", "Store", "cancel", "check", "doctor", "execute_run", "make_plan", "plan_chunks", "status"]
