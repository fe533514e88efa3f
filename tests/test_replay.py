import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strataflow.operators import merge
from strataflow.plans import replay, runstate
from strataflow.plans.model import Column, MaterializedView, Table
from strataflow.streaming.views import maintain, windowed

EVENTS = Table("app", "events", (Column("id", "UInt64"), Column("created_at", "DateTime"), Column("ts", "DateTime64(3)")), order_by=("id", "ts"))
TARGET = Table("app", "hourly", (Column("hour", "DateTime"), Column("n", "Int64")), engine="SummingMergeTree(n)", order_by=("hour",))
VIEW = MaterializedView("app", "mv", "SELECT toStartOfHour(ts) AS hour, count() AS n FROM app.events GROUP BY hour", ("app", "hourly"))


@pytest.mark.parametrize("hours, step, n, last", [(18, 6, 3, 6), (7, 2, 4, 1), (6, 2, 3, 2)])
def test_chunk_grids(hours, step, n, last):
    start = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    got = replay.chunks("p", start, start + dt.timedelta(hours=hours), dt.timedelta(hours=step))
    assert len(got) == n and got[-1].end - got[-1].start == dt.timedelta(hours=last) and all(a.end == b.start for a, b in zip(got, got[1:], strict=False))
    assert len({c.id for c in got} | {c.token for c in got}) == 2 * n and got == replay.chunks("p", start, start + dt.timedelta(hours=hours), dt.timedelta(hours=step))


def test_time_columns():
    assert replay.time_candidates(EVENTS) == [("ts", "order_by"), ("created_at", "column_scan")]
    assert replay.time_column(EVENTS, "x") == "x" and replay.time_column(EVENTS) == "ts"
    assert replay.time_column(Table("a", "b", (), plugins={"backfill": {"time_column": "q"}})) == "q"
    with pytest.raises(replay.ReplayError):
        replay.time_column(None)


def test_view_and_source_lookup():
    other = Table("app", "another", (Column("id", "UInt8"),))
    definitions = [other, EVENTS, TARGET, VIEW]
    assert replay.view_for(definitions, ("app", "hourly")) == VIEW and replay.source_table(definitions, ("app", "hourly")) == EVENTS
    assert replay.source_table(definitions, ("app", "another")) == other and replay.view_for(definitions, ("app", "another")) is None


def test_window_guards():
    a = replay.parse_time("2026-01-01")
    hour = dt.timedelta(hours=1)
    with pytest.raises(replay.ReplayError):
        replay.check_window(a, a, hour)
    with pytest.raises(replay.ReplayError):
        replay.check_window(a, a + 721 * hour, hour)
    replay.check_window(a, a + 721 * hour, hour, force=True)
    with pytest.raises(replay.ReplayError):
        replay.check_window(a, a + hour, dt.timedelta(minutes=14))
    with pytest.raises(replay.ReplayError):
        replay.parse_target("a.b.c")


def test_window_filter_reaches_the_scan(spark, data):
    plan = replay.in_window(spark.read.parquet(f"{data}/events.parquet"), "ts", "2024-01-02 00:00:00", "2024-01-03 00:00:00").groupBy("event_type").count()._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_replay_is_idempotent_and_resumes(spark, data, tmp_path):
    store = runstate.Store(str(tmp_path / "state"))
    plan = runstate.make_plan(store, "app.hourly", "2024-01-01", "2024-01-02T12:00:00Z", "ts", "view", runstate.Options(chunk_hours=12))
    target = replay.Target(spark, f"file://{tmp_path}/target", TARGET.spark_schema())
    events = spark.read.parquet(f"{data}/events.parquet")
    view = replay.view_function(spark, VIEW.query, "app.events")
    left = {1: 3}
    order = {c.id: k for k, c in enumerate(runstate.plan_chunks(plan))}

    def execute(chunk):
        if left.get(order[chunk.id], 0):
            left[order[chunk.id]] -= 1
            raise RuntimeError("lost")
        return target.apply(chunk.token, replay.replay(source[0], view, "ts", chunk.start, chunk.end, ["hour", "n"]), chunk.force)

    source = [events]
    waits = []
    run = runstate.execute_run(store, plan.id, execute, sleep=waits.append)
    assert run.status == "failed" and [c.status for c in run.chunks] == ["done", "failed", "done"] and waits == [1.0, 2.0]
    assert runstate.doctor(store, plan.id)["issues"] == ["backfill_chunk_failed_retry_exhausted"] and [f.code for f in runstate.check(store)] == ["backfill_required_pending", "backfill_chunk_failed_retry_exhausted"]
    run = runstate.execute_run(store, plan.id, execute, resume=True)
    assert run.status == "completed" and run.chunks[0].attempts == 1 and runstate.check(store) == []
    before = sorted(map(tuple, target.read().collect()))
    rows = [c.rows for c in run.chunks]
    again = runstate.execute_run(store, plan.id, execute, replay_done=True)
    assert again.status == "completed" and sorted(map(tuple, target.read().collect())) == before and [c.rows for c in again.chunks] == rows
    source[0] = events.where("event_type = 'click'")  # what a replay of done chunks reads now
    again = runstate.execute_run(store, plan.id, execute, replay_done=True)
    fewer = events.where("ts >= '2024-01-01' and ts < '2024-01-02 12:00:00' and event_type = 'click'").count()
    assert target.read().agg(F.sum("n")).first()[0] == fewer > 0 and sum(c.rows for c in again.chunks) == target.read().count() and not any(c.again for c in again.chunks)
    source[0] = events
    lost = store.run(plan.id)  # as if the run's file had not been written after the ledger was
    lost.status, lost.chunks[0].status, lost.chunks[0].rows = "running", "running", 0
    store.save(lost, "test")
    run = runstate.execute_run(store, plan.id, execute, resume=True)
    assert run.status == "completed" and [c.rows for c in run.chunks] == [c.rows for c in again.chunks]
    run = runstate.execute_run(store, plan.id, execute, replay_done=True)
    assert [c.rows for c in run.chunks] == rows and target.read().count() == sum(rows)
    full = events.where("ts >= '2024-01-01' and ts < '2024-01-02 12:00:00'").groupBy(F.date_trunc("HOUR", "ts").alias("hour")).count()
    assert sorted(map(tuple, merge.final(target.read(), TARGET).collect())) == sorted(map(tuple, full.collect()))
    assert [e["type"] for e in store.events(plan.id)][-1] == "run_completed" and runstate.status(store, plan.id).counts["done"] == 3


def test_interrupted_chunk_is_overwritten(spark, tmp_path):
    target = replay.Target(spark, f"file://{tmp_path}/t", spark.range(0).schema)
    spark.range(5).write.parquet(f"file://{tmp_path}/t/chunk=abc")  # written, but not in the ledger
    assert target.read().count() == 0 and target.apply("abc", spark.range(3)) == 3 and target.apply("abc", spark.range(9)) == 3 and target.read().count() == 3
    assert target.apply("abc", spark.range(4), force=True) == 4 and target.read().count() == 4 and target.apply("abc", spark.range(9)) == 4 and target.tokens() == {"abc"}


def test_plan_and_run_rules(tmp_path):
    store, options = runstate.Store(str(tmp_path)), runstate.Options(max_attempts=1, retry_delay_s=0, max_parallel=3)
    plan = runstate.make_plan(store, "a.t", "2026-01-01", "2026-01-02", "ts", "table", options)
    assert runstate.make_plan(store, "a.t", "2026-01-01", "2026-01-02", "ts", "table", options) == plan and runstate.status(store, plan.id).status == "planned"
    with pytest.raises(runstate.StateError):
        runstate.make_plan(store, "a.t", "2026-01-01", "2026-01-02", "ts", "view", options)
    with pytest.raises(runstate.StateError):
        runstate.execute_run(store, plan.id, lambda c: 0, options, environment="elsewhere")
    with pytest.raises(runstate.StateError):
        runstate.execute_run(store, plan.id, lambda c: 0, options, resume=True)
    calls = []
    one_by_one = replace(options, max_parallel=1)  # so that the stop is seen after two chunks, whatever the timing
    assert runstate.execute_run(store, plan.id, lambda c: calls.append(c) or 1, one_by_one, stop=lambda: len(calls) >= 2).status == "paused"
    with pytest.raises(runstate.StateError):
        runstate.execute_run(store, plan.id, lambda c: 1, runstate.Options(max_attempts=2))
    other = runstate.make_plan(store, "a.t", "2026-01-01", "2026-01-03", "ts", "table", options)
    run = store.run(plan.id)
    run.status = "running"
    store.save(run, "test")
    with pytest.raises(runstate.StateError):
        runstate.execute_run(store, other.id, lambda c: 1, options)
    assert runstate.execute_run(store, other.id, lambda c: 1, options, force_overlap=True).status == "completed"
    assert runstate.cancel(store, plan.id).status == "cancelled" and "force" in runstate.doctor(store, plan.id)["advice"][0]
    with pytest.raises(runstate.StateError):
        runstate.execute_run(store, plan.id, lambda c: 1, options)
    with pytest.raises(runstate.StateError):
        runstate.cancel(store, other.id)
    with pytest.raises(runstate.StateError):
        store.plan("../../etc")


def test_self_replay_needs_a_replacing_engine(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "ts timestamp")
    with pytest.raises(replay.ReplayError):
        replay.self_replay(df, EVENTS, "ts", "2024-01-01", "2024-01-02")
    assert replay.self_replay(df, Table("a", "b", (), "ReplacingMergeTree"), "ts", "2024-01-01", "2024-01-02").count() == 1


def test_stream_maintains_view_once(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = replay.Target(spark, f"file://{tmp_path}/out", TARGET.spark_schema())
    view = lambda df: df.groupBy(F.date_trunc("HOUR", "ts").alias("hour")).agg(F.count("*").alias("n"))
    for _ in range(2):  # the second start finds nothing new
        maintain(stream, view, target, "hourly", str(tmp_path / "check")).awaitTermination(60)
    assert sorted(map(tuple, merge.final(target.read(), TARGET).collect())) == sorted((r.hour, r.n) for r in view(events).collect())


def test_watermarked_windows(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{data}/events.parquet*")
    q = windowed(stream, "ts", "1 hour", "10 minutes", ["event_type"], {"n": F.count("*")}).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()
