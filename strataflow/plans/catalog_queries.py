"""Queries of the engine's own operators, each with the SQL it is compared with.

Queries over rows of the test tables, and over literal rows on both sides; ``engine_queries`` has those of definitions, files and state.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import translate_expression
from ..operators import granules, ingest, merge, metadata
from . import replay
from .model import Column, Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
STEP_S = 6 * 3600


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --- chunk grids and replay -------------------------------------------------------------------------------------------

_GRID = """
SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS BIGINT) AS chunk, s AS start, least(s + INTERVAL 6 HOUR, e) AS "end"
FROM (SELECT unnest(generate_series(TIMESTAMP '{a}', TIMESTAMP '{b}', INTERVAL 6 HOUR)) AS s, TIMESTAMP '{b}' AS e) WHERE s < e
"""
_FULL_GRID = _GRID.format(a=START, b=END)
_CUT_GRID = _GRID.format(a="2024-01-01 00:00:00", b="2024-01-02 07:30:00")


@query(_FULL_GRID)
def chunk_grid(spark, d):
    return replay.chunk_grid(spark, START, END, "6 hours")


@query(_CUT_GRID)
def chunk_grid_clipped(spark, d):
    return replay.chunk_grid(spark, "2024-01-01 00:00:00", "2024-01-02 07:30:00", "6 hours")


@query(f"""
WITH g AS ({_FULL_GRID}), h AS (SELECT chunk, strftime(start, '%Y-%m-%d %H:%M:%S') || '|' || strftime("end", '%Y-%m-%d %H:%M:%S') AS b FROM g)
SELECT chunk, substr(sha256('p1|' || b), 1, 16) AS id, substr(sha256('token|p1|' || b), 1, 16) AS token FROM h
""")
def chunk_identity(spark, d):
    return replay.chunk_identity(replay.chunk_grid(spark, START, END, "6 hours"), "p1").select("chunk", "id", "token")


@query(f"""
WITH g AS ({_FULL_GRID})
SELECT g.chunk, CAST(count(e.event_id) AS BIGINT) AS n FROM g LEFT JOIN events e ON e.ts >= g.start AND e.ts < g."end" GROUP BY 1
""")
def chunk_row_counts(spark, d):
    counted = replay.assigned(_t(spark, d, "events"), "ts", START, STEP_S).groupBy("chunk").agg(F.count("*").alias("n"))
    grid = replay.chunk_grid(spark, START, END, "6 hours").select("chunk")
    return grid.join(counted, "chunk", "left").select("chunk", F.coalesce("n", F.lit(0)).alias("n"))


def hourly(events: DataFrame) -> DataFrame:
    """Partial rows of the hourly view: they merge by adding."""
    return events.groupBy(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("hour", "event_type", "n", F.round("total", 4).alias("total"))


_HOURLY = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' GROUP BY 1, 2"


@query(_HOURLY.format(a="2024-01-05 00:00:00", b="2024-01-12 00:00:00"))
def replay_hourly_view(spark, d):
    return _shown(replay.replay(_t(spark, d, "events"), hourly, "ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00"))


@query(_HOURLY.format(a=START, b=END))
def replay_chunked_equals_full(spark, d):
    """All chunks in one pass: partial rows per chunk and bucket, merged by the summing engine."""
    rows = replay.assigned(replay.in_window(_t(spark, d, "events"), "ts", START, END), "ts", START, STEP_S)
    parts = rows.groupBy("chunk", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _shown(merge.summing(parts.drop("chunk"), ["hour", "event_type"], ["n", "total"]))


@query(_HOURLY.format(a="2024-01-03 00:30:00", b="2024-01-03 18:30:00"))
def replay_unaligned_chunks(spark, d):
    """Chunk bounds inside of buckets: the buckets come out in parts and are whole again after the merge."""
    events = _t(spark, d, "events")
    grid = replay.chunks("p", replay.parse_time("2024-01-03T00:30:00"), replay.parse_time("2024-01-03T18:30:00"), timedelta(hours=6))
    parts = [replay.replay(events, hourly, "ts", c.start, c.end) for c in grid]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _shown(merge.summing(every, ["hour", "event_type"], ["n", "total"]))


@query("SELECT date_trunc('hour', ts) AS event_time, count(*) AS n FROM events GROUP BY date_trunc('hour', ts)")
def replay_declared_view(spark, d):
    """A declared view body whose alias shadows its source column: grouped by the truncated value."""
    source = _t(spark, d, "events").withColumnRenamed("ts", "event_time")
    view = replay.view_function(spark, "SELECT toStartOfHour(event_time) AS event_time, count() AS n FROM app.events GROUP BY event_time SETTINGS x=1", "app.events")
    return view(source).select(F.col("event_time").cast("timestamp_ntz").alias("event_time"), "n")


@query("""
SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1
""")
def replay_daily_orders(spark, d):
    def view(o):
        return o.groupBy(F.date_trunc("DAY", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    return replay.replay(_t(spark, d, "orders"), view, "o_orderdate", "1995-01-01 00:00:00", "1996-01-01 00:00:00")


@query("""
SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1
""")
def replay_join_view(spark, d):
    customer = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))

    def view(o):
        return o.join(customer, o["o_custkey"] == customer["c_custkey"]).groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    return replay.replay(_t(spark, d, "orders"), view, "o_orderdate", "1996-01-01 00:00:00", "1997-01-01 00:00:00")


@query("SELECT CAST(ts AS DATE) AS day, user_id, event_type, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def replay_positional_reorder(spark, d):
    view = lambda e: e.select("*", F.to_date("ts").alias("day"))
    return replay.replay(_t(spark, d, "events"), view, "ts", "2024-01-10 00:00:00", "2024-01-11 00:00:00", ["day", "user_id", "event_type", "event_id"])


@query("""
SELECT name, CASE WHEN in_key THEN 'order_by' ELSE 'column_scan' END AS found_by, CAST(row_number() OVER (ORDER BY NOT in_key, pos) AS BIGINT) AS preference
FROM (VALUES (0, 'id', 'UInt64', true), (1, 'created_at', 'DateTime64(3)', false), (2, 'ts', 'DateTime', true), (3, 'loaded', 'DateTime', false), (4, 'event_time', 'DateTime(''UTC'')', false)) AS t(pos, name, type, in_key)
WHERE type LIKE 'DateTime%' AND (in_key OR name IN ('created_at', 'timestamp', 'ingested_at', 'event_time', 'event_at', 'occurred_at'))
""")
def time_column_candidates(spark, d):
    t = Table("app", "e", tuple(Column(n, k) for n, k in (("id", "UInt64"), ("created_at", "DateTime64(3)"), ("ts", "DateTime"), ("loaded", "DateTime"), ("event_time", "DateTime('UTC')"))), order_by=("id", "ts"))
    return _rows(spark, "name string, found_by string, preference long", *[(n, by, i) for i, (n, by) in enumerate(replay.time_candidates(t), 1)])


# --- merged reads ------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, ts, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def final_replacing(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", F.round("value", 6).alias("value"))
    t = Table("app", "e", (), engine="ReplacingMergeTree(ts)", order_by=("user_id",))
    return merge.final(e, t, ["event_id"])


@query("SELECT l_orderkey, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <> 0 OR sum(l_extendedprice) <> 0")
def final_summing(spark, d):
    t = Table("app", "l", (), engine="SummingMergeTree((l_quantity, l_extendedprice))", order_by=("l_orderkey",))
    out = merge.final(_t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), t)
    return out.select("l_orderkey", F.round("l_quantity", 2).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice"))


@query("SELECT event_type, max(ts) AS last_ts, round(sum(value), 4) AS total, min(user_id) AS first_user FROM events GROUP BY 1")
def final_aggregating(spark, d):
    columns = (
        Column("event_type", "String"), Column("last_ts", "SimpleAggregateFunction(max, DateTime64(6))"),
        Column("total", "SimpleAggregateFunction(sum, Float64)"), Column("first_user", "SimpleAggregateFunction(min, Int64)"),
    )
    e = _t(spark, d, "events").select("event_type", F.col("ts").alias("last_ts"), F.col("value").alias("total"), F.col("user_id").alias("first_user"))
    out = merge.final(e, Table("app", "a", columns, engine="AggregatingMergeTree()", order_by=("event_type",)))
    return out.withColumn("total", F.round("total", 4))


_SIGNED = "(SELECT user_id, event_id, value, event_id % 4 AS version, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign FROM events)"


def _signed(spark, d):
    return _t(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_id") % 4).alias("version"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"))


@query(f"SELECT user_id, CAST(sum(sign) AS BIGINT) AS n, round(sum(sign * value), 4) AS value FROM {_SIGNED} GROUP BY 1 HAVING sum(sign) > 0")
def final_collapsing(spark, d):
    return merge.collapsed_sums(_signed(spark, d), ["user_id"], "sign", ["value"]).select("user_id", "n", F.round("value", 4).alias("value"))


@query(f"SELECT user_id, max(event_id) FILTER (sign > 0) AS event_id, 1 AS sign FROM {_SIGNED} GROUP BY 1 HAVING sum(sign) > 0 AND max(event_id) FILTER (sign > 0) IS NOT NULL")
def final_collapsing_rows(spark, d):
    t = Table("app", "c", (), engine="CollapsingMergeTree(sign)", order_by=("user_id",))
    return merge.final(_signed(spark, d).select("user_id", "event_id", "sign"), t, ["event_id"])


@query(f"SELECT user_id, version, max(event_id) FILTER (sign > 0) AS event_id, 1 AS sign FROM {_SIGNED} GROUP BY 1, 2 HAVING sum(sign) > 0 AND max(event_id) FILTER (sign > 0) IS NOT NULL")
def final_versioned_collapsing(spark, d):
    t = Table("app", "v", (), engine="VersionedCollapsingMergeTree(sign, version)", order_by=("user_id",))
    return merge.final(_signed(spark, d).select("user_id", "version", "event_id", "sign"), t, ["event_id"])


@query("SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-31' GROUP BY 1")
def ttl_retained(spark, d):
    kept = merge.retained(_t(spark, d, "events"), "ts + INTERVAL 7 DAY DELETE", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS p, count(*) AS n FROM orders GROUP BY 1")
def partition_month_counts(spark, d):
    (part,) = merge.partition_columns("toYYYYMM(o_orderdate)").values()
    return _t(spark, d, "orders").groupBy(part.alias("p")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(year(ts) * 100 + month(ts) AS BIGINT) AS month, count(*) AS n FROM events GROUP BY 1, 2")
def partition_tuple_counts(spark, d):
    a, b = merge.partition_columns("tuple(event_type, toYYYYMM(ts))").values()
    return _t(spark, d, "events").groupBy(a.alias("event_type"), b.alias("month")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_key_violations(spark, d):
    return merge.unique_violations(_t(spark, d, "orders"), ["o_custkey"])


# --- skip indexes and projections -----------------------------------------------------------------------------------------


def _granules(spark, d, name="events", position="event_id", rows=1000):
    return granules.with_granule(_t(spark, d, name), position, rows)


@query("SELECT CAST(event_id // 1000 AS BIGINT) AS granule, min(ts) AS low, max(ts) AS high, count(*) AS n FROM events GROUP BY 1")
def granule_minmax(spark, d):
    return granules.minmax(_granules(spark, d), "ts")


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value BETWEEN 1 AND 2")
def granule_minmax_prune(spark, d):
    g = _granules(spark, d)
    return granules.prune_minmax(g, granules.minmax(g, "value"), 1, 2).where("value between 1 and 2").select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("""
SELECT granule, CASE WHEN len(m) <= 3 THEN array_to_string(m, ',') END AS members
FROM (SELECT CAST(event_id // 2 AS BIGINT) AS granule, list_sort(list(DISTINCT event_type)) AS m FROM events GROUP BY 1)
""")
def granule_set_index(spark, d):
    g = _granules(spark, d, rows=2)
    return granules.value_set(g, "event_type", 3).select("granule", F.array_join("members", ",").alias("members"))


@query("""
SELECT DISTINCT granule, token FROM (SELECT CAST(doc_id // 100 AS BIGINT) AS granule,
 unnest(string_split_regex(lower(text), '[^A-Za-z0-9]+')) AS token FROM documents) WHERE token <> ''
""")
def granule_token_index(spark, d):
    return granules.token_sets(_granules(spark, d, "documents", "doc_id", 100), "text")


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^A-Za-z0-9]+'), 'clown')")
def granule_token_prune(spark, d):
    g = _granules(spark, d, "documents", "doc_id", 100)
    return granules.prune_tokens(g, granules.token_sets(g, "text"), ["clown"]).where(F.array_contains(granules.tokens("text"), "clown")).select("doc_id")


@query("""
SELECT DISTINCT granule, substr(t, i, 4) AS token FROM (SELECT granule, t, unnest(range(1, greatest(length(t) - 2, 1))) AS i
FROM (SELECT CAST(p_partkey // 1000 AS BIGINT) AS granule, lower(p_name) AS t FROM part)) WHERE length(t) >= 4
""")
def granule_ngram_index(spark, d):
    return granules.token_sets(_granules(spark, d, "part", "p_partkey"), "p_name", n=4)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def projection_status_counts(spark, d):
    return granules.projection(_t(spark, d, "events"), "SELECT event_type, count() AS n GROUP BY event_type")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def projection_recent(spark, d):
    return granules.projection(_t(spark, d, "events"), "SELECT event_id, user_id, ts ORDER BY ts DESC, event_id LIMIT 10")


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def view_filter_project(spark, d):
    view = replay.view_function(spark, "SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance FROM app.customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", "app.customer")
    return view(_t(spark, d, "customer"))


# --- metadata ------------------------------------------------------------------------------------------------------------

_TABLES = "(VALUES ('a', 'e', 'MergeTree()'), ('a', 'u', 'Log()'), ('b', 'e', 'Log()')) AS t(database, name, engine)"
_COLUMNS = "(VALUES ('a', 'e', 2, 'ts', 'DateTime'), ('a', 'e', 1, 'id', 'UInt64'), ('a', 'u', 1, 'id', 'UInt64'), ('x', 'y', 1, 'q', 'Int8')) AS t(database, name, position, \"column\", type)"
_INDEXES = "(VALUES ('a', 'e', 'j', 'ts'), ('a', 'e', 'i', 'id')) AS t(database, name, \"index\", expression)"


@query(f"""
SELECT t.database, t.name, engine, (SELECT string_agg("column" || ' ' || type, ',' ORDER BY position) FROM {_COLUMNS.replace("AS t(", "AS c(")} WHERE c.database = t.database AND c.name = t.name) AS columns,
 (SELECT string_agg("index" || ' ' || expression, ',' ORDER BY "index") FROM {_INDEXES.replace("AS t(", "AS i(")} WHERE i.database = t.database AND i.name = t.name) AS indexes FROM {_TABLES}
""")
def table_details(spark, d):
    tables = _rows(spark, "database string, name string, engine string", ("a", "e", "MergeTree()"), ("a", "u", "Log()"), ("b", "e", "Log()"))
    columns = _rows(spark, "database string, name string, position int, column string, type string", ("a", "e", 2, "ts", "DateTime"), ("a", "e", 1, "id", "UInt64"), ("a", "u", 1, "id", "UInt64"), ("x", "y", 1, "q", "Int8"))
    indexes = _rows(spark, "database string, name string, index string, expression string", ("a", "e", "j", "ts"), ("a", "e", "i", "id"))
    text = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x[a], x[b])), ",").alias(c)
    return metadata.table_details(tables, columns, indexes).select("database", "name", "engine", text("columns", "column", "type"), text("indexes", "index", "expression"))


_FILES = (("001_a.sql", "create a"), ("002_b.sql", "create b"), ("003_c.sql", "create c"), ("004_d.sql", "create d"))
_FILES_SQL = "(VALUES " + ", ".join(map(str, _FILES)) + ") AS t(name, content)"


def _journal(spark):
    files = _rows(spark, "name string, content string", *_FILES).withColumn("checksum", F.sha2("content", 256))
    changed = F.when(F.col("name") == "002_b.sql", F.sha2(F.lit("other"), 256)).when(F.col("name") == "003_c.sql", "").otherwise(F.col("checksum"))
    return files, files.where("name < '004'").select("name", changed.alias("checksum"))


@query(f"SELECT name, sha256(content) AS checksum FROM {_FILES_SQL} WHERE name NOT IN ('001_a.sql', '002_b.sql', '003_c.sql')")
def pending_migrations(spark, d):
    from ..sources import journal

    return journal.pending(*_journal(spark)).select("name", "checksum")


@query(f"SELECT name, sha256('other') AS expected, sha256(content) AS actual FROM {_FILES_SQL} WHERE name = '002_b.sql'")
def checksum_mismatches(spark, d):
    from ..sources import journal

    return journal.mismatches(*_journal(spark))


@query("""
SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 0 AND 255 THEN '' ELSE 'o_custkey' END AS problem FROM orders
""")
def ingest_contract_split(spark, d):
    t = Table("app", "o", (Column("o_orderkey", "UInt64"), Column("o_custkey", "UInt8"), Column("o_orderstatus", "LowCardinality(String)"), Column("o_totalprice", "Nullable(Float64)")))
    marked = ingest.checked(_t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), t)
    return marked.select("o_orderkey", F.array_join("_problems", ",").alias("problem"))


# --- declared vocabulary ---------------------------------------------------------------------------------------------------


@query("SELECT event_type, round(avg(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)), 6) AS k FROM events GROUP BY 1")
def json_extract_avg(spark, d):
    value = F.expr(translate_expression("JSONExtractFloat(props, 'k')"))
    return _t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(value), 6).alias("k"))


@query("SELECT event_id, array_to_string(regexp_extract_all(props, '[0-9]+'), ',') AS numbers FROM events")
def extract_all_numbers(spark, d):
    return _t(spark, d, "events").select("event_id", F.array_join(F.expr(translate_expression("extractAll(props, '[0-9]+')")), ",").alias("numbers"))


@query("SELECT doc_id, len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS n FROM documents")
def array_distinct_filter(spark, d):
    words = _t(spark, d, "documents").withColumn("words", F.split("text", " "))
    return words.select("doc_id", F.size(F.expr(translate_expression("arrayDistinct(arrayFilter(x -> x != '', words))"))).cast("long").alias("n"))


@query("""
SELECT CAST(ts AS DATE) AS day, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS BIGINT) AS ymd, count(*) AS n, CAST(max(octet_length(encode(event_type))) AS INTEGER) AS longest FROM events GROUP BY 1, 2
""")
def date_vocabulary(spark, d):
    view = replay.view_function(spark, "SELECT toDate(ts) AS day, toYYYYMMDD(ts) AS ymd, count() AS n, max(length(event_type)) AS longest FROM app.events GROUP BY day, ymd", "app.events")
    return view(_t(spark, d, "events"))
