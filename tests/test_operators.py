import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataflow.operators import granules, ingest, merge, metadata
from strataflow.plans.model import Column, Table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replacing_never_mixes_rows(spark):
    df = spark.createDataFrame([("a", 1, 5, None), ("a", 2, None, "x"), ("a", 2, 7, None), ("b", 1, 1, "y")], "k string, v int, n int, s string")
    assert rows(merge.replacing(df.withColumn("seq", F.monotonically_increasing_id()), ["k"], "v", ["seq"]).drop("seq")) == [("a", 2, 7, None), ("b", 1, 1, "y")]


def test_replacing_with_maps_uses_a_window(spark):
    df = spark.sql("SELECT 'a' k, 1 v, map('x', 1) m UNION ALL SELECT 'a', 2, map('x', 2)")
    assert [r.m for r in merge.replacing(df, ["k"], "v").collect()] == [{"x": 2}]


def test_summing_drops_zero_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", -1, "y"), ("b", 2, "z"), ("b", 3, None)], "k string, n long, s string")
    assert rows(merge.summing(df, ["k"], ["n"])) == [("b", 5, "z")]


def test_collapsing_and_versions(spark):
    df = spark.createDataFrame([("a", 1, 10, 1), ("a", -1, 10, 1), ("a", 1, 20, 2), ("b", 1, 5, 1), ("b", -1, 5, 1)], "k string, sign int, v int, seq int")
    assert rows(merge.collapsing(df, ["k"], "sign", ["seq"])) == [("a", 1, 20, 2)]
    two = spark.createDataFrame([("a", 1, 1), ("a", -1, 2), ("a", 1, 2)], "k string, sign int, version int")
    assert rows(merge.versioned_collapsing(two, ["k"], "sign", "version")) == [("a", 1, 1)]


@pytest.mark.parametrize("engine", ["MergeTree", "SharedMergeTree", "ReplacingMergeTree(v)", "SummingMergeTree(v)", "AggregatingMergeTree", "CollapsingMergeTree(s)", "VersionedCollapsingMergeTree(s, v)"])
def test_final_dispatch(spark, engine):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "k string, v int, s int")
    t = Table("d", "t", (Column("k", "String"), Column("v", "SimpleAggregateFunction(max, Int32)"), Column("s", "Int32")), engine, order_by=("k",))
    assert merge.final(df, t).count() == (2 if engine.endswith("dMergeTree") and "Shared" in engine or engine == "MergeTree" or engine.startswith("Versioned") else 1)


def test_unknown_engine_and_aggregate(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        merge.final(df, Table("d", "t", (), "Log()"))
    with pytest.raises(ValueError):
        merge.aggregating(df, ["k"], {"v": "quantile"})


def test_ttl_keeps_rows_without_expiry(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9)), (3, None)], "id int, ts timestamp")
    assert sorted(r.id for r in merge.retained(df, "ts + INTERVAL 7 DAY DELETE", F.lit("2024-01-10").cast("timestamp")).collect()) == [2, 3]


def test_partition_columns_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 31)), (2, "b", dt.datetime(2024, 2, 1))], "id int, region string, ts timestamp")
    t = Table("d", "t", (), partition_by="tuple(region, toYYYYMM(ts))", order_by=("id",))
    assert list(merge.partition_columns(t.partition_by)) == ["region", "p1"] and list(merge.partition_columns("toDate(ts)")) == ["p0"]
    merge.write_partitioned(df, str(tmp_path / "t"), t)
    back = spark.read.parquet(str(tmp_path / "t")).where(merge.month_range("ts", "_p1", "2024-01-01", "2024-02-01"))
    assert [r.id for r in back.collect()] == [1] and "PartitionFilters: [isnotnull(_p1" in back._jdf.queryExecution().toString()


def test_granules_prune_no_match_away(spark):
    df = granules.with_granule(spark.range(100).select("id", (F.col("id") % 10).alias("v"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" Common")).alias("t")), "id", 10)
    assert granules.prune_minmax(df, granules.minmax(df, "id"), 35, 44).count() == 20
    assert granules.prune_set(df, granules.value_set(df, "v", 5), 3).count() == 100  # too many members: every granule is read
    assert granules.prune_set(df, granules.value_set(df, F.col("granule"), 5), 3).count() == 10
    assert granules.prune_tokens(df, granules.token_sets(df, "t"), ["COMMON", "w3"]).count() >= granules.prune_tokens(df, granules.token_sets(df, "t"), ["absent"]).count() == 0
    assert {r.token for r in granules.token_sets(df, "t", n=3).collect()} >= {"com", "omm", "mon"}


def test_bloom_files_and_projection(spark, tmp_path):
    df = spark.range(50).withColumn("g", F.col("id") % 3)
    granules.write_with_bloom(df, str(tmp_path / "b"), {"id": 50})
    assert spark.read.parquet(str(tmp_path / "b")).where("id = 7").count() == 1
    assert rows(granules.projection(df, "SELECT g, count() AS n WHERE id < 9 GROUP BY g")) == [(0, 3), (1, 3), (2, 3)]


def test_ingest_splits_with_reasons(spark):
    t = Table("d", "t", (Column("id", "UInt8"), Column("name", "String"), Column("kind", "Enum8('a'=1)", True), Column("src", "String", default="web")))
    df = spark.createDataFrame([("1", "x", "a", 1), ("300", "y", None, 2), ("2", None, "b", 3), ("z", "q", "a", 4)], "id string, name string, kind string, extra int")
    good, bad = ingest.split(df, t)
    assert rows(good) == [(1, "x", "a", "web")] and good.columns == ["id", "name", "kind", "src"]
    assert {r.extra: r._problems for r in bad.collect()} == {2: ["id"], 3: ["name", "kind"], 4: ["id"]}
    empty, rest = ingest.split(df.drop("name"), t)
    assert empty.count() == 0 and rest.count() == 4


def test_table_details(spark):
    tables = spark.createDataFrame([("d", "t"), ("d", "u")], "database string, name string")
    columns = spark.createDataFrame([("d", "t", 2, "b", "X"), ("d", "t", 1, "a", "Y")], "database string, name string, position int, column string, type string")
    indexes = spark.createDataFrame([], "database string, name string, index string, expression string")
    got = metadata.table_details(tables, columns, indexes).collect()
    assert [c.column for c in got[0].columns] == ["a", "b"] and got[1].columns is None
