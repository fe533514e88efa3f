import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions import text, types
from strataflow.functions.vocabulary import UnsupportedVocabulary, translate_expression, translate_query


@pytest.mark.parametrize(
    "declared, spark_type",
    [
        ("String", T.StringType()), ("UInt8", T.ShortType()), ("UInt16", T.IntegerType()), ("UInt32", T.LongType()), ("UInt64", T.DecimalType(20, 0)),
        ("UInt256", T.StringType()), ("Int8", T.ByteType()), ("Int16", T.ShortType()), ("Int32", T.IntegerType()), ("Int64", T.LongType()), ("Int128", T.StringType()),
        ("Float32", T.FloatType()), ("BFloat16", T.FloatType()), ("Float64", T.DoubleType()), ("Bool", T.BooleanType()), ("Boolean", T.BooleanType()),
        ("Date", T.DateType()), ("Date32", T.DateType()), ("DateTime", T.TimestampType()), ("DateTime('UTC')", T.TimestampType()), ("DateTime64(3, 'UTC')", T.TimestampType()),
        ("Decimal(18, 4)", T.DecimalType(18, 4)), ("Decimal32(2)", T.DecimalType(9, 2)), ("Decimal64(4)", T.DecimalType(18, 4)), ("Decimal128(10)", T.DecimalType(38, 10)), ("Decimal256(10)", T.StringType()),
        ("FixedString(10)", T.StringType()), ("UUID", T.StringType()), ("IPv4", T.StringType()), ("Enum8('a' = 1, 'b' = 2)", T.StringType()), ("JSON", T.VariantType()),
        ("Array(Array(UInt8))", T.ArrayType(T.ArrayType(T.ShortType(), False), False)), ("Array(Nullable(String))", T.ArrayType(T.StringType(), True)),
        ("Map(String, UInt32)", T.MapType(T.StringType(), T.LongType(), False)), ("LowCardinality(String)", T.StringType()),
        ("SimpleAggregateFunction(sum, UInt64)", T.DecimalType(20, 0)),
    ],
)
def test_type_mapping(declared, spark_type):
    assert types.map_type(declared).spark == spark_type


def test_nested_and_named_tuples():
    t = types.map_type("Tuple(a UInt8, Nullable(String), Tuple(Int64, Date))").spark
    assert [f.name for f in t] == ["a", "_2", "_3"] and t["_2"].nullable and not t["a"].nullable


def test_nullability_comes_from_flag_or_wrapper():
    assert types.struct_field("x", "LowCardinality(Nullable(String))").nullable
    assert types.struct_field("x", "String", True).nullable and not types.struct_field("x", "String").nullable


@pytest.mark.parametrize("bad", ["", "Strin", "AggregateFunction(sum, UInt8)", "Array()", "Map(String)", "Nullable(Array(UInt8))", "FixedString(x)", "Enum8()", "Decimal(3, 9)", "String(3)", "Nested(a UInt8)", "Array(UInt8))"])
def test_unknown_types_are_refused(bad):
    with pytest.raises(types.TypeMappingError):
        types.map_type(bad)


def test_long_opt_in_and_metadata():
    assert types.map_type("UInt64", "long").spark == T.LongType()
    assert types.map_type("SimpleAggregateFunction(max, DateTime)").metadata["agg"] == "max"
    assert types.map_type("Enum8('x' = -1, 'it''s' = 4)").metadata["enum"] == {"x": -1, "it's": 4}


def test_value_checks(spark):
    rows = spark.createDataFrame([(300, "a", str(2**128 - 1), "1.2.3.4"), (255, "z", str(2**128), "256.1.1.1"), (-1, None, "-1", None)], "u int, e string, w string, ip string")
    got = rows.select(
        types.value_check(F.col("u"), "UInt8").alias("u"), types.value_check(F.col("e"), "Enum8('a'=1)").alias("e"), types.value_check(F.col("w"), "UInt128").alias("w"), types.value_check(F.col("ip"), "IPv4").alias("ip")
    ).collect()
    assert [tuple(r) for r in got] == [(False, True, True, True), (True, False, False, False), (False, None, False, None)]
    codes = rows.select(types.enum_code(F.col("e"), "Enum8('a'=5,'z'=2)").alias("c")).collect()
    assert [r.c for r in codes] == [5, 2, None]


def test_split_top_level_and_keys():
    assert text.split_top_level("a, f(b, c), 'x,y', `d,e`") == ["a", "f(b, c)", "'x,y'", "`d,e`"]
    assert text.key_columns(["a, b", " c "]) == ["a", "b", "c"] and text.split_top_level(" ") == []


def test_normal_forms_keep_literals():
    assert text.normalize_fragment("  a\n  =  'x   y' ") == "a = 'x   y'"
    assert text.normalize_engine("SharedMergeTree") == "MergeTree()" and text.normalize_engine("ReplacingMergeTree(v)") == "ReplacingMergeTree(v)"
    assert text.normalize_clause("((`a`, b))") == "a, b" and text.normalize_clause("(a) + (b)") == "(a) + (b)" and text.normalize_clause(None) == ""


def test_engine_column_matches_function(spark):
    names = ["SharedReplacingMergeTree(v)", "MergeTree", "Sharedx"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(text.engine_column(F.col("n")).alias("e")).collect()
    assert [r.e for r in got] == [text.normalize_engine(n) for n in names]


def test_statement_splitter():
    sql = "-- head; not a statement\nSELECT ';' AS a; /* ; */ INSERT `x;y`;\n  -- tail\n;;SELECT \"a;b\""
    assert text.split_statements(sql) == ["SELECT ';' AS a", "/* ; */ INSERT `x;y`", 'SELECT "a;b"']


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("count()", "count(*)"), ("toYYYYMM(ts)", "cast(year(ts) * 100 + month(ts) AS bigint)"), ("toStartOfDay(x)", "date_trunc('DAY', x)"), ("tuple(a, toDate(b))", "struct(a, to_date(b))"),
        ("extractAll(s, '(\\\\d+)')", "regexp_extract_all(s, '(\\\\d+)', 1)"), ("extractAll(s, '\\\\d+')", "regexp_extract_all(s, '\\\\d+', 0)"), ("arrayFilter(x -> x != '', a)", "filter(a, x -> x != '')"),
        ("ts + INTERVAL 1 DAY", "ts + INTERVAL 1 DAY"), ("lower(name)", "lower(name)"), ("length(name)", "octet_length(name)"), ("now64(3)", "current_timestamp()"), ("'toDate(x)'", "'toDate(x)'"),
    ],
)
def test_vocabulary(given, wanted):
    assert translate_expression(given) == wanted


@pytest.mark.parametrize("bad", ["quantile(0.5)(x)", "toFoo(x)", "toDate(a, b, c)", "f(("])
def test_vocabulary_is_closed(bad):
    with pytest.raises(UnsupportedVocabulary):
        translate_expression(bad)


def test_query_translation(spark):
    q = "WITH toStartOfHour(ts) AS h SELECT h AS ts, count() AS n FROM (SELECT ts FROM t WHERE n > 0) GROUP BY ts QUALIFY row_number() OVER (ORDER BY count() DESC) = 1 SETTINGS a = 1"
    spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:20:00", 1), ("2024-01-01 01:20:00", 1), ("2024-01-01 02:00:00", 0)], "ts string, n int").withColumn("ts", F.col("ts").cast("timestamp")).createOrReplaceTempView("t")
    rows = spark.sql(translate_query(q)).collect()
    assert len(rows) == 1 and rows[0].n == 2
    with pytest.raises(UnsupportedVocabulary):
        translate_query("INSERT INTO x VALUES (1)")
