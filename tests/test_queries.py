"""Every query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from strataflow.plans import catalog_queries, engine_queries

QUERIES, ORACLES = {**catalog_queries.QUERIES, **engine_queries.QUERIES}, {**catalog_queries.ORACLES, **engine_queries.ORACLES}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(request):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, data, name):
    got = QUERIES[name](spark, data)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=str)
    assert a == b and a


def test_entry_and_queries_without_training_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
