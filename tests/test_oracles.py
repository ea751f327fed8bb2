"""Every registered query against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from paperloom.plans import registry
from paperloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_narrow_queries_read_few_columns(spark):
    plan = registry.QUERIES["clean_detections"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan
    plan = registry.QUERIES["box_geometry"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
