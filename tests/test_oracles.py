"""Every catalogued query equals its DuckDB oracle (row count, columns, values)."""

import pytest

import __spark_entry__ as E
from cohortscope.testkit import compare, duckdb_connection
from conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "metric" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, SQL[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
