"""Every registered query that has a SQL twin returns the same rows on DuckDB."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import connect, difference
from tests.conftest import SF

SQL = entry_point.oracle_sql()
QUERIES = entry_point.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, con):
    assert difference(QUERIES[name], SQL[name], spark, SF, con) is None


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() == 8 and "median" in df.columns
