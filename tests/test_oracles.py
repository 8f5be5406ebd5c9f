"""Every query that has SQL, against DuckDB over the same tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from compare import spark_bag, sql_bag, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test data are not here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    expected = con.execute(SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in expected.description)
    assert spark_bag(df) == sql_bag(con, SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_duckdb_is_there():
    assert duckdb.__version__
