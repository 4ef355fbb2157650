"""Every registered query that has SQL gives the same values as the SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_values(spark, root, con, name):
    assert compare(QUERIES[name](spark, root), con, SQL[name]) in ("", "EMPTY")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, root, name):
    assert QUERIES[name](spark, root).count() >= 0
