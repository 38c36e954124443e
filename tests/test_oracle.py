"""Every registered query against its SQL on DuckDB, over whole tables."""

import pytest
from oracle import connection, difference

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_answer(spark, folder, con, name):
    assert difference(QUERIES[name](spark, folder), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    # With ten suppliers in the smallest tables, l_suppkey counts as categorical there.
    names = {r.column_name for r in entry_points.entry(spark).collect()}
    assert names == {"l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"}
