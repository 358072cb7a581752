"""Every registered query of the base engine gives the rows of its SQL."""

import compare
import pytest

from tessera import write_queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    assert compare.difference(spark, duck, sf, Q.QUERIES[name], Q.SQL[name]) is None


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "o_orderkey"
    assert set(e.oracle_sql()) <= set(e.queries())
