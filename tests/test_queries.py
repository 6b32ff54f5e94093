"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) > 150


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, name):
    good, text = compare(spark, folder, name, QUERIES[name], SQL.get(name))
    assert good, text


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns[0] == "split"
    assert frame.count() == 2
