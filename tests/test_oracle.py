"""Every query with a SQL twin, at the smallest scale. The driver repeats this at a larger one."""

import pytest

import __spark_entry__ as entry
import oracle

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert oracle.compare(entry.queries()[name](spark, sf), con, SQL[name]) == ""


def test_entry(spark):
    assert {"category", "total_revenue", "revenue_percentage"} <= set(entry.entry(spark).columns)


def test_names():
    assert set(SQL) <= set(entry.queries())
