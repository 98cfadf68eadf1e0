"""Every registered query against its SQL on the smallest tables, and the entry point."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from thingfleet.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare(spark, con, name, SF)
    assert problem is None


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["nation", "region", "customers"] and df.count() > 0
