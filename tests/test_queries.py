"""Every registered core query against its SQL, and the driver's contract."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from lectern import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    got, want = compare(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= (name != "fuzzy_ratio")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
