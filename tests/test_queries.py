"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from ledgerloom.plans.registry import ORACLES, QUERIES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, error = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert error is None and rows > 0


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
