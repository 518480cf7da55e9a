"""Every registered query gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, difference

QUERIES, ORACLES = entry_module.QUERIES, entry_module.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_all_of_them_are_registered():
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLES.items() <= entry_module.oracle_sql().items()


def test_entry_gives_hours(spark):
    hours = entry_module.entry(spark)
    assert hours.columns == ["hour", "roots", "legs", "minutes", "amplification"]
    assert 0 < hours.count() <= 18


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None
