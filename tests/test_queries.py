import pytest

from lexaudit.plans.oracles import ORACLES
from lexaudit.plans.queries import QUERIES

from .oracle import DATA, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert assert_same(QUERIES[name](spark, DATA), ORACLES[name]) > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
