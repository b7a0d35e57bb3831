import pytest

from lexaudit.llm.oracles import ORACLES
from lexaudit.llm.queries import QUERIES

from ..oracle import DATA, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert assert_same(QUERIES[name](spark, DATA), ORACLES[name]) > 0
