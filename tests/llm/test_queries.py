"""Registered queries with an oracle, on the smallest tables."""

import pytest

from checks.compare import compare, connect
from statloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_matches_oracle(spark, small, name):
    ok, note, _ = compare(spark, connect(small), small, name, QUERIES[name], ORACLES[name])
    assert ok, note
