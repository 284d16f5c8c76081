"""Every registered query with an oracle against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from tests.conftest import DATA

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, note, _ = compare(spark, con, DATA, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
