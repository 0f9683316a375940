"""Every registered query that has an oracle agrees with it, value by value."""

import pytest
from compare import compare, database

from downfield.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


# The smallest tables hold no play of this kind, so its oracle is empty there.
EMPTY_AT_SMALLEST = {"replay_game"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf, con, name):
    found = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    if name in EMPTY_AT_SMALLEST:
        found = [d for d in found if d != "oracle gives no rows"]
    assert not found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
