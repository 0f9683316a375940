"""The registered corpus queries that have an oracle agree with it, value by value."""

import pytest
from compare import compare, database

from downfield.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, sf, con, name):
    assert not compare(queries.QUERIES[name](spark, sf), con, queries.ORACLES[name])
