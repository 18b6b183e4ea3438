"""Every registered query with a SQL twin must equal it at sf0.01."""

import pytest

from tests.oracle import compare, duck
from trawl.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    problems, n = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() >= 0
