"""The queries that SQL can express agree with it."""

import oracle
import pytest

from loomstone.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_matches_sql(spark, sf, name):
    con = oracle.duck(sf)
    df = queries.queries()[name](spark, sf)
    assert oracle.differences(df, con, oracles.SQL[name]) == ""
