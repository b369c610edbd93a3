"""Every query of the catalogue returns what its SQL does in DuckDB, over whole tables."""

import oracle
import pytest

from loomstone.plans import catalogue

#: Queries whose result is rightly empty on prose without what they look for.
MAY_BE_EMPTY = {"ch2_document_headings", "dd3_jaccard_join", "ex13_conditionals"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    assert oracle.differences(df, con, catalogue.oracle_sql()[name]) == ""
    assert name in MAY_BE_EMPTY or df.limit(1).count() == 1
