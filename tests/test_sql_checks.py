"""Every query that has SQL gives the rows of that SQL."""

import oracle
import pytest

from folioflow.plans import ORACLES, QUERIES

MAY_BE_EMPTY = {"keyword_search"}


@pytest.fixture(scope="module")
def con(small):
    return oracle.duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, small, name):
    problems = oracle.compare(spark, con, small, name)
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert len(QUERIES[name](spark, small).take(1)) == 1
