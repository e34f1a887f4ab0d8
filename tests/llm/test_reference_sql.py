"""The text queries that SQL can express, against it on the smallest tables."""

import pytest
from compare import compare, connect

from hourloom.llm.oracle import SQL
from hourloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    equal, message = compare(spark, con, QUERIES[name], SQL[name], FOLDER)
    assert equal, message
