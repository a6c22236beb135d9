"""The queries with SQL against DuckDB on the smallest tables."""

import os

import pytest

from cueframe.llm.queries import QUERIES, SQL
from tests.test_queries import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_contract_columns():
    assert list(QUERIES) == sorted(QUERIES, key=lambda k: int(k[2:].split("_")[0]))
