"""The registered queries against their oracle SQL on the smallest tables."""

import os

import harness
import pytest
from conftest import SMALL

from quern.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert harness.difference(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
