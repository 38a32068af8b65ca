"""Every registered query of the engine itself against its oracle SQL on the smallest tables."""

import os

import harness
import pytest
from conftest import SMALL

from quern.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return harness.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert harness.difference(spark, SMALL, registry.QUERIES[name], registry.ORACLE_SQL[name], con) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    assert df.count() > 0


def test_flagship_has_a_stable_schema(spark):
    df = registry.flagship(spark, SMALL)
    assert df.columns == ["data_source", "task_type", "n_prompts", "n_kept", "mean_score", "mean_abs_adv"]
