"""Every catalog query against its DuckDB statement (sf0.001)."""

import pytest

from logsift.plans.catalog import QUERIES
from logsift.plans.oracle import sql_queries
from oracle_harness import compare, duck

from conftest import SF_SMALL

SQL = sql_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, SQL[name])
    assert ok, msg


def test_every_query_has_oracle_or_is_a_model():
    rows_only = {n for n in QUERIES if n not in SQL}
    assert rows_only == {"iforest_score", "ocsvm_score", "detect_pipeline"}
