"""Queries that SQL can express, against DuckDB."""

import pytest
from oracle_harness import compare, duck

from llm_cases import SF
from logsift.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    ok, message = compare(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name])
    assert ok, message


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
