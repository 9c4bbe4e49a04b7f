"""Rows, paths and a fixture that the tests share."""

import pytest

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 6000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "a"), (5, "a"), (None, "b c d e f g"), (6, "Ünïcode ▁ 日本 \x00 end")]


@pytest.fixture
def docs_of(spark):
    """A documents table with columns whose names clash with those that operators use inside."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1.5, "y", None, 7) for i, t in rows],
            "doc_id long, text string, id string, score double, band string, component string, n int")
    return make
