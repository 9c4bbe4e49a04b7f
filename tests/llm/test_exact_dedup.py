"""Exact duplicates against plain grouping, with weak digests and odd rows."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_cases import LONG, ODD, docs_of  # noqa: F401
from logsift.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), at == 0, hashlib.sha256(t.encode()).hexdigest()) for at, i in enumerate(ids)]
    return sorted(out, key=str)


def got(df, **options):
    return sorted((tuple(r) for r in E.exact_duplicates(df, **options).collect()), key=str)


def test_odd_rows(docs_of):
    rows = ODD + [(8, "a  b\n"), (7, "a b "), (7, "a\tb\x0b"), (9, " a b "), (None, "no id"), (None, "no\tid"), (10, "A b "), (11, LONG + " "),
                  (12, LONG + "\n"), (0, " x"), (13, "\x1cx"), (14, " x")]
    assert got(docs_of(rows)) == brute(rows)


def test_empty_table(docs_of):
    df = docs_of([])
    assert got(df) == [] and E.distinct_texts(df).columns == df.columns and E.distinct_texts(df).count() == 0


@pytest.mark.parametrize("digest", [lambda t: F.lit("one"), lambda t: F.char_length(t).cast("string"), lambda t: F.left(t, F.lit(1))])
def test_texts_that_share_a_digest_stay_apart(docs_of, digest):
    rows = [(i, t) for i, t in enumerate(["ab", "ab", "cd", "ce", "a  b", "a b", "ab", None, "", " ", "cd"])] + [(3, "ce"), (None, "ce")]
    assert [r[:4] for r in got(docs_of(rows), digest=digest)] == [r[:4] for r in brute(rows)]


def test_a_hot_group_over_many_tasks(docs_of):
    rows = [(i, "the same text" if i % 3 else f"text {i // 6}") for i in range(600)]
    assert got(docs_of(rows).repartition(90)) == brute(rows)


def test_distinct_texts_keep_their_columns(docs_of):
    df = docs_of([(3, "x  y"), (2, "x y"), (2, "x\ny"), (5, None), (4, "")])
    kept = E.distinct_texts(df)
    assert kept.columns == df.columns
    rows = sorted((r.doc_id, r.text, r.score, r.n) for r in kept.collect())
    assert [r[0] for r in rows] == [2, 4] and rows[0][1] in ("x y", "x\ny") and rows[1] == (4, "", 1.5, 7)


def test_no_python_on_the_path(docs_of):
    plan = E.exact_duplicates(docs_of(ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
