"""Near duplicates against a brute force over all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import LONG, ODD, SF, docs_of  # noqa: F401
from logsift.llm import near_dedup as N
from logsift.llm.common import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def test_estimates_far_below_the_limit_are_verified():
    """Sets at a similarity of exactly 0.75 may by chance agree in half of the registers."""
    equal = np.arange(N.REGISTERS) < N.REGISTERS // 2
    ra, rb = np.arange(1, N.REGISTERS + 1, dtype=np.uint16), np.where(equal, 0, 1000).astype(np.uint16)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([2]), pa.array([200]), pa.array([200]), pa.array([ra.tobytes()]), pa.array([(ra + rb).tobytes()])],
        names=["a", "b", "na", "nb", "ra", "rb"])
    assert sum(b.num_rows for b in N._likely([batch])) == 1


def brute(rows):
    sets, by = {}, defaultdict(list)
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[i]:
            by[s].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}


def test_whole_table(spark):
    df = read_table(spark, SF, "documents", "doc_id", "text")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_a_large_group_of_drifting_copies(docs_of):
    """Copies of copies with words changed: many links near the limit, components that a star alone would miss."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts, pool = [], [base]
    for _ in range(260):
        t = list(rng.choice(pool))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
        pool.append(t)
        texts.append(" ".join(t))
    rows = list(enumerate(texts + [" ".join(rng.choice(words) for _ in range(80)) for _ in range(40)]))
    rng.shuffle(rows)
    assert got(docs_of(rows)) == brute(rows)


def test_short_texts_and_case(docs_of):
    rows = [(1, "A b C"), (2, "a B c"), (3, "a b"), (4, "a b c d e f g h"), (5, "a b c d e f g h i"), (6, "a b c d e"), (7, "É b"),
            (8, "é b")]
    assert got(docs_of(rows)) == brute(rows)


def test_odd_rows(docs_of):
    rows = N.near_duplicates(docs_of(ODD)).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[2] == by[3] == [(0, by[1][0][1], True)] or [by[k][0][0] for k in (1, 2, 3)] == [0, 0, 0]
    assert [by[k] for k in (1, 2, 3)] == [[(0, k, True)] for k in (1, 2, 3)]
    assert by[4] == [(8, 4, True)] and by[5] == [(1, 5, True)] * 2
    assert by[None] == [(2, None, False)]


def test_repeated_ids_with_different_texts(docs_of):
    """A row keeps its links whatever rows share its doc_id; rows without one are linked and kept like others."""
    w, v, u = (" ".join(f"{c}{i}" for i in range(40)) for c in "wvu")
    rows = [(1, w), (1, v), (2, v + " end"), (3, w + " tail"), (4, u), (None, u), (None, w), (None, "no one else has these words"),
            (None, "no one else has these words"), (None, None), (5, "a b"), (5, "a b")]
    got_rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got_rows == sorted([(1, 36, 1, True), (1, 36, 1, True), (2, 37, 1, False), (3, 37, 1, False), (4, 36, 4, True),
                               (None, 36, 4, False), (None, 36, 1, False), (None, 2, None, False), (None, 2, None, False),
                               (None, 0, None, False), (5, 1, 5, True), (5, 1, 5, True)], key=str)
    kept = N.keep_one(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(1, w), (1, v), (4, u), (None, "no one else has these words"), (None, None), (5, "a b")], key=str)
    assert N.near_duplicates(docs_of(rows)).columns == ["doc_id", "n_shingles", "component_id", "kept", "class_id"]


def test_empty_table_and_kept_rows(docs_of):
    assert N.near_duplicates(docs_of([])).count() == 0
    kept = N.keep_one(docs_of([(1, LONG), (2, LONG), (3, LONG + " omega"), (9, "other words stand here now"), (9, "other words stand here now")]))
    assert kept.columns == docs_of([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 9] and N.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("n", [3, 40, 400, 4000])
def test_estimate_and_registers(n):
    """The estimate is near the similarity, and equal sets have equal registers."""
    rng = np.random.default_rng(n)
    a = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
    b = np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2 ** 63, n - int(n * 0.9), dtype=np.uint64)])
    ra, rb = N.registers(np.sort(a)), N.registers(np.sort(b))
    assert (N.registers(a[::-1].copy()) == ra).all()
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    e = N.estimate(ra[None], rb[None], np.array([float(n)]), np.array([float(n)]))[0]
    assert abs(e - j) <= max(0.2, 4 * (j * (1 - j) / min(n, N.REGISTERS)) ** 0.5)
    unrelated = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
    assert N.estimate(ra[None], N.registers(unrelated)[None], np.array([float(n)]), np.array([float(n)]))[0] < 0.15
