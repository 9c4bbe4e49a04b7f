"""Vector codes against plain Lloyd rounds in Python integers."""

import math

import numpy as np
import pytest

from logsift.llm import vector_codes as V


@pytest.mark.parametrize("n,d,k,spread", [(3000, 4, 64, 60), (1, 4, 64, 60), (3, 2, 3, 5), (100, 1, 64, 9), (777, 4, 64, 3), (500, 4, 5, 60), (400, 3, 1, 60)])
def test_trees_find_the_nearest_entry(n, d, k, spread):
    """Assignments, with ties and equal entries, and cached sums."""
    rng = np.random.default_rng(n)
    parts, books = rng.integers(-spread, spread, (3, n, d)), rng.integers(-spread, spread, (3, k, d))
    books[:, k // 2] = books[:, 0]
    want = ((parts[:, :, None] - books[:, None]) ** 2).sum(-1).argmin(2)
    tree, book = V.Tree(parts, V.LEAF), V.Tree(books, 1)
    assert (V.codes(tree, book, n) == want).all()
    assert (V.codes(V.Tree(parts, V.LEAF, tree.places), book, n) == want).all()
    count, total = V.sums(tree, book, k)
    for t in range(3):
        for e in range(k):
            assert count[t, e] == (want[t] == e).sum() and (total[t, e] == parts[t][want[t] == e].sum(0)).all()


def test_whole_nodes_are_assigned_by_their_sums():
    """Parts in tight clusters around the entries: nearly nothing is left for the leaves."""
    rng = np.random.default_rng(1)
    books = rng.integers(-10_000, 10_000, (1, 16, 4))
    parts = (books[:, rng.integers(0, 16, 4096)] + rng.integers(-2, 3, (1, 4096, 4)))
    (_, whole, (place, _)), = V.assign(V.Tree(parts, V.LEAF), V.Tree(books, 1))
    assert len(place) < 2048 and any(level < 8 for level, node, _ in whole if len(node))


def brute(rows, parts, entries, rounds):
    rows = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    d = len(x[0]) // parts
    order = sorted(range(len(x)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, rows[r][1]))[:entries]
    books = [[x[r][p * d:p * d + d] for r in order] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * d:p * d + d], e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for v in x:
                mine.setdefault(nearest(p, v)[1], []).append(v[p * d:p * d + d])
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j])] if j in mine else e for j, e in enumerate(books[p])]
    found = [[nearest(p, v) for p in range(parts)] for v in x]
    return sorted(((i, label, "".join(f"{j:02x}" for _, j in f), sum(e for e, _ in f)) for (i, _, label), f in zip(rows, found)), key=str), books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", None, 3) for i, v, label in rows],
                                 "vec_id long, embedding array<double>, label int, code string, v string, far int")


@pytest.mark.parametrize("entries", [4, 64])
def test_rounds(spark, entries):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(size=8)], int(i) % 3 or None) for i in rng.permutation(150)]
    rows += [(7, rows[0][1], 1), (7, rows[1][1], 1), (None, rows[2][1], 2), (500, None, 1), (501, [1.0, None] * 4, 1), (502, [math.nan] * 8, 1),
             (503, [math.inf] + [0.0] * 7, 1), (504, [], 1), (505, [0.0] * 8, None), (-4, [-0.5] * 8, 1), (506, [-1 / 256 - 1e-9] * 8, 1)]
    coded, books = V.compress(frame(spark, rows).repartition(7), parts=4, entries=entries)
    want, want_books = brute(rows, 4, entries, V.ROUNDS)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == want
    assert books.tolist() == want_books


def test_defined_results(spark):
    near = [(i, [float(i), 1.0] * 8, None if i < 2 else 1) for i in range(4)]
    out = {r.vec_id: r for r in V.digest(frame(spark, near + [(9, [1e300, 0.0] * 8, 1), (10, [1.0] * 32, 1)])).collect()}
    assert out.keys() == {0, 1, 2, 3, 9}        # ten is of another length
    assert (out[9].code, out[9].error, out[9].label_error) == (None, None, None)
    assert [out[i].code for i in range(4)] == [f"{i:02x}00" * 8 for i in range(4)] and {out[i].label_error for i in range(4)} == {0}
    assert V.digest(frame(spark, [])).count() == 0 and V.digest(frame(spark, [(1, None, 2), (2, [math.nan], 2)])).count() == 0
    with pytest.raises(ValueError):
        V.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]), parts=2)
