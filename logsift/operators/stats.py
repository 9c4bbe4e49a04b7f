"""Quantiles and min/max as one-row aggregates.

Scalars (a quantile, a min and max) are computed by aggregate actions and then
used as literals: the plan that consumes them stays a narrow projection, with no
cross join and no one-row broadcast.

``exact=True`` finds exact linear-interpolation quantiles (the definition of
NumPy, pandas and DuckDB's ``quantile_cont``) of all columns together, by
narrowing value brackets (``exact_quantiles``): no buffer ever holds all
distinct values.  ``exact=False`` is ``percentile_approx``, a bounded sketch of
rank error ``1/accuracy``.  Null and NaN take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROX_ACCURACY = 100_000


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True) -> dict[str, list]:
    """{col: [q(p) for p in probs]} (None for a column without values)."""
    if not cols:
        return {}
    if exact:
        return exact_quantiles(df, {c: list(probs) for c in cols})
    row = df.agg(*[F.percentile_approx(_number(c), list(probs), APPROX_ACCURACY).alias(f"q{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(cols)}


def quantile(df: DataFrame, col: str, p: float, exact: bool = True):
    return quantiles(df, [col], [p], exact)[col][0]


def _number(c: str) -> Column:
    """The column as a double; NaN becomes null."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def min_max(df: DataFrame, col: str) -> tuple:
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r["lo"], r["hi"]


def minmax_norm(c, lo, hi) -> Column:
    """(x - lo) / (hi - lo); a constant column maps to 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    if lo is None or hi is None or hi == lo:
        return F.lit(0.0)
    return (col - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], accuracy: int = 10_000,
                    few: int = 4_096) -> dict[str, list]:
    """Exact linear-interpolation quantiles of several columns, all found together by the same passes.

    The rows at each column's least value are counted first: ranks among them are found, as in columns
    that are mostly zero, and are never sketched.
    Each other rank has an open bracket of values.  A pass (one aggregate over
    the table) sketches the values inside every bracket and counts those below
    it; the next counts the rows below and at the sketch's two values around
    the rank.  The rank then is one of these two values, or lies strictly
    between them, which is the next bracket; so a value that a third of all rows
    share is found as an end, never counted again, and every pass shrinks the
    bracket by about ``accuracy``.  Once a bracket holds at most ``few`` rows
    these are fetched in order.
    """
    cols = list(wanted)
    first = df.agg(*[f(_number(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("m", F.min))]).first()
    size = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    place = {(c, p): (size[c] - 1) * p for c in cols for p in wanted[c] if size[c]}
    ranks = {(c, min(int(math.floor(x)) + d, size[c] - 1)) for (c, _), x in place.items() for d in (0, 1)}
    found: dict[tuple, float] = {}
    # (column, low, high, rows at or below low, rows inside) to the ranks inside; low and high exclusive, None: open
    brackets = {(c, None, None, 0, size[c]): {k for x, k in ranks if x == c} for c in cols if size[c]}
    large = [(i, b) for i, b in enumerate((c, None, None, 0, size[c]) for c in cols) if b[4] > few]
    if large:
        row = df.agg(*[F.count_if(_number(b[0]) == F.lit(first[f"m{i}"])).alias(f"l{i}") for i, b in large]).first()
        for i, b in large:
            c, least, n = b[0], first[f"m{i}"], row[f"l{i}"]
            wanted_ranks = brackets.pop(b)
            found |= {(c, k): least for k in wanted_ranks if k < n}
            if rest := {k for k in wanted_ranks if k >= n}:
                brackets[c, least, None, n, size[c] - n] = rest

    def inside(c, low, high) -> Column:
        v = _number(c)
        keep = v.isNotNull()
        if low is not None:
            keep = keep & (v > F.lit(low))
        if high is not None:
            keep = keep & (v < F.lit(high))
        return F.when(keep, v)

    while brackets:
        small = [b for b in brackets if b[4] <= few]
        if small:
            # at most ``few`` rows of each bracket
            row = df.agg(*[F.sort_array(F.collect_list(inside(*b[:3]))).alias(f"v{i}") for i, b in enumerate(small)]).first()
            for i, b in enumerate(small):
                for k in brackets.pop(b):
                    found[b[0], k] = row[f"v{i}"][k - b[3]]
            continue
        open_, sketches = list(brackets), []
        for c, low, high, below, n in open_:
            eps = 2.0 / accuracy
            probs = [min(max((k - below) / max(n - 1, 1) + e, 0.0), 1.0)
                     for k in sorted(brackets[c, low, high, below, n]) for e in (-eps, eps)]
            sketches.append(F.percentile_approx(inside(c, low, high), probs, accuracy))
        row = df.agg(*[x.alias(f"s{i}") for i, x in enumerate(sketches)]).first()
        cuts = [sorted(set(row[f"s{i}"])) for i in range(len(open_))]
        row = df.agg(*[x.alias(f"c{i}_{j}_{kind}") for i, (c, low, high, _, _) in enumerate(open_) for j, v in enumerate(cuts[i])
                       for kind, x in (("l", F.count_if(inside(c, low, high) < F.lit(v))),
                                       ("e", F.count_if(inside(c, low, high) == F.lit(v))))]).first()
        narrower: dict[tuple, set] = {}
        for i, b in enumerate(open_):
            c, low, high, below, n = b
            less = [below + row[f"c{i}_{j}_l"] for j in range(len(cuts[i]))]
            upto = [less[j] + row[f"c{i}_{j}_e"] for j in range(len(cuts[i]))]
            for k in brackets[b]:
                at = next((j for j in range(len(cuts[i])) if less[j] <= k < upto[j]), None)
                if at is not None:
                    found[c, k] = cuts[i][at]
                    continue
                after = next((j for j in range(len(cuts[i])) if k < less[j]), len(cuts[i]))
                new_low, start = (cuts[i][after - 1], upto[after - 1]) if after else (low, below)
                new_high, end = (cuts[i][after], less[after]) if after < len(cuts[i]) else (high, below + n)
                narrower.setdefault((c, new_low, new_high, start, end - start), set()).add(k)
        brackets = narrower
    out = {}
    for c in cols:
        out[c] = []
        for p in wanted[c]:
            if not size[c]:
                out[c].append(None)
                continue
            x = place[c, p]
            k = int(math.floor(x))
            a, b = found[c, k], found[c, min(k + 1, size[c] - 1)]
            out[c].append(a if a == b else a + (x - k) * (b - a))
    return out
