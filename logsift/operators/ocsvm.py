"""Approximate one-class SVM (M4) with random Fourier features.

The RBF kernel ``exp(-gamma * |x - y|^2)`` is approximated by
``z(x) = sqrt(2 / D) * cos(x W + b)`` with ``W ~ N(0, 2 gamma)`` and
``b ~ U(0, 2 pi)`` (Rahimi & Recht, 2007).  The one-class problem is then linear:
minimise ``1/2 |w|^2 - rho + 1/(nu n) * sum max(0, rho - w.z_i)`` (Schoelkopf et
al., 2001).  With the best rho for given weights it is ``1/2 |w|^2`` less the mean of
the lowest nu-share of the products ``w.z_i``, and its dual is the point of least
norm among all means of the z_i with no weight over ``1 / (nu n)``.

That point is found by fully corrective steps.  The rows' vectors are written once as binary
values, so that a round reads plain matrices.  A round is one pass over all
rows: it adds up, in ``BINS`` bins of the products, the z and their number (only the number of rows above the bins,
whose z no corner uses); the lowest nu-share of the rows (with the same share of every row in the bin where it ends) gives
the next corner, and the point of least norm of all corners the next weights.  The
bins of a round span the bin that held the last quantile, widened by what the change
of the weights can move a product, so the quantile is always inside.  The
sums bound the distance of the objective to its best value; rounds end when that
is at most ``tolerance`` of it.  rho is the exact nu-quantile of the products.

The sums don't depend on how the rows are split (but for rounding), so neither does the
model.  A round sends ``BINS + 2`` rows of ``D + 1`` numbers per task, which are added up in
two levels if there are many tasks.  ``gamma = 1 / (d * var(X))`` uses the variance of all cells of the full
scaled matrix.  The raw anomaly score of a line is ``rho - w.z(x)`` (higher = further
outside); the exact kernel solver is quadratic in the number of lines and is not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev, polynomial
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .stats import quantile

BINS, SALTS = 32, 32
CACHE_ROWS = 128        # rows whose features stay in a core's cache
# cos(2 pi t) for t in [-1/2, 1/2] as a polynomial in t^2, within 2e-15: a third of the time of numpy's cosine
_COS = chebyshev.Chebyshev.interpolate(lambda u: np.cos(2.0 * np.pi * np.sqrt(u)), 10, [0.0, 0.25]).convert(kind=polynomial.Polynomial).coef
FEW_TASKS = 64          # sums of more tasks are added up in two levels before they reach the driver


@dataclass
class OneClassSVM:
    W: np.ndarray      # (d, D)
    b: np.ndarray      # (D,)
    w: np.ndarray      # (D,)
    rho: float
    gamma: float

    def features(self, X: np.ndarray) -> np.ndarray:
        return np.concatenate([z.copy() for z in self.parts(X)]) if len(X) else np.zeros((0, self.b.shape[0]))

    def parts(self, X: np.ndarray):
        """The features of ``CACHE_ROWS`` rows after the other; each array is written over by the next."""
        D = self.b.shape[0]
        W, b, coef = self.W / (2.0 * np.pi), self.b / (2.0 * np.pi), np.sqrt(2.0 / D) * _COS
        here = np.empty((2, min(len(X), CACHE_ROWS), D))
        for a in range(0, len(X), CACHE_ROWS):
            x = X[a: a + CACHE_ROWS]
            t, z = here[:, : len(x)]
            np.matmul(x, W, out=t)
            t += b
            np.rint(t, out=z)
            t -= z
            t *= t
            np.multiply(t, coef[-1], out=z)
            for c in coef[-2:0:-1]:
                z += c
                z *= t
            z += coef[0]
            yield z

    def products(self, X: np.ndarray) -> np.ndarray:
        return np.concatenate([z @ self.w for z in self.parts(X)]) if len(X) else np.zeros(0)

    def score(self, X: np.ndarray) -> np.ndarray:
        return self.rho - self.products(X)

    def to_dict(self) -> dict:
        return {"W": self.W.tolist(), "b": self.b.tolist(), "w": self.w.tolist(), "rho": self.rho,
                "gamma": self.gamma}

    @classmethod
    def from_dict(cls, d: dict) -> "OneClassSVM":
        return cls(np.array(d["W"]), np.array(d["b"]), np.array(d["w"]), d["rho"], d["gamma"])


def scale_gamma(xs: DataFrame, dim: int) -> float:
    """gamma = 1 / (d * population variance of every cell of X), from the tasks' means and squared deviations."""
    ship_package(xs.sparkSession)
    n, mean, square = 0.0, np.zeros(dim), np.zeros(dim)
    for r in xs.select("x").mapInArrow(_moments(dim), "n double, mean binary, square binary").collect():     # a small row a task
        n, mean, square = _merged(n, mean, square, r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["square"]))
    var = float(np.mean(square) / n + np.mean((mean - mean.mean()) ** 2)) if n else 0.0
    return 1.0 / (dim * var) if var > 0 else 1.0


def _merged(n, mean, square, m, mean_, square_):
    """Number, means and sums of squared deviations of two sets of rows together (Chan et al., 1979)."""
    step = mean_ - mean
    return n + m, mean + step * (m / (n + m)), square + square_ + step * step * (n * m / (n + m))


def _moments(dim: int):
    def run(batches):
        have = 0.0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            X = _matrix(batch.column(0), dim)
            if len(X):
                mean = X.mean(axis=0)
                have = _merged(*have, float(len(X)), mean, ((X - mean) ** 2).sum(axis=0))
        if have[0]:
            yield pa.RecordBatch.from_arrays([pa.array([have[0]]), pa.array([have[1].tobytes()], pa.binary()),
                                              pa.array([have[2].tobytes()], pa.binary())], names=["n", "mean", "square"])
    return run


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _packed(dim: int):
    """Vectors to their numbers as binary values."""
    def run(batches):
        for batch in batches:
            X = _matrix(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in X], pa.binary())], names=["block"])
    return run


def _unpacked(column, dim: int) -> np.ndarray:
    """The matrix of the binary values, on their own buffer."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[ends[0]: ends[1]].view(float).reshape(-1, dim) if len(column) else np.zeros((0, dim))


def _binned(model: OneClassSVM, edges: np.ndarray):
    """Rows (bin, salt, sums): in each bin of the products the sum of z (none above the last edge) and the number of rows, per task."""
    def run(batches):
        dim, D = model.W.shape
        top = max(len(edges), 1)
        sums, seen = np.zeros((len(edges) + 1, D + 1)), 0.0
        for batch in batches:
            for Z in model.parts(_unpacked(batch.column(0), dim)):
                place = np.searchsorted(edges, Z @ model.w, side="right")
                sums[:, D] += np.bincount(place, minlength=len(sums))
                order = np.argsort(place, kind="stable")
                order = order[: np.searchsorted(place[order], top)]
                if len(order):
                    bins, first = np.unique(place[order], return_index=True)
                    sums[bins, :D] += np.add.reduceat(Z[order], first, axis=0)
                seen += float(np.abs(Z[:, 0]).sum())
        salt = int(seen * 1e6) % SALTS      # spreads the tasks
        full = np.flatnonzero(sums[:, D])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), salt, np.int32)),
                                          pa.array([sums[i].tobytes() for i in full], pa.binary())], names=["bin", "salt", "sums"])
    return run


def _add(keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums"))
        return pa.table({c: table.column(c).slice(0, 1) for c in keys} | {"sums": pa.array([total.tobytes()], pa.binary())})
    return run


def _round(blocks: DataFrame, tasks: int, model: OneClassSVM, edges: np.ndarray) -> np.ndarray:
    """The bins' sums of z and counts over all rows: (len(edges) + 1, D + 1)."""
    found = blocks.mapInArrow(_binned(model, edges), "bin int, salt int, sums binary")
    if tasks > FEW_TASKS:
        found = (found.groupBy("bin", "salt").applyInArrow(_add(["bin", "salt"]), "bin int, salt int, sums binary")
                 .groupBy("bin").applyInArrow(_add(["bin"]), "bin int, sums binary"))
    out = np.zeros((len(edges) + 1, len(model.b) + 1))
    for r in found.collect():       # at most a row a bin, of each of few tasks
        out[r["bin"]] += np.frombuffer(r["sums"], np.float64)
    return out


def least_norm(gram: np.ndarray) -> np.ndarray:
    """The weights (at least 0, sum 1) of the point of least norm in the hull of points with these products (Wolfe, 1976)."""
    own, weight = [int(np.argmin(np.diag(gram)))], np.ones(1)
    while True:
        product = gram[:, own] @ weight
        norm, j = float(weight @ product[own]), int(np.argmin(product))
        if j in own or norm - product[j] <= 1e-12 * norm:
            break
        own, weight = own + [j], np.append(weight, 0.0)
        while True:
            k = len(own)
            system = np.ones((k + 1, k + 1))
            system[:k, :k], system[k, k] = gram[np.ix_(own, own)], 0.0
            flat = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
            low = flat <= 1e-12
            if not low.any():
                weight = flat
                break
            step = min(1.0, float(np.min(weight[low] / np.maximum(weight[low] - flat[low], 1e-300))))
            weight = weight + step * (flat - weight)
            keep = weight > 1e-12
            own, weight = [o for o, x in zip(own, keep) if x], weight[keep] / weight[keep].sum()
    out = np.zeros(len(gram))
    out[own] = weight
    return out


def products(xs: DataFrame, model: OneClassSVM, keep: list[str], out: str = "product", x: str = "x") -> DataFrame:
    """``keep`` columns and the product ``w.z(x)`` of every row."""
    ship_package(xs.sparkSession)
    sent = xs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def product(x: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array(m.products(_matrix(x, m.W.shape[0])))

    return xs.select(*keep, product(x).alias(out))


def fit_weights(xs: DataFrame, dim: int, gamma: float, *, nu: float = 0.05, n_features: int = 256,
                rounds: int = 100, tolerance: float = 0.01, seed: int = 42) -> tuple[OneClassSVM, float]:
    """The model without its rho, and the objective's distance to its best value as a share of that, from all rows of
    ``xs`` (column x, ``dim`` numbers)."""
    ship_package(xs.sparkSession)
    rng = np.random.default_rng([seed, 7919])
    W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(dim, n_features))
    b = rng.uniform(0.0, 2.0 * np.pi, size=n_features)
    model, gap = OneClassSVM(W, b, np.zeros(n_features), 0.0, gamma), 0.0
    blocks = materialize(xs.select("x").mapInArrow(_packed(dim), "block binary"), "svm-blocks")
    tasks = blocks.rdd.getNumPartitions()
    n, corners, low, high, moved = 0.0, [], 0.0, 0.0, 0.0
    for _ in range(rounds):
        reach = np.sqrt(2.0) * moved        # |z| is at most the root of two
        edges = np.linspace(low - reach - 1e-12, high + reach + 1e-12, BINS + 1) if corners else np.zeros(0)
        sums = _round(blocks, tasks, model, edges)
        if not corners:                     # the mean of all rows is the first corner
            n = float(sums[:, -1].sum())
            if n == 0:
                return model, 0.0
            corners = [sums[:, :-1].sum(axis=0) / n]
            low, high = -np.sqrt(2.0) * np.linalg.norm(corners[0]), np.sqrt(2.0) * np.linalg.norm(corners[0])
        else:
            upto = np.cumsum(sums[:, -1])
            at = int(np.searchsorted(upto, nu * n, side="left"))
            below = upto[at] - sums[at, -1]
            corner = (sums[:at, :-1].sum(axis=0) + sums[at, :-1] * (nu * n - below) / sums[at, -1]) / (nu * n)
            low, high = edges[max(at - 1, 0)], edges[min(at, BINS)]
            # the mean of the lowest share is at least this: its last bin at the bin's lower end
            least = (float(sums[:at, :-1].sum(axis=0) @ model.w) + (nu * n - below) * low) / (nu * n)
            half = 0.5 * float(model.w @ model.w)
            gap = max(2 * half - least, 0.0) / half if half > 0 else 0.0
            if gap <= tolerance:
                break
            corners.append(corner)
        points = np.array(corners)
        new = least_norm(points @ points.T) @ points
        moved = float(np.linalg.norm(new - model.w))
        if len(corners) > 1 and moved <= 1e-12:
            break                           # the bins' width is all that is left of the gap
        moved = moved if len(corners) > 1 else 0.0
        model = OneClassSVM(W, b, new, 0.0, gamma)
    return model, gap


def fit_ocsvm(xs: DataFrame, dim: int, gamma: float, *, nu: float = 0.05, **options) -> OneClassSVM:
    """Fit on all rows of ``xs`` (column x, ``dim`` numbers)."""
    model, _ = fit_weights(xs, dim, gamma, nu=nu, **options)
    rho = quantile(materialize(products(xs, model, []), "products"), "product", nu)
    return OneClassSVM(model.W, model.b, model.w, rho or 0.0, gamma)
