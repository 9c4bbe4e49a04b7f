"""Isolation forest (M3): Liu, Ting & Zhou (2008), "Isolation Forest".

Each tree isolates its own ``psi`` = min(max_samples, n) rows, drawn without
replacement from the whole table by a hash of (line number, tree): rows go to
trees by a threshold on that hash, a little over ``psi`` for each, and the tree's
task keeps the ``psi`` smallest.  Only drawn rows are shuffled, one small group a
tree, and no row is collected.  With far more rows than all trees can use, a
row is a candidate of one tree only, so the pass hashes each row once.  The
forest is a node table of at most ``n_trees * (2 * psi - 1)`` rows.

Scoring runs in the JVM: the node table is written in the folder layout of Spark's
own tree ensembles, whose regression forest then averages the leaves' path
lengths; a line never enters a Python worker.  The score is
``2 ** (-mean path length / c(psi))`` in (0, 1), higher = more isolated.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

EULER = 0.5772156649
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, leaf double"


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree over rows X; returns node arrays (feature=-1 marks a leaf)."""
    feat, thr, left, right, leaf = [], [], [], [], []

    def new_node():
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), leaf.append(0.0)
        return len(feat) - 1

    stack = [(new_node(), np.arange(X.shape[0]), 0)]
    while stack:
        node, idx, depth = stack.pop()
        n = idx.size
        if depth >= max_depth or n <= 1:
            leaf[node] = depth + float(c_factor([n])[0])
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            leaf[node] = depth + float(c_factor([n])[0])
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= t
        ln, rn = new_node(), new_node()
        feat[node], thr[node], left[node], right[node] = f, t, ln, rn
        stack.append((rn, idx[~go_left], depth + 1))
        stack.append((ln, idx[go_left], depth + 1))
    return feat, thr, left, right, leaf


def _tree_builder(psi: int, max_depth: int, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(["h", "line_no"]).head(psi)
        feat, thr, left, right, leaf = _build_tree(np.vstack(rows["x"].to_numpy()).astype(float),
                                                   np.random.default_rng([seed, tree]), max_depth)
        return pd.DataFrame({"tree": np.full(len(feat), tree, dtype=np.int32), "node": np.arange(len(feat), dtype=np.int32),
                             "feature": np.asarray(feat, dtype=np.int32), "threshold": np.asarray(thr, dtype=float),
                             "left": np.asarray(left, dtype=np.int32), "right": np.asarray(right, dtype=np.int32),
                             "leaf": np.asarray(leaf, dtype=float)})
    return build


@dataclass
class Forest:
    feature: np.ndarray      # (trees, nodes) int, -1 = leaf
    threshold: np.ndarray    # (trees, nodes)
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray         # path length contribution at leaves
    psi: int
    max_depth: int

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, psi: int, max_depth: int) -> "Forest":
        n_trees = int(nodes["tree"].max()) + 1
        width = int(nodes["node"].max()) + 1
        arrs = {k: np.full((n_trees, width), -1 if k in ("feature", "left", "right") else 0.0,
                           dtype=np.int32 if k in ("feature", "left", "right") else float)
                for k in ("feature", "threshold", "left", "right", "leaf")}
        t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        for k in arrs:
            arrs[k][t, n] = nodes[k].to_numpy()
        return cls(psi=psi, max_depth=max_depth, **arrs)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        t, n = np.nonzero(np.ones_like(self.feature, dtype=bool))
        known = np.zeros(self.feature.shape, dtype=bool)
        known[:, 0] = True
        inner = np.nonzero(self.feature >= 0)
        for child in (self.left, self.right):
            known[inner[0], child[inner]] = True
        keep = known[t, n]
        pdf = pd.DataFrame({"tree": t[keep].astype(np.int32), "node": n[keep].astype(np.int32),
                            "feature": self.feature[t, n][keep], "threshold": self.threshold[t, n][keep],
                            "left": self.left[t, n][keep], "right": self.right[t, n][keep],
                            "leaf": self.leaf[t, n][keep]})
        return spark.createDataFrame(pdf, NODE_SCHEMA)

    def path_lengths(self, X: np.ndarray) -> np.ndarray:
        """Mean path length of each row of X over all trees (vectorised walk)."""
        n_trees = self.feature.shape[0]
        rows = np.arange(X.shape[0])[:, None]
        trees = np.arange(n_trees)[None, :]
        node = np.zeros((X.shape[0], n_trees), dtype=np.int64)
        for _ in range(self.max_depth + 1):
            f = self.feature[trees, node]
            internal = f >= 0
            if not internal.any():
                break
            xv = X[rows, np.where(internal, f, 0)]
            nxt = np.where(xv <= self.threshold[trees, node], self.left[trees, node], self.right[trees, node])
            node = np.where(internal, nxt, node)
        return self.leaf[trees, node].mean(axis=1)

    def score(self, X: np.ndarray) -> np.ndarray:
        return np.power(2.0, -self.path_lengths(X) / self.mean_path)

    @property
    def mean_path(self) -> float:
        return float(c_factor([self.psi])[0]) or 1.0

    def ensemble(self, spark: SparkSession) -> RandomForestRegressionModel:
        """The forest as Spark's regression forest over vectors: its prediction is the mean path length.

        Written in that model's own layout (one row a node, metadata as JSON) and loaded by Spark.
        """
        path = scratch_path(spark, "forest")
        n_trees, kind = self.feature.shape[0], "org.apache.spark.ml.regression"

        def described(name: str, uid: str, params: dict, **more) -> str:
            return json.dumps({"class": f"{kind}.{name}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                               "paramMap": {"impurity": "variance"} | params, "defaultParamMap": {"featuresCol": "features", "predictionCol": "prediction", "leafCol": ""}} | more)

        head = described("RandomForestRegressionModel", "iforest", {"numTrees": n_trees}, numFeatures=int(self.feature.max(initial=0)) + 1, numTrees=n_trees)
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(t, described("DecisionTreeRegressionModel", f"itree{t}", {}), 1.0) for t in range(n_trees)],
                              "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        nodes, inner = self.to_frame(spark), F.col("feature") >= 0

        def child(c: str) -> Column:
            return F.when(inner, F.col(c)).otherwise(-1)

        split = F.struct(F.when(inner, F.col("feature")).otherwise(-1).alias("featureIndex"),
                         F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                         F.lit(-1).alias("numCategories"))
        data = F.struct(F.col("node").alias("id"), F.col("leaf").alias("prediction"), F.lit(0.0).alias("impurity"),
                        F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("impurityStats"), F.lit(1).cast("long").alias("rawCount"),
                        F.when(inner, 1.0).otherwise(-1.0).alias("gain"), child("left").alias("leftChild"),
                        child("right").alias("rightChild"), split.alias("split"))
        nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
        return RandomForestRegressionModel.load(path)

    def with_score(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """``df`` with the score of the array ``x`` as ``out``."""
        model = self.ensemble(df.sparkSession).setFeaturesCol("_vector").setPredictionCol("_path")
        walked = model.transform(df.withColumn("_vector", array_to_vector(x)))
        return walked.withColumn(out, F.pow(F.lit(2.0), -F.col("_path") / F.lit(self.mean_path))).drop("_vector", "_path")


def tree_samples(xs: DataFrame, n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, h, line_no, x): for each tree a few more than ``psi`` rows (all of them, if there are no more)."""
    extra = psi + 8 * math.sqrt(psi) + 8        # the count is about Poisson: fewer than psi is out of reach
    top = float(2 ** 62)
    if n >= 4 * n_trees * extra:
        h = F.shiftrightunsigned(F.xxhash64("line_no", F.lit(seed)), 2)
        share = n_trees * extra / n
        return (xs.select("line_no", "x", h.alias("h")).where(F.col("h") < F.lit(int(share * top)))
                .withColumn("tree", F.pmod(F.xxhash64("line_no", F.lit(seed + 1)), F.lit(n_trees)).cast("int")))
    limit = int(min(1.0, extra / max(n, 1)) * top)
    drawn = xs.select("line_no", "x", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    return (drawn.withColumn("h", F.shiftrightunsigned(F.xxhash64("line_no", "tree", F.lit(seed)), 2))
            .where(F.col("h") <= F.lit(limit)))


def forest_shape(n: int, max_samples: int) -> tuple[int, int]:
    """Rows of a tree's sample, and the greatest depth of a node."""
    psi = min(max_samples, n)
    return psi, max(int(math.ceil(math.log2(max(psi, 2)))), 1)


def fit_forest(xs: DataFrame, n: int, *, n_trees: int = 300, max_samples: int = 256, seed: int = 42) -> Forest:
    """A forest over all ``n`` rows (line_no, x) of ``xs``."""
    ship_package(xs.sparkSession)
    if n <= 0:
        raise ValueError("no line to learn from")
    psi, max_depth = forest_shape(n, max_samples)
    nodes = (tree_samples(xs, n, n_trees, psi, seed).groupBy("tree")
             .applyInPandas(_tree_builder(psi, max_depth, seed), NODE_SCHEMA).toPandas())
    return Forest.from_nodes(nodes, psi, max_depth)
