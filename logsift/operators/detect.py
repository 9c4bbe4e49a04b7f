"""Ensemble detection: fit, score, threshold, label.

``Detector.fit(logs)`` learns from the unified log table:
  1. the TF-IDF vocabulary (bounded by ``max_features``); the lines with their
     feature vectors are then written once, and all else reads that table,
  2. the robust scaler (median and IQR per feature; IQR 0 -> 1),
  3. the isolation forest, whose trees draw from the whole table; the lines with
     their scaled vectors and isolation scores are written,
  4. the approximate one-class SVM, fitted on all rows,
  5. min/max of each raw score over all lines and the flag threshold: the
     ``1 - fpr_target`` quantile of the ensemble score, or its 0.90 quantile
     when that equals the maximum.
All learned state is small (vocabulary, scaler vectors, forest node arrays,
SVM weights); it is inlined as literals or broadcast.

The forest scores inside the JVM; the SVM's products are one Arrow-batched pandas
function of the feature vector.  The line's other columns never leave the JVM, and
labelling needs no join back.  Each result is a stage kept by what it was made
from (``Stages``): another ``contamination`` runs the SVM's stages only.

``fpr_target`` is the flagged fraction, not a false-positive rate: with
distinct scores ``floor((n-1) * fpr) + 1`` lines are flagged.  It can be changed
afterwards on the kept raw scores (``DetectorModel.rethreshold``).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import Stages
from .features import STRUCTURED, structured_columns
from .iforest import NODE_SCHEMA, Forest, fit_forest, forest_shape
from .ocsvm import OneClassSVM, fit_weights, products, scale_gamma
from .stats import minmax_norm, quantile, quantiles
from .tfidf import Vocabulary, fit_vocabulary, with_tfidf


def flag_threshold(df: DataFrame, score_col: str, fpr_target: float, exact: bool = True) -> tuple[float, float]:
    """(threshold, max score).  Scores >= threshold are flagged.

    Exact quantiles narrow value brackets, so continuous scores never build one
    global map of every distinct value.
    """
    probs = [1.0 - fpr_target, 0.90]
    mx = df.agg(F.max(score_col).alias("mx")).first()["mx"]
    if mx is None:
        raise ValueError("there is no score to take a threshold from")
    q = quantiles(df, [score_col], probs, exact)[score_col]
    mx = float(mx)
    th = float(q[0])
    if th == mx:
        th = float(q[1])
    return th, mx


def validate_rate(name: str, v: float) -> float:
    """Both knobs are fractions in (0, 0.5]."""
    if not (0.0 < float(v) <= 0.5):
        raise ValueError(f"{name} must be in (0, 0.5], got {v}")
    return float(v)


def with_feature_vector(logs: DataFrame, vocab: Vocabulary, out: str = "x") -> DataFrame:
    """M0 + J2: ``out`` = the 7 structured features followed by the TF-IDF weights."""
    cols = logs.columns
    base = logs.select(*cols, *[c.alias(f"_{n}") for c, n in zip(structured_columns(), STRUCTURED)])
    t = with_tfidf(base, "message", vocab, "_tfidf")
    return t.select(*cols, F.concat(F.array(*[F.col(f"_{n}") for n in STRUCTURED]), F.col("_tfidf")).alias(out))


@dataclass
class Scaler:
    center: list
    scale: list

    def expr(self, col: str = "x"):
        c = F.array(*[F.lit(float(v)) for v in self.center])
        s = F.array(*[F.lit(float(v)) for v in self.scale])
        return F.zip_with(F.zip_with(F.col(col), c, lambda x, m: x - m), s, lambda d, k: d / k)


def fit_scaler(x: DataFrame, dim: int, exact: bool = True) -> Scaler:
    """M1 + A13: per-feature median and IQR, one aggregate pass."""
    names = [f"f{i}" for i in range(dim)]
    q = quantiles(x.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)]), names, [0.25, 0.5, 0.75], exact)
    center, scale = [], []
    for n in names:
        a, m, b = q[n]
        center.append(float(m or 0.0))
        iqr = float((b or 0.0) - (a or 0.0))
        scale.append(iqr if iqr != 0.0 else 1.0)
    return Scaler(center, scale)


def scaled_rows(featured: DataFrame, keep: list[str], scaler: Scaler) -> DataFrame:
    """``keep`` columns and the scaled vector as ``x`` (unpacked by a Generate, so that it is computed once)."""
    return featured.select(*keep, F.inline(F.array(F.struct(scaler.expr("x").alias("x")))))


def raw_scores(featured: DataFrame, keep: list[str], scaler: Scaler, forest: Forest, svm: OneClassSVM) -> DataFrame:
    """``keep`` columns of ``featured`` plus raw ``iso`` and ``svm`` scores of its vector ``x``."""
    scored = products(forest.with_score(scaled_rows(featured, keep, scaler), "x", "iso"), svm, [*keep, "iso"], "_product")
    return scored.select(*keep, "iso", (F.lit(svm.rho) - F.col("_product")).alias("svm"))


@dataclass
class Detector:
    fpr_target: float = 0.05
    contamination: float = 0.05
    seed: int = 42
    n_trees: int = 300
    max_samples: int = 256
    svm_features: int = 256
    svm_rounds: int = 100
    svm_tolerance: float = 0.01
    max_features: int = 50
    weights: tuple = (0.5, 0.5)
    exact_quantiles: bool = True

    def vector_stages(self, logs: DataFrame, stages: Stages, source: str):
        """The vocabulary, the lines with their vectors, their number and the scaler; and what they depend on."""
        made_from = [source, self.max_features]
        v = stages.value("vocabulary", made_from, lambda: asdict(fit_vocabulary(logs, "message", self.max_features)))
        vocab = Vocabulary(tuple(v["terms"]), tuple(v["idf"]), v["n_docs"])
        featured = stages.table("features", made_from, lambda: with_feature_vector(logs, vocab))
        dim = len(STRUCTURED) + max(vocab.size, 1)
        made_from = [*made_from, self.exact_quantiles]

        def fitted() -> dict:
            n = featured.count()
            if n == 0:
                raise ValueError("there is no line to learn from")
            return asdict(fit_scaler(featured, dim, self.exact_quantiles)) | {"n": n}

        s = stages.value("scaler", made_from, fitted)
        return vocab, featured, s["n"], Scaler(s["center"], s["scale"]), made_from

    def isolation(self, logs: DataFrame, stages: Stages, source: str):
        """The columns of ``logs``, the scaled vector ``x`` and the score ``iso`` of every line, as a written stage; with
        the vocabulary, the scaler, the forest and what they depend on."""
        vocab, featured, n, scaler, made_from = self.vector_stages(logs, stages, source)
        made_from = [*made_from, self.n_trees, self.max_samples, self.seed]
        rows = scaled_rows(featured, logs.columns, scaler)
        psi, depth = forest_shape(n, self.max_samples)
        nodes = stages.table("forest", made_from, lambda: fit_forest(
            rows.select("line_no", "x"), n, n_trees=self.n_trees, max_samples=self.max_samples, seed=self.seed).to_frame(stages.spark))
        forest = Forest.from_nodes(nodes.toPandas(), psi, depth)
        table = stages.table("isolation", made_from, lambda: forest.with_score(rows, "x", "iso"))
        return table, vocab, scaler, forest, made_from

    def boundary(self, rows: DataFrame, dim: int, stages: Stages, made_from: list, keep: list[str]):
        """The SVM of the written rows' vectors ``x``, and ``keep`` columns with the score ``svm`` of every row."""
        made_from = [*made_from, self.contamination, self.svm_features, self.svm_rounds, self.svm_tolerance]
        svm = OneClassSVM.from_dict(stages.value("weights", made_from, lambda: fit_weights(
            rows, dim, scale_gamma(rows, dim), nu=self.contamination, n_features=self.svm_features, rounds=self.svm_rounds,
            tolerance=self.svm_tolerance, seed=self.seed)[0].to_dict()))
        table = stages.table("products", made_from, lambda: products(rows, svm, keep, "_product"))
        svm.rho = stages.value("rho", made_from, lambda: {"rho": quantile(table, "_product", self.contamination)})["rho"]
        return svm, table.select(*keep, (F.lit(svm.rho) - F.col("_product")).alias("svm"))

    def fit_score(self, logs: DataFrame, stages: Stages | None = None, source: str | None = None) -> tuple["DetectorModel", DataFrame]:
        """Fit on ``logs`` and return the model with the written raw-scored table.

        ``source``: a fingerprint of ``logs``, by which stages are found again.
        """
        validate_rate("fpr_target", self.fpr_target)
        validate_rate("contamination", self.contamination)
        stages, source = stages or Stages(logs.sparkSession), source or uuid.uuid4().hex
        isolated, vocab, scaler, forest, made_from = self.isolation(logs, stages, source)
        svm, scored = self.boundary(isolated, len(scaler.center), stages, made_from, [*logs.columns, "iso"])
        b = scored.agg(F.min("iso").alias("ilo"), F.max("iso").alias("ihi"),
                       F.min("svm").alias("slo"), F.max("svm").alias("shi")).first()
        model = DetectorModel(self, vocab, scaler, forest, svm, (b["ilo"], b["ihi"]), (b["slo"], b["shi"]), 0.0, 0.0)
        th, mx = flag_threshold(model.ensemble(scored), "score", self.fpr_target, self.exact_quantiles)
        model.threshold, model.max_score = th, mx
        return model, scored

    def fit(self, logs: DataFrame) -> "DetectorModel":
        return self.fit_score(logs)[0]


@dataclass
class DetectorModel:
    params: Detector
    vocab: Vocabulary
    scaler: Scaler
    forest: Forest
    svm: OneClassSVM
    iso_bounds: tuple
    svm_bounds: tuple
    threshold: float
    max_score: float

    def ensemble(self, raw: DataFrame) -> DataFrame:
        """M5: equal-weight mean of the min-max normalised raw scores (column ``score``)."""
        wi, ws = self.params.weights
        return raw.withColumn("score", F.lit(float(wi)) * minmax_norm("iso", *self.iso_bounds)
                              + F.lit(float(ws)) * minmax_norm("svm", *self.svm_bounds))

    def label(self, raw: DataFrame) -> DataFrame:
        """M6: ``score`` (unrounded), ``anomaly_score`` (4 dp) and ``is_anomaly`` from raw scores."""
        e = self.ensemble(raw)
        return e.select(*[c for c in raw.columns if c not in ("iso", "svm")],
                        "score", F.bround("score", 4).alias("anomaly_score"),
                        F.when(F.col("score") >= F.lit(self.threshold), 1).otherwise(0).alias("is_anomaly"))

    def transform(self, logs: DataFrame) -> DataFrame:
        """Score new lines with the fitted model (row-local, streaming-safe)."""
        featured = with_feature_vector(logs, self.vocab)
        return self.label(raw_scores(featured, logs.columns, self.scaler, self.forest, self.svm))

    def rethreshold(self, scored: DataFrame, fpr_target: float) -> "DetectorModel":
        """The same model with the threshold of another flag rate, from the kept raw scores; nothing is refitted."""
        params = replace(self.params, fpr_target=validate_rate("fpr_target", fpr_target))
        th, mx = flag_threshold(self.ensemble(scored), "score", fpr_target, params.exact_quantiles)
        return replace(self, params=params, threshold=th, max_score=mx)

    def to_json(self) -> str:
        """M7: everything but the forest's nodes, as JSON."""
        return json.dumps({
            "params": asdict(self.params),
            "vocab": {"terms": list(self.vocab.terms), "idf": list(self.vocab.idf), "n_docs": self.vocab.n_docs},
            "scaler": asdict(self.scaler), "svm": self.svm.to_dict(),
            "forest": {"psi": self.forest.psi, "max_depth": self.forest.max_depth},
            "iso_bounds": list(self.iso_bounds), "svm_bounds": list(self.svm_bounds),
            "threshold": self.threshold, "max_score": self.max_score,
        })

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        self.forest.to_frame(spark).write.mode("overwrite").parquet(f"{path}/forest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DetectorModel":
        """The model that ``save`` wrote."""
        d = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
        params = Detector(**(d["params"] | {"weights": tuple(d["params"]["weights"])}))
        vocab = Vocabulary(tuple(d["vocab"]["terms"]), tuple(d["vocab"]["idf"]), d["vocab"]["n_docs"])
        nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/forest").toPandas()
        return cls(params, vocab, Scaler(**d["scaler"]), Forest.from_nodes(nodes, **d["forest"]),
                   OneClassSVM.from_dict(d["svm"]), tuple(d["iso_bounds"]), tuple(d["svm_bounds"]),
                   d["threshold"], d["max_score"])
