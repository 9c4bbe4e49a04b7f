"""The query catalog: one Spark callable per operator group of the blueprint.

Each callable takes ``(spark, sf_dir)``, derives its fixture from the driver's
tables (``fixtures``) and returns a DataFrame whose columns match the DuckDB
statement of the same name in ``oracle``.  File-based sources write their
fixture to a fresh folder in the shared scratch folder and read it back.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import enrich as EN
from ..operators import evaluate as EVAL
from ..operators import reports as R
from ..operators import signals as SIG
from ..operators import tfidf as TF
from ..operators.features import STRUCTURED, feature_view, with_structured_features
from ..operators.stats import min_max, minmax_norm, quantiles
from ..sources.ingest import ingest
from ..sources.sinks import write_csv
from ..sources.sniff import sniff
from ..sources.text import nonblank_lines, number_rows, read_lines
from ..session import materialize, scratch_path
from ..stages import Stages
from . import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- file-backed fixtures -------------------------------------------------------------

_paths: dict[tuple, str] = {}


def written(spark, sf, name: str) -> str:
    """The folder of a fixture's files, written on first use in a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _paths:
        if name == "mixed":
            lines = (FX.fx1(spark, sf).select((F.col("event_id") * 3).alias("key"), "line")
                     .unionByName(FX.fx2(spark, sf).select((F.col("page_id") * 3 + 1).alias("key"), "line"))
                     .unionByName(FX.fx6(spark, sf).select((F.col("event_id") * 3 + 2).alias("key"), "line")))
            _paths[key] = FX.write_lines(spark, lines, "key", name)
        elif name == "fx9":
            _paths[key] = FX.write_csv(spark, FX.fx9(spark, sf), "event_id", name)
        elif name == "fx5":
            _paths[key] = FX.write_csv_lines(spark, FX.fx5(spark, sf), "event_id", name)
        else:
            _paths[key] = FX.write_lines(spark, getattr(FX, name)(spark, sf), "page_id" if name == "fx2" else "event_id", name)
    return _paths[key]


def _cores(spark) -> int:
    """The test tables are single files: their texts are dealt over the cores."""
    return spark.sparkContext.defaultParallelism


def fx1_logs(spark, sf) -> DataFrame:
    return ingest(spark, written(spark, sf, "fx1"))


def fx2_logs(spark, sf) -> DataFrame:
    return ingest(spark, written(spark, sf, "fx2"))


# --- sources and parsing ----------------------------------------------------------------

@query("raw_line_split")
def raw_line_split(spark, sf):
    path = written(spark, sf, "fx1")
    numbered, _ = number_rows(nonblank_lines(read_lines(spark, path)))
    return numbered.select("line_no", "line")


@query("syslog_parse")
def syslog_parse(spark, sf):
    return fx1_logs(spark, sf).select("line_no", "timestamp", "level", "component", "message")


@query("apache_parse")
def apache_parse(spark, sf):
    from ..functions.scalars import parse_ts, time_text
    return fx2_logs(spark, sf).select(
        "line_no", "client_ip", "timestamp", "message", "level", "http_status", "response_size",
        time_text(parse_ts("timestamp")).alias("ts_parsed"))


@query("fallback_parse")
def fallback_parse(spark, sf):
    logs = ingest(spark, written(spark, sf, "fx6"))
    return logs.select("line_no", "level", "http_status", "response_time", "message")


@query("mixed_raw_parse")
def mixed_raw_parse(spark, sf):
    return ingest(spark, written(spark, sf, "mixed"), format="raw")


@query("ndjson_parse")
def ndjson_parse(spark, sf):
    logs = ingest(spark, written(spark, sf, "fx4"))
    return logs.select("line_no", "raw_line", "timestamp", "message", "level", "http_status",
                       "response_size", "response_time")


@query("csv_parse")
def csv_parse(spark, sf):
    logs = ingest(spark, written(spark, sf, "fx5"))
    return logs.select("line_no", "raw_line", "timestamp", "message", "level", "http_status",
                       "response_size", "response_time")


@query("csv_multiline")
def csv_multiline(spark, sf):
    logs = ingest(spark, written(spark, sf, "fx9"), csv_multiline=True)
    return logs.select("line_no", "timestamp", "message", "level", "http_status", "response_size", "response_time")


@query("format_sniff")
def format_sniff(spark, sf):
    dirs = {
        "fx1": written(spark, sf, "fx1"),
        "fx4": written(spark, sf, "fx4"),
        "fx5": written(spark, sf, "fx5"),
    }
    frames = [sniff(spark, d).select(F.lit(name).alias("fixture"), "format").distinct()
              for name, d in dirs.items()]
    return frames[0].union(frames[1]).union(frames[2])


@query("line_numbers")
def line_numbers(spark, sf):
    logs = ingest(spark, written(spark, sf, "fx4"), format="json")
    return logs.select("line_no", "raw_line")


# --- features ----------------------------------------------------------------------------

@query("structured_features")
def structured_features(spark, sf):
    f = with_structured_features(FX.fx3(spark, sf))
    return f.select("line_no", *[F.round(c, 6).alias(c) for c in STRUCTURED])


@query("feature_view")
def feature_view_q(spark, sf):
    return feature_view(FX.fx3(spark, sf))


@query("tfidf_vocab")
def tfidf_vocab(spark, sf):
    v = TF.vocabulary_frame(FX.fx7(spark, sf), "text", 50, parts=_cores(spark))
    return v.select("term", "tf", "df", F.round("idf", 9).alias("idf"))


@query("tfidf_weights")
def tfidf_weights(spark, sf):
    docs = FX.fx7(spark, sf)
    vocab = TF.fit_vocabulary(docs, "text", 50, parts=_cores(spark))
    return TF.tfidf_long(docs, "doc_id", "text", vocab, parts=_cores(spark)).select("doc_id", "term", F.round("weight", 9).alias("weight"))


@query("robust_scale")
def robust_scale(spark, sf):
    f = with_structured_features(FX.fx3(spark, sf))
    found = quantiles(f, STRUCTURED, [0.25, 0.5, 0.75])
    return spark.createDataFrame(
        [(c, round(a, 6), round(m, 6), round(b, 6), round(b - a, 6), round(b - a, 6) or 1.0) for c, (a, m, b) in found.items()],
        "feature string, q25 double, median double, q75 double, iqr double, scale double")


@query("minmax_score")
def minmax_score(spark, sf):
    s = FX.fx3(spark, sf)
    lo, hi = min_max(s, "anomaly_score")
    return s.select("line_no", F.round(minmax_norm("anomaly_score", lo, hi), 6).alias("score_norm"))


@query("quantile_threshold")
def quantile_threshold(spark, sf):
    from ..operators.detect import flag_threshold
    s = FX.fx3(spark, sf)
    th, mx = flag_threshold(s, "anomaly_score", 0.05)
    n = s.where(F.col("anomaly_score") >= F.lit(th)).count()
    return spark.createDataFrame([(round(th, 9), round(mx, 9), n)], "threshold double, max_score double, n_flagged long")


# --- evaluation ---------------------------------------------------------------------------

@query("ground_truth")
def ground_truth(spark, sf):
    g = EVAL.with_ground_truth(FX.fx3(spark, sf))
    return g.select("line_no", "gt", F.array_join("reasons", ",").alias("reasons"))


@query("evaluation_metrics")
def evaluation_metrics(spark, sf):
    return EVAL.evaluate(FX.fx3(spark, sf))


# --- reports -------------------------------------------------------------------------------

@query("kpi_summary")
def kpi_summary(spark, sf):
    return R.kpi_summary(FX.fx3(spark, sf))


@query("minute_volume")
def minute_volume(spark, sf):
    return R.minute_volume(FX.fx3(spark, sf))


@query("minute_anomalies")
def minute_anomalies(spark, sf):
    return R.minute_anomalies(FX.fx3(spark, sf))


@query("anomaly_events")
def anomaly_events(spark, sf):
    return R.anomaly_events(FX.fx3(spark, sf))


@query("score_histogram")
def score_histogram(spark, sf):
    return R.score_histogram(FX.fx3(spark, sf))


@query("score_histogram_line")
def score_histogram_line(spark, sf):
    from ..operators.detect import flag_threshold
    s = FX.fx3(spark, sf)
    return R.score_histogram(s, threshold=round(flag_threshold(s, "anomaly_score", 0.05)[0], 9))


@query("level_breakdown")
def level_breakdown(spark, sf):
    return R.level_breakdown(fx1_logs(spark, sf))


@query("feature_profile")
def feature_profile(spark, sf):
    return R.feature_profile(FX.fx3(spark, sf))


@query("severity_pivot")
def severity_pivot(spark, sf):
    return R.severity_pivot(FX.fx3(spark, sf))


@query("anomaly_table")
def anomaly_table(spark, sf):
    return R.anomaly_table(FX.fx3(spark, sf))


@query("all_lines_table")
def all_lines_table(spark, sf):
    return R.all_lines_table(FX.fx3(spark, sf))


@query("normal_table")
def normal_table(spark, sf):
    return R.normal_table(FX.fx3(spark, sf))


@query("top_anomalies")
def top_anomalies(spark, sf):
    return R.top_anomalies(FX.fx3(spark, sf))


@query("explain_cards")
def explain_cards(spark, sf):
    return R.explain_cards(FX.fx3(spark, sf), P.EXPLAIN_DEFAULT, text_col="message")


@query("enrich_distinct")
def enrich_distinct(spark, sf):
    anoms = FX.fx3(spark, sf).where(F.col("is_anomaly") == 1)
    return EN.enrich_distinct(anoms, "message", EN.summarize_text).select("line_no", "explanation")


@query("explain_top")
def explain_top(spark, sf):
    return EN.explain_top(FX.fx3(spark, sf), EN.summarize_text, 50, text_col="message")


@query("csv_sink_roundtrip")
def csv_sink_roundtrip(spark, sf):
    s = FX.fx3(spark, sf).withColumn("raw_line", F.col("message"))
    path = scratch_path(spark, "sink")
    write_csv(s, path)
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return back.select(
        F.col("line_no").cast("long"), "timestamp", F.coalesce("message", F.lit("")).alias("message"), "level",
        F.col("http_status").cast("int"), F.col("response_size").cast("double"),
        F.col("response_time").cast("double"), F.col("anomaly_score").cast("double"),
        F.col("is_anomaly").cast("int"))


# --- signals -------------------------------------------------------------------------------

@query("latency_spikes")
def latency_spikes(spark, sf):
    return SIG.latency_spikes(FX.fx3(spark, sf))


@query("size_outliers")
def size_outliers(spark, sf):
    return SIG.size_outliers(FX.fx3(spark, sf))


@query("severity_bursts")
def severity_bursts(spark, sf):
    return SIG.severity_bursts(fx1_logs(spark, sf))


@query("rare_vocabulary")
def rare_vocabulary(spark, sf):
    return SIG.rare_vocabulary(FX.fx7(spark, sf), "doc_id", "text", 20, parts=_cores(spark))


@query("client_error_rate")
def client_error_rate(spark, sf):
    return SIG.client_error_rate(fx2_logs(spark, sf))


@query("server_errors")
def server_errors(spark, sf):
    return SIG.server_errors(fx2_logs(spark, sf))


@query("off_hours")
def off_hours(spark, sf):
    return SIG.off_hours(FX.fx3(spark, sf))


@query("volume_bursts")
def volume_bursts(spark, sf):
    return SIG.volume_bursts(FX.fx3(spark, sf))


@query("failed_logins")
def failed_logins(spark, sf):
    return SIG.failed_logins(ingest(spark, written(spark, sf, "fx8")))


@query("failure_tags")
def failure_tags(spark, sf):
    return SIG.failure_tags(fx1_logs(spark, sf))


# --- models (rows-only checks) ----------------------------------------------------------------

def _fx3_logs(spark, sf):
    return FX.fx3(spark, sf).drop("anomaly_score", "is_anomaly")


@query("iforest_score")
def iforest_score(spark, sf):
    from ..operators.detect import Detector
    isolated, *_ = Detector().isolation(_fx3_logs(spark, sf), Stages(spark), sf)
    return isolated.select("line_no", F.round("iso", 6).alias("iso_score"))


@query("ocsvm_score")
def ocsvm_score(spark, sf):
    from ..operators.detect import Detector, scaled_rows
    d, stages = Detector(), Stages(spark)
    logs = _fx3_logs(spark, sf)
    _, featured, _, scaler, made_from = d.vector_stages(logs, stages, sf)
    rows = stages.table("scaled", made_from, lambda: scaled_rows(featured, ["line_no"], scaler))
    _, scored = d.boundary(rows, len(scaler.center), stages, made_from, ["line_no"])
    return scored.select("line_no", F.round("svm", 6).alias("svm_score"))


@query("detect_pipeline")
def detect_pipeline(spark, sf):
    from .pipeline import run
    path = written(spark, sf, "fx1")
    return run(spark, path).table.select("line_no", "level", "message", "anomaly_score", "is_anomaly")


# --- given models: every line's scores under a model that is stated by rule, which DuckDB can follow -------------------

TREES, DEPTH, DRAWS = 12, 4, 16     # of the stated models
_GIVEN = STRUCTURED                 # their features: the structured ones, scaled


def given_forest():
    """A forest of full trees: feature and threshold of an inner node, and a leaf's path length, by rule."""
    import pandas as pd

    from ..operators.iforest import Forest
    rows = []
    for t in range(TREES):
        for node in range(2 ** (DEPTH + 1) - 1):        # children of node k are 2k + 1 and 2k + 2
            inner = node < 2 ** DEPTH - 1
            rows.append((t, node, (t * 3 + node * 5) % 7 if inner else -1, ((t * 5 + node * 3) % 9 - 3) / 4.0 if inner else 0.0,
                         2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1,
                         0.0 if inner else DEPTH + ((t + node) % 5) / 2.0))
    return Forest.from_nodes(pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "leaf"]), 256, DEPTH)


def given_boundary(gamma: float):
    """An SVM without its rho: draws of the kernel's features and weights by rule."""
    import numpy as np

    from ..operators.ocsvm import OneClassSVM
    i, j = np.arange(len(_GIVEN))[:, None], np.arange(DRAWS)
    W = np.sqrt(2.0 * gamma) * (((i * 31 + j * 17) % 13 - 6) / 4.0)
    return OneClassSVM(W, 2.0 * np.pi * ((j * 7) % 13) / 13.0, ((j * 5) % 7 - 2) / 10.0, 0.0, gamma)


def given_rows(spark, sf):
    """The lines with their scaled features ``x``, written; the SVM's gamma comes from them."""
    from ..operators.detect import Scaler
    feats = with_structured_features(_fx3_logs(spark, sf)).select("line_no", *_GIVEN)
    found = quantiles(feats, _GIVEN, [0.25, 0.5, 0.75])
    scaler = Scaler([found[c][1] for c in _GIVEN], [(found[c][2] - found[c][0]) or 1.0 for c in _GIVEN])
    rows = feats.select("line_no", F.array(*_GIVEN).alias("x"))
    return materialize(rows.select("line_no", scaler.expr("x").alias("x")), "given")


def given_model(spark, sf):
    """The raw scores of every line under the stated models, and the SVM's rho as the exact 0.05-quantile."""
    from ..operators.ocsvm import products, scale_gamma
    rows = given_rows(spark, sf)
    svm = given_boundary(scale_gamma(rows, len(_GIVEN)))
    raw = products(given_forest().with_score(rows, "x", "iso"), svm, ["line_no", "iso"])
    # (the last bits of a product depend on the rows that share its batch)
    raw = materialize(raw.withColumn("product", F.round("product", 9)), "given-scores")
    rho = quantiles(raw, ["product"], [0.05])["product"][0]
    return raw.select("line_no", "iso", (F.lit(rho) - F.col("product")).alias("svm")), svm, rho


@query("forest_walk")
def forest_walk(spark, sf):
    walked = given_forest().with_score(given_rows(spark, sf), "x", "iso")
    return walked.select("line_no", F.round("iso", 6).alias("iso_score"))


@query("svm_products")
def svm_products(spark, sf):
    raw, svm, rho = given_model(spark, sf)
    return raw.select("line_no", F.round("svm", 6).alias("svm_score"), (F.col("svm") > 0).cast("int").alias("outside"),
                      F.lit(round(svm.gamma, 6)).alias("gamma"), F.lit(round(rho, 6)).alias("rho"))


@query("ensemble_labels")
def ensemble_labels(spark, sf):
    from ..operators.detect import Detector, DetectorModel, flag_threshold
    raw, svm, _ = given_model(spark, sf)
    model = DetectorModel(Detector(), None, None, None, svm, min_max(raw, "iso"), min_max(raw, "svm"), 0.0, 0.0)
    model.threshold, model.max_score = flag_threshold(model.ensemble(raw), "score", 0.05)
    return model.label(raw).select("line_no", "anomaly_score", "is_anomaly", F.lit(round(model.threshold, 6)).alias("threshold"))
