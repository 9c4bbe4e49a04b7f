"""Dashboard aggregates and tables over a scored log table.

Input: the unified log table plus ``anomaly_score`` and ``is_anomaly``.  Every
report is an independent DataFrame over that (persisted) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from .features import with_structured_features
from .stats import minmax_norm


def with_time(df: DataFrame) -> DataFrame:
    """parsed wall-clock time and its minute (both TIMESTAMP_NTZ)."""
    ts = S.parse_ts("timestamp")
    return df.withColumn("ts_parsed", ts).withColumn("minute", S.floor_minute("ts_parsed"))


def kpi_summary(scored: DataFrame) -> DataFrame:
    """A5: total lines, anomalies, percent flagged (1 dp)."""
    a = scored.agg(F.count(F.lit(1)).alias("total_lines"),
                   F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("anomalies"))
    return a.select("total_lines", "anomalies",
                    F.when(F.col("total_lines") > 0,
                           F.bround(100.0 * F.col("anomalies") / F.col("total_lines"), 1))
                    .otherwise(F.lit(0.0)).alias("pct"))


def _timed(scored: DataFrame) -> DataFrame:
    """Rows whose timestamp parses (empty output when none does)."""
    return with_time(scored).where(F.col("ts_parsed").isNotNull())


def minute_volume(scored: DataFrame) -> DataFrame:
    """A1: lines per minute."""
    return (_timed(scored).groupBy(S.time_text("minute").alias("minute"))
            .agg(F.count(F.lit(1)).alias("count")))


def minute_anomalies(scored: DataFrame) -> DataFrame:
    """A2: anomalous lines per minute (minutes without anomalies are absent)."""
    return (_timed(scored).where(F.col("is_anomaly") == 1)
            .groupBy(S.time_text("minute").alias("minute"))
            .agg(F.count(F.lit(1)).alias("anom_count")))


def anomaly_events(scored: DataFrame) -> DataFrame:
    """Each timed anomaly with its minute's total volume (1 when unmatched).

    The volume side has one row per minute of the time span, not per line.
    """
    vol = minute_volume(scored)
    anoms = _timed(scored).where(F.col("is_anomaly") == 1).select(
        "line_no", S.time_text("ts_parsed").alias("ts"),
        S.time_text("minute").alias("minute"), "anomaly_score")
    return (anoms.join(vol, "minute", "left")
            .select("line_no", "ts", "minute", "anomaly_score",
                    F.coalesce(F.col("count"), F.lit(1)).cast("long").alias("minute_count")))


def score_histogram(scored: DataFrame, normal_bins: int = P.HIST_BINS_NORMAL, anomaly_bins: int = P.HIST_BINS_ANOMALY,
                    score_col: str | None = None, threshold: float | None = None) -> DataFrame:
    """Equal-width bins over [0, 1]; the maximum falls in the last bin.

    Bins the unrounded ``score``, if the table has it.  With a ``threshold``, each bin says where the threshold
    line stands and whether it runs through the bin.
    """
    score = F.col(score_col or ("score" if "score" in scored.columns else "anomaly_score"))
    nb = F.when(F.col("is_anomaly") == 1, F.lit(anomaly_bins)).otherwise(F.lit(normal_bins))

    def bin_of(x, n):
        return F.least(F.greatest(F.floor(x * n) + 1, F.lit(1)), n).cast("int")

    line = [] if threshold is None else [
        F.lit(float(threshold)).alias("threshold"), (F.col("bin") == bin_of(F.lit(float(threshold)), F.col("n_bins"))).alias("at_threshold")]
    return (scored.select("is_anomaly", bin_of(score, nb).alias("bin"), nb.alias("n_bins"))
            .groupBy("is_anomaly", "bin", "n_bins").agg(F.count(F.lit(1)).alias("count"))
            .select("is_anomaly", "bin",
                    F.round((F.col("bin") - 1) / F.col("n_bins"), 6).alias("lo"),
                    F.round(F.col("bin") / F.col("n_bins"), 6).alias("hi"), "count", *line))


def level_breakdown(logs: DataFrame) -> DataFrame:
    """A3: lines per level with their share of all lines, largest first."""
    counts = logs.groupBy("level").agg(F.count(F.lit(1)).alias("count"))
    # one row per level: its sum over all levels is the total, without another pass over the lines
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return (counts.select("level", "count", F.round(F.col("count") / total, 6).alias("share"))
            .orderBy(F.desc("count"), "level"))


def feature_profile(scored: DataFrame, features=None) -> DataFrame:
    """Per feature, mean of the min-max normalised value for anomalies and for normal lines."""
    features = list(features or P.PROFILE_FEATURES)
    feats = scored if set(features) <= set(scored.columns) else with_structured_features(scored)
    bounds = feats.agg(*[F.min(c).alias(f"lo_{c}") for c in features],
                       *[F.max(c).alias(f"hi_{c}") for c in features]).first()
    norm = {c: minmax_norm(c, bounds[f"lo_{c}"], bounds[f"hi_{c}"]) for c in features}
    is_a = F.col("is_anomaly") == 1
    agg = feats.agg(*[F.avg(F.when(is_a, norm[c])).alias(f"a_{c}") for c in features],
                    *[F.avg(F.when(~is_a, norm[c])).alias(f"n_{c}") for c in features])
    stack = ", ".join(f"'{c}', a_{c}, n_{c}" for c in features)
    return agg.selectExpr(f"stack({len(features)}, {stack}) as (feature, anomaly_mean, normal_mean)") \
        .select("feature", F.round(F.coalesce("anomaly_mean", F.lit(0.0)), 6).alias("anomaly_mean"),
                F.round("normal_mean", 6).alias("normal_mean"))


def severity_pivot(scored: DataFrame, fold_days: bool = True) -> DataFrame:
    """A4: 'HH:mm' x level counts over the fixed level columns (days fold together, or have minutes of their own)."""
    minute = S.clock_minute("ts_parsed") if fold_days else F.substring(S.time_text("minute"), 1, 16)
    t = _timed(scored).select(minute.alias("minute_str"), F.upper("level").alias("level"))
    pv = t.groupBy("minute_str").pivot("level", P.PIVOT_LEVELS).agg(F.count(F.lit(1)))
    return pv.select("minute_str", *[F.coalesce(F.col(l), F.lit(0)).cast("long").alias(l) for l in P.PIVOT_LEVELS])


def _display(df: DataFrame) -> DataFrame:
    """P10 + F23: display columns and the score band."""
    return df.select(
        F.col("line_no").alias("Line"), F.col("timestamp").alias("Timestamp"),
        F.col("level").alias("Level"), F.col("http_status").alias("Status"),
        F.col("anomaly_score").alias("Score"), F.col("message").alias("Message"),
        S.score_band("anomaly_score").alias("Band"))


def anomaly_table(scored: DataFrame) -> DataFrame:
    """T1 + P7: anomalies, highest score first."""
    return _display(scored.where(F.col("is_anomaly") == 1)).orderBy(F.desc("Score"), "Line")


def normal_table(scored: DataFrame) -> DataFrame:
    """Normal lines in line order."""
    return _display(scored.where(F.col("is_anomaly") == 0)).orderBy("Line")


def all_lines_table(scored: DataFrame) -> DataFrame:
    """Every line, anomalies first."""
    return _display(scored.orderBy(F.desc("is_anomaly"), "line_no"))


def top_anomalies(scored: DataFrame, k: int = P.TOP_ANOMALIES) -> DataFrame:
    """T3 + F22 + F24: the k highest-scoring anomalies with a label and an emphasis weight."""
    top = (scored.where(F.col("is_anomaly") == 1)
           .orderBy(F.desc("anomaly_score"), "line_no").limit(k)
           .select("line_no", "level", "message", "anomaly_score"))
    lo, hi = (lambda r: (r["lo"], r["hi"]))(
        top.agg(F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi")).first())
    span = max((hi or 0.0) - (lo or 0.0), 1e-6)
    label = F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(" · "), F.col("level"),
                     F.lit(" · "), F.substring(F.coalesce("message", F.lit("")), 1, P.LABEL_MSG_CHARS))
    return top.select("line_no", label.alias("label"), "anomaly_score",
                      F.round(F.lit(0.4) + F.lit(0.6) * (F.col("anomaly_score") - F.lit(lo or 0.0)) / F.lit(span), 6)
                      .alias("emphasis"))


def top_n(scored: DataFrame, n: int = P.EXPLAIN_DEFAULT) -> DataFrame:
    """T4: the N highest-scoring anomalies."""
    if int(n) < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    return scored.where(F.col("is_anomaly") == 1).orderBy(F.desc("anomaly_score"), "line_no").limit(n)


def _padded(c: str, width: int):
    """The number as text, blanks in front up to ``width``; longer numbers stay whole."""
    text = F.col(c).cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


def explain_cards(scored: DataFrame, n: int = P.EXPLAIN_DEFAULT, text_col: str = "raw_line") -> DataFrame:
    """U4: context card per top-N anomaly (header line, context line, text sent for explanation)."""
    t = top_n(scored, n)
    text = F.col(text_col) if text_col in t.columns else F.col("message")
    header = F.concat(
        F.lit("Line "), _padded("line_no", 4), F.lit("  |  ["), F.col("level"),
        F.lit("]  |  Score "), F.format_string("%.4f", "anomaly_score"), F.lit("  |  "),
        S.ellipsize(F.coalesce("message", F.lit("")), P.CARD_MSG_CHARS))
    context = F.concat(F.coalesce("timestamp", F.lit("None")), F.lit(" · Line "), F.col("line_no").cast("string"),
                       F.lit(" · "), F.col("level"))
    return t.select("line_no", header.alias("header"), context.alias("context"),
                    F.coalesce(text, F.lit("")).alias("text"))
