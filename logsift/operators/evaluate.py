"""Rule-based ground truth and evaluation.

A line is a heuristic anomaly if any rule fires: error level; HTTP status
>= 500; an error keyword in the message; response time strictly above the
95th percentile of all response times (+inf when there is none).  Every rule
is closed over NULL (NULL -> false), so three-valued logic cannot leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .stats import quantile

RULES = ["error_level", "server_error", "error_keyword", "slow_response"]


def response_time_p95(df: DataFrame, exact: bool = True) -> float:
    """Exact p95 of response times, +inf when there is none."""
    q = quantile(df, "response_time", 0.95, exact)
    return float("inf") if q is None else float(q)


def with_ground_truth(df: DataFrame, p95: float | None = None) -> DataFrame:
    """Adds ``reasons`` (array of fired rule names) and ``gt`` (0/1)."""
    if p95 is None:
        p95 = response_time_p95(df)
    fired = [
        F.when(S.is_error_level("level"), F.lit(RULES[0])),
        F.when(F.coalesce(F.col("http_status") >= 500, F.lit(False)), F.lit(RULES[1])),
        F.when(S.has_error_keyword("message"), F.lit(RULES[2])),
        F.when(F.coalesce((F.col("response_time") > F.lit(p95)) & ~F.isnan("response_time"), F.lit(False)), F.lit(RULES[3])),
    ]
    reasons = F.filter(F.array(*fired), lambda x: x.isNotNull())
    return (df.withColumn("reasons", reasons)
            .withColumn("gt", F.when(F.size("reasons") > 0, 1).otherwise(0)))


def metrics(df: DataFrame, label_col: str = "is_anomaly", gt_col: str = "gt") -> DataFrame:
    """A8-A10 then A9: one row of confusion counts and percentages (1 dp)."""
    pred, gt = F.col(label_col) == 1, F.col(gt_col) == 1
    counts = df.agg(
        F.count_if(pred & gt).cast("long").alias("tp"),
        F.count_if(pred & ~gt).cast("long").alias("fp"),
        F.count_if(~pred & gt).cast("long").alias("fn"),
        F.count_if(~pred & ~gt).cast("long").alias("tn"),
        F.count(F.lit(1)).cast("long").alias("n"),
    )
    tp, fp, fn, tn, n = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn", "n"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    step = counts.select("*", precision.alias("_p"), recall.alias("_r"))
    p, r = F.col("_p"), F.col("_r")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    fpr = F.when(fp + tn > 0, fp / (fp + tn)).otherwise(F.lit(0.0))
    acc = F.when(n > 0, (tp + tn) / n).otherwise(F.lit(0.0))
    pct = lambda c: F.bround(c * 100, 1)
    return step.select(
        "tp", "fp", "fn", "tn",
        pct(p).alias("precision"), pct(r).alias("recall"), pct(f1).alias("f1"),
        pct(fpr).alias("fpr"), pct(acc).alias("estimated_accuracy"),
        (F.col("tp") + F.col("fn")).alias("gt_anomalies"),
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """M8: ground truth from the rules, then the metrics of ``is_anomaly`` against it."""
    return metrics(with_ground_truth(scored))
