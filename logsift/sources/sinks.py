"""Sinks (S11): the scored table as CSV with a header, or as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import scalars as S

RESULT_COLUMNS = ["line_no", "raw_line", "timestamp", "message", "level", "http_status",
                  "response_size", "response_time", "anomaly_score", "is_anomaly"]


def result_view(scored: DataFrame) -> DataFrame:
    """Result columns plus ts_parsed and minute, as the CSV export has them."""
    ts = S.parse_ts("timestamp")
    return scored.select(*RESULT_COLUMNS, ts.alias("ts_parsed"), S.floor_minute(ts).alias("minute"))


def write_csv(scored: DataFrame, path: str, mode: str = "error") -> None:
    result_view(scored).write.mode(mode).option("header", True).csv(path)


def write_parquet(scored: DataFrame, path: str, mode: str = "error", partition_by=None) -> None:
    w = result_view(scored).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
