"""Structured features (M0 without text, F6, F7, F12-F14, F16, P14).

Seven doubles per line, computed as native column expressions on the same
DataFrame (no positional alignment).  The two size/time features are named
``f_response_size`` / ``f_response_time`` so they do not collide with the raw
columns; the debug view restores the reference names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

STRUCTURED = ["severity_score", "http_status_sev", "f_response_size", "f_response_time",
              "hour_of_day", "error_keyword", "http_code"]


def structured_columns():
    return [
        S.level_weight("level").alias("severity_score"),
        S.http_severity("http_status").alias("http_status_sev"),
        S.log1p0("response_size").alias("f_response_size"),
        S.log1p0("response_time").alias("f_response_time"),
        S.hour_of_day("timestamp").alias("hour_of_day"),
        S.error_keyword("message").alias("error_keyword"),
        S.http_code("http_status").alias("http_code"),
    ]


def with_structured_features(logs: DataFrame) -> DataFrame:
    return logs.select("*", *structured_columns())


def feature_view(logs: DataFrame, digits: int = 4) -> DataFrame:
    """The interpretable features rounded for display, reference names."""
    names = {"f_response_size": "response_size", "f_response_time": "response_time"}
    feats = with_structured_features(logs.select("line_no", "level", "http_status", "response_size",
                                                 "response_time", "timestamp", "message"))
    return feats.select("line_no", *[F.round(c, digits).alias(names.get(c, c)) for c in STRUCTURED])
