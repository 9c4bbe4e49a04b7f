"""Edge cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from logsift.functions import scalars as S


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,level", [
    ("a traceback here", "TRACE"), ("2 errors seen", "ERROR"), ("fatal and error", "FATAL"),
    ("warn: disk", "WARN"), ("nothing", "INFO"), ("CRITICAL path", "CRITICAL"),
])
def test_level_from_text(spark, text, level):
    assert one(spark, S.level_from_text, text) == level


@pytest.mark.parametrize("text,status", [
    ("worker 123 done status 404", 123), ("got 600 then 503", 503), ("no code", None), ("x1234 200", 200),
])
def test_status_from_text(spark, text, status):
    assert one(spark, S.status_from_text, text) == status


@pytest.mark.parametrize("text,ms", [
    ("took 12ms", 12.0), ("took 5 sec", 5000.0), ("took 8.3 seconds", None), ("took 2.5s", 2500.0),
    ("12 msgs", 12.0), ("none", None),
])
def test_response_time_from_text(spark, text, ms):
    assert one(spark, S.response_time_from_text, text) == ms


@pytest.mark.parametrize("msg,flag", [
    ("login failed", 0.0), ("it did fail", 1.0), ("Connection refused", 1.0), ("killer app", 0.0),
    ("OOM kill", 1.0), ("errors", 0.0), (None, 0.0),
])
def test_error_keyword_whole_words(spark, msg, flag):
    assert one(spark, S.error_keyword, msg) == flag


@pytest.mark.parametrize("ts,hour", [
    ("2024-01-01T05:06:07+03:00", 5.0), ("2024-01-01 23:59:59Z", 23.0), ("10/Oct/2000:13:55:36 -0700", 13.0),
    (None, 0.0), ("garbage", 0.0), ("", 0.0),
])
def test_hour_of_day_is_wall_clock(spark, ts, hour):
    assert one(spark, S.hour_of_day, ts) == hour


@pytest.mark.parametrize("v,out", [("200", 200), ("200.7", 200), ("abc", None), ("true", None), (" 42 ", 42)])
def test_safe_int(spark, v, out):
    assert one(spark, S.safe_int, v) == out


def test_safe_float(spark):
    assert one(spark, S.safe_float, "1.0d") is None
    assert one(spark, S.safe_float, " 1.5 ") == 1.5
    assert math.isnan(one(spark, S.safe_float, "nan"))
    assert one(spark, S.safe_float, "1e3") == 1000.0


def test_strip_unicode_nbsp(spark):
    assert one(spark, S.strip_unicode, "  x  ") == "x"


@pytest.mark.parametrize("level,w", [("debug", 0.0), ("WARN", 3.0), ("EMERG", 5.0), ("odd", 1.0), ("NOTICE", 2.0)])
def test_level_weight(spark, level, w):
    assert one(spark, S.level_weight, level) == w


@pytest.mark.parametrize("code,sev", [(None, 1.0), (200, 0.0), (302, 1.0), (404, 2.0), (503, 4.0)])
def test_http_severity(spark, code, sev):
    assert one(spark, S.http_severity, code, "int") == sev
