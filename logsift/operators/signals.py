"""Targeted anomaly signals (D1-D10), each a table operator.

Thresholds marked as parameters are ours; the reference names the signals
without coding them.  Skew notes: per-key time windows are computed on
per-(key, second) counts, which map-side aggregation keeps small even when one
key holds a large share of the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize
from .stats import quantiles
from .tfidf import grams, spread

SPAN_S = 3600                                   # time spans that per-key windows are split into
COMMON_DF, COMMON_TERMS = 0.001, 500_000        # a term in more of the documents is a hot key; most terms sent out


def latency_spikes(logs: DataFrame, factor: float = 10.0) -> DataFrame:
    """Response time above ``factor`` x the median response time."""
    med = quantiles(logs.where(F.col("response_time").isNotNull()), ["response_time"], [0.5])["response_time"][0]
    if med is None:
        return logs.where(F.lit(False)).select("line_no", "response_time", F.lit(0.0).alias("median_rt"))
    return logs.where(F.col("response_time") > F.lit(factor * med)).select(
        "line_no", "response_time", F.round(F.lit(med), 6).alias("median_rt"))


def size_outliers(logs: DataFrame, z: float = 3.0) -> DataFrame:
    """Robust z-score |size - median| / IQR above ``z`` (IQR 0 -> 1)."""
    q = quantiles(logs.where(F.col("response_size").isNotNull()), ["response_size"], [0.25, 0.5, 0.75])["response_size"]
    if q[1] is None:
        return logs.where(F.lit(False)).select("line_no", "response_size", F.lit(0.0).alias("robust_z"))
    iqr = (q[2] - q[0]) or 1.0
    rz = F.abs(F.col("response_size") - F.lit(q[1])) / F.lit(iqr)
    return logs.where(rz > z).select("line_no", "response_size", F.round(rz, 6).alias("robust_z"))


def severity_bursts(logs: DataFrame, window_s: int = 60, min_count: int = 3, min_weight: float = 4.0) -> DataFrame:
    """D3: high-severity lines with at least ``min_count`` high-severity lines of the same
    component in the ``window_s`` seconds up to and including their own second.

    The window runs over per-(component, second) counts, not over lines, and in spans of ``SPAN_S``
    seconds; each span also gets the last ``window_s`` seconds before it, so a component that holds
    a third of all lines is many groups.
    """
    hs = (logs.where(S.level_weight("level") >= min_weight)
          .select("line_no", F.coalesce("component", F.lit("")).alias("component"),
                  S.parse_ts("timestamp").alias("t"))
          .select("line_no", "component", S.seconds("t").alias("sec"), S.time_text("t").alias("ts"))
          .where(F.col("sec").isNotNull()))
    per_sec = hs.groupBy("component", "sec").agg(F.count(F.lit(1)).alias("n"))
    here = F.floor(F.col("sec") / SPAN_S)
    later = F.floor((F.col("sec") + window_s) / SPAN_S)
    spans = per_sec.withColumn("span", F.explode(F.sequence(here, later)))
    w = Window.partitionBy("component", "span").orderBy("sec").rangeBetween(-window_s, 0)
    counts = (spans.select("component", "sec", "span", F.sum("n").over(w).alias("burst_count"))
              .where(F.col("span") == here).drop("span"))
    return (hs.join(counts, ["component", "sec"])
            .where(F.col("burst_count") >= min_count)
            .select("line_no", "component", "ts", F.col("burst_count").cast("long").alias("burst_count")))


def rare_vocabulary(docs: DataFrame, key_col: str, text_col: str, k: int = 20, stop_words=None,
                    parts: int | None = None) -> DataFrame:
    """Rows whose distinct terms have the highest mean IDF (top ``k``)."""
    n = docs.count()
    terms = materialize(spread(docs.select(key_col, text_col), parts).select(
        key_col, F.explode(F.array_distinct(grams(F.col(text_col), stop_words))).alias("term")), "terms")
    idf = (F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf")
    stats = materialize(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", idf), "term-idf")
    # frequent terms, the hot keys, are a table whose size their frequency bounds: it is checked and sent to the
    # pairs; only pairs of rare terms are shuffled by term (and all of them, if the check fails)
    common = stats.where(F.col("df") > max(n * COMMON_DF, 1.0)).select("term", F.col("idf").alias("common_idf"))
    rare = stats.where(F.col("df") <= max(n * COMMON_DF, 1.0)).select("term", "idf")
    if common.count() <= COMMON_TERMS:
        marked = terms.join(F.broadcast(common), "term", "left")
        parts = (marked.where("common_idf is not null").select(key_col, F.col("common_idf").alias("idf"))
                 .unionByName(marked.where("common_idf is null").join(rare, "term").select(key_col, "idf")))
    else:
        parts = terms.join(stats, "term").select(key_col, "idf")
    per_doc = parts.groupBy(key_col).agg(F.avg("idf").alias("mean_idf"), F.count(F.lit(1)).alias("n_terms"))
    return (per_doc.select(key_col, F.round("mean_idf", 6).alias("mean_idf"), "n_terms")
            .orderBy(F.desc("mean_idf"), key_col).limit(k))


def client_error_rate(logs: DataFrame) -> DataFrame:
    """Per client and minute, requests, 4xx responses and their rate."""
    t = logs.where(F.col("client_ip").isNotNull()).select(
        "client_ip", S.minute_text(S.parse_ts("timestamp")).alias("minute"), "http_status")
    is4 = (F.col("http_status") >= 400) & (F.col("http_status") < 500)
    return (t.groupBy("client_ip", "minute")
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(is4).cast("long").alias("client_errors"))
            .withColumn("error_rate", F.round(F.col("client_errors") / F.col("requests"), 6)))


def server_errors(logs: DataFrame) -> DataFrame:
    """Every 5xx line."""
    return logs.where(F.col("http_status") >= 500).select("line_no", "client_ip", "http_status", "message")


def off_hours(logs: DataFrame, start: int = 8, end: int = 18) -> DataFrame:
    """Lines whose hour of day is before ``start`` or at/after ``end``."""
    h = S.hour_of_day("timestamp")
    return logs.select("line_no", h.alias("hour_of_day")).where((F.col("hour_of_day") < start) |
                                                                 (F.col("hour_of_day") >= end))


def volume_bursts(logs: DataFrame, z: float = 3.0) -> DataFrame:
    """Per minute, line count and its z-score against all minutes; flag above ``z``."""
    per_min = (logs.select(S.minute_text(S.parse_ts("timestamp")).alias("minute"))
               .where(F.col("minute").isNotNull())
               .groupBy("minute").agg(F.count(F.lit(1)).alias("count")))
    st = per_min.agg(F.avg("count").alias("mu"), F.stddev_pop("count").alias("sd")).first()
    mu, sd = st["mu"] or 0.0, st["sd"] or 0.0
    zc = (F.col("count") - F.lit(mu)) / F.lit(sd) if sd > 0 else F.lit(0.0)
    return per_min.select("minute", "count", F.round(zc, 6).alias("z"),
                          F.when(zc > z, 1).otherwise(0).alias("is_burst"))


IP_RE = r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"
FAILED_LOGIN_RE = (r"(?i)\b(failed login|login failed|failed password|authentication failure|invalid password|"
                   r"invalid user|login denied|access denied for user)\b")


def failed_logins(logs: DataFrame, gap_s: int = 60, min_attempts: int = 3) -> DataFrame:
    """Per client address, runs of failed-login lines less than ``gap_s`` seconds apart; flag >= ``min_attempts``.

    The address is ``client_ip``, else the first one in the message; lines without any are the address ``''``.
    Lines are counted per (address, second) first.  Runs are found within a day of an address; only the first
    and last run of each day are then compared across days, so an address that holds a third of all lines is
    many groups.
    """
    t = (logs.where(F.col("message").rlike(FAILED_LOGIN_RE))
         .select(F.coalesce("client_ip", F.regexp_extract("message", IP_RE, 1)).alias("ip"),
                 S.seconds(S.parse_ts("timestamp")).alias("sec"))
         .where(F.col("sec").isNotNull())
         .groupBy("ip", "sec").agg(F.count(F.lit(1)).alias("n"))
         .withColumn("day", F.floor(F.col("sec") / 86400)))

    def runs(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
        """(keys, first, last, n) of runs of rows whose start is less than the gap after the last end."""
        w = Window.partitionBy(*keys).orderBy(start)
        new = F.when(F.col(start) - F.lag(end).over(w) < gap_s, 0).otherwise(1)
        marked = df.withColumn("_new", new)
        return (marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy(*keys, "_run").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.sum("n").alias("n")))

    daily = runs(t, ["ip", "day"], "sec", "sec")
    day = Window.partitionBy("ip", "day")
    daily = daily.withColumn("edge", (F.col("_run") == F.min("_run").over(day)) | (F.col("_run") == F.max("_run").over(day)))
    daily = materialize(daily.select("ip", "first", "last", "n", "edge"), "login-runs")
    edges = runs(daily.where("edge").select("ip", "first", "last", "n"), ["ip"], "first", "last")
    found = daily.where("not edge").select("ip", "first", "last", "n").unionByName(edges.select("ip", "first", "last", "n"))

    def text(c):
        return F.concat(
            F.date_from_unix_date(F.floor(c / 86400).cast("int")).cast("string"), F.lit(" "),
            F.lpad(F.floor(c % 86400 / 3600).cast("string"), 2, "0"), F.lit(":"),
            F.lpad(F.floor(c % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((c % 60).cast("string"), 2, "0"))

    return found.select("ip", text(F.col("first")).alias("session_start"), text(F.col("last") + gap_s).alias("session_end"),
                        F.col("n").alias("attempts"),
                        F.when(F.col("n") >= min_attempts, 1).otherwise(0).alias("is_attack"))


# Failure families (our parameters).
FAILURE_TAGS = {
    "connection": r"(?i)\b(refused|connection|unreachable|timeout|timed out)\b",
    "circuit_breaker": r"(?i)\b(circuit|breaker)\b",
    "oom": r"(?i)\b(oom|out of memory|killed)\b",
    "disk": r"(?i)\b(disk|filesystem|no space|read-only|i/o error)\b",
}


def failure_tags(logs: DataFrame) -> DataFrame:
    """Failure-family tags per line (lines with at least one tag)."""
    tags = F.filter(F.array(*[F.when(F.col("message").rlike(p), F.lit(n)) for n, p in FAILURE_TAGS.items()]),
                    lambda x: x.isNotNull())
    return (logs.select("line_no", F.array_join(tags, ",").alias("tags"))
            .where(F.col("tags") != ""))
