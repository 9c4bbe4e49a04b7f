"""Hand-valued cases: whole line numbers, rounding, clocks, wide CSV rows, split plans, many files, hot keys."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from logsift.operators import evaluate as EVAL
from logsift.operators import reports as R
from logsift.operators import signals as SIG
from logsift.sources.ingest import ingest, parsed_frames, quarantine

SCORED = "line_no long, timestamp string, message string, level string, anomaly_score double, is_anomaly int"


def write(d, name, text):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_long_line_numbers_stay_whole(spark):
    df = spark.createDataFrame([(12345, None, "m", "INFO", 0.9, 1), (7, None, "n", "INFO", 0.8, 1)], SCORED)
    headers = [r.header for r in R.explain_cards(df, 2, text_col="message").collect()]
    assert headers[0].startswith("Line 12345  |") and headers[1].startswith("Line    7  |")


def test_top_n_is_honoured(spark):
    df = spark.createDataFrame([(i, None, "m", "INFO", i / 100, 1) for i in range(60)], SCORED)
    assert R.top_n(df, 50).count() == 50
    with pytest.raises(ValueError):
        R.top_n(df, 0)


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(i, None, "m", "INFO", 0.1, int(i == 0)) for i in range(16)], SCORED)
    assert R.kpi_summary(df).first()["pct"] == 6.2
    gt = df.withColumn("gt", F.col("is_anomaly")).withColumn("is_anomaly", F.lit(1))
    assert EVAL.metrics(gt).first()["precision"] == 6.2


def test_clock_is_not_moved_by_the_session_zone(spark):
    rows = [(i, t, "Failed login from 198.51.100.5", "FATAL", 0.1, 1) for i, t in
            enumerate(["2024-03-10 02:30:15", "2024-03-10 02:30:16", "10/Mar/2024:02:30:17 -0700"])]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")      # 02:30 does not exist there on that day
    try:
        df = spark.createDataFrame(rows, SCORED).withColumn("component", F.lit("a")).withColumn("client_ip", F.lit(None).cast("string"))
        assert [(r.minute, r["count"]) for r in R.minute_volume(df).collect()] == [("2024-03-10 02:30:00", 3)]
        assert [r.ts for r in SIG.severity_bursts(df).collect()] == ["2024-03-10 02:30:17"]
        got = SIG.failed_logins(df).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r.ip, r.session_start, r.session_end, r.attempts, r.is_attack) for r in got] == [
        ("198.51.100.5", "2024-03-10 02:30:15", "2024-03-10 02:31:17", 3, 1)]


def test_failed_logins_need_a_login(spark):
    rows = [(1, "2024-01-01 00:00:00", "Connection refused for user 5", "ERROR", 0.1, 1),
            (2, "2024-01-01 23:59:59", "Failed password for root from 10.0.0.1", "ERROR", 0.1, 1),
            (3, "2024-01-02 00:00:30", "Failed password for root from 10.0.0.1", "ERROR", 0.1, 1),
            (4, "2024-01-02 00:05:00", "Failed password for root from 10.0.0.1", "ERROR", 0.1, 1),
            (5, "2024-01-02 09:00:00", "login failed", "ERROR", 0.1, 1)]
    df = spark.createDataFrame(rows, SCORED).withColumn("client_ip", F.lit(None).cast("string"))
    got = sorted((r.ip, r.session_start, r.attempts) for r in SIG.failed_logins(df).collect())
    assert got == [("", "2024-01-02 09:00:00", 1), ("10.0.0.1", "2024-01-01 23:59:59", 2), ("10.0.0.1", "2024-01-02 00:05:00", 1)]


def test_hot_component_and_span_borders(spark):
    """A component with most lines: counts over the borders of time spans are those of one window."""
    rows = [(s, f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", "m", "ERROR", 0.1, 1) for s in range(3500, 3700, 7)]
    df = spark.createDataFrame(rows, SCORED).withColumn("component", F.lit(None).cast("string"))
    secs = [r[0] for r in rows]
    want = {s: sum(s - 60 <= x <= s for x in secs) for s in secs}
    got = {r.line_no: r.burst_count for r in SIG.severity_bursts(df, min_count=1).collect()}
    assert got == want


def test_wide_csv_rows_and_bad_json_go_to_quarantine(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "a.csv", 'time,level,msg\n2024-01-01 00:00:00,info,ok\n1,2,3,4\n,warn\n"2024,x",error,"say ""hi"", you"\n')
    write(d, "b.jsonl", '{"msg": "x"}\n{broken\n')
    rows = ingest(spark, d).orderBy("line_no").collect()
    assert [(r.timestamp, r.level, r.message) for r in rows] == [
        ("2024-01-01 00:00:00", "INFO", "ok"), (None, "WARN", ""), ("2024,x", "ERROR", 'say "hi", you'), ("", "INFO", "x")]
    bad = {(os.path.basename(r.path), r.line, r.reason) for r in quarantine(spark, d).collect()}
    assert bad == {("a.csv", "1,2,3,4", "more cells than the header"), ("b.jsonl", "{broken", "not a JSON object")}


def test_csv_multiline_cells(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "a.csv", 'time,level,msg\n1,info,"two\nlines"\n1,2,3,4\n')
    assert [r.message for r in ingest(spark, d, csv_multiline=True).collect()] == ["two\nlines"]


def test_numbers_survive_another_split_plan(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "big.log", "".join(f"2024-01-01 00:00:00 [INFO] svc: event {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = ingest(spark, d)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        rows = df.select("line_no", "message").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.message) for r in rows] == [(i + 1, f"event {i}") for i in range(5000)]


def test_many_files_with_different_first_lines(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    for i in range(2000):
        write(d, f"f{i:04d}.log", f"start {i}, a, b\nx,{i},z\n")
    assert len(parsed_frames(spark, d)) == 1
    rows = ingest(spark, d).select("line_no", "raw_line").orderBy("line_no").collect()
    assert [(r.line_no, r.raw_line) for r in rows] == [(i + 1, f"x {i} z") for i in range(2000)]


def test_shared_folder_of_the_context_is_honoured(spark):
    from logsift.session import shared_dir
    assert shared_dir(spark).rstrip("/") in (spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir())


def test_answers_are_kept_between_runs(spark, tmp_path):
    """A second run asks for new texts only; old answers expire, and errors aren't kept."""
    from logsift.operators.enrich import enrich_distinct
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()

    def fn(text, calls=str(calls)):
        import uuid
        open(f"{calls}/{uuid.uuid4().hex}-{text}", "w").close()
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    def run(texts, **options):
        df = spark.createDataFrame([(t,) for t in texts], "m string")
        out = sorted((r.m or "", r.explanation) for r in enrich_distinct(df, "m", fn, store=store, **options).collect())
        asked = sorted(f.name.split("-")[1] for f in calls.iterdir())
        [f.unlink() for f in calls.iterdir()]
        return [e for _, e in out], asked

    first, asked = run(["a", "b", "a ", "bad"])
    assert first == ["A", "A", "B", "Error: no"] and asked == ["a", "b", "bad"]
    assert run(["b", "c", "bad"]) == (["B", "Error: no", "C"], ["bad", "c"])
    assert run(["a", "b", "c"])[1] == []
    assert run(["a"], max_age_s=0.0)[1] == ["a"]


def test_pivot_by_day(spark):
    from logsift.operators.reports import severity_pivot
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:05", "ERROR"), (2, "2024-01-02 10:00:07", "ERROR"), (3, "2024-01-02 10:00:09", "INFO")],
                                 "line_no long, timestamp string, level string")
    assert [(r.minute_str, r.ERROR, r.INFO) for r in severity_pivot(rows).collect()] == [("10:00", 2, 1)]
    assert sorted((r.minute_str, r.ERROR, r.INFO) for r in severity_pivot(rows, fold_days=False).collect()) == [
        ("2024-01-01 10:00", 1, 0), ("2024-01-02 10:00", 1, 1)]


def test_histogram_of_unrounded_scores_and_its_line(spark):
    rows = [(0.02499, 0.025, 0), (0.51, 0.51, 1), (1.0, 1.0, 1), (0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "score double, anomaly_score double, is_anomaly int")
    out = {(r.is_anomaly, r.bin): r for r in R.score_histogram(df, threshold=0.5).collect()}
    assert {k: r["count"] for k, r in out.items()} == {(0, 1): 2, (1, 11): 1, (1, 20): 1}   # 0.02499 isn't in bin 2
    assert [k for k, r in out.items() if r.at_threshold] == [(1, 11)] and {r.threshold for r in out.values()} == {0.5}
    assert R.score_histogram(df, score_col="anomaly_score").where("bin = 2").count() == 1
