"""Readers, sniffing and dense line numbers on small hand-written files."""

import os
import tempfile

from pyspark.sql import functions as F

from logsift.sources.ingest import EmptyLogError, ingest
from logsift.sources.sniff import sniff

SYSLOG = """# maintenance window notes

2024-05-01 07:00:01 [INFO] gateway: GET /health 200 3ms
2024-05-01 07:00:02 [ERROR] auth: Failed login for user admin from 203.0.113.9
2024-05-01 07:00:03 [ERROR] auth: Failed login for user admin from 203.0.113.9
2024-05-01 07:00:04 [CRITICAL] auth: account admin locked
   
# a traceback was printed by the worker
2024-05-01T07:00:05.250+02:00 pool: at 97% capacity
"""


def write(dirpath, name, text):
    os.makedirs(dirpath, exist_ok=True)
    p = os.path.join(dirpath, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_raw_text_mixed_shapes(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "app.log", SYSLOG)
    rows = ingest(spark, d).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(1, 8))
    assert rows[0].level == "INFO" and rows[0].timestamp is None          # comment -> fallback
    assert rows[2].level == "ERROR" and rows[2].component == "auth"
    assert rows[5].level == "TRACE"                                       # "traceback" in a comment
    assert rows[6].level == "INFO" and rows[6].component == "pool"
    assert all(r.http_status is None for r in rows[1:5])                  # syslog never extracts status


def test_json_presence_beats_null_and_malformed_dropped(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "a.jsonl", '{"level": null, "severity": "error", "msg": "x", "status": 200.7}\n'
                        '{broken\n\n{"severity": "warn", "message": "y", "duration": "12.5"}\n'
                        '{"a": 1} trailing\n')
    rows = ingest(spark, d).orderBy("line_no").collect()
    assert len(rows) == 2
    assert rows[0].level == "NONE" and rows[0].http_status == 200 and rows[0].timestamp == ""
    assert rows[1].level == "WARN" and rows[1].response_time == 12.5


def test_csv_aliases_per_file(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "x.csv", 'Date,Log Level,Text,Response Code,Bytes,Elapsed\n'
                      '2024-01-01 10:00:00,warning,"hello, world",404,12,3.5\n'
                      '2024-01-01 10:00:01,,plain,,,\n')
    rows = ingest(spark, d).orderBy("line_no").collect()
    assert rows[0].timestamp == "2024-01-01 10:00:00" and rows[0].level == "WARNING"
    assert rows[0].message == "hello, world" and rows[0].http_status == 404 and rows[0].response_time == 3.5
    assert rows[1].level == "INFO" and rows[1].http_status is None


def test_sniff_order(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    a = write(d, "a.log", '{"msg": 1}\n{"msg": 2}\nplain\n')
    b = write(d, "b.log", "x,y,z\n1,2,3\n")
    c = write(d, "c.txt", "just text, one comma\n")
    e = write(d, "d.csv", '{"msg": 1}\n')
    got = {os.path.basename(r.path): r.format for r in sniff(spark, spark.read.text(d).inputFiles()).collect()}
    assert got == {"a.log": "json", "b.log": "csv", "c.txt": "raw", "d.csv": "json"}


def test_line_numbers_dense_across_splits(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    lines = [f"2024-01-01 00:00:{i % 60:02d} [INFO] svc: event {i}" if i % 7 else "" for i in range(1, 5001)]
    write(d, "big.log", "\n".join(lines) + "\n")
    write(d, "small.log", "2024-01-01 00:00:00 [INFO] svc: tail\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = ingest(spark, d)
        rows = df.select("line_no", "message").orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [l for l in lines if l]
    assert [r.line_no for r in rows] == list(range(1, len(kept) + 2))
    assert rows[0].message == "event 1" and rows[len(kept) - 1].message == kept[-1].split(": ", 1)[1]
    assert rows[-1].message == "tail"


def test_empty_input_raises(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "e.log", "\n   \n")
    try:
        ingest(spark, d)
        assert False, "expected EmptyLogError"
    except EmptyLogError:
        pass
    assert ingest(spark, d, allow_empty=True).count() == 0


def test_heads_are_read_by_tasks(spark, monkeypatch):
    """Long lines, odd bytes, few lines and many files; the driver opens none of them."""
    d = tempfile.mkdtemp(dir="/tmp")
    write(d, "long.txt", "x" * 200_000 + "\n" + '{"a": 1}\n' * 300_000)
    with open(os.path.join(d, "bytes.log"), "wb") as f:
        f.write(b"\xff\xfe,a,b\n\xffrest\n")
    write(d, "empty.log", "")
    write(d, "blank.log", "\n\n")
    for i in range(60):
        write(d, f"n{i}.csv", f"time,level,c{i}\n1,2,3\n")
    files = spark.read.text(d).inputFiles()
    monkeypatch.setattr("builtins.open", lambda f, *a, __open=open, **k: 1 / 0 if str(f).startswith(d) else __open(f, *a, **k))
    got = {os.path.basename(r.path): r for r in sniff(spark, files).collect()}
    assert len(got) == 63 and got["long.txt"].format == "json" and got["bytes.log"].format == "csv" and got["blank.log"].format == "raw"
    assert all((got[f"n{i}.csv"].cells, got[f"n{i}.csv"].timestamp, got[f"n{i}.csv"].level, got[f"n{i}.csv"].status) == (3, 0, 1, None)
               for i in range(60))


def test_two_thousand_headers_are_one_branch(spark):
    from logsift.sources.ingest import parsed_frames
    d, extra = tempfile.mkdtemp(dir="/tmp"), [f"x{i}" for i in range(2000)]
    for i in range(2000):
        names = ["time", "level", "message", extra[i]]
        order = [(i + j) % 4 for j in range(4)] if i % 2 else [3 - (i + j) % 4 for j in range(4)]
        cells = [f"t{i}", "warn" if i % 3 else "", f"m, {i}", "e"]
        write(d, f"f{i:04d}.csv", ",".join(names[j] for j in order) + "\n" + ",".join(f'"{cells[j]}"' for j in order) + "\n")
    frames = parsed_frames(spark, d)
    assert len(frames) == 1
    plan = frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2 and len(plan) < 20_000
    rows = ingest(spark, d).orderBy("line_no").collect()
    assert [(r.line_no, r.timestamp, r.level, r.message) for r in rows] == [
        (i + 1, f"t{i}", "WARN" if i % 3 else "INFO", f"m, {i}") for i in range(2000)]


def _reader_rows(spark, d, names):
    """Rows as Spark's own reader of whole files gives them."""
    df = (spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", True).option("lineSep", "\n").csv(d))
    return sorted(tuple(c or "" for c in r) for r in df.collect())


def test_records_over_split_borders(spark):
    """Cells with line ends, quotes and commas, records longer than a split, in splits of a few bytes."""
    import random
    rng = random.Random(3)
    d = tempfile.mkdtemp(dir="/tmp")
    for name in ("a.csv", "b.csv"):
        lines = ["Time,Severity,Msg"]
        for i in range(120):
            parts = [rng.choice(["line", "two\nlines", 'quote "" in', "a, comma", "\n", "\n\n\n", 'end ""', "é", "x" * 40 + "\n"]) for _ in range(rng.randint(0, 6))]
            lines.append(f'{name}{i},{rng.choice(["error", "info", ""])},"{"".join(parts)}"')
            if i == 50:
                lines.append(f'{name}long,warn,"' + "\n".join(f'row {j} ""x""' for j in range(400)) + '"')
            if i == 70:
                lines.append('stray,info,5" disk')
        write(d, name, "\n".join(lines) + ("\n" if name == "a.csv" else ""))
    want = _reader_rows(spark, d, ["time", "severity", "msg"])
    for size in ("64", "777", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = ingest(spark, d, csv_multiline=True).orderBy("line_no").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r.line_no for r in rows] == list(range(1, len(want) + 1))
        assert sorted((r.timestamp or "", r.level, r.message) for r in rows) == sorted((t, (s or "INFO").upper(), m) for t, s, m in want)
        names = [r.timestamp for r in rows]     # in the files' order
        assert names == [n for f in ("a.csv", "b.csv") for n in [f"{f}{i}" for i in range(51)] + [f"{f}long"]
                         + [f"{f}{i}" for i in range(51, 71)] + ["stray"] + [f"{f}{i}" for i in range(71, 120)]]


def test_surplus_cells_and_carriage_returns_in_records(spark):
    from logsift.sources.ingest import quarantine
    d = tempfile.mkdtemp(dir="/tmp")
    with open(os.path.join(d, "x.csv"), "wb") as f:
        f.write(b'time,level,message\r\n1,info,"a\r\nb"\r\n2,info,"c",d\r\n\r\n3,info,"e, ""f""\n",g\n4,"warn",last\r\n5,info,"open\n')
    for size in ("16", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = ingest(spark, d, csv_multiline=True).orderBy("line_no").collect()
            bad = quarantine(spark, d, csv_multiline=True).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.line_no, r.timestamp, r.level, r.message) for r in rows] == [
            (1, "1", "INFO", "a\r\nb"), (2, "4", "WARN", "last"), (3, "5", "INFO", "open")]
        assert sorted(r.line for r in bad) == ['2,info,"c",d', '3,info,"e, ""f""\n",g']


def test_states_of_lines():
    import itertools

    import numpy as np

    from logsift.sources.records import states
    for n in range(5):
        for flags in itertools.product([(a, b) for a in (False, True) for b in (False, True)], repeat=n):
            for start in (False, True):
                want = [start]
                for a, b in flags:
                    want.append(b if want[-1] else a)
                got = states(np.array([a for a, _ in flags], bool), np.array([b for _, b in flags], bool), start)
                assert got.tolist() == want
