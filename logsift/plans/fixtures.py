"""Log fixtures derived from the driver's tables (FX1-FX7), as DataFrames.

Every fixture is a projection of ``events``, ``pages`` or ``documents``, so its
size grows with the tables.  File-based fixtures are written with Spark's own
writers into a fresh folder inside the shared scratch folder and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# --- fixed values: fixture text shapes ----------------------------------------
CSV_HEADER = "Time,Severity,Msg,Status Code,Bytes,Latency_MS"
APACHE_STATUS = [200, 201, 301, 404, 500, 503]   # by page_id % 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared base: events with the integer ``k``, the text time ``t`` and a level."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.substring(F.col("ts").cast("string"), 1, 19).alias("t"),
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "purchase", "WARNING")
        .when(F.col("event_type") == "click", "DEBUG")
        .otherwise("INFO").alias("lvl"),
    )


def msg() -> Column:
    u, k, et = F.col("user_id").cast("string"), F.col("k").cast("string"), F.col("event_type")
    return (
        F.when(et == "error", F.concat(F.lit("Connection refused for user "), u, F.lit(" after "), k, F.lit("ms")))
        .when(et == "purchase", F.concat(F.lit("Slow query detected ("), k, F.lit("ms) for user "), u))
        .otherwise(F.concat(F.lit("user "), u, F.lit(" "), et, F.lit(" ok in "), k, F.lit("ms")))
    )


def fx1(spark, sf_dir) -> DataFrame:
    """Syslog lines (event_id, line)."""
    return ev(spark, sf_dir).select(
        "event_id",
        F.concat(F.col("t"), F.lit(" ["), F.col("lvl"), F.lit("] "), F.col("event_type"),
                 F.lit("_service: "), msg()).alias("line"))


def fx2(spark, sf_dir) -> DataFrame:
    """Apache combined lines (page_id, line); every ninth size is '-'."""
    p = _table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    status = F.element_at(F.array(*[F.lit(s) for s in APACHE_STATUS]), (pid % 6 + 1).cast("int"))
    size = F.when(pid % 9 == 0, F.lit("-")).otherwise(F.length("html").cast("string"))
    return p.select(
        "page_id",
        F.concat(F.lit("10.0.0."), (pid % 256).cast("string"), F.lit(" - - [10/Oct/2000:13:"),
                 F.lpad((pid % 60).cast("string"), 2, "0"), F.lit(':36 -0700] "GET '), F.col("url"),
                 F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" "), size).alias("line"))


def fx3(spark, sf_dir) -> DataFrame:
    """Structured, scored log table with a deterministic stand-in score."""
    e = ev(spark, sf_dir)
    h = (F.col("k") * 37 + F.col("user_id") * 11) % 1000
    return e.select(
        (F.col("event_id") + 1).alias("line_no"),
        F.col("t").alias("timestamp"),
        msg().alias("message"),
        F.col("lvl").alias("level"),
        F.when(F.col("event_type") == "signup", F.lit(None)).otherwise((F.col("k") % 5 + 1) * 100)
        .cast("int").alias("http_status"),
        F.when(F.col("k") % 7 == 0, F.lit(None)).otherwise((F.col("k") * 100).cast("double"))
        .alias("response_size"),
        F.when(F.col("k") % 11 == 0, F.lit(None)).otherwise(F.col("value")).alias("response_time"),
        (h.cast("double") / 1000).alias("anomaly_score"),
        F.when(h >= 950, 1).otherwise(0).alias("is_anomaly"),
    )


def fx4(spark, sf_dir) -> DataFrame:
    """NDJSON lines: 2 % malformed, 2 % blank, 10 % with a null level beside a severity."""
    e = ev(spark, sf_dir)
    eid = F.col("event_id")
    body = F.concat(
        F.lit('{"time":"'), F.col("t"), F.lit('","severity":"'), F.lower("lvl"), F.lit('",'),
        F.when(eid % 10 == 3, F.lit('"level":null,')).otherwise(F.lit("")),
        F.lit('"msg":"'), msg(), F.lit('","status":'), ((F.col("k") % 5 + 1) * 100).cast("string"),
        F.lit(',"latency_ms":'), F.col("value").cast("string"), F.lit("}"))
    return e.select("event_id", F.when(eid % 50 == 0, F.lit("{broken"))
                    .when(eid % 50 == 1, F.lit("")).otherwise(body).alias("line"))


def fx5(spark, sf_dir) -> DataFrame:
    """CSV data lines (header written separately)."""
    e = ev(spark, sf_dir)
    status = F.when(F.col("k") % 4 == 0, F.lit("")).otherwise(((F.col("k") % 5 + 1) * 100).cast("string"))
    return e.select("event_id", F.concat(
        F.col("t"), F.lit(","), F.col("lvl"), F.lit(',"'), msg(), F.lit('",'), status, F.lit(","),
        (F.col("k") * 100).cast("string"), F.lit(","), F.col("value").cast("string")).alias("line"))


def fx6(spark, sf_dir) -> DataFrame:
    """Free-text worker lines."""
    e = ev(spark, sf_dir)
    et, k = F.col("event_type"), F.col("k")
    return e.select("event_id", F.concat(
        F.lit("worker "), F.col("user_id").cast("string"),
        F.when(et == "error", F.lit(" FATAL crash")).when(et == "purchase", F.lit(" warn backlog"))
        .otherwise(F.lit(" done")),
        F.when(k % 2 == 0, F.concat(F.lit(" status "), ((k % 5 + 1) * 100).cast("string"))).otherwise(F.lit("")),
        F.lit(" took "), k.cast("string"),
        F.when(k % 3 == 0, F.lit(" sec")).otherwise(F.lit("ms"))).alias("line"))


def fx7(spark, sf_dir) -> DataFrame:
    """All documents as a text corpus (doc_id, text)."""
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def fx8(spark, sf_dir) -> DataFrame:
    """Login lines of an authentication service; failures name the address, and every other one the user too."""
    e = ev(spark, sf_dir)
    ip = F.concat(F.lit("198.51."), (F.col("user_id") % 3).cast("string"), F.lit("."), (F.col("user_id") % 40).cast("string"))
    message = (F.when(F.col("event_type").isin("error", "click"),
                      F.concat(F.lit("Failed login from "), ip,
                               F.when(F.col("k") % 2 == 0, F.concat(F.lit(" user "), F.col("user_id").cast("string")))
                               .otherwise(F.lit(""))))
               .when(F.col("event_type") == "purchase", F.concat(F.lit("Connection refused for "), ip))
               .otherwise(F.concat(F.lit("Accepted login from "), ip)))
    return e.select("event_id", F.concat("t", F.lit(" ["), "lvl", F.lit("] auth: "), message).alias("line"))


def fx9(spark, sf_dir) -> DataFrame:
    """CSV columns whose messages hold a line end, quotes and a comma (event_id, then the columns of CSV_HEADER)."""
    e = ev(spark, sf_dir)
    detail = F.concat(msg(), F.lit('\ndetail "'), F.col("k").cast("string"), F.lit('", end'))
    status = F.when(F.col("k") % 4 != 0, ((F.col("k") % 5 + 1) * 100).cast("string"))
    cells = [F.col("t"), F.col("lvl"), detail, status, (F.col("k") * 100).cast("string"), F.col("value").cast("string")]
    return e.select("event_id", *[c.alias(n) for c, n in zip(cells, CSV_HEADER.split(","))])


# --- writers -------------------------------------------------------------------

def _files_per_write(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def write_lines(spark, lines: DataFrame, order_col: str, name: str, *, parts: int | None = None) -> str:
    """Write ``line`` ordered by ``order_col`` as text files; file names follow key ranges."""
    path = scratch_path(spark, name)
    n = parts or _files_per_write(lines)
    (lines.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
     .select("line").write.text(path))
    return path


def write_csv_lines(spark, lines: DataFrame, order_col: str, name: str, header: str = CSV_HEADER,
                    *, parts: int | None = None) -> str:
    """Write pre-formatted CSV lines with ``header`` as the first line of every file.

    Spark's CSV writer emits the column name as a header in each part file.
    The single column is written with a delimiter that never occurs in the
    text and without quote escaping, so each line is written exactly as given.
    """
    path = scratch_path(spark, name)
    n = parts or _files_per_write(lines)
    (lines.repartitionByRange(n, order_col).sortWithinPartitions(order_col)
     .select(F.col("line").alias(header))
     .write.option("header", True).option("sep", "\u0001").option("quoteAll", False)
     .option("escapeQuotes", False).csv(path))
    return path


def write_csv(spark, df: DataFrame, order_col: str, name: str) -> str:
    """Write all columns but ``order_col`` as CSV files with headers; cells are quoted where they must be."""
    path = scratch_path(spark, name)
    (df.repartitionByRange(_files_per_write(df), order_col).sortWithinPartitions(order_col).drop(order_col)
     .write.option("header", True).option("escape", '"').csv(path))
    return path
