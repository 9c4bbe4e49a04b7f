"""Unified ingest (S7, S10): files of any supported shape -> one numbered log table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsers import UNIFIED, bad_csv_lines, bad_json_lines, parse_csv_rows, parse_json_lines, parse_raw, read_csv_rows
from .sniff import sniff
from .text import MID, nonblank_lines, number_rows, read_lines

LOG_COLUMNS = ["line_no"] + UNIFIED
FORMATS = ("auto", "raw", "json", "csv")


class EmptyLogError(ValueError):
    pass


def list_files(spark: SparkSession, paths) -> list[str]:
    if isinstance(paths, str):
        paths = [paths]
    return sorted(spark.read.text(list(paths)).inputFiles())


def grouped_files(spark: SparkSession, paths, format: str) -> tuple[dict[str, list[str]], DataFrame | None]:
    """The files of each format, and the layouts of the CSV files' headers, which stay a table."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    grouped: dict[str, list[str]] = {"raw": [], "json": [], "csv": []}
    if format in ("raw", "json"):
        grouped[format] = list_files(spark, paths)
        return grouped, None
    heads = sniff(spark, paths)
    for r in heads.select("path", F.lit("csv").alias("format") if format == "csv" else F.col("format")).orderBy("path").collect():
        grouped[r["format"]].append(r["path"])
    return grouped, heads


def parsed_frames(spark: SparkSession, paths, format: str = "auto", *, csv_multiline: bool = False) -> list[DataFrame]:
    """One parsed (unnumbered) frame per format, all in scan order or with their rows' order."""
    grouped, heads = grouped_files(spark, paths, format)
    frames = []
    if grouped["raw"]:
        frames.append(parse_raw(nonblank_lines(read_lines(spark, grouped["raw"]))))
    if grouped["json"]:
        frames.append(parse_json_lines(nonblank_lines(read_lines(spark, grouped["json"]))))
    if grouped["csv"]:
        frames.append(parse_csv_rows(read_csv_rows(spark, grouped["csv"], heads, multiline=csv_multiline)))
    return [f if MID in f.columns else f.withColumn(MID, F.monotonically_increasing_id()) for f in frames]


def ingest(spark: SparkSession, paths, format: str = "auto", *, allow_empty: bool = False,
           csv_multiline: bool = False) -> DataFrame:
    """Read, sniff, parse and number log lines.

    Returns ``line_no, raw_line, timestamp, message, level, http_status,
    response_size, response_time, client_ip, component``.  Raises
    ``EmptyLogError`` when nothing parses, unless ``allow_empty``.
    ``csv_multiline=True`` reads quoted line ends inside cells, in splits like all else.
    Lines that don't parse are in ``quarantine``.
    """
    frames = parsed_frames(spark, paths, format, csv_multiline=csv_multiline)
    if frames:
        numbered, total = number_rows(reduce(lambda a, b: a.unionByName(b), frames))
        if total:
            return numbered.select(*LOG_COLUMNS)
    if not allow_empty:
        raise EmptyLogError("the input holds no line that can be parsed")
    return spark.createDataFrame([], log_schema_ddl())


def quarantine(spark: SparkSession, paths, format: str = "auto", *, csv_multiline: bool = False) -> DataFrame:
    """(path, line, reason) of what ``ingest`` leaves out: malformed NDJSON lines and CSV rows with surplus cells."""
    grouped, heads = grouped_files(spark, paths, format)
    frames = [spark.createDataFrame([], "path string, line string, reason string")]
    if grouped["json"]:
        frames.append(bad_json_lines(nonblank_lines(read_lines(spark, grouped["json"]))))
    if grouped["csv"]:
        frames.append(bad_csv_lines(read_csv_rows(spark, grouped["csv"], heads, multiline=csv_multiline, fitting=False)))
    return reduce(lambda a, b: a.unionByName(b), frames)


def log_schema_ddl() -> str:
    return ("line_no long, raw_line string, timestamp string, message string, level string, "
            "http_status int, response_size double, response_time double, client_ip string, "
            "component string")
