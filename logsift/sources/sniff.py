"""Format dispatch per file.

Order, per file: a JSON extension or a JSON-looking head -> NDJSON; else a CSV
extension or a CSV-looking first line -> CSV; else raw text.

* JSON look (S8): of the first 20 non-blank stripped lines, at least half start
  with ``{`` (denominator ``min(non-blank lines, 20)``; no line -> not JSON).
* CSV look (S9): the first physical line holds at least two commas.

Only heads are read, and executors read them: large files by a scan with one partition a
file, whose task stops after the file's first 20 non-blank lines; small files, up to
``SMALL_FILE`` bytes, whole and some 32 to a partition.  What comes back is a table
with a row a file; a CSV file's row also says where its header has which column.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .parsers import LAYOUT, LAYOUT_SCHEMA, csv_header, header_layout

JSON_EXT = ("json", "jsonl", "ndjson")
CSV_EXT = ("csv",)
HEAD_NONBLANK = 20
SMALL_FILE, PACKED = 1 << 18, 1 << 24
LINE_CHARS = 1 << 16        # of each head line; longer lines keep their start, which is all that is looked at


def extension(path: str) -> str:
    name = os.path.basename(path.rstrip("/"))
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def dispatch(file: str, first_line: str, head: list[str]) -> str:
    """'json', 'csv' or 'raw' from a file's name and head."""
    ext = extension(file)
    if ext in JSON_EXT or head and sum(x.startswith("{") for x in head) / len(head) >= 0.5:
        return "json"
    if ext in CSV_EXT or first_line.count(",") >= 2:
        return "csv"
    return "raw"


def _row(path: str, first: str, head: list[str]):
    row = {"path": path, "format": dispatch(path, first, head), "first_line": first} | header_layout(csv_header(first))
    return pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.string()) for c in ("path", "format", "first_line")]
                                                       + [(c, pa.int32()) for c in LAYOUT]))


def _heads(alone: bool):
    """Files' lines (path, value) to their rows; if a task has one file ``alone``, what follows its head is left unread."""
    def run(batches):
        path, first, head = None, "", []
        for batch in batches:
            paths = batch.column(0).dictionary_encode()
            edges = np.flatnonzero(np.diff(paths.indices.to_numpy(), prepend=-1))
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                here = batch.column(0)[int(a)].as_py()
                if here != path:
                    if path is not None:
                        yield _row(path, first, head)
                    path, first, head = here, batch.column(1)[int(a)].as_py().decode("utf-8", "replace"), []
                for i in range(int(a), int(b)):
                    if len(head) == HEAD_NONBLANK:
                        break
                    line = batch.column(1)[i].as_py().decode("utf-8", "replace").strip()
                    if line:
                        head.append(line)
            if alone and len(head) == HEAD_NONBLANK:
                break
        if path is not None:
            yield _row(path, first, head)
    return run


def sniff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, format, first_line, cells and the place of each role's column) of every file under ``paths`` that isn't empty;
    format in {'json', 'csv', 'raw'}."""
    ship_package(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    sizes = spark.read.format("binaryFile").load(paths).select("_metadata.file_path", "_metadata.file_size").collect()
    path = scratch_path(spark, "heads")
    schema = f"path string, format string, first_line string, {LAYOUT_SCHEMA}"
    # settings that hold for these scans only: no file is split, and a large one has a partition of its own
    reading = spark.newSession()
    large = [r[0] for r in sizes if r[1] > SMALL_FILE]
    small = [r[0] for r in sizes if r[1] <= SMALL_FILE] if large else paths * bool(sizes)
    for some, alone in ((small, False), (large, True)):
        for key, value in {"spark.sql.files.maxPartitionBytes": 1 << 50 if alone else PACKED, "spark.sql.files.minPartitionNum": 1,
                           "spark.sql.files.openCostInBytes": 1 << 50 if alone else PACKED >> 5,
                           "spark.sql.execution.arrow.maxRecordsPerBatch": 64 if alone else 10_000}.items():
            reading.conf.set(key, str(value))
        if some:
            lines = reading.read.text(some).select(F.col("_metadata.file_path").alias("path"),
                                                   F.left("value", F.lit(LINE_CHARS)).cast("binary").alias("value"))
            lines.mapInArrow(_heads(alone), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if sizes else spark.createDataFrame([], schema)
