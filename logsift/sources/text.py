"""Line source (S1, S6, P1) and dense line numbering.

Lines are read with ``spark.read.text``: one row per physical line, split on
``\\n``/``\\r``/``\\r\\n`` by Spark.  Python's ``str.splitlines`` also splits on a
few rarer separators, so a line that contains one is exploded further.

Dense 1-based numbering in file order, without a global sort and without a
shuffle of the data:

* every row carries ``_path`` and ``_block`` (file and split start) from the
  hidden ``_metadata`` column, and ``monotonically_increasing_id()`` taken right
  after the last row filter: inside one split the ids are consecutive;
* the rows are parsed once and written with these; everything later reads that
  table, so no second planning of splits can disagree with the first;
* the splits, one row each, are range-partitioned in ``(path, start)`` order and
  summed up in two levels; their shift of ids to numbers is joined back by a
  64-bit key and sent to the rows as long as it has at most ``SENT_SPLITS`` rows
  (16 bytes each), else joined as any table;
* numbered rows are counted against the written ones by the join's own keys: a
  split without a shift raises an error instead of vanishing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..session import materialize

PATH, BLOCK, MID = "_path", "_block", "_mid"
SENT_SPLITS = 4_000_000


def read_lines(spark: SparkSession, paths, *, split_extra_breaks: bool = True) -> DataFrame:
    """(_path, _block, value) for every physical line of every file under ``paths``."""
    if isinstance(paths, str):
        paths = [paths]
    df = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias(PATH),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.col("value"),
    )
    if split_extra_breaks:
        br = P.EXTRA_LINE_BREAKS_RE
        df = df.select(
            PATH, BLOCK,
            F.explode(F.when(F.col("value").rlike(br), F.split("value", br))
                      .otherwise(F.array("value"))).alias("value"),
        )
    return df


def nonblank_lines(lines: DataFrame) -> DataFrame:
    """Strip Unicode whitespace and drop blank lines (column ``line``)."""
    return (lines.select(PATH, BLOCK, S.strip_unicode("value").alias("line"))
            .where(F.col("line") != ""))


def number_rows(df: DataFrame, out: str = "line_no") -> tuple[DataFrame, int]:
    """Dense 1-based number in (file, split, position) order, and the number of rows.

    ``df`` carries ``_path`` and ``_block``, and either ``_mid``, by which a split's rows follow
    each other without gaps, or is still in scan order (no shuffle since the read).
    """
    spark = df.sparkSession
    rows = materialize(df if MID in df.columns else df.withColumn(MID, F.monotonically_increasing_id()), "lines")
    # a task can hold several splits, and only its ids tell where each began
    splits = (rows.groupBy(PATH, BLOCK).agg(F.min(MID).alias("_m0"), F.count(F.lit(1)).alias("_n"))
              .repartitionByRange(PATH, BLOCK).withColumn("_part", F.spark_partition_id()))
    splits = materialize(splits, "splits")
    parts = {r["_part"]: r["_n"] for r in splits.groupBy("_part").agg(F.sum("_n").alias("_n")).collect()}
    before, total = {}, 0
    for p in sorted(parts):
        before[p], total = total, total + parts[p]
    if not total:
        return rows.withColumn(out, F.lit(None).cast("long")).drop(MID), 0
    start = F.create_map(*[F.lit(x) for p in before.items() for x in p])
    order = Window.partitionBy("_part").orderBy(PATH, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    shift = (start[F.col("_part")] + F.coalesce(F.sum("_n").over(order), F.lit(0)) - F.col("_m0") + 1).cast("long")
    key = F.xxhash64(PATH, BLOCK)
    shifts = materialize(splits.select(key.alias("_key"), shift.alias("_shift")), "shifts")
    n = shifts.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_key").alias("d")).first()
    if n["n"] != n["d"]:
        raise RuntimeError("two splits share a key")
    numbered = rows.withColumn("_key", key).join(F.broadcast(shifts) if n["n"] <= SENT_SPLITS else shifts, "_key", "left")
    found = F.coalesce(F.col(MID) + F.col("_shift"), F.raise_error(F.lit("a line's split has no number")).cast("long"))
    return numbered.withColumn(out, found).drop("_shift", "_key", MID), total
