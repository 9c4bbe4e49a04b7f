"""Exact duplicates by skew-safe combining, all in DataFrame expressions (operator 11).

Texts are equal when they are identical after each run of blanks
(``[\\x20\\x09-\\x0D]+``) has become one space.  Groups are combined in three
stages, each of which groups by the digest *and* the whole text, so two texts
that share a digest never become one group:

1. local: the map side of the first aggregation leaves one row per task and text,
2. salted: a group meets in ``SALTS`` parts, dealt by the number of the task, so
   a text that a third of all rows hold is spread like any other,
3. global: the at most ``SALTS`` winners of each group are combined.

The result goes back to the rows by the digest alone, as texts would only add
to the shuffle.  That is exact where a digest has one text, which the third
stage has counted.  Rows of digests with several texts (none, with SHA-256) go
back by their texts instead.  Joins with a hot digest are sort-merge joins on
small rows, which adaptive execution splits.

Of equal texts the row with the smallest id stays.  Defined results: a null text
counts as empty; a null id comes after all others, so such a row stays only in
a group without other ids (keep_id is null then); of repeated rows with the
smallest id exactly one stays; further columns are ignored, and an empty table
gives none.  Texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SALTS = 64
BLANKS = r"[\x20\x09-\x0D]++"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _combined(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, keep_id, group_size and keep_row (if there is a column row) of each group of ``rows`` (keys, id)."""
    number = "row" in rows.columns
    first = [F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    then = [F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    if number:
        first += [F.min_by("row", "id").alias("by_id"), F.min("row").alias("any")]
        then += [F.coalesce(F.min_by("by_id", "keep_id"), F.min("any")).alias("keep_row")]
    salted = (rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
              .groupBy(*keys, "salt").agg(*first))
    # by the digest alone, so that what is counted by digest afterwards needs no other shuffle
    return salted.repartition(keys[0]).groupBy(*keys).agg(*then)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row of ``df``: id, keep_id, group_size, kept, digest (of the normalised text)."""
    source = df.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("t"))
    source = source.select("id", "t", digest(F.col("t")).alias("digest"))
    rows = materialize(source.select(F.monotonically_increasing_id().alias("row"), "id", "digest"), "digests")
    groups = materialize(_combined(source, "digest", "t").groupBy("digest").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")), "groups")
    # which one of repeated rows with the smallest id stays
    first = _combined(rows, "digest").select("digest", "keep_row")
    winners = groups.where("texts = 1").join(first, "digest").select("digest", "keep_id", "group_size", "keep_row")
    out = _result(rows.join(winners, "digest"), id_col)
    clashing = groups.where("texts > 1").select("digest")
    if clashing.isEmpty():
        return out
    rest = materialize(source.withColumn("row", F.monotonically_increasing_id()).join(clashing, "digest", "left_semi"), "clashing")
    return out.unionAll(_result(rest.join(_combined(rest.select("digest", "t", "id", "row"), "digest", "t"), ["digest", "t"]), id_col))


def _result(joined: DataFrame, id_col: str) -> DataFrame:
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    whole = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"),
                                  F.monotonically_increasing_id().alias("row")), "numbered")
    texts = whole.select("row", F.col(f"r.`{id_col}`").alias("id"), normalised(F.col(f"r.`{text_col}`")).alias("t"))
    texts = texts.select("row", "id", "t", sha256(F.col("t")).alias("digest"))
    stay = _combined(texts, "digest", "t").select(F.col("keep_row").alias("row"))
    return whole.join(stay, "row", "left_semi").select("r.*")
