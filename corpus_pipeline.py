"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage works on all that its predecessor kept, and its decisions take
effect; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.llm import decontaminate, near_dedup, pieces, pii, quality
from logsift.session import materialize


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go (score under the threshold)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    weights = quality.fit(docs, labels, ~quality.held_out())
    return quality.scored_rows(docs, weights).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return near_dedup.keep_one(docs).select(*docs.columns)


def decontaminate_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # the row itself is what the search carries, so that its decision meets the row, whatever the doc_id
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return decontaminate.contamination(rows, benchmark, id_col="row").where("not contaminated").select("row.*")


def pii_stage(spark, docs, sf_dir):
    """Personal data is replaced by its kind in brackets; n_chars follows the new text."""
    return pii.redacted(docs).select(*docs.columns)


def encode_stage(spark, docs, sf_dir):
    """Every text becomes piece ids, with their number."""
    return pieces.encoded(docs).withColumn("n_pieces", F.size("ids"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pieces", encode_stage),
]

# the classifier's weights and the piece segmentation can't be stated in SQL: tests/llm holds brute-force versions
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, for ``documents`` under ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
