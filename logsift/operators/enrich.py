"""Per-text enrichment with a caller-supplied function.

The reference sends each selected anomaly's text to an external explainer and
caches answers by text.  Here the function is any ``str -> str`` callable that
runs on the executors: texts are trimmed and made distinct first (one call per distinct text), the function runs in Arrow
batches via ``mapInPandas``, and the answers are joined back.  A blank text
gets a fixed answer and a failing call returns its error text, the row kept.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..session import materialize, ship_package
from .reports import top_n


def _apply(fn: Callable[[str], str], max_chars: int | None):
    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["_key"]:
                if text is None or not str(text).strip():
                    out.append(P.BLANK_EXPLANATION)
                    continue
                try:
                    out.append(str(fn(text if max_chars is None else text[:max_chars])))
                except Exception as exc:  # noqa: BLE001 - the row is kept with the error text
                    out.append(f"Error: {exc}")
            yield pd.DataFrame({"_key": pdf["_key"], "explanation": out})
    return run


def kept_answers(df: DataFrame, fn: Callable[[str], str], store: str, max_age_s: float | None, max_chars: int | None) -> DataFrame:
    """(_key, explanation) of the texts ``_key``: those that ``store`` has and are no older than ``max_age_s``, and new ones,
    which are appended to it.  A failed call's error isn't kept."""
    spark = df.sparkSession
    schema = "_key string, explanation string, answered timestamp"
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(store)      # so that there is a folder to read
    known = spark.read.schema(schema).parquet(store)
    if max_age_s is not None:
        known = known.where(F.col("answered") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(max_age_s))))
    known = known.groupBy("_key").agg(F.max_by("explanation", "answered").alias("explanation"))
    keys = materialize(df.select("_key").where("_key is not null").distinct().join(known, "_key", "left"), "answers")
    new = materialize(keys.where("explanation is null").select("_key").mapInPandas(_apply(fn, max_chars), "_key string, explanation string"),
                      "new-answers")
    (new.where(~F.col("explanation").startswith("Error: ")).withColumn("answered", F.current_timestamp())
     .write.mode("append").parquet(store))
    return keys.where("explanation is not null").unionByName(new)


def enrich_distinct(df: DataFrame, col: str, fn: Callable[[str], str], out: str = "explanation",
                    max_chars: int | None = None, store: str | None = None, max_age_s: float | None = None) -> DataFrame:
    """Adds ``out`` = fn(trimmed text), one call per distinct whole text; ``max_chars`` cuts only what ``fn`` sees.

    ``store``: a shared folder that keeps answers for later runs, which call ``fn`` for new texts only.
    Blank texts get their answer without a join; a text that many rows share is a skewed join key, which
    adaptive execution splits on the side of the rows (an answer is one row).
    """
    ship_package(df.sparkSession)
    keyed = df.withColumn("_key", F.nullif(S.strip_unicode(F.coalesce(F.col(col), F.lit(""))), F.lit("")))
    if store is not None:
        answers = kept_answers(keyed, fn, store, max_age_s, max_chars)
    else:
        answers = (keyed.select("_key").where("_key is not null").distinct()
                   .mapInPandas(_apply(fn, max_chars), "_key string, explanation string"))
    return (keyed.join(answers, "_key", "left")
            .withColumn(out, F.when(F.col("_key").isNull(), F.lit(P.BLANK_EXPLANATION)).otherwise(F.col("explanation")))
            .drop("_key", *(["explanation"] if out != "explanation" else [])))


def explain_top(scored: DataFrame, fn: Callable[[str], str], n: int = P.EXPLAIN_DEFAULT,
                text_col: str = "raw_line") -> DataFrame:
    """Top-N anomalies with line, score, an 80-character preview and the explanation."""
    t = top_n(scored, n)
    col = text_col if text_col in t.columns else "message"
    e = enrich_distinct(t, col, fn)
    return e.select("line_no", "anomaly_score",
                    F.substring(F.coalesce(F.col(col), F.lit("")), 1, P.PREVIEW_CHARS).alias("preview"),
                    "explanation")


def summarize_text(text: str) -> str:
    """A deterministic stand-in explainer used by tests and the query catalog."""
    return f"{text[:30].upper()} ({len(text)} chars)"
