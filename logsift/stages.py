"""Results of a run's stages, kept by what they were made from.

A stage's key is a digest of its name and of everything it depends on (the
source's fingerprint and the parameters that reach it).  A result with that key
is read back instead of being made again: within a session always, and between
sessions if ``store`` names a shared folder.  ``made`` lists the stages that were
really run.  A stage counts as written once Spark's writer has committed it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import materialize


class Stages:
    def __init__(self, spark: SparkSession, store: str | None = None):
        self.spark, self.store = spark, store.rstrip("/") if store else None
        self.have: dict[str, object] = {}
        self.made: list[str] = []

    def _key(self, name: str, parts) -> str:
        return f"{name}-{hashlib.sha256(json.dumps([name, parts], sort_keys=True, default=str).encode()).hexdigest()[:20]}"

    def _written(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def table(self, name: str, parts, build: Callable[[], DataFrame]) -> DataFrame:
        """The written table of this stage."""
        key = self._key(name, parts)
        if key not in self.have:
            path = self.store and f"{self.store}/{key}"
            if path and self._written(path):
                self.have[key] = self.spark.read.parquet(path)
                return self.have[key]
            if path:
                build().write.mode("overwrite").parquet(path)
                self.have[key] = self.spark.read.parquet(path)
            else:
                self.have[key] = materialize(build(), name)
            self.made.append(name)
        return self.have[key]

    def value(self, name: str, parts, build: Callable[[], dict]) -> dict:
        """A small result of this stage that JSON can hold."""
        key = self._key(name, parts)
        if key not in self.have:
            path = self.store and f"{self.store}/{key}"
            if path and self._written(path):
                self.have[key] = json.loads(self.spark.read.text(path, wholetext=True).first()[0])
                return self.have[key]
            self.have[key] = json.loads(json.dumps(build()))
            self.made.append(name)
            if path:
                self.spark.createDataFrame([(json.dumps(self.have[key]),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return self.have[key]


def files_fingerprint(spark: SparkSession, paths) -> str:
    """A digest of the names, sizes and times of all files under ``paths``, whose contents aren't read."""
    listed = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    r = listed.select(F.xxhash64("path", "modificationTime", "length").alias("h")).agg(
        F.count("h").alias("n"), F.sum((F.col("h") % 1_000_000_007).cast("decimal(20,0)")).alias("a"), F.bit_xor("h").alias("b")).first()
    return f"{r['n']}:{r['a']}:{r['b']}"
