"""The end-to-end pipeline (C1): ingest -> features -> fit -> score -> label -> evaluate."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import Detector, DetectorModel
from ..operators.evaluate import evaluate
from ..sources.ingest import ingest
from ..stages import Stages, files_fingerprint


@dataclass
class Result:
    table: DataFrame          # unified log table + anomaly_score + is_anomaly
    model: DetectorModel
    raw: DataFrame            # the kept raw scores, for another flag rate
    logs: DataFrame           # the unified log table
    stages: Stages            # the kept stages, for other parameters
    source: str

    @property
    def metrics(self) -> DataFrame:
        """One row (A8-A10), computed when asked for."""
        return evaluate(self.table)

    def rethreshold(self, fpr_target: float) -> "Result":
        """Labels for another flag rate, without refitting."""
        model = self.model.rethreshold(self.raw, fpr_target)
        return replace(self, table=model.label(self.raw), model=model)

    def refit(self, **params) -> "Result":
        """Other parameters; only the stages that depend on them are run again (the SVM's, for ``contamination``)."""
        return detect(self.logs, stages=self.stages, source=self.source, **(vars(self.model.params) | params))

    @property
    def threshold(self) -> float:
        return self.model.threshold


def detect(logs: DataFrame, fpr_target: float = 0.05, contamination: float = 0.05, seed: int = 42, *,
           stages: Stages | None = None, source: str | None = None, **params) -> Result:
    """Fit the ensemble on a log table and label every line."""
    stages, source = stages or Stages(logs.sparkSession), source or uuid.uuid4().hex
    model, raw = Detector(fpr_target=fpr_target, contamination=contamination, seed=seed, **params).fit_score(logs, stages, source)
    return Result(model.label(raw), model, raw, logs, stages, source)


def run(spark: SparkSession, paths, fpr_target: float = 0.05, contamination: float = 0.05,
        format: str = "auto", store: str | None = None, **params) -> Result:
    """Read log files of any supported shape and run the whole pipeline.

    ``store``: a shared folder where the stages are kept for later runs over the same files.
    """
    stages = Stages(spark, store)
    if store is None:
        return detect(ingest(spark, paths, format), fpr_target, contamination, stages=stages, **params)
    source = f"{format}:{files_fingerprint(spark, paths)}"
    logs = stages.table("lines", [source], lambda: ingest(spark, paths, format))
    return detect(logs, fpr_target, contamination, stages=stages, source=source, **params)
