"""Scoring arrivals with a fitted detector that may be replaced while the stream runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anomaly.detector import AnomalyDetector
from . import folders


class ModelTable:
    """Versions of a detector below one folder. A version counts once its ready mark is written, after all its tables,
    so readers meet a whole model or the one before it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.loaded: dict[int, AnomalyDetector] = {}

    def versions(self) -> list[int]:
        return folders.numbers(self.spark, f"{self.path}/ready", "version")

    def publish(self, detector: AnomalyDetector) -> int:
        """The number of the new version. What an unfinished publication left behind is written over."""
        n = (self.versions() or [0])[-1] + 1
        folders.remove(self.spark, f"{self.path}/version={n}")
        detector.save(self.spark, f"{self.path}/version={n}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/ready/version={n}")
        return n

    def load(self, version: int) -> AnomalyDetector:
        if version not in self.loaded:
            if version not in self.versions():
                raise LookupError(f"no model version {version} in {self.path}")
            self.loaded = {version: AnomalyDetector.load(self.spark, f"{self.path}/version={version}")}
        return self.loaded[version]

    def current(self) -> int:
        found = self.versions()
        if not found:
            raise LookupError(f"no model has been published in {self.path}")
        return found[-1]

    def keep(self, newest: int) -> None:
        """Remove all but the ``newest`` versions, marks first."""
        for n in self.versions()[:-newest]:
            folders.remove(self.spark, f"{self.path}/ready/version={n}")
            folders.remove(self.spark, f"{self.path}/version={n}")


def scored(stream: DataFrame, detector: AnomalyDetector) -> DataFrame:
    """The stream with scores of one model: stateless methods only, as part of the streaming plan."""
    if detector.algorithm in ("lof", "dbscan"):
        raise ValueError(f"{detector.algorithm} compares rows with others: score its batches with BatchScorer")
    return detector.transform(stream)


class BatchScorer:
    """Scores each micro-batch with the model that is current when the batch is first seen, by any method.

    The version is noted for the batch before rows are scored, so a replayed batch has the same scores whatever has been
    published since. Rows carry ``model_version``. Each batch has a folder of its own, which a replay writes over.
    """

    def __init__(self, spark: SparkSession, models: ModelTable, path: str):
        self.spark, self.models, self.path = spark, models, path

    def version_of(self, batch_id: int) -> int:
        note = f"{self.path}/notes/batch={batch_id}"
        if not folders.complete(self.spark, note):
            self.spark.range(1).select(F.lit(self.models.current()).alias("version")).coalesce(1).write.mode("overwrite").parquet(note)
        return self.spark.read.parquet(note).first()["version"]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        version = self.version_of(batch_id)
        rows = self.models.load(version).transform(batch).withColumn("model_version", F.lit(version))
        rows.write.mode("overwrite").parquet(f"{self.path}/scored/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/scored").drop("batch")
