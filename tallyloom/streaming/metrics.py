"""Counters of a stream that outlive its driver: one row for each batch, written by the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import Handler


class Metered:
    """A batch handler that also notes each batch's rows and event times below ``path``.

    The note is written after the handler has succeeded, under the batch's id, so a replay counts once. Sums are over all batches,
    whatever process ran them and however many they are.
    """

    def __init__(self, spark: SparkSession, path: str, handler: Handler):
        self.spark, self.path, self.handler = spark, path, handler

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self.handler(batch, batch_id)
            note = batch.agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.current_timestamp().alias("written"))
            note.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        finally:
            batch.unpersist()

    def batches(self) -> DataFrame:
        """(batch, n_rows, first, last, written)."""
        return self.spark.read.schema("n_rows long, first timestamp, last timestamp, written timestamp, batch long").parquet(self.path)

    def totals(self) -> DataFrame:
        """One row: batches, total rows, first and last event, rows a minute of event time and of running time."""
        seconds = lambda lo, hi: F.greatest(F.lit(1.0), (F.unix_micros(hi) - F.unix_micros(lo)) / 1e6)
        sums = self.batches().agg(F.count("*").alias("batches"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"), F.min("first").alias("first"), F.max("last").alias("last"),
                                  F.min("written").alias("_from"), F.max("written").alias("_to"))
        return sums.select("batches", "total", "first", "last", (F.col("total") / seconds(F.col("first"), F.col("last")) * 60).alias("per_event_minute"),
                           (F.col("total") / seconds(F.col("_from"), F.col("_to")) * 60).alias("per_running_minute"))
