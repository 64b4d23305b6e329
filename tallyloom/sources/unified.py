"""History and live rows as one table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import keep_last


def unified_scan(live: DataFrame, history: DataFrame | None = None, limit: int | None = None,
                 ordered: bool = True) -> DataFrame:
    """Union by name, the last copy of an id wins (live after history, then newest), oldest first.

    ``limit`` keeps the newest rows; 0 or None keeps all.
    """
    if history is None:
        combined = live
    else:
        tagged = history.withColumn("source_rank", F.lit(0)).unionByName(
            live.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
        combined = keep_last(tagged, "transaction_id", ["source_rank", "timestamp"]).drop("source_rank")
    if limit:
        combined = latest(combined, limit)
    return combined.orderBy("timestamp", "transaction_id") if ordered else combined


def latest(df: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` rows; Spark keeps only ``n`` per task."""
    return df.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(n)


def since(df: DataFrame, start: datetime) -> DataFrame:
    return df.filter(F.col("timestamp") >= F.lit(str(start)).cast("timestamp"))
