"""Streaming transformations. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import money
from ..operators.anomaly.stats import ColumnStats, detect_by_zscore
from ..operators.anomaly.stats import Z_THRESHOLD
from ..schema import SALES_SCHEMA
from ..sources import star


def read_sales(spark: SparkSession, landing: str, files_per_trigger: int | None = None, schema=SALES_SCHEMA) -> DataFrame:
    """Sales files as they arrive in a landing folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(landing)


def read_event_sales(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The event table as a stream, joined to the customer table it needs; like the batch view, known customers only."""
    schema = star.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return star.shape_events(star.of_known_customers(events, spark, sf_dir, columns), star.event_customers(spark, sf_dir), columns)


def windowed_kpis(sales: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "1 hour",
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Count and revenue per event-time window; a window is final once the watermark passes it."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    out = (sales.withWatermark("timestamp", delay).groupBy(w.alias("w"), *keys)
           .agg(F.count(F.lit(1)).alias("transaction_count"), money("total_amount").alias("total_revenue")))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                      "transaction_count", "total_revenue")


def sessions(sales: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per customer."""
    out = (sales.withWatermark("timestamp", delay).groupBy(F.session_window("timestamp", gap).alias("w"), "customer_id")
           .agg(F.count(F.lit(1)).alias("transaction_count"), money("total_amount").alias("total_revenue")))
    return out.select("customer_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                      "transaction_count", "total_revenue")


def deduplicate(sales: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each transaction id once, with state kept only as long as the watermark needs it."""
    return sales.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def score(sales: DataFrame, stats: ColumnStats, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Standard score, flag and severity of every arrival. Stateless."""
    return detect_by_zscore(sales, stats, threshold)
