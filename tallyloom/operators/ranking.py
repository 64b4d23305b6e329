"""Top-k, paging and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, labels
from . import aggregates, series


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """``limit`` rows, newest first, after ``offset`` rows. For deep pages use ``page_after``."""
    ordered = df.orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    return ordered.offset(offset).limit(limit)


def page_after(df: DataFrame, timestamp, transaction_id: str, limit: int = 100) -> DataFrame:
    """The page that follows a known row: the filter is pushed down and no rows are skipped."""
    ts = dates.timestamp_literal(timestamp)
    older = (F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("transaction_id") < transaction_id))
    return page(df.filter((F.col("timestamp") <= ts) & older), limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def trend(df: DataFrame, period: str = "daily", last_n: int = 30) -> DataFrame:
    """The newest ``last_n`` periods, oldest first."""
    frame = {"hourly": aggregates.hourly, "weekly": aggregates.weekly}.get(period, series.daily_features)(df)
    column = "datetime" if period == "hourly" else "date"
    return frame.orderBy(F.desc(column)).limit(last_n).orderBy(column)


def top_by_revenue(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    totals = aggregates.revenue_by(df, key, key)
    ranked = totals.orderBy(F.desc("total_revenue"), key).limit(n)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("total_revenue"), key)))


def scatter_index(latest_rows: DataFrame) -> DataFrame:
    """Position of each row in a page of newest rows, for a scatter of normal against flagged."""
    w = Window.partitionBy().orderBy(F.desc("timestamp"), F.desc("transaction_id"))
    flag = F.col("is_anomaly").cast("int") if "is_anomaly" in latest_rows.columns else F.lit(0)
    return latest_rows.select(
        "transaction_id", (F.row_number().over(w) - 1).alias("x"),
        F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("y"),
        F.when(flag == 1, "flagged").otherwise("normal").alias("series"))


def transactions_table(latest_rows: DataFrame, rows: int = 20) -> DataFrame:
    """Display cells of the newest transactions."""
    top = page(latest_rows, rows)
    flag = F.col("is_anomaly").cast("int") if "is_anomaly" in top.columns else F.lit(0)
    return top.select(
        "transaction_id", dates.clock_time(F.col("timestamp")).alias("time"),
        labels.short_id(F.col("transaction_id")).alias("short_id"),
        F.coalesce("product_name", F.lit("-")).alias("product"),
        F.coalesce("category", F.lit("-")).alias("category"), F.coalesce("region", F.lit("-")).alias("region"),
        F.coalesce("quantity", F.lit(0)).alias("quantity"),
        F.concat(F.lit("$"), F.translate(F.format_number(F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)), 2), ",", "")).alias("amount"),
        F.when(flag == 1, "Anomaly").otherwise("Normal").alias("status"))
