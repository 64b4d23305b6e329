"""Key figures as one-row frames."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, numbers
from ..functions.dates import timestamp_literal
from ..sources.unified import latest
from .aggregates import money


def _top_category(df: DataFrame) -> DataFrame:
    """One row: the category of highest revenue, the first in the alphabet on a tie."""
    totals = (df.filter(F.col("category").isNotNull()).groupBy("category").agg(money("total_amount").alias("revenue")))
    best = totals.agg(F.min(F.struct((-F.col("revenue")).alias("order"), "category", "revenue")).alias("top"))
    return best.select(F.col("top.category").alias("top_category"), F.col("top.revenue").alias("top_category_revenue"))


def summary(df: DataFrame, as_of: datetime, days: int = 30, flag=None) -> DataFrame:
    """Current period, change against the period before, top category.

    One filtered scan serves both periods: rows collapse to (period, category) once, and both the
    totals and the top category come from that small frame. Distinct customers need the raw keys
    and are counted beside it. ``flag`` is a column expression marking anomalies.
    """
    cutoff, start = as_of - timedelta(days=days), as_of - timedelta(days=2 * days)
    scoped = df.filter(F.col("timestamp") >= timestamp_literal(start)).withColumn(
        "current", F.col("timestamp") >= timestamp_literal(cutoff))
    marks = F.sum(F.when(F.col("current") & flag, 1).otherwise(0)) if flag is not None else F.sum(F.lit(0))
    cells = scoped.groupBy("current", "category").agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("n"), marks.alias("flagged"))
    now = F.col("current")
    best = F.min(F.when(now & F.col("category").isNotNull(),
                        F.struct((-F.col("revenue")).alias("order"), "category", "revenue")))
    totals = cells.agg(
        F.coalesce(F.sum(F.when(now, F.col("revenue"))), F.lit(0)).cast("double").alias("revenue"),
        F.coalesce(F.sum(F.when(~now, F.col("revenue"))), F.lit(0)).cast("double").alias("previous"),
        F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~now, F.col("n"))), F.lit(0)).alias("previous_n"),
        F.coalesce(F.sum("flagged"), F.lit(0)).cast("bigint").alias("anomaly_count"), best.alias("top"))
    customers = scoped.filter("current").agg(F.countDistinct("customer_id")).scalar()
    change = numbers.change_percentage(F.col("revenue"), F.col("previous"))
    return totals.select(
        numbers.round_scaled(F.col("revenue")).alias("total_revenue"),
        numbers.round_scaled(change).alias("revenue_change"),
        labels.trend_word(change).alias("revenue_trend"),
        F.col("n").alias("transaction_count"),
        numbers.round_scaled(numbers.change_percentage(F.col("n"), F.col("previous_n"))).alias("transaction_change"),
        numbers.round_scaled(numbers.safe_divide(F.col("revenue"), F.col("n"))).alias("avg_order_value"),
        customers.alias("unique_customers"),
        F.col("top.category").alias("top_category"),
        F.col("top.revenue").cast("double").alias("top_category_revenue"),
        "anomaly_count", F.lit(days).alias("period_days"))


def realtime(df: DataFrame, as_of: datetime, minutes: int = 60, sample: int | None = None) -> DataFrame:
    """Rates per minute over all rows of the last ``minutes``, or of the newest ``sample`` of them if given."""
    recent = df.filter(F.col("timestamp") >= timestamp_literal(as_of - timedelta(minutes=minutes)))
    if sample is not None:
        recent = latest(recent, sample)
    out = recent.agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("revenue"),
                     F.count(F.lit(1)).alias("n"),
                     F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    seconds = (F.unix_micros("last") - F.unix_micros("first")) / 1e6
    span = F.greatest(F.lit(1.0), F.coalesce(seconds / 60.0, F.lit(1.0)))
    return out.select(
        numbers.round_scaled(F.col("revenue") / span).alias("revenue_per_minute"),
        numbers.round_scaled(F.col("n") / span).alias("transactions_per_minute"),
        F.col("last").alias("last_transaction"), F.col("n").alias("sample_size"))


def from_two_sets(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The same figures from two explicit row sets, unrounded and safe against nulls."""
    def figures(df: DataFrame, prefix: str) -> DataFrame:
        flags = F.count_if(F.col("is_anomaly").cast("int") == 1) if "is_anomaly" in df.columns else F.sum(F.lit(0))
        return df.agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias(f"{prefix}revenue"),
                      F.count(F.lit(1)).alias(f"{prefix}n"), F.countDistinct(
                          F.when(F.col("customer_id") != "", F.col("customer_id"))).alias(f"{prefix}customers"),
                      F.coalesce(flags, F.lit(0)).cast("bigint").alias(f"{prefix}flagged"))
    top = _top_category(current)
    out = figures(current, "").withColumns({
        "top_category": top.select("top_category").scalar(),
        "top_category_revenue": top.select("top_category_revenue").scalar()})
    if previous is None:
        out = out.withColumns({"prev_revenue": F.lit(0.0), "prev_n": F.lit(0).cast("bigint")})
    else:
        before = previous.agg(F.struct(
            F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("revenue"),
            F.count(F.lit(1)).alias("n")).alias("before")).scalar()
        out = out.withColumn("before", before).withColumns({
            "prev_revenue": F.col("before.revenue"), "prev_n": F.col("before.n")})
    some = F.col("n") > 0
    change = F.when(some, numbers.change_percentage(F.col("revenue"), F.col("prev_revenue"))).otherwise(0.0)
    count_change = F.when(some, numbers.change_percentage(F.col("n"), F.col("prev_n"))).otherwise(0.0)
    positive = F.col("top_category_revenue") > 0
    return out.select(
        F.col("revenue").alias("total_revenue"), change.alias("revenue_change"),
        labels.trend_word(change).alias("revenue_trend"), F.col("n").alias("transaction_count"),
        count_change.alias("transaction_change"),
        numbers.safe_divide(F.col("revenue"), F.col("n")).alias("avg_order_value"),
        F.col("customers").alias("unique_customers"),
        F.when(positive, F.col("top_category")).alias("top_category"),
        F.when(positive, F.col("top_category_revenue")).alias("top_category_revenue"),
        F.col("flagged").alias("anomaly_count"))
