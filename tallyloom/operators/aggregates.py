"""Grouped aggregates of sales rows.

Money is summed as decimal, so totals do not depend on row order, and turned to double after the
sum. Every group-by reduces inside the map tasks first; the shuffled frame is one row per group
and task, whatever the skew of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers


def money(column: str) -> Column:
    return F.sum(column).cast("double")


def mean_of(column: str) -> Column:
    """Exact decimal sum over count."""
    return numbers.ratio(F.sum(column), F.count(column))


def share(column: str) -> Column:
    """Percent of the total over an already aggregated frame."""
    return numbers.round_scaled(numbers.ratio(F.col(column), F.sum(column).over(Window.partitionBy())) * 100.0)


def daily(df: DataFrame, segment: tuple[str, ...] = ()) -> DataFrame:
    """One row per day with sales (and segment)."""
    day = df.withColumn("date", F.to_date("timestamp"))
    out = day.filter(F.col("date").isNotNull()).groupBy(*segment, "date").agg(
        F.count("transaction_id").alias("transaction_count"),
        money("total_amount").alias("total_revenue"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        mean_of("unit_price").alias("avg_unit_price"),
        F.countDistinct("customer_id").alias("unique_customers"))
    return out.withColumns({
        "avg_order_value": numbers.ratio(F.col("total_revenue"), F.col("transaction_count")),
        "day_of_week": F.weekday("date"),
        "month": F.month("date"),
        "is_weekend": dates.is_weekend(F.col("date")),
    })


def hourly(df: DataFrame) -> DataFrame:
    out = (df.groupBy(F.date_trunc("hour", "timestamp").alias("datetime"))
           .agg(F.count("transaction_id").alias("transaction_count"),
                money("total_amount").alias("total_revenue"),
                F.sum("quantity").cast("bigint").alias("total_quantity"))
           .filter(F.col("datetime").isNotNull()))
    return out.withColumns({"hour": F.hour("datetime"), "day_of_week": F.weekday("datetime"),
                            "is_weekend": dates.is_weekend(F.col("datetime"))})


def weekly(df: DataFrame) -> DataFrame:
    """Weeks start on Monday."""
    return (df.groupBy(dates.week_start(F.col("timestamp")).alias("date"))
            .agg(money("total_amount").alias("total_revenue"),
                 F.count("transaction_id").alias("transaction_count"))
            .filter(F.col("date").isNotNull()))


def by_category(df: DataFrame, ordered: bool = True) -> DataFrame:
    out = (df.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("transaction_id").alias("transaction_count"),
        money("total_amount").alias("total_revenue"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        mean_of("unit_price").alias("avg_price"),
        F.countDistinct("customer_id").alias("unique_customers"))
        .withColumn("revenue_percentage", share("total_revenue")))
    return out.orderBy(F.desc("total_revenue"), "category") if ordered else out


def by_region(df: DataFrame, ordered: bool = True) -> DataFrame:
    out = (df.filter(F.col("region").isNotNull()).groupBy("region").agg(
        F.count("transaction_id").alias("transaction_count"),
        money("total_amount").alias("total_revenue"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        F.countDistinct("customer_id").alias("unique_customers"))
        .withColumn("revenue_percentage", share("total_revenue"))
        .withColumn("avg_order_value", numbers.round_scaled(
            numbers.ratio(F.col("total_revenue"), F.col("transaction_count")))))
    return out.orderBy(F.desc("total_revenue"), "region") if ordered else out


def revenue_by(df: DataFrame, key: Column | str, name: str) -> DataFrame:
    """Revenue and count per key, nothing else."""
    key = F.col(key) if isinstance(key, str) else key
    return (df.groupBy(key.alias(name))
            .agg(money("total_amount").alias("total_revenue"),
                 F.count("transaction_id").alias("transaction_count"))
            .filter(F.col(name).isNotNull()))


AGGREGATES = {
    "sum": lambda c: F.sum(c).cast("double"),
    "mean": mean_of,
    "count": lambda c: F.count(c),
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
}

_STEPS = {"H": ("hour", "INTERVAL 1 HOUR"), "D": ("day", "INTERVAL 1 DAY"),
          "W": ("week", "INTERVAL 7 DAYS"), "M": ("month", "INTERVAL 1 MONTH")}


def resample(df: DataFrame, value: str, period: str = "D", func: str = "sum",
             date_column: str = "timestamp") -> DataFrame:
    """One row per calendar period, empty periods included.

    Weeks are labelled by their Sunday and months by their last day. Empty periods hold 0 for sum
    and count, null otherwise; an unknown ``func`` means sum. Each aggregated period also emits the
    empty ones up to the next, so the rows are read once and the window sees one row per period.
    """
    func = func if func in AGGREGATES else "sum"
    unit, step = _STEPS[period]
    grouped = (df.filter(F.col(date_column).isNotNull())
               .groupBy(F.date_trunc(unit, date_column).alias("start"))
               .agg(AGGREGATES[func](value).alias("aggregate")))
    following = F.lead("start").over(Window.partitionBy().orderBy("start")) - F.expr(step)
    out = grouped.withColumn("last", F.coalesce(following, F.col("start"))).select(
        "aggregate", F.posexplode(F.sequence("start", "last", F.expr(step))).alias("gap", "period"))
    out = out.withColumn(value, F.when(F.col("gap") == 0, F.col("aggregate")))
    if func in ("sum", "count"):
        out = out.fillna(0, subset=[value])
    label = {"W": F.date_add(F.to_date("period"), 6), "M": F.last_day("period"),
             "D": F.to_date("period"), "H": F.col("period")}[period]
    return out.select(label.alias(date_column), value)


def group_top(df: DataFrame, key: str, value: str, func: str = "sum", top_n: int | None = None) -> DataFrame:
    """Any aggregate per key, largest first, optionally the first ``top_n``."""
    out = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(AGGREGATES[func](value).alias(value))
           .orderBy(F.desc(value), key))
    return out.limit(top_n) if top_n else out


def dataset_summary(df: DataFrame) -> DataFrame:
    flags = F.sum(F.col("is_anomaly").cast("int")) if "is_anomaly" in df.columns else F.lit(0)
    return df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        numbers.round_currency(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_revenue"),
        numbers.round_currency(mean_of("total_amount")).alias("avg_order_value"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.countDistinct("category").alias("categories"),
        F.countDistinct("product_id").alias("products"),
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct("region").alias("regions"),
        F.coalesce(flags, F.lit(0)).cast("bigint").alias("anomaly_count"))


def seasonal_index(df: DataFrame, part: str) -> DataFrame:
    """Mean amount per hour or weekday, relative to the mean of those means."""
    key = F.hour("timestamp") if part == "hour" else F.weekday("timestamp")
    means = df.filter(F.col("timestamp").isNotNull()).groupBy(key.alias(part)).agg(mean_of("total_amount").alias("mean_amount"))
    return means.withColumn("seasonal_index", numbers.ratio(
        F.col("mean_amount"), F.avg("mean_amount").over(Window.partitionBy())))


def row_share(df: DataFrame, key: str) -> DataFrame:
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("transaction_count"))
    return counts.withColumn("share", numbers.ratio(
        F.col("transaction_count"), F.sum("transaction_count").over(Window.partitionBy())))


def order_value_stats(df: DataFrame) -> DataFrame:
    return df.agg(mean_of("total_amount").alias("avg_order_value"),
                  F.stddev_samp(F.col("total_amount").cast("double")).alias("std_order_value"))


def hour_histogram(df: DataFrame) -> DataFrame:
    """Row counts for all 24 hours, zero where no row falls."""
    counts = df.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return (hours.join(counts, "hour", "left")
            .select("hour", F.coalesce("n", F.lit(0)).cast("bigint").alias("transaction_count")))


def weekend_weekday(df: DataFrame) -> DataFrame:
    """Revenue per distinct active day, weekends against weekdays.

    Rows collapse to days first, so the distinct count runs over a calendar-sized frame.
    """
    days = df.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("rows"))
    return (days.filter(F.col("date").isNotNull()).groupBy(dates.is_weekend(F.col("date")).alias("is_weekend"))
            .agg(F.sum("revenue").cast("double").alias("revenue"),
                 F.sum("rows").cast("bigint").alias("transaction_count"),
                 F.count("date").alias("active_days"))
            .withColumn("revenue_per_day", numbers.ratio(
                F.col("revenue"), F.greatest(F.lit(1), F.col("active_days")))))


def best_worst_day(df: DataFrame) -> DataFrame:
    """Days of highest and lowest revenue; the earlier day wins a tie."""
    days = df.groupBy(F.to_date("timestamp").alias("date")).agg(money("total_amount").alias("revenue"))
    best = F.max(F.struct("revenue", (-F.unix_date("date")).alias("age"), "date"))
    worst = F.min(F.struct("revenue", "date"))
    out = days.filter(F.col("date").isNotNull()).agg(
        best.alias("best"), worst.alias("worst"), F.count(F.lit(1)).alias("active_days"))
    return out.select(F.col("best.date").alias("best_day"), F.col("best.revenue").alias("best_revenue"),
                      F.col("worst.date").alias("worst_day"), F.col("worst.revenue").alias("worst_revenue"),
                      "active_days")


def daily_average(df: DataFrame) -> DataFrame:
    """Mean of the daily revenue totals."""
    days = df.groupBy(F.to_date("timestamp").alias("date")).agg(F.sum("total_amount").alias("revenue"))
    return days.filter(F.col("date").isNotNull()).agg(mean_of("revenue").alias("daily_average"))
