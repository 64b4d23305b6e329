"""Window features over daily series.

The windows run after aggregation to days, so a partition holds at most one row per calendar day
of its segment: a few thousand rows, at any volume of transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers
from .aggregates import daily

LAGS = (1, 7, 14, 30)
WINDOWS = (7, 14, 30)


def ordered(segment: tuple[str, ...] = (), descending: bool = False):
    order = F.desc("date") if descending else F.asc("date")
    return Window.partitionBy(*segment).orderBy(order)


def lag_features(df: DataFrame, segment=(), lags=LAGS) -> DataFrame:
    w, cols = ordered(segment), {}
    for n in lags:
        cols[f"revenue_lag_{n}"] = F.lag("total_revenue", n).over(w)
        cols[f"transactions_lag_{n}"] = F.lag("transaction_count", n).over(w).cast("double")
    return df.withColumns(cols)


def full_frame(aggregate: Column, column: str, n: int, w) -> Column:
    """A rolling value that is null until the frame holds ``n`` values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, aggregate.over(frame))


def rolling_features(df: DataFrame, segment=(), windows=WINDOWS) -> DataFrame:
    w, cols = ordered(segment), {}
    for n in windows:
        for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            cols[f"revenue_rolling_{name}_{n}d"] = full_frame(fn("total_revenue"), "total_revenue", n, w)
    return df.withColumns(cols)


def growth_features(df: DataFrame, segment=()) -> DataFrame:
    w, now = ordered(segment), F.col("total_revenue")
    return df.withColumns({
        "daily_growth_rate": numbers.percent_change(now, F.lag("total_revenue", 1).over(w)),
        "week_over_week_change": numbers.percent_change(now, F.lag("total_revenue", 7).over(w)),
    })


def back_fill(df: DataFrame, columns: list[str], segment=(), then_zero: bool = True) -> DataFrame:
    """Next known value, then 0. Reading the series backwards keeps the frame growing row by row."""
    w = ordered(segment, descending=True).rowsBetween(Window.unboundedPreceding, 0)
    types = dict(df.dtypes)
    def fill(c: str) -> Column:
        filled = F.last(c, ignorenulls=True).over(w)
        return F.coalesce(filled, F.lit(0).cast(types[c])) if then_zero else filled
    return df.withColumns({c: fill(c) for c in columns})


def forward_fill(df: DataFrame, columns: list[str], segment=()) -> DataFrame:
    """Last known value, and the next one for a leading gap."""
    w = ordered(segment).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    return back_fill(filled, columns, segment, then_zero=False)


def daily_features(df: DataFrame, segment=(), lags=LAGS, windows=WINDOWS, include_lag: bool = True,
                   include_rolling: bool = True, include_growth: bool = True, fill: str = "bfill",
                   mode: str = "compat") -> DataFrame:
    """Daily aggregate with lag, rolling and growth features.

    ``fill`` is 'bfill' (next value, then 0), 'zero' or 'none'. ``mode='causal'`` ends every
    rolling frame on the previous day and drops the same-day measures, so no feature knows its
    own day.
    """
    out = daily(df, segment)
    base = set(out.columns)
    if include_lag:
        out = lag_features(out, segment, lags)
    if include_rolling:
        out = rolling_features(out, segment, windows)
        if mode == "causal":
            w = ordered(segment)
            names = [c for c in out.columns if "_rolling_" in c]
            out = out.withColumns({c: F.lag(c, 1).over(w) for c in names})
    if include_growth:
        out = growth_features(out, segment)
        if mode == "causal":
            w = ordered(segment)
            out = out.withColumns({c: F.lag(c, 1).over(w)
                                   for c in ("daily_growth_rate", "week_over_week_change")})
    if mode == "causal":
        out = out.drop("transaction_count", "total_quantity", "avg_unit_price", "unique_customers",
                       "avg_order_value")
    made = [c for c in out.columns if c not in base]
    if fill == "bfill":
        out = back_fill(out, made + [c for c in ("avg_unit_price",) if c in out.columns], segment)
    elif fill == "zero":
        out = out.fillna(0, subset=made)
    return out


def week_against_prior(df: DataFrame) -> DataFrame:
    """Revenue of the last 7 active days and of the 7 before."""
    days = df.groupBy(F.to_date("timestamp").alias("date")).agg(F.sum("total_amount").alias("revenue"))
    ranked = days.filter(F.col("date").isNotNull()).withColumn(
        "age", F.row_number().over(ordered(descending=True)))
    out = ranked.agg(
        F.sum(F.when(F.col("age") <= 7, F.col("revenue"))).cast("double").alias("recent_7d_total"),
        F.sum(F.when(F.col("age").between(8, 14), F.col("revenue"))).cast("double").alias("previous_7d_total"),
        F.count(F.lit(1)).alias("active_days"))
    comparable = F.col("active_days") >= 14
    return out.withColumn("growth_rate", F.when(comparable, numbers.growth_rate(
        F.col("recent_7d_total"), F.col("previous_7d_total"))))


def trailing_features(daily_df: DataFrame, segment=()) -> DataFrame:
    """What a model may know about each day from the days before it.

    Lags 1, 7, 14 and 30, means over 7, 14 and 30 previous days, population deviation over 7.
    """
    w = ordered(segment)
    cols = {f"revenue_lag_{n}": F.lag("total_revenue", n).over(w) for n in LAGS}
    for n in WINDOWS:
        frame = w.rowsBetween(-n, -1)
        enough = F.count("total_revenue").over(frame) == n
        cols[f"revenue_rolling_mean_{n}d"] = F.when(enough, F.avg("total_revenue").over(frame))
        if n == 7:
            cols["revenue_rolling_std_7d"] = F.when(enough, F.stddev_pop("total_revenue").over(frame))
    return daily_df.select(*segment, "date", "total_revenue", *[c.alias(n) for n, c in cols.items()])


def calendar_features(date: Column) -> dict[str, Column]:
    return {"day_of_week": F.weekday(date), "month": F.month(date),
            "is_weekend": dates.is_weekend(date), "day_of_month": F.day(date)}
