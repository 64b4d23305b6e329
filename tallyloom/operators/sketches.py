"""Distinct counts over any window from one sketch a day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a theta sketch's size: counts up to 16,384 are exact, larger ones have a relative standard error of about 0.8 %.
SIZE = 14


def daily_sketches(df: DataFrame, column: str, keys: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """(date, keys, sketch): a theta sketch of ``column`` for each day, counted in the map tasks. Null values are not counted."""
    return (df.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("date"), *keys)
            .agg(F.theta_sketch_agg(F.col(column).cast("string"), size).alias("sketch")))


def trailing_distinct(sketches: DataFrame, days: int, keys: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """(date, keys, n_distinct) over each day with data and the ``days`` - 1 days before it: unions of small sketches."""
    later = F.explode(F.sequence("date", F.date_add("date", days - 1))).alias("date")
    spread = sketches.select(later, *keys, "sketch")
    union = spread.groupBy("date", *keys).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", size)).alias("n_distinct"))
    return union.join(sketches.select("date", *keys), ["date", *keys], "left_semi")


def distinct_between(sketches: DataFrame, first: date, last: date, keys: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """(keys, n_distinct) from ``first`` to ``last``, both included."""
    some = sketches.filter(F.col("date").between(F.lit(first), F.lit(last)))
    return some.groupBy(*keys).agg(F.coalesce(F.theta_sketch_estimate(F.theta_union_agg("sketch", size)), F.lit(0)).alias("n_distinct"))
