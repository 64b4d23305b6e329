"""Row filters. All compare raw columns with literals, so they reach the Parquet scan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import labels
from ..functions.dates import timestamp_literal
from ..functions.fixed import SEVERITY_ORDER


def newest(df: DataFrame, column: str = "timestamp") -> datetime | None:
    """Latest timestamp of a frame: the default reference time of every trailing window."""
    return df.agg(F.max(column)).first()[0]


def trailing(df: DataFrame, days: int, as_of: datetime) -> DataFrame:
    """Rows from ``days`` before ``as_of``, with no upper bound.

    A table written by month is also filtered on its folder column, so older folders are not listed.
    """
    start = as_of - timedelta(days=days)
    if dict(df.dtypes).get("month") == "string":
        df = df.filter(F.col("month") >= start.strftime("%Y-%m"))
    return df.filter(F.col("timestamp") >= timestamp_literal(start))


def matching(df: DataFrame, category: str | None = None, region: str | None = None) -> DataFrame:
    if category:
        df = df.filter(F.col("category") == category)
    if region:
        df = df.filter(F.col("region") == region)
    return df


def period_tag(days: int, as_of: datetime, baseline: str = "all") -> Column:
    """'current' for the last ``days``, 'previous' before it, else null.

    ``baseline`` is 'all' for the whole earlier history or 'previous_window' for as many days again.
    """
    cutoff = as_of - timedelta(days=days)
    earlier = F.lit(True)
    if baseline == "previous_window":
        earlier = F.col("timestamp") >= timestamp_literal(cutoff - timedelta(days=days))
    return (F.when(F.col("timestamp") >= timestamp_literal(cutoff), "current")
            .when(earlier & F.col("timestamp").isNotNull(), "previous"))


def flagged(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_anomaly").cast("int") == 1)


def with_severity(df: DataFrame, level: str | None = None) -> DataFrame:
    return df.filter(F.col("severity") == level) if level else df


def at_least_severity(df: DataFrame, minimum: str = "low") -> DataFrame:
    return df.filter(labels.severity_rank(F.col("severity")) >= SEVERITY_ORDER.index(minimum))


def on_date(date: str) -> Column:
    """All rows of one calendar day as a range, which keeps pushdown."""
    start = F.lit(date).cast("timestamp")
    return (F.col("timestamp") >= start) & (F.col("timestamp") < start + F.expr("INTERVAL 1 DAY"))


def with_columns_defaulted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``; absent ones and nulls become 0."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have
                       else F.lit(0.0).alias(c) for c in columns])


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def inject_events(df: DataFrame, events: list[dict]) -> DataFrame:
    """Scale ``total_amount`` on chosen days and flag the rows; events apply in order.

    An event is {type: spike | drop | region_drop, date, magnitude, region}.
    """
    if "is_anomaly" not in df.columns:
        df = df.withColumn("is_anomaly", F.lit(False))
    amount, flag = F.col("total_amount").cast("double"), F.col("is_anomaly")
    for event in events:
        kind, size = event.get("type", "spike"), float(event.get("magnitude", 2.0))
        hit = on_date(event["date"])
        if kind == "region_drop":
            hit = hit & (F.col("region") == event["region"])
        elif kind not in ("spike", "drop"):
            continue
        amount = F.when(hit, amount * size if kind == "spike" else amount / size).otherwise(amount)
        flag = F.when(hit, F.lit(True)).otherwise(flag)
    return df.withColumns({"total_amount": amount, "is_anomaly": flag})
