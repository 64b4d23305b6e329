"""Feature frames for models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..session import stage
from . import quality, series
from .filters import numeric_columns, with_columns_defaulted

#: Labels that may be broadcast; a longer list is joined by shuffle.
BROADCAST_LABELS = 1_000_000

# Columns that are never features.
NOT_FEATURES = {"date", "datetime", "timestamp", "transaction_id", "product_id", "product_name",
                "customer_id", "time_of_day", "is_anomaly", "is_extreme"}


def time_features(df: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    return df.withColumns({
        "hour": F.hour(ts), "day_of_week": F.weekday(ts), "day_of_month": F.day(ts),
        "month": F.month(ts), "quarter": F.quarter(ts), "week_of_year": F.weekofyear(ts),
        "year": F.year(ts), "is_weekend": dates.is_weekend(ts),
        "is_month_start": dates.is_month_start(ts), "is_month_end": dates.is_month_end(ts),
        "time_of_day": dates.time_of_day(ts),
    })


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """Alphabetical codes from 0 for the distinct labels: a dimension table."""
    labels = df.select(F.coalesce(column, F.lit("Unknown")).alias(column)).distinct()
    return labels.withColumn("code", F.row_number().over(Window.partitionBy().orderBy(column)) - 1)


def _codes(labels: DataFrame, column: str) -> DataFrame:
    """(_label, <column>_encoded) to join with: staged, counted, and hinted for broadcast if short enough.

    A shuffle by a few labels would put all rows of a label into one task.
    """
    known = stage(labels.select(F.col(column).alias("_label"), F.col("code").alias(f"{column}_encoded")), "labels")
    return F.broadcast(known) if known.count() <= BROADCAST_LABELS else known


def encode(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Adds ``<column>_encoded``; a label never seen counts as "Unknown" and fails if that is unseen too.

    The label table is broadcast while it is small.
    """
    out = df.join(_codes(labels, column), F.coalesce(F.col(column), F.lit("Unknown")) == F.col("_label"), "left").drop("_label")
    unknown = labels.filter(F.col(column) == "Unknown").agg(F.max("code")).scalar()
    return out.withColumn(f"{column}_encoded", F.coalesce(F.col(f"{column}_encoded"), unknown))


def engineer(df: DataFrame, encoders: dict[str, DataFrame] | None = None, include_time: bool = True) -> DataFrame:
    """Calendar features and label codes; ``encoders`` reuses fitted codes."""
    out = time_features(df) if include_time else df
    for column in ("category", "region"):
        if column not in df.columns:
            continue
        if encoders and column in encoders:
            out = encode(out, column, encoders[column])
        else:
            known = _codes(fit_labels(df, column), column)
            out = out.join(known, F.coalesce(F.col(column), F.lit("Unknown")) == F.col("_label")).drop("_label")
    return out


@dataclass
class Scaler:
    """Column means and population deviations; a constant column divides by 1."""

    columns: list[str]
    means: dict[str, float]
    stds: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "Scaler":
        cells = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
        row = df.agg(*[F.avg(cells[c]).alias(f"m{i}") for i, c in enumerate(columns)],
                     *[F.stddev_pop(cells[c]).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        means = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}
        stds = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)}
        return Scaler(columns, means, stds)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replaces the columns by their standard scores; null counts as 0."""
        return df.withColumns({c: self.expression(c) for c in self.columns})

    def expression(self, c: str):
        return (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - self.means[c]) / self.stds[c]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, self.means[c], self.stds[c]) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "position int, feature string, mean double, std double")

    @staticmethod
    def from_frame(df: DataFrame) -> "Scaler":
        rows = df.orderBy("position").collect()  # one row per feature
        return Scaler([r.feature for r in rows], {r.feature: r["mean"] for r in rows},
                      {r.feature: r["std"] for r in rows})


def ml_dataset(df: DataFrame, target: str = "total_revenue", exclude: list[str] = (),
               scaler: Scaler | None = None) -> tuple[DataFrame, Scaler]:
    """Scaled numeric features with the target; fits a scaler unless one is given."""
    columns = scaler.columns if scaler else numeric_columns(df, NOT_FEATURES | set(exclude) | {target})
    scaler = scaler or Scaler.fit(df, columns)
    keys = [c for c in ("date", "datetime") if c in df.columns]
    return scaler.transform(df.select(*keys, *columns, target)), scaler


def prepare_for_inference(df: DataFrame, columns: list[str], scaler: Scaler | None = None) -> DataFrame:
    """Exactly the training columns, absent ones as 0, scaled when a scaler is fitted."""
    rows = with_columns_defaulted(df, columns)
    return scaler.transform(rows) if scaler else rows


def pipeline(df: DataFrame, strict: bool = True, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate, clean, engineer and aggregate: (transaction features, daily features).

    ``strict`` refuses invalid rows; without it they are cleaned.
    """
    if strict:
        valid, errors = quality.is_valid(df)
        if not valid:
            raise ValueError(f"the rows do not pass validation: {errors}")
    featured = engineer(quality.clean(df, order))
    return featured, series.daily_features(featured)
