"""Statistical detection: standard scores and interquartile fences.

Fitted statistics are a handful of numbers. They are read back once and enter the plan as
literals, so scoring is a narrow projection and outlier filters are pushed into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import labels
from ..quantiles import iqr

Z_THRESHOLD = 3.0
IQR_MULTIPLIER = 1.5
PRIMARY = ("total_revenue", "total_amount")


@dataclass
class ColumnStats:
    """Mean, sample and population deviation per column."""

    means: dict[str, float | None] = field(default_factory=dict)
    stds: dict[str, float | None] = field(default_factory=dict)
    pops: dict[str, float | None] = field(default_factory=dict)

    @staticmethod
    def expressions(columns: list[str]) -> list[Column]:
        out = []
        for i, c in enumerate(columns):
            v = F.col(c).cast("double")
            out += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.stddev_pop(v).alias(f"p{i}")]
        return out

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "ColumnStats":
        columns = list(dict.fromkeys(columns))
        row = df.agg(*ColumnStats.expressions(columns)).first()
        pick = lambda k: {c: row[f"{k}{i}"] for i, c in enumerate(columns)}
        return ColumnStats(pick("m"), pick("s"), pick("p"))

    @staticmethod
    def frame(df: DataFrame, columns: list[str]) -> DataFrame:
        """The same statistics as a lazy frame, one row per column."""
        row = df.agg(*ColumnStats.expressions(columns))
        return row.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
            for i, c in enumerate(columns)])))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.means[c], self.stds[c], self.pops[c]) for c in self.means]
        return spark.createDataFrame(rows, "feature string, mean double, std double, pop double")

    @staticmethod
    def from_frame(df: DataFrame) -> "ColumnStats":
        rows = df.collect()  # one row per column
        return ColumnStats({r.feature: r["mean"] for r in rows}, {r.feature: r["std"] for r in rows},
                           {r.feature: r["pop"] for r in rows})

    def usable(self, c: str) -> bool:
        return bool(self.stds.get(c))

    def z(self, c: str) -> Column:
        return (F.col(c).cast("double") - self.means[c]) / self.stds[c]


def add_zscore_flags(df: DataFrame, stats: ColumnStats, threshold: float = Z_THRESHOLD) -> DataFrame:
    """``<column>_zscore`` for revenue and amount, flags OR-ed over both."""
    used = [c for c in PRIMARY if c in df.columns and stats.usable(c)]
    if not used:
        return df
    hit = F.lit(False)
    for c in used:
        df = df.withColumn(f"{c}_zscore", stats.z(c))
        hit = hit | F.coalesce(F.abs(F.col(f"{c}_zscore")) > threshold, F.lit(False))
    return df.withColumn("is_anomaly_zscore", hit.cast("int"))


def detect_by_zscore(df: DataFrame, stats: ColumnStats, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Flag and severity from the standard score alone."""
    out = add_zscore_flags(df, stats, threshold)
    if "is_anomaly_zscore" not in out.columns:
        return out.withColumns({"is_anomaly": F.lit(0), "severity": F.lit("low")})
    scores = [F.abs(F.col(f"{c}_zscore")) for c in PRIMARY if f"{c}_zscore" in out.columns]
    size = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return out.withColumns({"is_anomaly": F.col("is_anomaly_zscore"),
                            "severity": labels.severity(F.coalesce(size, F.lit(0.0)))})


def zscore_outliers(df: DataFrame, column: str, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Rows beyond ``threshold`` population deviations."""
    stats = ColumnStats.fit(df, [column])
    mean, std = stats.means[column], stats.pops[column]
    if not std:
        return df.limit(0)
    return df.filter(F.abs((F.col(column).cast("double") - mean) / std) > threshold)


def iqr_outliers(df: DataFrame, column: str, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Rows outside the interquartile fences."""
    q1, q3, spread = iqr(df, column)
    value = F.col(column).cast("double")
    return df.filter((value < q1 - multiplier * spread) | (value > q3 + multiplier * spread))
