"""Chronological splits and error measures over daily frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.numbers import ratio


def _numbered(df: DataFrame, order: str, segment) -> DataFrame:
    w = Window.partitionBy(*segment)
    return df.withColumns({"_n": F.count(F.lit(1)).over(w),
                           "_i": F.row_number().over(w.orderBy(order)) - 1})


def chrono_split(df: DataFrame, test_size: float = 0.2, order: str = "date", segment=()) -> DataFrame:
    """Adds ``part``: 'train' for the first ``1 - test_size`` of each series, 'test' after it."""
    cut = F.floor(F.col("_n") * F.lit(1.0 - test_size))
    return (_numbered(df, order, segment)
            .withColumn("part", F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_n", "_i"))


def cv_folds(df: DataFrame, n_splits: int = 5, order: str = "date", segment=()) -> DataFrame:
    """Expanding folds as rows (fold, part): fold f tests one block and trains on all before it."""
    size = F.floor(F.col("_n") / (n_splits + 1))
    start = F.col("_n") - (n_splits - F.col("fold")) * F.col("_t")
    out = (_numbered(df, order, segment).withColumn("_t", size)
           .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")))
    part = (F.when(F.col("_i") < start, "train")
            .when(F.col("_i") < start + F.col("_t"), "test"))
    return out.withColumn("part", part).filter(F.col("part").isNotNull()).drop("_n", "_i", "_t")


def metrics(df: DataFrame, actual: str, predicted: str, order: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """RMSE, MAE, MAPE (zero actuals skipped), R2 and direction accuracy per key."""
    y, p = F.col(actual), F.col(predicted)
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"_dy": y - F.lag(actual).over(w), "_dp": p - F.lag(predicted).over(w)})
    same = F.when(F.col("_dy").isNotNull(), (F.signum("_dy") == F.signum("_dp")).cast("double"))
    out = rows.groupBy(*keys).agg(
        F.sqrt(F.avg((y - p) ** 2)).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        (F.avg(F.when(y != 0, F.abs((y - p) / F.when(y != 0, y)))) * 100.0).alias("mape"),
        F.sum((y - p) ** 2).alias("_sse"), (F.var_pop(actual) * F.count(actual)).alias("_sst"),
        (F.coalesce(F.avg(same), F.lit(0.0)) * 100.0).alias("direction_accuracy"))
    r2 = (F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1.0 - ratio(F.col("_sse"), F.col("_sst"))))
    return out.select(*keys, "rmse", "mae", "mape", r2.alias("r2"), "direction_accuracy")


MEASURES = ("rmse", "mae", "mape", "r2", "direction_accuracy")


def average_metrics(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation of every measure over the folds."""
    return per_fold.agg(*[F.avg(m).alias(m) for m in MEASURES],
                        *[F.stddev_pop(m).alias(f"{m}_cv_std") for m in MEASURES])


def overlay(actuals: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual and forecast values on one date axis, null where a series has no value."""
    return actuals.select("date", F.col("total_revenue").alias("actual")).unionByName(
        forecast.select("date", F.col("value").alias("forecast"), "confidence_upper"),
        allowMissingColumns=True)
