"""Weighted combination of forecasts from several models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import autoregression
from .models import SalesForecastModel, Z95


def weights_from_mape(scores: DataFrame, normalise: bool = False) -> DataFrame:
    """(model, mape) to (model, weight).

    Models with a positive MAPE share 1 in proportion to its inverse; the others keep an equal
    share of the model count. ``normalise`` scales the weights to sum to 1.
    """
    everything = Window.partitionBy()
    inverse = F.when(F.col("mape") > 0, 1.0 / F.when(F.col("mape") > 0, F.col("mape")))
    out = scores.withColumn("_inv", inverse).select("model", F.coalesce(
        F.col("_inv") / F.sum("_inv").over(everything),
        1.0 / F.count(F.lit(1)).over(everything)).alias("weight"))
    if normalise:
        out = out.withColumn("weight", F.col("weight") / F.sum("weight").over(everything))
    return out


def combine(forecasts: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(model, keys, value) to the weighted value with an interval from the spread of the models."""
    known = forecasts.join(F.broadcast(weights), "model", "left")  # one row per model
    out = known.groupBy(*keys).agg(
        F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("value"),
        F.stddev_pop("value").alias("spread"), F.count(F.lit(1)).alias("models"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "value")))).alias("individual"))
    return out.select(*keys, "value", (F.col("value") - Z95 * F.col("spread")).alias("confidence_lower"),
                      (F.col("value") + Z95 * F.col("spread")).alias("confidence_upper"), "models", "individual")


class EnsembleForecastModel:
    """Random forest and gradient boosting, optionally with ARIMA."""

    def __init__(self, include_arima: bool = False, segment: tuple[str, ...] = (), normalise: bool = False,
                 params: dict[str, dict] | None = None):
        params = params or {}
        self.segment, self.include_arima, self.normalise = segment, include_arima, normalise
        self.models = {name: SalesForecastModel(name, segment=segment, params=params.get(name, {}))
                       for name in ("random_forest", "gradient_boosting")}
        self.weights: DataFrame | None = None

    def train(self, daily: DataFrame) -> "EnsembleForecastModel":
        scores = [(name, m.train(daily)["mape"]) for name, m in self.models.items()]
        if self.include_arima:
            scores.append(("arima", None))
        frame = daily.sparkSession.createDataFrame(scores, "model string, mape double")
        self.weights = weights_from_mape(frame, self.normalise)
        return self

    def forecast(self, daily: DataFrame, horizon: int = 7) -> DataFrame:
        if self.weights is None:
            raise RuntimeError("this ensemble has not been trained")
        parts = [m.forecast(daily, horizon) for m in self.models.values()]
        if self.include_arima:
            parts.append(autoregression.forecast(autoregression.fit(daily, segment=self.segment), horizon, self.segment))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return combine(every, self.weights, (*self.segment, "date"))
