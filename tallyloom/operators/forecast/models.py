"""Forecast models: random forest, gradient boosting and ridge on daily features."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...functions.numbers import checked_horizon, clamp_non_negative, round_currency
from ...session import fresh_path, stage
from ..features import Scaler
from ..filters import numeric_columns
from ..quantiles import exact_quantiles
from . import evaluate, grower
from .trees import NODE_SCHEMA, TreeArrays, node_table

# Model parameters.
FOREST = {"numTrees": 200, "maxDepth": 15, "minRowsToSplit": 5, "minInstancesPerNode": 2}
BOOSTING = {"maxIter": 100, "maxDepth": 10, "stepSize": 0.1}
RIDGE_ALPHA = 1.0
SEED = 42
Z95, Z99 = 1.96, 2.576
HISTORY = 30

NEVER_FEATURES = {"date", "datetime", "timestamp", "is_anomaly", "is_extreme"}


@dataclass
class SalesForecastModel:
    """Fit on a daily frame, then predict rows or forecast future days of one or many series.

    ``segment`` names the columns that identify a series; all series share one model. Trees split between any two values, with
    a least number of rows to split, and do not depend on the layout of the rows; ``exact=False`` takes Spark's own trees, which
    split at 32 bins and know no such number.
    """

    algorithm: str = "random_forest"
    target: str = "total_revenue"
    segment: tuple[str, ...] = ()
    confidence_level: float = 0.95
    params: dict = field(default_factory=dict)
    parallelism: int = 8
    exact: bool = True
    columns: list[str] = field(default_factory=list)
    scaler: Scaler | None = None
    nodes: pd.DataFrame | None = None
    coefficients: list[float] | None = None
    intercept: float = 0.0
    importances: list[tuple[str, float]] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)

    # ------------------------------------------------------------------ fitting
    def prepare_features(self, daily: DataFrame) -> DataFrame:
        """Numeric features (null as 0) and the target (null as its median)."""
        for c in ("date", self.target):
            if c not in daily.columns:
                raise ValueError(f"the daily table lacks the column {c}")
        self.columns = numeric_columns(daily, NEVER_FEATURES | {self.target} | set(self.segment))
        rows = daily.select(*self.segment, "date", self.target, *[
            F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.columns])
        middle = exact_quantiles(rows, {self.target: [0.5]})[self.target, 0.5]
        return rows.fillna(middle, subset=[self.target]) if middle is not None else rows

    def train(self, daily: DataFrame, test_size: float = 0.2) -> dict[str, float]:
        """Fit on the first part of the series and measure on the rest, then fit on all of it."""
        rows = stage(evaluate.chrono_split(self.prepare_features(daily), test_size, segment=self.segment), "train")
        self._fit(rows.filter("part = 'train'"))
        scored = self.predict_rows(rows.filter("part = 'test'"))
        self.metrics = evaluate.metrics(scored, self.target, "prediction").first().asDict()
        self._fit(rows)
        return self.metrics

    def train_with_cv(self, daily: DataFrame, n_splits: int = 5) -> dict[str, float]:
        """Expanding cross-validation for the measures, then a final fit on all rows."""
        rows = stage(self.prepare_features(daily), "train")
        folds = stage(evaluate.cv_folds(rows, n_splits, segment=self.segment), "folds")
        scored = None
        for fold in range(n_splits):
            one = folds.filter(F.col("fold") == fold)
            trial = SalesForecastModel(self.algorithm, self.target, self.segment, params=self.params,
                                       parallelism=self.parallelism, exact=self.exact, columns=self.columns)
            trial._fit(one.filter("part = 'train'"))
            part = trial.predict_rows(one.filter("part = 'test'"))
            scored = part if scored is None else scored.unionByName(part)
        per_fold = evaluate.metrics(scored, self.target, "prediction", keys=("fold",))
        self.metrics = evaluate.average_metrics(per_fold).first().asDict()
        self._fit(rows)
        return self.metrics

    def _fit(self, rows: DataFrame) -> "SalesForecastModel":
        spark = rows.sparkSession
        self.scaler = Scaler.fit(rows, self.columns)
        if self.exact and self.algorithm != "linear":
            return self._fit_exact(rows)
        vectors = VectorAssembler(inputCols=self.columns, outputCol="features").transform(
            self.scaler.transform(rows)).select("features", F.col(self.target).alias("label"))
        # Tree fitting ships one histogram per node and partition: few, full partitions are cheapest.
        n = vectors.count()
        vectors = vectors.coalesce(max(1, n // 100_000)).persist()
        try:
            if self.algorithm == "linear":
                self._fit_ridge(vectors, n)
            elif self.algorithm == "gradient_boosting":
                model = GBTRegressor(seed=SEED, **{**BOOSTING, **self.params}).fit(vectors)
                self._export(spark, [model], [list(model.treeWeights)])
            else:
                self._fit_forest(spark, vectors)
        finally:
            vectors.unpersist()
        return self

    def _fit_exact(self, rows: DataFrame) -> "SalesForecastModel":
        x = F.array(*[self.scaler.expression(c) for c in self.columns])
        held = stage(rows.select(x.alias("x"), F.col(self.target).cast("double").alias("y"), F.xxhash64(*self.segment, "date").alias("key")), "rows")
        boosting = self.algorithm == "gradient_boosting"
        p = {**(BOOSTING if boosting else FOREST), **self.params}
        rules = grower.Rules(p["maxDepth"], p.get("minRowsToSplit", 2), p.get("minInstancesPerNode", 1))
        grown = (grower.boosted(held, len(self.columns), p["maxIter"], p["stepSize"], rules) if boosting
                 else grower.forest(held, len(self.columns), p["numTrees"], rules, SEED))
        self.importances = sorted(zip(self.columns, grower.shares(grown, len(self.columns)).tolist()), key=lambda p: -p[1])
        self.nodes = grown.drop(columns=["gain", "drawn"])
        return self

    def _fit_forest(self, spark: SparkSession, vectors: DataFrame) -> None:
        """The forest in slices fitted at the same time, each with its own seed."""
        params = {**FOREST, **self.params}
        total = params.pop("numTrees")
        params.pop("minRowsToSplit", None)
        slices = min(self.parallelism, total)
        sizes = [total // slices + (i < total % slices) for i in range(slices)]
        def one(i: int):
            return RandomForestRegressor(numTrees=sizes[i], seed=SEED + i, featureSubsetStrategy="all",
                                         maxMemoryInMB=64, **params).fit(vectors)
        with ThreadPool(slices) as pool:
            models = pool.map(one, range(slices))
        self._export(spark, models, [[1.0 / total] * m.getNumTrees for m in models])

    def _fit_ridge(self, vectors: DataFrame, n: int) -> None:
        spread = vectors.agg(F.stddev_pop("label")).first()[0] or 1.0
        model = LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal",
                                 regParam=RIDGE_ALPHA * spread / n).fit(vectors)
        self.coefficients, self.intercept = [float(c) for c in model.coefficients], float(model.intercept)
        self.importances = sorted(((c, abs(w)) for c, w in zip(self.columns, self.coefficients)), key=lambda p: -p[1])

    def _export(self, spark: SparkSession, models: list, weights: list[list[float]]) -> None:
        parts, first = [], 0
        total = sum(len(w) for w in weights)
        share = np.zeros(len(self.columns))
        for model, w in zip(models, weights):
            path = fresh_path(spark, "model")
            model.save(path)
            parts.append(node_table(spark, path, w, first).toPandas())  # bounded by the model's size
            share += model.featureImportances.toArray() * len(w) / total
            first += len(w)
        self.nodes = pd.concat(parts, ignore_index=True)
        self.importances = sorted(zip(self.columns, share.tolist()), key=lambda p: -p[1])

    # --------------------------------------------------------------- prediction
    @property
    def fitted(self) -> bool:
        return self.scaler is not None

    def _require_fit(self) -> None:
        if not self.fitted:
            raise RuntimeError("this model has not been trained")

    def predict_rows(self, df: DataFrame, confidence: bool = False) -> DataFrame:
        """Adds ``prediction`` and, for forests, deviation and interval over the trees."""
        self._require_fit()
        shared = df.sparkSession.sparkContext.broadcast(self._evaluator_parts())

        @F.pandas_udf("prediction double, std double")
        def score(features: pd.DataFrame) -> pd.DataFrame:
            value, std = _evaluator_from(shared.value)(features.to_numpy(float))
            return pd.DataFrame({"prediction": value, "std": std if std is not None else np.nan})

        have = set(df.columns)
        inputs = [(self.scaler.expression(c) if c in have else
                   (F.lit(0.0) - self.scaler.means[c]) / self.scaler.stds[c]).alias(c) for c in self.columns]
        out = df.withColumn("_p", score(F.struct(*inputs))).withColumn("prediction", F.col("_p.prediction"))
        if confidence and self.algorithm not in ("linear", "gradient_boosting"):
            z = Z95 if self.confidence_level == 0.95 else Z99
            std = F.col("_p.std")
            out = out.withColumns({"std": std, "confidence_lower": F.col("prediction") - z * std,
                                   "confidence_upper": F.col("prediction") + z * std})
        return out.drop("_p")

    def _evaluator_parts(self):
        if self.algorithm == "linear":
            return ("linear", np.array(self.coefficients), self.intercept)
        return ("forest" if self.algorithm != "gradient_boosting" else "boosting", TreeArrays(self.nodes), None)

    def series_state(self, daily: DataFrame) -> DataFrame:
        """One row per series: last day, last 30 values in order, and moments of the history."""
        w = Window.partitionBy(*self.segment).orderBy(F.desc("date"))
        y = F.col(self.target).cast("double")
        rows = daily.select(*self.segment, "date", y.alias("y")).withColumn("age", F.row_number().over(w))
        tail = F.transform(F.sort_array(F.collect_list(F.when(F.col("age") <= HISTORY, F.struct("date", "y")))),
                           lambda s: s["y"])
        return rows.groupBy(*self.segment).agg(
            F.max("date").alias("last_date"), tail.alias("tail"), F.count("y").alias("n"),
            F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("m2")).filter("n > 0")

    def forecast(self, daily: DataFrame, horizon: int = 7) -> DataFrame:
        """``horizon`` future days of every series, each day built on the ones before it.

        A series is one small row by now, so the recursion is a narrow map over series: no
        shuffle per step and no growing plan.
        """
        self._require_fit()
        horizon = checked_horizon(horizon)
        spark = daily.sparkSession
        shared = spark.sparkContext.broadcast(self._evaluator_parts())
        columns, segment = self.columns, list(self.segment)
        means = np.array([self.scaler.means[c] for c in columns])
        stds = np.array([self.scaler.stds[c] for c in columns])

        def run(batches):
            predict = _evaluator_from(shared.value)
            for pdf in batches:
                tails = [list(t) for t in pdf["tail"]]
                n, mean, m2 = (pdf[c].to_numpy(float).copy() for c in ("n", "mean", "m2"))
                for step in range(1, horizon + 1):
                    days = [d + timedelta(days=step) for d in pdf["last_date"]]
                    x = np.array([_future_row(columns, d, t) for d, t in zip(days, tails)])
                    value, std = predict((x - means) / stds)
                    if std is None:
                        std = 0.1 * np.sqrt(m2 / np.maximum(n - 1, 1))
                    out = pdf[segment].copy()
                    out["step"], out["date"] = step, days
                    out["value"], out["std"] = value, std
                    yield out
                    n += 1
                    shift = value - mean
                    mean += shift / n
                    m2 += shift * (value - mean)
                    tails = [(t + [v])[-HISTORY:] for t, v in zip(tails, value)]

        kinds = dict(daily.dtypes)
        schema = ", ".join([f"{c} {kinds[c]}" for c in segment] + ["step int", "date date", "value double", "std double"])
        raw = self.series_state(daily).mapInPandas(run, schema)
        return raw.select(
            *segment, "step", "date", clamp_non_negative(F.col("value")).alias("value"),
            clamp_non_negative(F.col("value") - Z95 * F.col("std")).alias("confidence_lower"),
            (F.col("value") + Z95 * F.col("std")).alias("confidence_upper"), F.lit(self.algorithm).alias("model"))

    # ------------------------------------------------------------------ reports
    def feature_importance(self, spark: SparkSession, top_n: int = 10) -> DataFrame:
        rows = [(i + 1, c, float(v)) for i, (c, v) in enumerate(self.importances[:top_n])]
        return spark.createDataFrame(rows, "rank int, feature string, importance double")

    def confidence_report(self, spark: SparkSession) -> DataFrame:
        """Measures and leading features of the fitted model in long form."""
        rows = [("metric", k, float(v)) for k, v in self.metrics.items() if v is not None]
        rows += [("importance", c, float(v)) for c, v in self.importances[:10]]
        rows.append(("fitted", self.algorithm, 1.0 if self.fitted else 0.0))
        return spark.createDataFrame(rows, "section string, name string, value double")

    # -------------------------------------------------------------- persistence
    def save(self, spark: SparkSession, path: str) -> str:
        """Small Parquet tables below ``path``."""
        self._require_fit()
        self.scaler.to_frame(spark).write.parquet(f"{path}/scaler")
        self.confidence_report(spark).write.parquet(f"{path}/report")
        spark.createDataFrame(
            [(self.algorithm, self.target, list(self.segment), self.confidence_level, self.coefficients, self.intercept)],
            "algorithm string, target string, segment array<string>, confidence_level double, "
            "coefficients array<double>, intercept double").write.parquet(f"{path}/meta")
        if self.nodes is not None:
            spark.createDataFrame(self.nodes, NODE_SCHEMA).write.parquet(f"{path}/nodes")
        rows = [(i, c, float(v)) for i, (c, v) in enumerate(self.importances)]
        spark.createDataFrame(rows, "rank int, feature string, importance double").write.parquet(f"{path}/importances")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SalesForecastModel":
        meta = spark.read.parquet(f"{path}/meta").first()
        scaler = Scaler.from_frame(spark.read.parquet(f"{path}/scaler"))
        model = SalesForecastModel(meta.algorithm, meta.target, tuple(meta.segment), meta.confidence_level,
                                   columns=scaler.columns, scaler=scaler, intercept=meta.intercept,
                                   coefficients=list(meta.coefficients) if meta.coefficients else None)
        if model.algorithm != "linear":
            model.nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        report = spark.read.parquet(f"{path}/report").filter("section = 'metric'").collect()
        model.metrics = {r.name: r.value for r in report}
        ranks = spark.read.parquet(f"{path}/importances").orderBy("rank").collect()
        model.importances = [(r.feature, r.importance) for r in ranks]
        return model


def _evaluator_from(parts):
    kind, body, intercept = parts
    if kind == "linear":
        return lambda x: (x @ body + intercept, None)
    def run(x):
        each = body.per_tree(x)
        return body.weight @ each, (each.std(axis=0) if kind == "forest" else None)
    return run


def _future_row(columns: list[str], day, tail: list[float]) -> list[float]:
    """Features of a day that has not happened: calendar, lags and trailing statistics."""
    known = {"day_of_week": day.weekday(), "month": day.month, "day_of_month": day.day,
             "is_weekend": 1 if day.weekday() >= 5 else 0}
    for n in (1, 7, 14, 30):
        if len(tail) >= n:
            known[f"revenue_lag_{n}"] = tail[-n]
    for n in (7, 14, 30):
        if len(tail) >= n:
            known[f"revenue_rolling_mean_{n}d"] = np.mean(tail[-n:])
    if len(tail) >= 7:
        known["revenue_rolling_std_7d"] = np.std(tail[-7:])
    return [float(known.get(c, 0.0)) for c in columns]


def forecast_totals(forecast: DataFrame, segment: tuple[str, ...] = ()) -> DataFrame:
    """Total, daily mean and horizon of a forecast, in currency."""
    return forecast.groupBy(*segment).agg(
        round_currency(F.sum("value")).alias("total_forecast"),
        round_currency(F.avg("value")).alias("avg_daily_forecast"),
        F.count(F.lit(1)).alias("horizon_days"))


def rounded(forecast: DataFrame) -> DataFrame:
    return forecast.withColumns({c: round_currency(F.col(c))
                                 for c in ("value", "confidence_lower", "confidence_upper")})


def prediction_summary(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg("prediction").alias("mean"), F.sum("prediction").alias("total"),
                         F.count("prediction").alias("rows"))


def proxy_interval(df: DataFrame, value: str, history_std: str) -> DataFrame:
    """Interval of models without trees: a tenth of the history's deviation."""
    spread = 0.1 * Z95 * F.col(history_std)
    return df.withColumns({"confidence_lower": clamp_non_negative(F.col(value) - spread),
                           "confidence_upper": F.col(value) + spread})
