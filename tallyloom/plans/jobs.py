"""Batch jobs: train, score and refresh, each writing Parquet tables."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import features, filters, insights, quality, series
from ..operators.anomaly import report
from ..operators.anomaly.detector import AnomalyDetector
from ..operators.anomaly.stats import ColumnStats, detect_by_zscore
from ..operators.forecast.models import SalesForecastModel, rounded
from ..operators.partials import DailyCells
from ..session import stage

MIN_ROWS = 100
ANOMALY_FEATURES = ["quantity", "unit_price", "total_amount"]


def train_forecast(sales: DataFrame, model_dir: str | None = None, algorithm: str = "random_forest",
                   n_splits: int = 5, horizon: int = 7, **options) -> tuple[SalesForecastModel, DataFrame]:
    """Clean, aggregate, cross-validate, fit, save and forecast. Needs at least 100 rows."""
    rows = quality.clean(sales)
    # cleaning only drops rows, so the sales themselves are read again only if too few clean ones are left
    if len(rows.take(MIN_ROWS)) < MIN_ROWS and len(sales.take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError(f"training takes {MIN_ROWS} sales or more")
    daily = stage(series.daily_features(rows).dropna(), "daily")
    model = SalesForecastModel(algorithm, **options)
    model.train_with_cv(daily, n_splits)
    if model_dir:
        model.save(sales.sparkSession, model_dir)
    return model, rounded(model.forecast(daily, horizon))


def train_anomaly(sales: DataFrame, model_dir: str | None = None, algorithm: str = "isolation_forest",
                  contamination: float = 0.02, columns: list[str] = ANOMALY_FEATURES) -> AnomalyDetector:
    detector = AnomalyDetector(algorithm, contamination, key=["transaction_id"]).fit(sales, columns)
    if model_dir:
        detector.save(sales.sparkSession, model_dir)
    return detector


def _replace(rows: DataFrame, out: str) -> DataFrame:
    """Write ``rows`` as a new version below ``out``. Readers of earlier versions are not disturbed, and a failed job leaves them;
    ``newest_version`` finds the last one that was written in full."""
    version = f"{out}/version={time.time_ns():020d}"
    rows.write.parquet(version)
    return rows.sparkSession.read.schema(rows.schema).parquet(version)


def newest_version(spark: SparkSession, out: str) -> DataFrame:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(root)), reverse=True)
    done = next(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS")))
    return spark.read.parquet(f"{out}/{done}")


def score_anomalies(sales: DataFrame, out: str, model_dir: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Clean, engineer, detect and write the scored rows; without a model the z-score decides."""
    featured = features.engineer(quality.clean(sales, order))
    if model_dir:
        scored = AnomalyDetector.load(sales.sparkSession, model_dir).transform(featured)
    else:
        stats = ColumnStats.fit(featured, ["total_amount"])
        scored = detect_by_zscore(featured, stats)
    return _replace(scored, out)


def refresh_insights(sales: DataFrame, out: str, as_of: datetime | None = None, days: int = 30,
                     forecast: DataFrame | None = None, detect: bool = True) -> DataFrame:
    """Clean, split, run all rules and replace the insight table."""
    rows = quality.clean(sales)
    as_of = as_of or filters.newest(rows)
    breakdown = None
    if detect:
        stats = ColumnStats.fit(rows, ["total_amount"])
        current = detect_by_zscore(filters.trailing(rows, days, as_of), stats)
        breakdown = report.breakdown(current, as_of)
    found = insights.generate(rows, as_of, days, breakdown=breakdown, forecast=forecast, ordered=False)
    return _replace(found, out)


def refresh_insights_incrementally(sales: DataFrame, cells: DailyCells, out: str, as_of: datetime | None = None, days: int = 30,
                                   forecast: DataFrame | None = None, threshold: float = 3.0) -> DataFrame:
    """All rules from stored sums of days: history is not read again.

    ``sales`` are clean rows. Days before that of ``as_of`` are stored first; then the rules take stored sums and the open day,
    and detection takes statistics from the sums and reads the current period only.
    """
    as_of = as_of or filters.newest(sales)
    cells.update(sales, as_of.date())
    current = detect_by_zscore(filters.trailing(sales, days, as_of), cells.stats(sales), threshold)
    found = insights.generate(sales, as_of, days, breakdown=report.breakdown(current, as_of), forecast=forecast, ordered=False,
                              cells=cells.summarise(sales, as_of, days))
    return _replace(found, out)
