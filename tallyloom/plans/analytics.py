"""The query surface: one method per question the dashboard asks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import checked_horizon
from ..operators import aggregates, filters, insights, kpis, ranking, series
from ..operators.anomaly import report
from ..operators.anomaly.detector import AnomalyDetector
from ..operators.forecast.models import SalesForecastModel, rounded
from ..sources.unified import latest, unified_scan

MIN_FORECAST_ROWS = 30


class SalesAnalytics:
    """Questions over one sales table, or over history united with live rows.

    ``as_of`` is the reference time of all trailing windows; the newest sale if not given.
    """

    def __init__(self, sales: DataFrame, live: DataFrame | None = None, as_of: datetime | None = None,
                 forecast_model: SalesForecastModel | None = None, detector: AnomalyDetector | None = None):
        self.sales = unified_scan(live, sales, ordered=False) if live is not None else sales
        self.live = live if live is not None else sales
        self._as_of, self.forecast_model, self.detector = as_of, forecast_model, detector

    @property
    def spark(self) -> SparkSession:
        return self.sales.sparkSession

    @property
    def as_of(self) -> datetime:
        if self._as_of is None:
            self._as_of = filters.newest(self.sales)
        if self._as_of is None:
            raise ValueError("the sales table is empty, so there is no reference time")
        return self._as_of

    def _recent(self, days: int) -> DataFrame:
        return filters.trailing(self.sales, days, self.as_of)

    def sales_history(self, days: int = 30, granularity: str = "daily", category: str | None = None,
                      region: str | None = None) -> DataFrame:
        rows = filters.matching(self._recent(days), category, region)
        if granularity == "daily":
            return series.daily_features(rows).orderBy("date")
        if granularity == "hourly":
            return aggregates.hourly(rows).orderBy("datetime")
        if granularity == "weekly":
            return aggregates.weekly(rows).orderBy("date")
        return rows.orderBy("timestamp", "transaction_id")

    def live_sales(self, limit: int = 100) -> DataFrame:
        return latest(self.live, limit)

    def transactions(self, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page and the total row count."""
        return ranking.page(self.sales, limit, offset), ranking.total(self.sales)

    def forecast(self, horizon: int = 7) -> DataFrame:
        model = self._model()
        if len(self.sales.take(MIN_FORECAST_ROWS)) < MIN_FORECAST_ROWS:
            raise ValueError(f"a forecast takes {MIN_FORECAST_ROWS} sales or more")
        daily = aggregates.daily(self.sales, model.segment)
        return rounded(model.forecast(daily, checked_horizon(horizon)))

    def forecast_confidence(self) -> DataFrame:
        return self._model().confidence_report(self.spark)

    def _model(self) -> SalesForecastModel:
        if self.forecast_model is None or not self.forecast_model.fitted:
            raise RuntimeError("pass a fitted forecast_model to ask for forecasts")
        return self.forecast_model

    def _detected(self, days: int) -> DataFrame:
        if self.detector is None:
            raise RuntimeError("pass a fitted detector to ask for anomalies")
        return self.detector.transform(self._recent(days))

    def anomalies(self, days: int = 7, severity: str | None = None) -> DataFrame:
        return filters.with_severity(filters.flagged(self._detected(days)), severity)

    def latest_anomalies(self, history: DataFrame, limit: int = 10, min_severity: str = "low") -> DataFrame:
        return report.recent(history, limit, min_severity)

    def anomaly_report(self, days: int = 30) -> DataFrame:
        return report.summary(report.breakdown(self._detected(days), self.as_of))

    def kpi_summary(self, days: int = 30) -> DataFrame:
        """Key figures; with a detector, the anomalies are those it flags among the current rows."""
        figures = kpis.summary(self.sales, self.as_of, days)
        if self.detector is None:
            return figures
        found = filters.flagged(self._detected(days)).agg(F.count(F.lit(1))).scalar()
        return figures.withColumn("anomaly_count", found.cast("bigint"))

    def kpi_realtime(self) -> DataFrame:
        return kpis.realtime(self.live, self.as_of)

    def insights(self, category: str | None = None, days: int = 30, horizon: int = 7) -> DataFrame:
        breakdown = report.breakdown(self._detected(days), self.as_of) if self.detector else None
        future = None
        if self.forecast_model is not None and self.forecast_model.fitted:
            future = self.forecast(horizon)
        found = insights.generate(self.sales, self.as_of, days, breakdown=breakdown, forecast=future)
        return insights.of_type(found, category) if category and category != "all" else found

    def top_insights(self, limit: int = 5) -> DataFrame:
        return insights.top(self.insights(), limit)

    def by_category(self, days: int = 30) -> DataFrame:
        return aggregates.by_category(self._recent(days))

    def by_region(self, days: int = 30) -> DataFrame:
        return aggregates.by_region(self._recent(days))

    def trends(self, days: int = 30, granularity: str = "daily", category: str | None = None,
               region: str | None = None) -> DataFrame:
        rows = filters.matching(self._recent(days), category, region)
        return ranking.trend(rows, granularity, days)
