"""Sums by day that a refresh merges instead of reading history again."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import folders
from .anomaly.stats import ColumnStats
from .filters import timestamp_literal
from .insights import summarise

DIMS = ["category", "region", "product_name"]
STORED = "day date, dim string, key string, revenue decimal(38,2), squares decimal(38,4), n long"


def day_start(day: date) -> datetime:
    return datetime.combine(day, time())


class DailyCells:
    """Revenue, its squares and counts by (day, dimension, key), persisted step by step for days that are over.

    ``update`` reads sales from the first day that is not stored on; the cut-off is a literal on ``timestamp`` and so reaches the
    scan. A step is one folder and counts once it is complete; a failed step is written again under the same number. Rows that
    arrive late for a stored day are not seen until ``rebuild`` is called for it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _steps(self) -> list[int]:
        return folders.numbers(self.spark, self.path, "step")

    def cells(self) -> DataFrame:
        """The newest step's cells for each day."""
        steps = self._steps()
        if not steps:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(f"{STORED}, step int").option("basePath", self.path).parquet(*[f"{self.path}/step={n}" for n in steps])
        newest = rows.groupBy("day").agg(F.max("step").alias("step"))
        return rows.join(newest, ["day", "step"]).drop("step")

    def last_day(self) -> date | None:
        return self.cells().agg(F.max("day")).first()[0]

    def _write(self, sales: DataFrame) -> int:
        step = (self._steps() or [0])[-1] + 1
        rows = sales.where("timestamp is not null").withColumn("day", F.to_date("timestamp"))
        sets = [[F.col("day"), F.col(d)] for d in DIMS] + [[F.col("day")]]
        out = rows.groupingSets(sets, F.col("day"), *[F.col(d) for d in DIMS]).agg(
            F.sum("total_amount").alias("revenue"), F.sum(F.col("total_amount") * F.col("total_amount")).alias("squares"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
        dim, key = F.lit("date"), F.col("day").cast("string")
        for i, d in enumerate(DIMS):
            mine = F.col("gid") == 7 - 2 ** (2 - i)
            dim, key = F.when(mine, d).otherwise(dim), F.when(mine, F.col(d)).otherwise(key)
        cells = out.select("day", dim.alias("dim"), key.alias("key"), F.col("revenue").cast("decimal(38,2)").alias("revenue"),
                           F.col("squares").cast("decimal(38,4)").alias("squares"), "n")
        cells.write.mode("overwrite").parquet(f"{self.path}/step={step}")
        return step

    def new_rows(self, sales: DataFrame, until: date | None = None) -> DataFrame:
        """The rows that the next update reads: days after the last stored one and before ``until``."""
        last = self.last_day()
        rows = sales if last is None else sales.filter(F.col("timestamp") >= timestamp_literal(day_start(last + timedelta(days=1))))
        return rows if until is None else rows.filter(F.col("timestamp") < timestamp_literal(day_start(until)))

    def update(self, sales: DataFrame, until: date) -> int:
        """Store the days before ``until`` that are not stored yet; gives the step's number."""
        return self._write(self.new_rows(sales, until))

    def rebuild(self, sales: DataFrame, day: date) -> int:
        """Count one stored day again."""
        lo, hi = day_start(day), day_start(day + timedelta(days=1))
        return self._write(sales.filter((F.col("timestamp") >= timestamp_literal(lo)) & (F.col("timestamp") < timestamp_literal(hi))))

    def summarise(self, sales: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
        """What ``insights.summarise`` gives against all earlier history, from stored days, newer rows and, where the period
        begins inside a day, the rows of that day."""
        last, cutoff = self.last_day(), as_of - timedelta(days=days)
        if last is None:
            return summarise(sales, as_of, days)
        whole = cutoff == day_start(cutoff.date())
        raw = F.col("timestamp") >= timestamp_literal(day_start(last + timedelta(days=1)))
        stored = self.cells()
        if not whole:
            lo, hi = day_start(cutoff.date()), day_start(cutoff.date() + timedelta(days=1))
            raw |= (F.col("timestamp") >= timestamp_literal(lo)) & (F.col("timestamp") < timestamp_literal(hi))
            stored = stored.filter(F.col("day") != F.lit(cutoff.date()))
        period = F.when(F.col("day") >= F.lit(cutoff.date()), "current").otherwise("previous")
        kept = (period == "current") | F.col("dim").isin("category", "region")
        merged = stored.select("dim", period.alias("period"), F.when(kept, F.col("key")).alias("key"), "revenue", "n").unionByName(
            summarise(sales.filter(raw), as_of, days).withColumn("revenue", F.col("revenue").cast("decimal(38,2)")))
        return merged.groupBy("dim", "period", "key").agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n"))

    def stats(self, sales: DataFrame) -> ColumnStats:
        """Mean and deviations of ``total_amount`` over stored days and newer rows, from exact sums."""
        stored = self.cells().filter("dim = 'date'").agg(F.sum("n").alias("n"), F.sum("revenue").alias("s"), F.sum("squares").alias("q"))
        newer = self.new_rows(sales).agg(F.count("total_amount").alias("n"), F.sum("total_amount").cast("decimal(38,2)").alias("s"),
                                         F.sum(F.col("total_amount") * F.col("total_amount")).cast("decimal(38,4)").alias("q"))
        row = stored.unionByName(newer).agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
        n, s, q = (x or 0 for x in row)
        spread = float(q - s * s / n) if n else None
        name = "total_amount"
        return ColumnStats({name: float(s / n) if n else None}, {name: sqrt(max(spread, 0.0) / (n - 1)) if n > 1 else None}, {name: sqrt(max(spread, 0.0) / n) if n else None})
