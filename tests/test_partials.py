"""Stored sums of days and daily sketches against counting everything again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import insights, partials, sketches
from tallyloom.operators.anomaly.stats import ColumnStats
from tallyloom.sources.star import load_event_sales

COLS = ["timestamp", "transaction_id", "category", "region", "total_amount", "customer_id"]


def content(df):
    return sorted(map(repr, (tuple(r) for r in df.select("dim", "period", "key", F.col("revenue").cast("decimal(38,2)"), "n").collect())))


@pytest.mark.parametrize("hour", [0, 13])
def test_merged_cells_equal_one_pass(spark, sf, tmp_path, hour):
    rows = load_event_sales(spark, sf, COLS).withColumn("product_name", F.col("category"))
    newest = rows.agg(F.max("timestamp")).first()[0]
    as_of = datetime(newest.year, newest.month, newest.day, hour)
    cells = partials.DailyCells(spark, f"{tmp_path}/cells")
    assert content(cells.summarise(rows, as_of, 7)) == content(insights.summarise(rows, as_of, 7))
    for back in (20, 12, 2):
        cells.update(rows, (as_of - timedelta(days=back)).date())
        assert cells.last_day() == (as_of - timedelta(days=back + 1)).date()
    assert content(cells.summarise(rows, as_of, 7)) == content(insights.summarise(rows, as_of, 7))
    got, want = cells.stats(rows), ColumnStats.fit(rows, ["total_amount"])
    for a, b in ((got.means, want.means), (got.stds, want.stds), (got.pops, want.pops)):
        assert a["total_amount"] == pytest.approx(b["total_amount"], rel=1e-9)


def test_updates_read_new_days_only(spark, sf, tmp_path):
    rows = load_event_sales(spark, sf, COLS)
    rows.select("timestamp", "total_amount", "category", "region", F.lit("p").alias("product_name")).write.parquet(f"{tmp_path}/sales")
    stored = spark.read.parquet(f"{tmp_path}/sales")
    cells = partials.DailyCells(spark, f"{tmp_path}/cells")
    newest = stored.agg(F.max("timestamp")).first()[0].date()
    cells.update(stored, newest - timedelta(days=3))
    plan = cells.new_rows(stored, newest)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(timestamp,{newest - timedelta(days=3)}" in plan and "PushedFilters" in plan
    assert cells.update(stored, newest - timedelta(days=3)) == 2  # nothing new: an empty step
    assert cells.last_day() == newest - timedelta(days=4)


def test_late_rows_come_in_with_a_rebuild(spark, tmp_path):
    day = datetime(2024, 5, 1)
    make = lambda n: spark.createDataFrame([(day + timedelta(days=k % 3, hours=1), 1.5, "c", "r", None) for k in range(n)] + [(None, 9.0, "c", "r", "p")],
                                           "timestamp timestamp, total_amount double, category string, region string, product_name string").withColumn("total_amount", F.col("total_amount").cast("decimal(12,2)"))
    cells = partials.DailyCells(spark, f"{tmp_path}/cells")
    cells.update(make(6), (day + timedelta(days=3)).date())
    as_of = day + timedelta(days=4)
    assert content(cells.summarise(make(6), as_of, 2)) == content(insights.summarise(make(6), as_of, 2))
    cells.rebuild(make(9), day.date())
    cells.rebuild(make(9), (day + timedelta(days=1)).date())
    cells.rebuild(make(9), (day + timedelta(days=2)).date())
    assert content(cells.summarise(make(9), as_of, 2)) == content(insights.summarise(make(9), as_of, 2))


def test_sketches_are_exact_below_their_size_and_close_above(spark):
    rows = spark.range(60_000).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("id") % 40).cast("int"))).alias("timestamp"),
                                      (F.xxhash64("id") % 9000).alias("who"), (F.col("id") % 2).alias("k"))
    last = "select date, count(distinct who) as n from (select d.date, r.who from (select distinct to_date(timestamp) as date from rows) d join rows r on to_date(r.timestamp) between date_sub(d.date, 9) and d.date) group by 1"
    rows.createOrReplaceTempView("rows")
    want = {r.date: r.n for r in spark.sql(last).collect()}
    exact = sketches.trailing_distinct(sketches.daily_sketches(rows, "who"), 10)
    assert {r.date: r.n_distinct for r in exact.collect()} == want
    rough = {r.date: r.n_distinct for r in sketches.trailing_distinct(sketches.daily_sketches(rows, "who", size=10), 10, size=10).collect()}
    assert max(abs(rough[d] - n) / n for d, n in want.items()) < 5 / 2 ** 5  # five standard errors of 1 / sqrt(1024)
    day = min(want)
    pair = sketches.distinct_between(sketches.daily_sketches(rows, "who", ("k",)), day, day + timedelta(days=50), ("k",)).collect()
    assert {r.k: r.n_distinct for r in pair} == {r.k: r.n for r in rows.groupBy("k").agg(F.countDistinct("who").alias("n")).collect()}
    assert sketches.daily_sketches(rows.limit(0), "who").count() == 0
