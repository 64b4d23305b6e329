import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.operators import aggregates, dedupe, features, filters, insights, kpis, quality, ranking, series
from tallyloom.operators.quantiles import exact_quantiles, weighted_quantile
from tallyloom.plans.analytics import SalesAnalytics
from tallyloom.schema import SALES_SCHEMA
from tallyloom.sources import files, unified
from tallyloom.sources.star import load_event_sales, load_newest_sales, load_sales


def sales_rows(spark, rows):
    """rows: (timestamp, id, category, region, amount)"""
    return spark.createDataFrame(
        [(t, i, "P1", "thing", c, 1, float(a), float(a), r, f"c{i}", "cash") for t, i, c, r, a in rows],
        "timestamp timestamp, transaction_id string, product_id string, product_name string, category string, "
        "quantity bigint, unit_price double, total_amount double, region string, customer_id string, payment_method string")


def test_resample_gaps(spark):
    rows = sales_rows(spark, [(datetime(2024, 1, d), str(d), "a", "x", 10.0 * d) for d in (1, 7, 10)])
    weekly = {r.timestamp: r.total_amount for r in aggregates.resample(rows, "total_amount", "W", "sum").collect()}
    assert weekly == {date(2024, 1, 7): 80.0, date(2024, 1, 14): 100.0}
    daily = {r.timestamp: r.total_amount for r in aggregates.resample(rows, "total_amount", "D", "mean").collect()}
    assert len(daily) == 10 and daily[date(2024, 1, 2)] is None and daily[date(2024, 1, 7)] == 70.0
    sums = {r.timestamp: r.total_amount for r in aggregates.resample(rows, "total_amount", "D", "odd").collect()}
    assert sums[date(2024, 1, 2)] == 0.0
    assert aggregates.resample(rows.limit(0), "total_amount").count() == 0


def test_rolling_matches_pandas(spark):
    rng = np.random.default_rng(0)
    y = rng.uniform(1, 100, 50)
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=50), "y": y})
    rows = sales_rows(spark, [(d.to_pydatetime(), str(i), "a", "x", v) for i, (d, v) in enumerate(zip(pdf["date"], y))])
    got = series.daily_features(rows).orderBy("date").toPandas()
    for n in (7, 14, 30):
        for k in ("mean", "std", "min", "max"):
            want = getattr(pdf["y"].rolling(n), k)().bfill().fillna(0)
            assert np.allclose(got[f"revenue_rolling_{k}_{n}d"], want)
        assert np.allclose(got[f"revenue_lag_{n}"], pdf["y"].shift(n).bfill().fillna(0))
    assert np.allclose(got["week_over_week_change"], pdf["y"].pct_change(7).bfill().fillna(0))
    causal = series.daily_features(rows, mode="causal", fill="none").orderBy("date").toPandas()
    assert np.allclose(causal["revenue_rolling_mean_7d"][7:], pdf["y"].rolling(7).mean().shift(1)[7:])
    assert "transaction_count" not in causal


def test_back_fill(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), None), (date(2024, 1, 2), 2.0), (date(2024, 1, 3), None)], "date date, v double")
    assert [r.v for r in series.back_fill(df, ["v"]).orderBy("date").collect()] == [2.0, 2.0, 0.0]
    assert [r.v for r in series.forward_fill(df, ["v"]).orderBy("date").collect()] == [2.0, 2.0, 2.0]


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 5, "p"), (None, 4, "q")], "k string, o int, v string")
    assert {(r.k, r.v) for r in dedupe.keep_first(df, "k", ["o"]).collect()} == {("a", "x"), (None, "q")}
    assert {(r.k, r.v) for r in dedupe.keep_last(df, "k", ["o"]).collect()} == {("a", "y"), (None, "p")}
    plan = dedupe.keep_first(df, "k", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


@pytest.mark.parametrize("kind", ["spread", "hot", "two"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=20_000),
         "hot": np.concatenate([np.full(8_000, 1.5), rng.exponential(size=12_000)]),
         "two": np.concatenate([np.zeros(10_000), np.ones(10_000)])}[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    big = exact_quantiles(df, {"x": ps}, small=200)
    for p in ps:
        assert math.isclose(big["x", p], np.percentile(x, 100 * p), rel_tol=1e-12, abs_tol=1e-12)
    few = df.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    for p in (0.05, 0.5, 0.95):
        assert math.isclose(weighted_quantile(few, "x", "w", p), np.percentile(x, 100 * p), rel_tol=1e-12, abs_tol=1e-12)
    assert exact_quantiles(df.limit(0), {"x": [0.5]})["x", 0.5] is None


def test_forward_fill_rows(spark):
    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.6 else str(i) for i in range(3_000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(8)
    got = [r.v for r in quality.forward_fill_rows(df, "v", ["i"]).orderBy("i").collect()]
    want = pd.Series([float(v) if v else np.nan for v in values]).ffill().bfill()
    assert np.allclose(got, want)


def test_clean_small(spark):
    rows = [("2024-01-01", "a", "2", 10.0, 20.0, None), ("2024-01-01", "a", "3", 10.0, 30.0, "x"), ("bad", "b", "1", 1.0, 1.0, "x"),
            ("2024-01-02", "c", "0", -1.0, 5.0, "y"), ("2024-01-03", "d", "abc", 8.0, 16.0, "z")]
    df = spark.createDataFrame(rows, "timestamp string, transaction_id string, quantity string, unit_price double, total_amount double, category string")
    got = {r.transaction_id: r for r in quality.clean(df, ordered=True).collect()}
    assert set(got) == {"a", "c", "d"} and not any(r.is_extreme for r in got.values())
    assert got["a"].quantity == 2.0 and got["a"].category == "Unknown"
    assert got["c"].quantity == 1.0 and got["c"].unit_price == 8.0 and got["c"].total_amount == 8.0
    assert got["d"].quantity == 2.0 and got["d"].total_amount == 16.0


def test_validation(spark):
    rows = sales_rows(spark, [(datetime(2024, 1, 1), "1", "a", "x", -5.0)])
    valid, errors = quality.is_valid(rows)
    assert valid and len(errors) == 1 and "negative" in errors[0]
    valid, errors = quality.is_valid(rows.withColumn("region", F.lit(None).cast("string")))
    assert not valid and any("nulls region" in e for e in errors)
    assert quality.missing_columns(rows.drop("category")) == ["category"]
    assert not quality.is_valid(rows.limit(0))[0]
    with pytest.raises(ValueError, match="validation"):
        features.pipeline(rows.drop("category"))


def test_encoding(spark):
    train = sales_rows(spark, [(datetime(2024, 1, 1), str(i), c, "x", 1.0) for i, c in enumerate(["b", "Unknown", "c"])])
    codes = features.fit_labels(train, "category")
    new = sales_rows(spark, [(datetime(2024, 1, 1), "1", "zzz", "x", 1.0), (datetime(2024, 1, 1), "2", "c", "x", 1.0)])
    got = {r.transaction_id: r.category_encoded for r in features.encode(new, "category", codes).collect()}
    assert got == {"1": 0, "2": 2}


def test_inject_in_order(spark):
    rows = sales_rows(spark, [(datetime(2024, 1, 1, 5), "1", "a", "x", 10.0), (datetime(2024, 1, 2), "2", "a", "x", 10.0)])
    got = {r.transaction_id: (r.total_amount, r.is_anomaly) for r in filters.inject_events(rows, [
        {"type": "spike", "date": "2024-01-01", "magnitude": 2.5}, {"type": "drop", "date": "2024-01-01", "magnitude": 5.0}]).collect()}
    assert got == {"1": (5.0, True), "2": (10.0, False)}


def test_kpis_on_nothing(spark):
    rows = sales_rows(spark, [(datetime(2024, 1, 1), "1", "a", "x", 1.0)]).limit(0)
    r = kpis.summary(rows, datetime(2024, 1, 1)).first()
    assert r.total_revenue == 0 and r.transaction_count == 0 and r.avg_order_value == 0 and r.top_category is None
    r = kpis.realtime(rows, datetime(2024, 1, 1)).first()
    assert r.revenue_per_minute == 0 and r.sample_size == 0
    assert kpis.from_two_sets(rows).first().total_revenue == 0


def test_unified(spark):
    history = sales_rows(spark, [(datetime(2024, 1, d), str(d), "a", "x", 1.0) for d in (1, 2, 3)])
    live = sales_rows(spark, [(datetime(2024, 1, 3), "3", "a", "x", 9.0), (datetime(2024, 1, 4), "4", "a", "x", 1.0)])
    rows = unified.unified_scan(live, history).collect()
    assert [(r.transaction_id, r.total_amount) for r in rows] == [("1", 1.0), ("2", 1.0), ("3", 9.0), ("4", 1.0)]
    assert [r.transaction_id for r in unified.unified_scan(live, history, limit=2).collect()] == ["3", "4"]
    assert unified.unified_scan(live, history, limit=0).count() == 4


def test_insight_rules(spark):
    as_of = datetime(2024, 3, 31)
    rows = [(as_of - timedelta(days=d), f"n{d}", "up" if d % 2 else "flat", "east", 300.0 if d < 7 else 100.0) for d in range(28)]
    rows += [(as_of - timedelta(days=40 + d), f"o{d}", "up", "east", 50.0) for d in range(10)]
    rows += [(as_of - timedelta(days=40), "w", "flat", "west", 900.0), (as_of, "w2", "flat", "west", 10.0)]
    got = insights.generate(sales_rows(spark, rows), as_of).collect()
    by_rule = {r.rule: r for r in got}
    assert [r.priority for r in got] == sorted(r.priority for r in got)
    assert by_rule["volume"].title == "29 Transactions Processed"
    assert by_rule["region_decline"].title == "west Underperforming" and by_rule["region_decline"].priority_label == "high"
    assert by_rule["weekly_trend"].title == "Weekly Trend: Upward"
    assert by_rule["best_worst_day"].data["best_day"] == "2024-03-31"
    assert insights.generate(sales_rows(spark, rows).limit(0), as_of).count() == 0
    assert insights.top(insights.generate(sales_rows(spark, rows), as_of), 2).count() == 2


def test_forecast_insight_variants(spark):
    ahead = spark.createDataFrame([(date(2024, 1, d), 100.0) for d in (1, 2)], "date date, value double")
    figs = insights.forecast_plain_figures(ahead)
    row = insights.present("forecast_plain", figs, datetime(2024, 1, 1)).first()
    assert row.title == "2-Day Revenue Forecast" and "$200.00 (avg $100.00/day)" in row.message


def test_surface(spark, sf):
    from tallyloom.operators.anomaly.detector import AnomalyDetector
    rows = load_event_sales(spark, sf).withColumn("product_name", F.col("category"))
    found = AnomalyDetector("zscore").fit(rows, ["total_amount"])
    site = SalesAnalytics(rows, detector=found)
    page, total = site.transactions(limit=5000, offset=10)
    assert total.first().total == rows.count() and page.count() == min(5000, rows.count() - 10)
    assert site.live_sales(7).count() == 7
    assert site.by_category().count() == 5 and site.by_region().count() <= 5
    for g in ("daily", "hourly", "weekly", "raw"):
        assert site.sales_history(10, g).count() > 0
    assert site.trends(10, "weekly").count() <= 10
    assert site.kpi_summary(7).first().anomaly_count == site.anomalies(7).count()
    assert site.anomaly_report(30).first().total_anomalies > 0
    assert site.insights("product").filter("type <> 'product'").count() == 0
    assert site.top_insights(3).count() == 3 and site.kpi_realtime().count() == 1
    with pytest.raises(RuntimeError):
        site.forecast()


def test_no_caps(spark):
    from datetime import timedelta
    now = datetime(2024, 1, 1, 12)
    rows = [(now - timedelta(seconds=i), str(i), "a", "x", 1.0) for i in range(6000)]
    df = sales_rows(spark, rows)
    assert kpis.realtime(df, now).first().sample_size == 3601
    assert kpis.realtime(df, now, sample=10).first().sample_size == 10
    assert ranking.page(df, 5000).count() == 5000
    flagged = quality.flag_extremes(df.limit(50))
    assert flagged.count() == 50 and not flagged.filter("is_extreme").count()
    with pytest.raises(ValueError):
        numbers.checked_horizon(31)


def test_detector_counts_in_the_figures(spark, sf):
    from tallyloom.operators.anomaly.detector import AnomalyDetector
    rows = load_event_sales(spark, sf).withColumn("product_name", F.col("category"))
    found = AnomalyDetector("isolation_forest", key=["transaction_id"]).fit(rows, ["quantity", "total_amount"])
    site = SalesAnalytics(rows, detector=found)
    assert site.kpi_summary(30).first().anomaly_count == site.anomalies(30).count() > 0


@pytest.mark.parametrize("columns", [["transaction_id", "total_amount"], ["quantity", "unit_price", "category"]])
def test_lines_alone_are_read_without_a_join_of_orders(spark, sf, columns):
    assert "o_orderkey" not in plan(load_sales(spark, sf, columns))


def test_files(spark, sf, tmp_path):
    rows = load_sales(spark, sf)
    files.write_csv(rows, f"{tmp_path}/csv")
    back = files.read_transactions(spark, f"{tmp_path}/csv", "csv")
    assert back.schema == SALES_SCHEMA and back.count() == rows.count()
    assert back.exceptAll(rows).count() == 0
    files.write_table(rows, f"{tmp_path}/table")
    assert files.read_transactions(spark, f"{tmp_path}/table").count() == rows.count()
    monthly = files.read_transactions(spark, f"{tmp_path}/table", by_month=True)
    recent = filters.trailing(monthly, 30, datetime(2001, 7, 30))
    assert "month#" in plan(recent).split("PartitionFilters: [")[1].split("]")[0]
    assert recent.count() == filters.trailing(rows, 30, datetime(2001, 7, 30)).count()
    files.add_transactions(spark, [rows.first().asDict()], f"{tmp_path}/landing")
    assert files.read_transactions(spark, f"{tmp_path}/landing").count() == 1
    files.export_csv(rows.limit(3), f"{tmp_path}/export")
    line = spark.read.text(f"{tmp_path}/export").filter("value like '\"1%' or value like '\"2%'").first()[0]
    assert line.startswith('"') and line.endswith('"')
    record = files.to_records(spark.createDataFrame([(1.0, float("nan"), None)], "a double, b double, c string")).first()[0]
    assert record == '{"a":1.0,"b":null,"c":null}'


# ------------------------------------------------------------------ plans
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark, sf):
    p = plan(aggregates.by_category(load_sales(spark, sf, since=datetime(2001, 7, 1))))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_only_needed_tables_and_columns(spark, sf):
    p = plan(aggregates.daily(load_sales(spark, sf, ["timestamp", "transaction_id", "quantity", "unit_price", "total_amount", "customer_id"])))
    assert "part.parquet" not in p and "customer.parquet" not in p and "l_comment" not in p
    p = plan(aggregates.revenue_by(load_sales(spark, sf, ["timestamp", "transaction_id", "total_amount"]), "timestamp", "t"))
    assert "l_discount" not in p and "o_totalprice" not in p


def test_no_python_in_sql_paths(spark, sf):
    for df in (series.daily_features(load_sales(spark, sf)), aggregates.by_region(load_sales(spark, sf)), ranking.trend(load_sales(spark, sf))):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df)


def test_tail_is_enough(spark, sf):
    want = [r.transaction_id for r in unified.latest(load_sales(spark, sf), 50).collect()]
    tail = load_newest_sales(spark, sf, 50)
    assert [r.transaction_id for r in unified.latest(tail, 50).collect()] == want
    assert "GreaterThanOrEqual(o_orderdate" in plan(tail)
    assert load_newest_sales(spark, sf, 10 ** 9).count() == load_sales(spark, sf).count()
