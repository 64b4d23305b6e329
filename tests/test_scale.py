"""What keeps the work of large tables in bounds: inputs read once, few shuffles, no task that holds a label or a range too many."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import dedupe, features, quality
from tallyloom.operators.anomaly import forest
from tallyloom.plans import jobs, queries_insights
from tallyloom.sources import star
from tallyloom.sources.star import load_sales


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Joins as on tables too large to be broadcast by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def counted(spark, rows, schema):
    """A frame of ``rows`` and an accumulator of the rows that were read from it."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    return spark.createDataFrame(rows, schema).mapInPandas(read, schema), seen


SALE = "timestamp string, transaction_id string, quantity string, unit_price double, total_amount double, category string, customer_id string"


def sales(n=300):
    rows = [(str(date(2024, 1, 1) + timedelta(days=i % 60)), f"t{i}", str(1 + i % 5), 2.0 + i % 7, 3.0 + i, "ab"[i % 2], f"c{i % 9}") for i in range(n)]
    return rows + [rows[0], rows[7]]


def test_cleaning_reads_its_rows_once(spark):
    df, seen = counted(spark, sales(), SALE)
    assert quality.clean(df).count() == 300 and seen.value == 302


def test_training_reads_its_rows_once(spark, monkeypatch):
    class Stop(Exception):
        pass

    def model(*_, **__):
        raise Stop
    monkeypatch.setattr(jobs, "SalesForecastModel", model)
    df, seen = counted(spark, sales(), SALE)
    with pytest.raises(Stop):
        jobs.train_forecast(df)
    assert seen.value == 302
    with pytest.raises(ValueError, match="100 sales"):
        jobs.train_forecast(df.limit(99))
    same = df.limit(0).unionByName(spark.createDataFrame([sales()[0]] * 100, SALE))
    with pytest.raises(Stop):
        jobs.train_forecast(same)


def test_lines_are_shuffled_twice(spark, sf, no_broadcast):
    p = plan(load_sales(spark, sf, queries_insights.FIGURES))
    before_parts = p.split("hashpartitioning(l_partkey")[1]
    assert "hashpartitioning(l_orderkey" in before_parts and "hashpartitioning(o_custkey" not in p.split("hashpartitioning(l_orderkey")[0]


def test_few_recent_orders_go_to_the_lines(spark, sf, no_broadcast, monkeypatch):
    since = datetime(2001, 7, 1)
    got = load_sales(spark, sf, None, since)
    assert "hashpartitioning(l_orderkey" not in plan(got)
    newest = star.latest_sale(spark, sf)
    monkeypatch.setattr(star, "BROADCAST_ORDERS", 0)
    want = load_sales(spark, sf, None, since)
    assert "hashpartitioning(l_orderkey" in plan(want)
    assert got.count() and not got.exceptAll(want).count() and not want.exceptAll(got).count()
    assert star.latest_sale(spark, sf) == newest == load_sales(spark, sf, ["timestamp"]).agg(F.max("timestamp")).first()[0]


def test_insights_join_the_sales_once(spark, sf, monkeypatch):
    whole, load = [], queries_insights.load_sales

    def loading(spark, d, columns=None, since=None):
        if since is None:
            whole.append(columns)
        return load(spark, d, columns, since)
    monkeypatch.setattr(queries_insights, "load_sales", loading)
    assert queries_insights.everything(spark, sf).count() and len(whole) == 1


def test_incremental_refresh_reads_joined_sales(spark, sf, monkeypatch):
    files = []

    def refresh(rows, *args, **kwargs):
        files.extend(rows.inputFiles())
        return jobs_refresh(rows, *args, **kwargs)
    jobs_refresh = jobs.refresh_insights_incrementally
    monkeypatch.setattr(jobs, "refresh_insights_incrementally", refresh)
    assert queries_insights.job_refresh_incrementally(spark, sf).count()
    assert files and not any("lineitem" in f or "orders" in f for f in files)


def test_labels_do_not_gather_rows(spark, no_broadcast):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "ab"[i % 2], None if i % 3 else "x") for i in range(30)],
                               "timestamp timestamp, category string, region string")
    out = features.engineer(df)
    p = plan(out)
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p and p.count("BroadcastHashJoin") == 2
    assert {(r.category, r.region, r.category_encoded, r.region_encoded) for r in out.collect()} == {
        ("a", "x", 0, 1), ("b", "x", 1, 1), ("a", None, 0, 0), ("b", None, 1, 0)}
    assert "SortMergeJoin" not in plan(features.encode(df, "category", features.fit_labels(df, "category")))


def test_filling_keeps_to_ranges(spark):
    values = [None if i < 250 or i % 7 or 1000 < i < 1400 else str(i) for i in range(3_000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(8)
    out = quality.forward_fill_rows(df, "v", ["i"], range_rows=100)
    assert ", 30)" in plan(out).split("hashpartitioning(_range")[1][:40]
    want = pd.Series([float(v) if v else np.nan for v in values]).ffill().bfill()
    assert np.allclose([r.v for r in out.orderBy("i").collect()], want)
    empty = quality.forward_fill_rows(df.filter("i < 250"), "v", ["i"], range_rows=100)
    assert empty.count() == 250 and empty.filter("v is not null").count() == 0


@pytest.mark.parametrize("width", [1, 3, 5])
def test_grid_gives_the_leaves_of_the_walk(width, monkeypatch):
    rng = np.random.default_rng(width)
    nodes = []
    for t in range(10):
        x = np.round(rng.normal(size=(256, width)), 1)
        nodes += [(t, i, n["feature"], n["threshold"], n["left"], n["right"], n["path"])
                  for i, n in enumerate(forest._grow(x, np.random.default_rng(t), 8))]
    feature, cut, path, levels = forest._complete(nodes)
    cuts, grids = forest._grids(feature, cut, path, levels, width)
    x = np.round(rng.normal(size=(2_000, width)) * 2, 1)
    x[:3], x[3:6] = np.inf, -np.inf
    x[10:10 + min(50, len(cuts[0])), 0] = cuts[0][:50]
    below = [np.searchsorted(c, v) for c, v in zip(cuts, x.T)]
    for f, c, p, (steps, leaf, lengths) in ((*t, g) for *t, g in zip(feature, cut, path, grids) if g):
        cell = sum(s[r] for s, r in zip(steps, below))
        assert (lengths[leaf[cell]] == p[forest._walk(x, f, c, levels)]).all()
    assert any(grids)
    monkeypatch.setattr(forest, "GRID_CELLS", 0)
    assert not any(forest._grids(feature, cut, path, levels, width)[1])


def test_forest_scores_by_grid_and_by_walk_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"i": range(2_000), "a": rng.normal(size=2_000), "b": rng.integers(0, 9, 2_000).astype(float)}))
    df = df.withColumn("a", F.when(F.col("i") % 50 == 0, F.lit(float("nan"))).when(F.col("i") % 51 == 0, None).otherwise(F.col("a")))
    model = forest.fit_forest(df.filter("i % 50 <> 0"), ["a", "b"], trees=20, key=["i"])
    score = lambda: [r.s for r in df.select("i", model.score_column(spark).alias("s")).orderBy("i").collect()]
    by_grid = score()
    monkeypatch.setattr(forest, "GRID_CELLS", 0)
    assert by_grid == score()


def test_distinct_keys_stay_where_they_are(spark, monkeypatch):
    rows = [(f"k{i}", i % 5, float(i)) for i in range(400)] + [("k7", 0, 1.0), ("k7", 0, 2.0), ("k9", 4, 9.0), ("k9", 4, 9.0), (None, 2, 1.0), (None, 1, 5.0)]
    df = spark.createDataFrame(rows, "id string, day int, v double")
    want = {(r.id, r.day, r.v) for r in dedupe.keep_first(df, "id", ["day"]).collect()}
    got = dedupe.keep_first_staged(df, "id", ["day"])
    assert "LeftAnti" in plan(got) and len(want) == 401 and ("k7", 0, 1.0) in want and (None, 1, 5.0) in want
    assert sorted(got.collect(), key=str) == sorted(dedupe.keep_first(df, "id", ["day"]).collect(), key=str) and got.columns == df.columns
    monkeypatch.setattr(dedupe, "BROADCAST_KEYS", 2)
    assert {(r.id, r.day, r.v) for r in dedupe.keep_first_staged(df, "id", ["day"]).collect()} == want
    twice = df.unionByName(df)
    assert "LeftAnti" not in plan(dedupe.keep_first_staged(twice, "id", ["day"]))
    assert dedupe.keep_first_staged(df.limit(0), "id", ["day"]).count() == 0
