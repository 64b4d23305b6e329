"""Model versions, bounded history, upserts and durable counters: replays, restarts and eviction."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.anomaly.detector import AnomalyDetector
from tallyloom.sources.star import load_event_sales
from tallyloom.sources.unified import unified_scan
from tallyloom.streaming import folders, history, metrics, pipeline, scoring, sinks, upsert

FEATURES = ["quantity", "unit_price", "total_amount"]
START = datetime(2024, 3, 1)
SALES = "transaction_id string, timestamp timestamp, total_amount double"


def sales(spark, ids, amount=1.0, shift=0):
    return spark.createDataFrame([(f"t{i:04}", START + timedelta(minutes=i + shift, microseconds=7), amount) for i in ids], SALES)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_batches_pick_up_new_models_and_replays_keep_theirs(spark, sf, tmp_path):
    rows = load_event_sales(spark, sf, ["timestamp", "transaction_id", *FEATURES]).limit(600).persist()
    models = scoring.ModelTable(spark, f"{tmp_path}/models")
    with pytest.raises(LookupError):
        models.current()
    first = AnomalyDetector("isolation_forest", key=["transaction_id"]).fit(rows, FEATURES)
    second = AnomalyDetector("zscore", zscore_threshold=1.0).fit(rows, FEATURES)
    assert models.publish(first) == 1
    scorer = scoring.BatchScorer(spark, models, f"{tmp_path}/out")
    scorer(rows, 0)
    assert models.publish(second) == 2
    scorer(rows, 1)
    before = content(scorer.read())
    scoring.BatchScorer(spark, scoring.ModelTable(spark, f"{tmp_path}/models"), f"{tmp_path}/out")(rows, 0)  # a restart repeats batch 0
    assert content(scorer.read()) == before
    assert {r.model_version: r.n for r in scorer.read().groupBy("model_version").agg(F.count("*").alias("n")).collect()} == {1: 600, 2: 600}
    shown = ["transaction_id", "anomaly_score", "is_anomaly_ml"]
    for version, model in ((1, first), (2, second)):
        assert content(scorer.read().where(F.col("model_version") == version).select(*shown)) == content(model.transform(rows).select(*shown))


def test_unfinished_model_is_not_seen(spark, sf, tmp_path):
    rows = load_event_sales(spark, sf, ["timestamp", "transaction_id", *FEATURES]).limit(200)
    models, model = scoring.ModelTable(spark, f"{tmp_path}/m"), AnomalyDetector("zscore").fit(rows, FEATURES)
    models.publish(model)
    model.save(spark, f"{tmp_path}/m/version=2")  # no mark: its writer was lost
    assert models.current() == 1
    assert models.publish(model) == 2 and models.current() == 2
    models.keep(1)
    assert models.versions() == [2]
    with pytest.raises(ValueError):
        scoring.scored(rows, AnomalyDetector("dbscan").fit(rows, FEATURES))


def run_history(spark, table, path):
    table.start(pipeline.read_sales(spark, path, 1, SALES)).awaitTermination()
    return table.read()


def test_history_keeps_the_newest_over_a_restart(spark, tmp_path):
    landing = f"{tmp_path}/in"
    sales(spark, range(0, 60)).coalesce(1).write.mode("append").parquet(landing)
    sales(spark, range(30, 90), 2.0).coalesce(1).write.mode("append").parquet(landing)  # repeated ids stay once
    assert run_history(spark, history.HistoryTable(spark, f"{tmp_path}/h", 25, parts=3), landing).count() == 25
    sales(spark, [5, 200, 201], 3.0).coalesce(1).write.mode("append").parquet(landing)
    table = history.HistoryTable(spark, f"{tmp_path}/h", 25, parts=3)
    got = run_history(spark, table, landing)
    want = [f"t{i:04}" for i in [201, 200, *range(89, 66, -1)]]
    assert [r.transaction_id for r in got.collect()] == want
    assert got.where("transaction_id = 't0200'").first().timestamp == START + timedelta(minutes=200, microseconds=7)
    assert len(folders.numbers(spark, f"{tmp_path}/h/table")) <= 2
    assert content(history.HistoryTable(spark, f"{tmp_path}/h", 25).read(got.schema)) == content(got)


def test_history_evicts_by_age(spark, tmp_path):
    landing = f"{tmp_path}/in"
    for ids in (range(0, 50), range(100, 150), range(1000, 1003)):
        sales(spark, ids).coalesce(1).write.mode("append").parquet(landing)
    got = run_history(spark, history.HistoryTable(spark, f"{tmp_path}/h", 500, age="60 minutes", parts=4, delay="10 minutes"), landing)
    assert sorted(r.transaction_id for r in got.collect()) == ["t1000", "t1001", "t1002"]


def test_empty_history(spark, tmp_path):
    table = history.HistoryTable(spark, f"{tmp_path}/h")
    assert table.read() is None
    sales(spark, []).write.parquet(f"{tmp_path}/in")
    table.start(pipeline.read_sales(spark, f"{tmp_path}/in", 1, SALES)).awaitTermination()


def test_upsert_equals_the_unified_scan_and_replays_change_nothing(spark, tmp_path):
    old = sales(spark, range(0, 80)).withColumn("source_rank", F.lit(0))
    new = sales(spark, range(60, 100), 9.0).withColumn("source_rank", F.lit(1))
    late = sales(spark, [70, 71], 4.0, -500).withColumn("source_rank", F.lit(1))  # older copies lose
    table = upsert.UpsertTable(spark, f"{tmp_path}/t", "transaction_id", ["source_rank", "timestamp"], buckets=8)
    assert table.read() is None
    for n, rows in enumerate((old, new, late)):
        table(rows, n)
    want = content(unified_scan(new.unionByName(late).drop("source_rank"), old.drop("source_rank")))
    assert content(table.read().drop("source_rank")) == want
    table(late, 2)
    assert content(table.read().drop("source_rank")) == want
    again = upsert.UpsertTable(spark, f"{tmp_path}/t", "transaction_id", ["source_rank", "timestamp"], buckets=8)
    assert content(again.read().drop("source_rank")) == want


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = upsert.UpsertTable(spark, f"{tmp_path}/t", "transaction_id", ["timestamp"], buckets=8)
    table(sales(spark, range(200)), 0)
    table(sales(spark, [3], 5.0, 1), 1)
    places = table.places(1)
    assert sorted(places.values()).count(1) == 1 and set(places) == set(range(8))
    table(sales(spark, []), 2)
    assert table.places(2) == places and table.read().count() == 200
    table(sales(spark, range(200), 6.0, 2), 3)
    table(sales(spark, [1], 7.0, 3), 4)
    assert not any(folders.complete(spark, f"{tmp_path}/t/manifest/batch={n}") for n in (0, 1, 2))
    assert table.read().where("total_amount = 6").count() == 199
    null = spark.createDataFrame([(None, START, 1.0), (None, START, 2.0)], SALES)
    table(null, 5)
    assert content(table.read().where("transaction_id is null")) == [(None, START, 2.0)]


def test_counters_outlive_a_restart_and_many_batches(spark, tmp_path):
    landing, seen = f"{tmp_path}/in", []
    for k in range(3):
        sales(spark, range(10 * k, 10 * k + 10)).coalesce(1).write.mode("append").parquet(landing)

    def run():
        metered = metrics.Metered(spark, f"{tmp_path}/m", lambda batch, n: seen.append(n))
        sinks.start_batches(pipeline.read_sales(spark, landing, 1, SALES), metered, f"{tmp_path}/cp").awaitTermination()
        return metered
    assert run().totals().first()["total"] == 30
    sales(spark, range(30, 34)).coalesce(1).write.mode("append").parquet(landing)
    metered = run()
    row = metered.totals().first()
    assert (row.batches, row.total, row.first, row.last) == (4, 34, START + timedelta(microseconds=7), START + timedelta(minutes=33, microseconds=7))
    assert row.per_event_minute == pytest.approx(34 / 33)
    metered(sales(spark, range(30, 34)), 3)  # a replay counts once
    for n in range(4, 120):
        spark.range(1).select(F.lit(1).cast("long").alias("n_rows"), F.lit(START).alias("first"), F.lit(START).alias("last"), F.lit(START).alias("written")).write.parquet(f"{tmp_path}/m/batch={n}")
    assert metered.totals().first()["total"] == 34 + 116


def test_a_failed_batch_is_not_counted(spark, tmp_path):
    def broken(batch, n):
        raise ValueError("no")
    with pytest.raises(ValueError):
        metrics.Metered(spark, f"{tmp_path}/m", broken)(sales(spark, [1]), 0)
    assert folders.numbers(spark, f"{tmp_path}/m") == []
