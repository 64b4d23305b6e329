from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators.anomaly.stats import ColumnStats, detect_by_zscore
from tallyloom.plans import jobs
from tallyloom.sources.star import load_event_sales, load_sales
from tallyloom.streaming import pipeline, sinks


def write_parts(rows, path, cuts):
    """Files in event-time order, one append per part."""
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = rows
        if lo is not None:
            part = part.filter(F.col("timestamp") >= lo)
        if hi is not None:
            part = part.filter(F.col("timestamp") < hi)
        part.write.mode("append").parquet(path)


def test_restart_adds_nothing_and_windows_match(spark, sf, tmp_path):
    rows = load_event_sales(spark, sf)
    first = rows.agg(F.min("timestamp")).first()[0]
    write_parts(rows, f"{tmp_path}/in", [first + timedelta(days=10), first + timedelta(days=20)])
    def run():
        stream = pipeline.windowed_kpis(pipeline.read_sales(spark, f"{tmp_path}/in", 1, rows.schema), "1 day")
        sinks.start_append(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")
    got = {r.window_start: (r.transaction_count, round(r.total_revenue, 2)) for r in run().collect()}
    newest = rows.agg(F.max("timestamp")).first()[0]
    days = rows.groupBy(F.window("timestamp", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("double").alias("v"))
    want = {r.w.start: (r.n, round(r.v, 2)) for r in days.collect() if r.w.end <= newest - timedelta(hours=1)}
    assert got == want
    assert run().count() == len(want)


def test_scores_match_batch(spark, sf):
    rows = load_event_sales(spark, sf, ["timestamp", "transaction_id", "total_amount"])
    stats = ColumnStats.fit(rows, ["total_amount"])
    stream = pipeline.score(pipeline.read_event_sales(spark, sf, rows.columns), stats)
    live = sinks.run_to_end(stream, "test-score")
    assert live.exceptAll(detect_by_zscore(rows, stats)).count() == 0 and live.count() == rows.count()


def test_callbacks_are_isolated(spark, sf, tmp_path):
    seen = []
    calls = sinks.Callbacks()
    def broken(batch, batch_id):
        raise ValueError("no")
    calls.add(broken)
    calls.add(lambda batch, batch_id: seen.append(batch.count()))
    stream = pipeline.read_event_sales(spark, sf, ["timestamp", "transaction_id"])
    sinks.start_batches(stream, calls, f"{tmp_path}/cp").awaitTermination()
    assert sum(seen) == load_event_sales(spark, sf, ["transaction_id"]).count()
    calls.remove(broken)
    assert len(calls.handlers) == 1


def test_latest_table_replay(spark, sf, tmp_path):
    rows = load_event_sales(spark, sf, ["timestamp", "transaction_id"])
    table = sinks.LatestTable(spark, f"{tmp_path}/t", 10)
    assert table.read() is None
    old = rows.orderBy("timestamp").limit(30)
    table(old, 0)
    table(rows, 1)
    table(rows, 1)
    want = rows.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(10)
    assert table.read().exceptAll(want).count() == 0 and table.read().count() == 10


def test_late_rows_go_aside(spark, tmp_path):
    make = lambda *hours: spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(hours=h), str(h)) for h in hours], "timestamp timestamp, transaction_id string")
    split = sinks.LateSplitter(spark, f"{tmp_path}/s", "2 hours")
    split(make(10, 11), 0)
    split(make(12, 8, 9), 1)
    split(make(12, 8, 9), 1)
    split(make(9, 13), 2)
    assert sorted(r.transaction_id for r in split.read("late").collect()) == ["8", "9"]
    assert split.read("on_time").count() == 5


def test_counters(spark, sf, tmp_path):
    stream = pipeline.read_event_sales(spark, sf, ["timestamp", "transaction_id"])
    counters = sinks.Counters()
    spark.streams.addListener(counters)
    run = sinks.start_append(stream, f"{tmp_path}/o", f"{tmp_path}/c")
    run.awaitTermination()
    history = load_sales(spark, sf, ["transaction_id"])
    row = sinks.stream_stats(run, spark, counters, latest=spark.read.parquet(f"{tmp_path}/o"), history=history).first()
    assert row.total == row.buffer_size == 1000 and row.total_available == 1000 + row.historical_records
    spark.streams.removeListener(counters)


def test_counters_of_more_batches_than_spark_remembers(spark, tmp_path):
    spark.range(0, 130, 1, 130).selectExpr("id", "timestamp_seconds(id) as timestamp").write.parquet(f"{tmp_path}/in")
    counters = sinks.Counters()
    spark.streams.addListener(counters)
    stream = spark.readStream.schema("id bigint, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = sinks.start_append(stream, f"{tmp_path}/o", f"{tmp_path}/c")
    run.awaitTermination()
    assert len(run.recentProgress) <= 100 < counters.batch.get(str(run.id), 200)
    assert sinks.stream_stats(run, spark, counters).first().total == 130
    spark.streams.removeListener(counters)


def test_jobs(spark, sf, tmp_path):
    sales = load_sales(spark, sf)
    found = jobs.train_anomaly(sales, f"{tmp_path}/model")
    assert found.contamination == 0.02
    scored = jobs.score_anomalies(sales, f"{tmp_path}/scored", f"{tmp_path}/model")
    assert {"is_anomaly", "severity", "category_encoded"} <= set(scored.columns)
    assert 0.01 < scored.agg(F.avg("is_anomaly_ml")).first()[0] < 0.04
    out = jobs.refresh_insights(sales, f"{tmp_path}/insights")
    assert out.filter("rule = 'volume'").count() == 1
    jobs.refresh_insights(sales, f"{tmp_path}/insights")


def test_timed_refresh(spark, sf, tmp_path):
    import time
    done = []
    def refresh(batch, batch_id):
        batch.groupBy("category").count().write.mode("overwrite").parquet(f"{tmp_path}/table")
        done.append(batch_id)
    stream = pipeline.read_event_sales(spark, sf, ["category"])
    run = sinks.start_refresh(stream, refresh, f"{tmp_path}/cp", every="1 second")
    for _ in range(60):
        if done:
            break
        time.sleep(0.5)
    run.stop()
    assert done and spark.read.parquet(f"{tmp_path}/table").count() == 5
