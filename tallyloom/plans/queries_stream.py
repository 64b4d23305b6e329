"""Streaming queries: finite runs over the event table, drained and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import filters
from ..operators.anomaly import report
from ..operators.anomaly.detector import AnomalyDetector
from ..operators.anomaly.stats import ColumnStats
from ..session import fresh_path, stage
from ..sources.star import load_event_sales
from ..sources.unified import unified_scan
from ..streaming import history, metrics, pipeline, scoring, sinks, upsert
from .queries_anomaly import DETECTED, FEATURES
from .registry import on_events, plain, query, rounded

# Windows that the watermark has closed when the stream ends: one hour before the newest event.
CLOSED = "(select as_of from ref) - interval 1 hour"


@query("stream_window_kpi", on_events(f"""select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end,
  count(*) as transaction_count, cast(sum(total_amount) as double) as total_revenue from sales
group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= {CLOSED}"""))
def stream_window_kpi(spark, d):
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "total_amount"])
    return sinks.run_to_end(pipeline.windowed_kpis(sales, "1 hour"), "window-kpi")


@query("stream_daily_by_category", on_events(f"""select cast(ts as date)::timestamp as window_start, cast(ts as date)::timestamp + interval 1 day as window_end, category,
  count(*) as transaction_count, cast(sum(total_amount) as double) as total_revenue from sales
group by 1, 2, 3 having cast(ts as date)::timestamp + interval 1 day <= {CLOSED}"""))
def stream_daily_by_category(spark, d):
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "category", "total_amount"])
    return sinks.run_to_end(pipeline.windowed_kpis(sales, "1 day", keys=("category",)), "daily-kpi")


@query("stream_sliding", on_events(f"""with w as (select unnest(generate_series(date_trunc('hour', ts) + to_minutes(cast(floor(minute(ts)/15)*15 as bigint)) - interval 45 minute,
    date_trunc('hour', ts) + to_minutes(cast(floor(minute(ts)/15)*15 as bigint)), interval 15 minute)) as s, total_amount from sales)
select s as window_start, s + interval 1 hour as window_end, count(*) as transaction_count, cast(sum(total_amount) as double) as total_revenue from w
group by 1 having s + interval 1 hour <= {CLOSED}"""))
def stream_sliding(spark, d):
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "total_amount"])
    return sinks.run_to_end(pipeline.windowed_kpis(sales, "1 hour", "15 minutes"), "sliding-kpi")


@query("stream_dedupe", on_events('select transaction_id, ts as "timestamp", cast(total_amount as double) as total_amount from sales'))
def stream_dedupe(spark, d):
    """The stream united with a replay of itself holds every id once."""
    cols = ["timestamp", "transaction_id", "total_amount"]
    twice = pipeline.read_event_sales(spark, d, cols).unionByName(pipeline.read_event_sales(spark, d, cols))
    return plain(sinks.run_to_end(pipeline.deduplicate(twice), "dedupe"))


@query("stream_zscore", on_events(f"with {DETECTED} select transaction_id, round(z,4) as total_amount_zscore, severity from det where flag=1"))
def stream_zscore(spark, d):
    fitted = ColumnStats.fit(load_event_sales(spark, d, ["total_amount"]), ["total_amount"])
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    out = sinks.run_to_end(filters.flagged(pipeline.score(sales, fitted)), "zscore")
    return rounded(out.select("transaction_id", "total_amount_zscore", "severity"), "total_amount_zscore")


@query("stream_anomaly_history", on_events(f"""with {DETECTED} select transaction_id, ts as "timestamp", severity from det where flag=1 and severity in ('high','critical')
order by ts desc, transaction_id desc limit 10"""))
def stream_anomaly_history(spark, d):
    """Flagged arrivals kept as history; the newest ten of at least high severity."""
    fitted = ColumnStats.fit(load_event_sales(spark, d, ["total_amount"]), ["total_amount"])
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    history = sinks.run_to_end(filters.flagged(pipeline.score(sales, fitted)), "history")
    return report.recent(history, 10, "high").select("transaction_id", "timestamp", "severity")


@query("stream_unified", on_events('select transaction_id, ts as "timestamp", cast(total_amount as double) as total_amount from sales'))
def stream_unified(spark, d):
    """Deduplicated live rows over history that overlaps them: every id once."""
    cols = ["timestamp", "transaction_id", "total_amount"]
    rows = load_event_sales(spark, d, cols)
    history = rows.filter(F.col("timestamp") < filters.newest(rows) - timedelta(days=5))
    live = sinks.run_to_end(pipeline.deduplicate(pipeline.read_event_sales(spark, d, cols)), "live")
    return plain(unified_scan(live, history))


@query("stream_last_n", on_events('select transaction_id, ts as "timestamp", cast(total_amount as double) as total_amount from sales order by ts desc, transaction_id desc limit 1000'))
def stream_last_n(spark, d):
    base = fresh_path(spark, "last-n")
    latest = sinks.LatestTable(spark, f"{base}/latest", 1000)
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    sinks.start_batches(sales, latest, f"{base}/checkpoint").awaitTermination()
    return plain(latest.read())


@query("stream_session", on_events(f"""with g as (select *, case when ts - lag(ts) over (partition by customer_id order by ts) <= interval 30 minute then 0 else 1 end as fresh from sales),
s as (select *, sum(fresh) over (partition by customer_id order by ts rows between unbounded preceding and current row) as k from g)
select customer_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as transaction_count, cast(sum(total_amount) as double) as total_revenue
from s group by customer_id, k having max(ts) + interval 30 minute <= {CLOSED}"""))
def stream_session(spark, d):
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "customer_id", "total_amount"])
    return sinks.run_to_end(pipeline.sessions(sales), "session")


@query("stream_late_rows", on_events("""with c as (select (select as_of from ref) - interval 10 day as cut)
select transaction_id, ts as "timestamp" from sales, c where ts < cut"""))
def stream_late_rows(spark, d):
    """Newest rows land first, older ones after them: the side table holds what came too late."""
    base = fresh_path(spark, "late")
    rows = load_event_sales(spark, d, ["timestamp", "transaction_id"])
    cut = filters.newest(rows) - timedelta(days=10)
    splitter = sinks.LateSplitter(spark, f"{base}/tables")
    on_time = F.col("timestamp") >= F.lit(str(cut)).cast("timestamp")
    landing = f"{base}/landing"
    for part in (rows.filter(on_time), rows.filter(~on_time)):
        part.write.mode("append").parquet(landing)
        stream = pipeline.read_sales(spark, landing, schema=rows.schema)
        sinks.start_batches(stream, splitter, f"{base}/checkpoint").awaitTermination()
    return splitter.read("late")


@query("stream_metrics", on_events("""select false as running, count(*) as buffer_size, 10000 as max_buffer_size, count(*) as total,
  count(*) as historical_records, 2*count(*) as total_available from sales"""))
def stream_metrics(spark, d):
    """Counters of a drained stream, without the rate, which is another one each time."""
    base = fresh_path(spark, "metrics")
    sales = pipeline.read_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    counters = sinks.Counters()
    spark.streams.addListener(counters)
    try:
        run = sinks.start_append(sales, f"{base}/out", f"{base}/checkpoint")
        run.awaitTermination()
        out = spark.read.schema(sales.schema).parquet(f"{base}/out")
        stats = sinks.stream_stats(run, spark, counters, latest=out, history=load_event_sales(spark, d, ["transaction_id"]))
        return stats.drop("transactions_per_minute")
    finally:
        spark.streams.removeListener(counters)


# ------------------------------------------------------------------ fitted models, bounded history, upserts, durable counters
FOREST_COLUMNS = ["timestamp", "transaction_id", *FEATURES]


def event_batches(spark, d, columns, parts=3):
    """A landing folder with the events in ``parts`` files, oldest first, and its schema."""
    rows = load_event_sales(spark, d, columns)
    landing, first, last = f"{fresh_path(spark, 'landing')}/in", *rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    edges = [first + (last - first) * k / parts for k in range(parts)] + [None]
    for lo, hi in zip(edges, edges[1:]):
        some = rows.filter(F.col("timestamp") >= F.lit(str(lo)).cast("timestamp"))
        (some if hi is None else some.filter(F.col("timestamp") < F.lit(str(hi)).cast("timestamp"))).coalesce(1).write.mode("append").parquet(landing)
    return landing, rows.schema


def forest_scored(spark, d, landing, schema):
    """Arrivals scored by a stored isolation forest, batch by batch."""
    base = fresh_path(spark, "forest-stream")
    models = scoring.ModelTable(spark, f"{base}/models")
    models.publish(AnomalyDetector("isolation_forest", key=["transaction_id"]).fit(load_event_sales(spark, d, FOREST_COLUMNS), FEATURES))
    scorer = scoring.BatchScorer(spark, models, f"{base}/out")
    sinks.start_batches(pipeline.read_sales(spark, landing, 1, schema), scorer, f"{base}/checkpoint").awaitTermination()
    return models, scorer.read()


@query("stream_forest", on_events("""select 'scored' as outcome, count(*) as transactions from sales
union all select 'equal to batch', count(*) from sales"""))
def stream_forest(spark, d):
    """How many arrivals the streamed forest scores, and for how many of them score, flag and severity equal the batch result."""
    landing, schema = event_batches(spark, d, FOREST_COLUMNS)
    models, live = forest_scored(spark, d, landing, schema)
    shown = ["transaction_id", "anomaly_score", "is_anomaly_ml", "is_anomaly", "severity"]
    batch = models.load(1).transform(load_event_sales(spark, d, FOREST_COLUMNS)).select(*shown)
    live = stage(live.select(*shown), "live")
    same = live.join(batch.select(F.col("transaction_id").alias("id"), F.struct(*shown[1:]).alias("b")), F.expr("transaction_id = id")).where(F.struct(*shown[1:]) == F.col("b"))
    count = lambda name, rows: rows.agg(F.lit(name).alias("outcome"), F.count("*").alias("transactions"))
    return count("scored", live).unionByName(count("equal to batch", same))


@query("stream_forest_scores")
def stream_forest_scores(spark, d):
    """Scores, flags and severity that a stored isolation forest gives each arrival, in the streaming plan itself."""
    fitted = AnomalyDetector("isolation_forest", key=["transaction_id"]).fit(load_event_sales(spark, d, FOREST_COLUMNS), FEATURES)
    models = scoring.ModelTable(spark, fresh_path(spark, "models"))
    stored = models.load(models.publish(fitted))
    out = sinks.run_to_end(scoring.scored(pipeline.read_event_sales(spark, d, FOREST_COLUMNS), stored), "forest-scores")
    return out.select("transaction_id", "anomaly_score", "is_anomaly_ml", "is_anomaly", "severity")


def flagged_arrivals(spark, d, landing, schema, threshold=3.0):
    fitted = ColumnStats.fit(load_event_sales(spark, d, ["total_amount"]), ["total_amount"])
    stream = filters.flagged(pipeline.score(pipeline.read_sales(spark, landing, 1, schema), fitted, threshold))
    return stream.select("timestamp", "transaction_id", F.col("total_amount").cast("double").alias("total_amount"), "severity")


@query("stream_bounded_history", on_events(f"""with {DETECTED} select transaction_id, ts as "timestamp", cast(total_amount as double) as total_amount, severity
from det where abs(z)>1 order by ts desc, transaction_id desc limit 1000"""))
def stream_bounded_history(spark, d):
    """The newest 1,000 arrivals beyond one standard deviation, kept in state with eviction; the stream is stopped and restarted on the way."""
    cols = ["timestamp", "transaction_id", "total_amount"]
    rows = load_event_sales(spark, d, cols)
    table = history.HistoryTable(spark, fresh_path(spark, "bounded"), 1000)
    landing, cut = fresh_path(spark, "arrivals"), F.lit(str(filters.newest(rows) - timedelta(days=8))).cast("timestamp")
    for part in (rows.filter(F.col("timestamp") < cut), rows.filter(F.col("timestamp") >= cut)):
        part.write.mode("append").parquet(landing)
        table.start(flagged_arrivals(spark, d, landing, rows.schema, 1.0)).awaitTermination()
    return table.read()


@query("stream_aged_history", on_events(f"""with {DETECTED} select transaction_id, ts as "timestamp", severity from det
where flag=1 and ts > (select max(ts) from det where flag=1) - interval 1 hour - interval 5 day order by ts desc, transaction_id desc limit 1000"""))
def stream_aged_history(spark, d):
    """Flagged arrivals that are at most five days behind the watermark: older ones are evicted by timers."""
    landing, schema = event_batches(spark, d, ["timestamp", "transaction_id", "total_amount"], 4)
    table = history.HistoryTable(spark, fresh_path(spark, "aged"), 1000, age="5 days")
    table.start(flagged_arrivals(spark, d, landing, schema)).awaitTermination()
    return table.read().select("transaction_id", "timestamp", "severity")


@query("stream_upsert", on_events("""with live as (select * from sales where ts >= (select as_of from ref) - interval 12 day),
past as (select * from sales where ts < (select as_of from ref) - interval 8 day)
select transaction_id, ts as "timestamp", cast(total_amount as double) as total_amount from live
union all select transaction_id, ts, cast(total_amount + 1 as double) from past where transaction_id not in (select transaction_id from live)"""))
def stream_upsert(spark, d):
    """History and, in three batches, arrivals that correct part of it: one row an id, the arrival's if there is one."""
    rows = load_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    as_of = filters.newest(rows)
    past = rows.filter(F.col("timestamp") < as_of - timedelta(days=8)).withColumn("total_amount", (F.col("total_amount") + 1).cast("decimal(12,2)"))
    live = rows.filter(F.col("timestamp") >= as_of - timedelta(days=12))
    landing, base = fresh_path(spark, "changes"), fresh_path(spark, "upsert")
    table = upsert.UpsertTable(spark, f"{base}/table", "transaction_id", ["source_rank", "timestamp"])
    ordered = [past.withColumn("source_rank", F.lit(0))] + [live.filter(F.pmod(F.xxhash64("transaction_id"), F.lit(2)) == k).withColumn("source_rank", F.lit(1)) for k in range(2)]
    for part in ordered:
        part.write.mode("append").parquet(landing)
        sinks.start_batches(pipeline.read_sales(spark, landing, schema=part.schema), table, f"{base}/checkpoint").awaitTermination()
    return plain(table.read().drop("source_rank"))


@query("stream_counters", on_events("""select 3 as batches, count(*) as total, min(ts) as first, max(ts) as last,
  round(count(*) / greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) * 60, 6) as per_event_minute from sales"""))
def stream_counters(spark, d):
    """Counters kept by the batches themselves, over a restart after the first file."""
    landing, schema = event_batches(spark, d, ["timestamp", "transaction_id", "total_amount"])
    base = fresh_path(spark, "counters")
    for _ in range(2):  # the second start finds nothing new and counts nothing twice
        latest = sinks.LatestTable(spark, f"{base}/latest", 1000)
        metered = metrics.Metered(spark, f"{base}/metrics", latest)
        sinks.start_batches(pipeline.read_sales(spark, landing, 1, schema), metered, f"{base}/checkpoint").awaitTermination()
    return rounded(metered.totals().select(F.col("batches").cast("int").alias("batches"), "total", "first", "last", "per_event_minute"), "per_event_minute", digits=6)


@query("stream_callbacks", on_events("""select category, count(*) as n, cast(sum(total_amount) as double) as total from sales group by 1"""))
def stream_callbacks(spark, d):
    """Two handlers of every batch, one of which always fails: the other's table is whole."""
    base, calls = fresh_path(spark, "callbacks"), sinks.Callbacks()

    def broken(batch, batch_id):
        raise RuntimeError("a handler that fails")
    calls.add(broken)
    calls.add(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}"))
    landing, schema = event_batches(spark, d, ["timestamp", "transaction_id", "category", "total_amount"])
    sinks.start_batches(pipeline.read_sales(spark, landing, 1, schema), calls, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("category").agg(F.count("*").alias("n"), F.sum("total_amount").cast("double").alias("total"))
