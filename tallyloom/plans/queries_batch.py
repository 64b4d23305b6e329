"""Scans, aggregates, windows, functions and quality queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, labels, numbers
from ..operators import aggregates, dedupe, features, filters, kpis, quality, ranking, series, sketches
from ..operators.anomaly.detector import AnomalyDetector
from ..operators.quantiles import exact_quantiles
from ..session import fresh_path, stage
from ..sources import files, unified
from ..sources.star import latest_sale, load_dirty_sales, load_event_sales, load_newest_sales, load_sales
from .analytics import SalesAnalytics
from .registry import (ROLLED, SQL, daily_ctes, last_days, on_dirty, on_events, on_sales, plain, query, rounded)

DAILY_COLS = ["timestamp", "transaction_id", "quantity", "unit_price", "total_amount", "customer_id"]


def recent_sales(spark, d, days, columns):
    """Trailing sales with the cut-off applied to the order scan."""
    as_of = latest_sale(spark, d)
    return load_sales(spark, d, columns, since=as_of - timedelta(days=days))


# ------------------------------------------------------------------ scans
SCAN = """ts as "timestamp", transaction_id, product_id, product_name, category, quantity,
  cast(unit_price as double) as unit_price, cast(total_amount as double) as total_amount, region, customer_id, payment_method"""


@query("sales_scan", on_sales(f"select {SCAN} from sales"))
def sales_scan(spark, d):
    return plain(load_sales(spark, d))


@query("event_scan", on_events("""select ts as "timestamp", transaction_id, category, quantity,
  cast(unit_price as double) as unit_price, cast(total_amount as double) as total_amount, region, customer_id, payment_method from sales"""))
def event_scan(spark, d):
    return plain(load_event_sales(spark, d))


@query("latest_n", on_sales(f"select {SCAN} from sales order by ts desc, transaction_id desc limit 100"))
def latest_n(spark, d):
    return plain(unified.latest(load_newest_sales(spark, d, 100), 100))


@query("since", on_sales(f"select {SCAN} from sales where {last_days(90)}"))
def since(spark, d):
    return plain(recent_sales(spark, d, 90, None))


@query("unified_scan", on_sales(f"""with live as (select * replace (cast(total_amount*2 as decimal(13,2)) as total_amount) from sales where {last_days(365)}),
both_ as (select 0 as source_rank, ts, transaction_id, cast(total_amount as decimal(13,2)) as total_amount from sales union all
  select 1, ts, transaction_id, total_amount from live)
select ts as "timestamp", transaction_id, cast(total_amount as double) as total_amount
from (select *, row_number() over (partition by transaction_id order by source_rank desc, ts desc, total_amount desc) as k from both_) where k = 1"""))
def unified_scan(spark, d):
    cols = ["timestamp", "transaction_id", "total_amount"]
    wide = F.col("total_amount").cast("decimal(13,2)")
    history = load_sales(spark, d, cols).withColumn("total_amount", wide)
    live = recent_sales(spark, d, 365, cols).withColumn("total_amount", (F.col("total_amount") * 2).cast("decimal(13,2)"))
    return plain(unified.unified_scan(live, history))


@query("tail_load", on_sales("""select ts as "timestamp", transaction_id, cast(total_amount as double) as total_amount
from sales order by ts desc, transaction_id desc limit 10000"""))
def tail_load(spark, d):
    return plain(files.load_tail(load_newest_sales(spark, d, 10_000, ["timestamp", "transaction_id", "total_amount"])))


@query("export_projection", on_sales("""select cast(ts as varchar) as "timestamp", transaction_id, product_name, category, region,
  case when quantity=0 then '' else cast(quantity as varchar) end as quantity,
  case when unit_price=0 then '' else cast(unit_price as varchar) end as unit_price,
  case when total_amount=0 then '' else cast(total_amount as varchar) end as total_amount from sales"""))
def export_projection(spark, d):
    return files.export_projection(load_sales(spark, d, files.EXPORT_COLUMNS))


@query("json_records", on_events("""select transaction_id, concat('{"transaction_id":"', transaction_id, '","timestamp":"',
  strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.', lpad(cast(millisecond(ts) % 1000 as varchar), 3, '0'), '","quantity":', cast(quantity as varchar), ',"region":"', region, '"}') as record from sales"""))
def json_records(spark, d):
    rows = load_event_sales(spark, d, ["transaction_id", "timestamp", "quantity", "region"])
    return files.to_records(rows).select(
        F.get_json_object("record", "$.transaction_id").alias("transaction_id"), "record")


@query("csv_round_trip", on_sales(f"select {SCAN} from sales"))
def csv_round_trip(spark, d):
    path = files.write_csv(load_sales(spark, d), fresh_path(spark, "csv"))
    return plain(files.read_transactions(spark, path, "csv"))


@query("month_table", on_sales(f"select {SCAN}, strftime(ts, '%Y-%m') as month from sales where {last_days(90)}"))
def month_table(spark, d):
    """The sales table written by month, then its last 90 days: other folders are never opened."""
    path = files.write_table(load_sales(spark, d), fresh_path(spark, "months"))
    rows = files.read_transactions(spark, path, by_month=True)
    return plain(filters.trailing(rows, 90, latest_sale(spark, d)))


# ------------------------------------------------------------------ history
@query("history_daily", on_sales(f"with r as (select * from sales where {last_days(30)}), {daily_ctes('r')} select * from g"))
def history_daily(spark, d):
    return rounded(series.daily_features(recent_sales(spark, d, 30, DAILY_COLS)), *ROLLED)


HOURLY_SQL = """select date_trunc('hour', ts) as datetime, count(transaction_id) as transaction_count,
  cast(sum(total_amount) as double) as total_revenue, cast(sum(quantity) as bigint) as total_quantity,
  cast(hour(date_trunc('hour', ts)) as integer) as hour, cast(isodow(date_trunc('hour', ts))-1 as integer) as day_of_week,
  case when isodow(date_trunc('hour', ts))>=6 then 1 else 0 end as is_weekend from {} group by 1"""


@query("history_hourly", on_events(f"with r as (select * from sales where {last_days(30)}) {HOURLY_SQL.format('r')}"))
def history_hourly(spark, d):
    rows = load_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount", "quantity"])
    return aggregates.hourly(filters.trailing(rows, 30, filters.newest(rows)))


WEEKLY_SQL = """select cast(date_trunc('week', ts) as date) as date, cast(sum(total_amount) as double) as total_revenue,
  count(transaction_id) as transaction_count from {} group by 1"""


@query("history_weekly", on_sales(f"with r as (select * from sales where {last_days(365)}) {WEEKLY_SQL.format('r')}"))
def history_weekly(spark, d):
    return aggregates.weekly(recent_sales(spark, d, 365, ["timestamp", "transaction_id", "total_amount"]))


@query("history_filtered", on_sales(f"""with r as (select * from sales where {last_days(365)} and category='PROMO' and region='ASIA'),
{daily_ctes('r')} select * from g"""))
def history_filtered(spark, d):
    rows = recent_sales(spark, d, 365, DAILY_COLS + ["category", "region"])
    return rounded(series.daily_features(filters.matching(rows, "PROMO", "ASIA")), *ROLLED)


# ------------------------------------------------------------------ groups
@query("by_category", on_sales(f"""select category, count(transaction_id) as transaction_count,
  cast(sum(total_amount) as double) as total_revenue, cast(sum(quantity) as bigint) as total_quantity,
  cast(sum(unit_price) as double)/count(unit_price) as avg_price, count(distinct customer_id) as unique_customers,
  round_even(cast(sum(total_amount) as double)/sum(cast(sum(total_amount) as double)) over ()*100*100, 0)/100 as revenue_percentage
from sales where {last_days(30)} group by category"""))
def by_category(spark, d):
    return aggregates.by_category(recent_sales(spark, d, 30, DAILY_COLS + ["category"]))


@query("by_region", on_sales(f"""select region, count(transaction_id) as transaction_count,
  cast(sum(total_amount) as double) as total_revenue, cast(sum(quantity) as bigint) as total_quantity,
  count(distinct customer_id) as unique_customers,
  round_even(cast(sum(total_amount) as double)/sum(cast(sum(total_amount) as double)) over ()*100*100, 0)/100 as revenue_percentage,
  round_even(cast(sum(total_amount) as double)/count(transaction_id)*100, 0)/100 as avg_order_value
from sales where {last_days(30)} group by region"""))
def by_region(spark, d):
    return aggregates.by_region(recent_sales(spark, d, 30, DAILY_COLS + ["region"]))


@query("by_category_all_time", on_sales("""select category, count(transaction_id) as transaction_count,
  cast(sum(total_amount) as double) as total_revenue, cast(sum(quantity) as bigint) as total_quantity,
  cast(sum(unit_price) as double)/count(unit_price) as avg_price, count(distinct customer_id) as unique_customers,
  round_even(cast(sum(total_amount) as double)/sum(cast(sum(total_amount) as double)) over ()*100*100, 0)/100 as revenue_percentage
from sales group by category"""))
def by_category_all_time(spark, d):
    return aggregates.by_category(load_sales(spark, d, DAILY_COLS + ["category"]))


@query("group_topn", on_sales("""select product_name, cast(sum(total_amount) as double) as total_amount from sales
group by 1 order by 2 desc, 1 limit 10"""))
def group_topn(spark, d):
    return aggregates.group_top(load_sales(spark, d, ["product_name", "total_amount"]), "product_name", "total_amount", "sum", 10)


@query("group_functions", on_sales("""select payment_method, cast(min(total_amount) as double) as lowest, cast(max(total_amount) as double) as highest,
  cast(sum(total_amount) as double)/count(total_amount) as mean, count(total_amount) as n from sales group by 1"""))
def group_functions(spark, d):
    rows = load_sales(spark, d, ["payment_method", "total_amount"])
    make = aggregates.AGGREGATES
    return rows.groupBy("payment_method").agg(
        make["min"]("total_amount").alias("lowest"), make["max"]("total_amount").alias("highest"),
        make["mean"]("total_amount").alias("mean"), make["count"]("total_amount").alias("n"))


@query("fallback_revenue", on_sales(f"""select cast(ts as date) as date, cast(sum(total_amount) as double) as total_revenue,
  count(transaction_id) as transaction_count from sales where {last_days(30)} group by 1"""))
def fallback_revenue(spark, d):
    rows = recent_sales(spark, d, 30, ["timestamp", "transaction_id", "total_amount"])
    return aggregates.revenue_by(rows, F.to_date("timestamp"), "date")


@query("revenue_by_dimension", on_sales("""select 'category' as dimension, category as key, cast(sum(total_amount) as double) as total_revenue from sales group by 2
union all select 'region', region, cast(sum(total_amount) as double) from sales group by 2"""))
def revenue_by_dimension(spark, d):
    rows = load_sales(spark, d, ["category", "region", "total_amount"])
    both = rows.groupingSets([[F.col("category")], [F.col("region")]], F.col("category"), F.col("region")).agg(
        aggregates.money("total_amount").alias("total_revenue"), F.grouping("category").alias("g"))
    return both.select(F.when(F.col("g") == 0, "category").otherwise("region").alias("dimension"),
                       F.coalesce("category", "region").alias("key"), "total_revenue")


def _resample_sql(on, trunc, step, label, agg, empty, value="total_amount", out="total_amount"):
    fill = f"coalesce(v,{empty})" if empty != "null" else "v"
    return on(f"""with c as (select unnest(generate_series(date_trunc('{trunc}', min(ts)), date_trunc('{trunc}', max(ts)), interval {step})) as p from sales),
a as (select date_trunc('{trunc}', ts) as p, {agg} as v from sales group by 1)
select {label} as "timestamp", {fill} as {out} from c left join a using (p)""")


@query("resample_day_sum", _resample_sql(on_sales, "day", "1 day", "cast(p as date)", "cast(sum(total_amount) as double)", "0"))
def resample_day_sum(spark, d):
    return aggregates.resample(load_sales(spark, d, ["timestamp", "total_amount"]), "total_amount", "D", "sum")


@query("resample_week_mean", _resample_sql(on_sales, "week", "7 days", "cast(p + interval 6 day as date)",
                                           "cast(sum(total_amount) as double)/count(total_amount)", "null"))
def resample_week_mean(spark, d):
    return aggregates.resample(load_sales(spark, d, ["timestamp", "total_amount"]), "total_amount", "W", "mean")


@query("resample_month_max", _resample_sql(on_sales, "month", "1 month", "last_day(p)", "cast(max(total_amount) as double)", "null"))
def resample_month_max(spark, d):
    return aggregates.resample(load_sales(spark, d, ["timestamp", "total_amount"]), "total_amount", "M", "max")


@query("resample_hour_count", _resample_sql(on_events, "hour", "1 hour", "p", "count(total_amount)", "0"))
def resample_hour_count(spark, d):
    return aggregates.resample(load_event_sales(spark, d, ["timestamp", "total_amount"]), "total_amount", "H", "count")


# ------------------------------------------------------------------ key figures
@query("kpi_summary", on_sales("""with cur as (select * from sales where ts >= (select as_of from ref) - interval 30 day),
prev as (select * from sales where ts >= (select as_of from ref) - interval 60 day and ts < (select as_of from ref) - interval 30 day),
c as (select cast(coalesce(sum(total_amount),0) as double) as rev, count(*) as n, count(distinct customer_id) as cust from cur),
p as (select cast(coalesce(sum(total_amount),0) as double) as rev, count(*) as n from prev),
t as (select category, cast(sum(total_amount) as double) as rev from cur group by 1 order by 2 desc, 1 limit 1)
select round_even(c.rev*100,0)/100 as total_revenue,
  round_even(case when p.rev>0 then (c.rev-p.rev)/p.rev*100 else 0 end*100,0)/100 as revenue_change,
  case when c.rev>p.rev and p.rev>0 then 'up' when c.rev<p.rev then 'down' else 'stable' end as revenue_trend,
  c.n as transaction_count, round_even(case when p.n>0 then (c.n-p.n)/p.n*100 else 0 end*100,0)/100 as transaction_change,
  round_even(case when c.n=0 then 0 else c.rev/c.n end*100,0)/100 as avg_order_value, c.cust as unique_customers,
  t.category as top_category, t.rev as top_category_revenue, cast(0 as bigint) as anomaly_count, 30 as period_days from c, p, t"""))
def kpi_summary(spark, d):
    as_of = latest_sale(spark, d)
    rows = load_sales(spark, d, ["timestamp", "total_amount", "category", "customer_id"], since=as_of - timedelta(days=60))
    return kpis.summary(rows, as_of, 30)


@query("kpi_detected", on_sales("""with cur as (select * from sales where ts >= (select as_of from ref) - interval 30 day),
st as (select avg(cast(total_amount as double)) as m, stddev_samp(cast(total_amount as double)) as s from sales)
select count(*) as anomaly_count, 30 as period_days from cur, st where abs((cast(total_amount as double)-m)/s)>1.5"""))
def kpi_detected(spark, d):
    """The key figures' anomaly count, from the detector fitted on all sales."""
    rows = load_sales(spark, d)
    found = AnomalyDetector("zscore", zscore_threshold=1.5).fit(rows.select("total_amount"), ["total_amount"])
    site = SalesAnalytics(rows, as_of=latest_sale(spark, d), detector=found)
    return site.kpi_summary(30).select("anomaly_count", "period_days")


@query("kpi_realtime", on_events("""with r as (select * from sales where ts >= (select as_of from ref) - interval 60 minute),
a as (select cast(coalesce(sum(total_amount),0) as double) as rev, count(*) as n, max(ts) as last_,
  greatest(1.0, coalesce((epoch_us(max(ts))-epoch_us(min(ts)))/1e6/60.0, 1.0)) as span from r)
select round_even(rev/span*100,0)/100 as revenue_per_minute, round_even(n/span*100,0)/100 as transactions_per_minute,
  last_ as last_transaction, n as sample_size from a"""))
def kpi_realtime(spark, d):
    rows = load_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    return kpis.realtime(rows, filters.newest(rows))


@query("kpi_two_sets", on_events("""with cur as (select * from sales where ts >= (select as_of from ref) - interval 7 day),
prev as (select * from sales where ts < (select as_of from ref) - interval 7 day),
c as (select cast(sum(total_amount) as double) as rev, count(*) as n, count(distinct customer_id) as cust from cur),
p as (select cast(sum(total_amount) as double) as rev, count(*) as n from prev),
t as (select category, cast(sum(total_amount) as double) as rev from cur group by 1 order by 2 desc, 1 limit 1)
select c.rev as total_revenue, (c.rev-p.rev)/p.rev*100 as revenue_change,
  case when c.rev>p.rev then 'up' when c.rev<p.rev then 'down' else 'stable' end as revenue_trend, c.n as transaction_count,
  (c.n-p.n)/p.n*100 as transaction_change, c.rev/c.n as avg_order_value, c.cust as unique_customers,
  t.category as top_category, t.rev as top_category_revenue, cast(0 as bigint) as anomaly_count from c, p, t"""))
def kpi_two_sets(spark, d):
    rows = load_event_sales(spark, d)
    cut = filters.newest(rows) - timedelta(days=7)
    return kpis.from_two_sets(rows.filter(F.col("timestamp") >= cut), rows.filter(F.col("timestamp") < cut))


@query("dataset_summary", on_sales("""select count(*) as total_transactions, cast(sum(total_amount) as double) as total_revenue,
  round(cast(sum(total_amount) as double)/count(total_amount), 2) as avg_order_value, min(ts) as start, max(ts) as "end",
  count(distinct category) as categories, count(distinct product_id) as products, count(distinct customer_id) as customers,
  count(distinct region) as regions, cast(0 as bigint) as anomaly_count from sales"""))
def dataset_summary(spark, d):
    return aggregates.dataset_summary(load_sales(spark, d, ["timestamp", "total_amount", "category", "product_id", "customer_id", "region"]))


# ------------------------------------------------------------------ seasonality
def _seasonal_sql(on, part, name):
    return on(f"""with m as (select cast({part} as integer) as {name}, cast(sum(total_amount) as double)/count(total_amount) as mean_amount from sales group by 1)
select {name}, mean_amount, round(mean_amount/avg(mean_amount) over (), 6) as seasonal_index from m""")


@query("seasonal_hour", _seasonal_sql(on_events, "hour(ts)", "hour"))
def seasonal_hour(spark, d):
    return rounded(aggregates.seasonal_index(load_event_sales(spark, d, ["timestamp", "total_amount"]), "hour"), "seasonal_index", digits=6)


@query("seasonal_weekday", _seasonal_sql(on_sales, "isodow(ts)-1", "weekday"))
def seasonal_weekday(spark, d):
    return rounded(aggregates.seasonal_index(load_sales(spark, d, ["timestamp", "total_amount"]), "weekday"), "seasonal_index", digits=6)


@query("category_share", on_sales("select category, count(*) as transaction_count, count(*)/sum(count(*)) over () as share from sales group by 1"))
def category_share(spark, d):
    return aggregates.row_share(load_sales(spark, d, ["category"]), "category")


@query("order_value_stats", on_sales("""select cast(sum(total_amount) as double)/count(*) as avg_order_value,
  round(stddev_samp(cast(total_amount as double)), 4) as std_order_value from sales"""))
def order_value_stats(spark, d):
    return rounded(aggregates.order_value_stats(load_sales(spark, d, ["total_amount"])), "std_order_value")


@query("hour_histogram", on_events("""select cast(h as integer) as hour, count(s.ts) as transaction_count
from range(24) r(h) left join sales s on hour(s.ts) = r.h group by 1"""))
def hour_histogram(spark, d):
    return aggregates.hour_histogram(load_event_sales(spark, d, ["timestamp"]))


@query("weekend_weekday", on_sales("""select case when isodow(ts)>=6 then 1 else 0 end as is_weekend, cast(sum(total_amount) as double) as revenue,
  count(*) as transaction_count, count(distinct cast(ts as date)) as active_days,
  cast(sum(total_amount) as double)/greatest(1, count(distinct cast(ts as date))) as revenue_per_day from sales group by 1"""))
def weekend_weekday(spark, d):
    return aggregates.weekend_weekday(load_sales(spark, d, ["timestamp", "total_amount"]))


@query("best_worst_day", on_sales("""with d as (select cast(ts as date) as date, cast(sum(total_amount) as double) as revenue from sales group by 1),
b as (select * from d order by revenue desc, date limit 1), w as (select * from d order by revenue, date limit 1)
select b.date as best_day, b.revenue as best_revenue, w.date as worst_day, w.revenue as worst_revenue,
  (select count(*) from d) as active_days from b, w"""))
def best_worst_day(spark, d):
    return aggregates.best_worst_day(load_sales(spark, d, ["timestamp", "total_amount"]))


@query("daily_average", on_sales("""with d as (select cast(ts as date) as date, sum(total_amount) as revenue from sales group by 1)
select cast(sum(revenue) as double)/count(*) as daily_average from d"""))
def daily_average(spark, d):
    return aggregates.daily_average(load_sales(spark, d, ["timestamp", "total_amount"]))


# ------------------------------------------------------------------ windows
def _daily(spark, d):
    return aggregates.daily(load_sales(spark, d, DAILY_COLS))


@query("daily", on_sales(f"with {daily_ctes('sales')} select date, transaction_count, total_revenue, total_quantity, avg_unit_price, unique_customers, avg_order_value, day_of_week, month, is_weekend from f"))
def daily(spark, d):
    return _daily(spark, d)


_LAGGED = [f"{k}_lag_{n}" for n in series.LAGS for k in ("revenue", "transactions")]


@query("lags", on_sales(f"with {daily_ctes('sales')} select date, {', '.join(_LAGGED)} from f"))
def lags(spark, d):
    return series.lag_features(_daily(spark, d)).select("date", *_LAGGED)


_ROLLING = [f"revenue_rolling_{k}_{n}d" for n in series.WINDOWS for k in ("mean", "std", "min", "max")]


@query("rolling", on_sales(f"with {daily_ctes('sales')} select date, {', '.join(f'round({c},4) as {c}' for c in _ROLLING)} from f"))
def rolling(spark, d):
    return rounded(series.rolling_features(_daily(spark, d)).select("date", *_ROLLING), *_ROLLING)


@query("growth", on_sales(f"with {daily_ctes('sales')} select date, daily_growth_rate, week_over_week_change from f"))
def growth(spark, d):
    return series.growth_features(_daily(spark, d)).select("date", "daily_growth_rate", "week_over_week_change")


@query("daily_features", on_sales(f"with {daily_ctes('sales')} select * from g"))
def daily_features(spark, d):
    return rounded(series.daily_features(load_sales(spark, d, DAILY_COLS)), *ROLLED)


@query("daily_features_by_region", on_sales(f"with {daily_ctes('sales', 'region')} select * from g"))
def daily_features_by_region(spark, d):
    return rounded(series.daily_features(load_sales(spark, d, DAILY_COLS + ["region"]), ("region",)), *ROLLED)


@query("ffill", on_dirty("""with o as (select transaction_id, ts_text, l_partkey, l_suppkey, total_amount, try_cast(quantity_text as double) as q from dirty),
k as (select *, last_value(q ignore nulls) over (order by ts_text, transaction_id, l_partkey, l_suppkey, total_amount rows between unbounded preceding and current row) as up,
  first_value(q ignore nulls) over (order by ts_text, transaction_id, l_partkey, l_suppkey, total_amount rows between current row and unbounded following) as down from o)
select ts_text as "timestamp", transaction_id, l_partkey, l_suppkey, coalesce(up, down) as quantity from k"""))
def ffill(spark, d):
    order = ["timestamp", "transaction_id", "l_partkey", "l_suppkey", "total_amount"]
    filled = quality.forward_fill_rows(load_dirty_sales(spark, d).select(*order, "quantity"), "quantity", order)
    return filled.select("timestamp", "transaction_id", "l_partkey", "l_suppkey", "quantity")


@query("daily_fill", on_sales(f"""with {daily_ctes('sales')}, h as (select date, case when transaction_count > 20 then total_revenue end as total_revenue from f)
select date, coalesce(last_value(total_revenue ignore nulls) over (order by date rows between unbounded preceding and current row),
  first_value(total_revenue ignore nulls) over (order by date rows between current row and unbounded following)) as total_revenue from h"""))
def daily_fill(spark, d):
    gappy = _daily(spark, d).select("date", F.when(F.col("transaction_count") > 20, F.col("total_revenue")).alias("total_revenue"))
    return series.forward_fill(gappy, ["total_revenue"])


@query("week_vs_prior", on_sales("""with d as (select cast(ts as date) as date, sum(total_amount) as revenue from sales group by 1),
r as (select *, row_number() over (order by date desc) as age from d),
a as (select cast(sum(case when age<=7 then revenue end) as double) as recent_7d_total,
  cast(sum(case when age between 8 and 14 then revenue end) as double) as previous_7d_total, count(*) as active_days from r)
select *, case when active_days>=14 then (recent_7d_total-previous_7d_total)/previous_7d_total end as growth_rate from a"""))
def week_vs_prior(spark, d):
    return series.week_against_prior(load_sales(spark, d, ["timestamp", "total_amount"]))


def _trailing_sql():
    cols = [f"lag(total_revenue,{n}) over (order by date) as revenue_lag_{n}" for n in series.LAGS]
    for n in series.WINDOWS:
        frame = f"(order by date rows between {n} preceding and 1 preceding)"
        full = f"count(total_revenue) over {frame} = {n}"
        cols.append(f"round(case when {full} then avg(total_revenue) over {frame} end,4) as revenue_rolling_mean_{n}d")
        if n == 7:
            cols.append(f"round(case when {full} then stddev_pop(total_revenue) over {frame} end,4) as revenue_rolling_std_7d")
    return on_sales(f"with {daily_ctes('sales')} select date, total_revenue, {', '.join(cols)} from d")


@query("trailing_features", _trailing_sql())
def trailing_features(spark, d):
    out = series.trailing_features(_daily(spark, d))
    return rounded(out, *[c for c in out.columns if "rolling" in c])


# ------------------------------------------------------------------ ranking
@query("page_transactions", on_sales(f"select {SCAN} from sales order by ts desc, transaction_id desc limit 100 offset 500"))
def page_transactions(spark, d):
    return plain(ranking.page(load_newest_sales(spark, d, 600), 100, 500))


@query("page_total", on_sales("select count(*) as total from sales"))
def page_total(spark, d):
    return ranking.total(load_sales(spark, d, ["transaction_id"]))


@query("page_after", on_sales("""select ts as "timestamp", transaction_id from sales
where ts < (select as_of from ref) - interval 10 day or (ts = (select as_of from ref) - interval 10 day and transaction_id < '5')
order by ts desc, transaction_id desc limit 100"""))
def page_after(spark, d):
    rows = load_sales(spark, d, ["timestamp", "transaction_id"])
    return ranking.page_after(rows, latest_sale(spark, d) - timedelta(days=10), "5", 100)


@query("trend_last_n", on_sales(f"with r as (select * from sales where {last_days(90)}), {daily_ctes('r')} select * from g order by date desc limit 30"))
def trend_last_n(spark, d):
    return rounded(ranking.trend(recent_sales(spark, d, 90, DAILY_COLS), "daily", 30), *ROLLED)


@query("trend_weekly", on_sales(f"{WEEKLY_SQL.format('sales')} order by 1 desc limit 12"))
def trend_weekly(spark, d):
    return ranking.trend(load_sales(spark, d, ["timestamp", "transaction_id", "total_amount"]), "weekly", 12)


@query("trend_hourly", on_events(f"{HOURLY_SQL.format('sales')} order by 1 desc limit 48"))
def trend_hourly(spark, d):
    return ranking.trend(load_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount", "quantity"]), "hourly", 48)


def _top_sql(key, n):
    return on_sales(f"""select {key}, cast(sum(total_amount) as double) as total_revenue, count(*) as transaction_count,
  cast(row_number() over (order by sum(total_amount) desc, {key}) as integer) as rank from sales group by 1 order by 2 desc, 1 limit {n}""")


@query("top_products", _top_sql("product_name", 3))
def top_products(spark, d):
    return ranking.top_by_revenue(load_sales(spark, d, ["product_name", "transaction_id", "total_amount"]), "product_name", 3)


@query("top_categories", _top_sql("category", 6))
def top_categories(spark, d):
    return ranking.top_by_revenue(load_sales(spark, d, ["category", "transaction_id", "total_amount"]), "category", 6)


@query("scatter_index", on_events("""with l as (select * from sales order by ts desc, transaction_id desc limit 200)
select transaction_id, cast(row_number() over (order by ts desc, transaction_id desc)-1 as integer) as x, cast(total_amount as double) as y,
  case when total_amount > 200 then 'flagged' else 'normal' end as series from l"""))
def scatter_index(spark, d):
    rows = load_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    page = unified.latest(rows, 200).withColumn("is_anomaly", F.col("total_amount") > 200)
    return ranking.scatter_index(page)


@query("transactions_table", on_sales("""select transaction_id, strftime(ts, '%I:%M %p') as time, concat(substr(transaction_id,1,15),'...') as short_id,
  product_name as product, category, region, quantity, concat('$', format('{:.2f}', cast(total_amount as double))) as amount, 'Normal' as status
from sales order by ts desc, transaction_id desc limit 20"""))
def transactions_table(spark, d):
    return ranking.transactions_table(load_newest_sales(spark, d, 20))


# ------------------------------------------------------------------ functions
@query("fn_dates", on_events("""select transaction_id, cast(hour(ts) as integer) as hour, cast(isodow(ts)-1 as integer) as day_of_week, cast(day(ts) as integer) as day_of_month,
  cast(month(ts) as integer) as month, cast(quarter(ts) as integer) as quarter, cast(week(ts) as integer) as week_of_year, cast(year(ts) as integer) as year,
  case when isodow(ts)>=6 then 1 else 0 end as is_weekend, case when day(ts)=1 then 1 else 0 end as is_month_start,
  case when cast(ts as date)=last_day(ts) then 1 else 0 end as is_month_end,
  case when hour(ts)<6 then 'night' when hour(ts)<12 then 'morning' when hour(ts)<18 then 'afternoon' else 'evening' end as time_of_day from sales"""))
def fn_dates(spark, d):
    return features.time_features(load_event_sales(spark, d, ["transaction_id", "timestamp"])).drop("timestamp")


@query("fn_floor", on_events("""select transaction_id, date_trunc('hour', ts) as floor_hour, cast(ts as date) as floor_day,
  cast(date_trunc('week', ts) as date) as floor_week, ts - interval 30 day as range_start, ts as range_end from sales"""))
def fn_floor(spark, d):
    ts = F.col("timestamp")
    start, end = dates.date_range(30, ts)
    return load_event_sales(spark, d, ["transaction_id", "timestamp"]).select(
        "transaction_id", F.date_trunc("hour", ts).alias("floor_hour"), F.to_date(ts).alias("floor_day"),
        dates.week_start(ts).alias("floor_week"), start.alias("range_start"), end.alias("range_end"))


@query("fn_format", on_events("""select transaction_id, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts,'%B %d, %Y %I:%M %p') as display,
  strftime(ts,'%Y-%m-%d') as date_only, strftime(ts,'%H:%M:%S') as time_only, strftime(ts,'%m/%d/%Y') as short,
  strftime(ts,'%I:%M %p') as clock, strftime(ts,'%b %-d') as short_date from sales"""))
def fn_format(spark, d):
    ts = F.col("timestamp")
    styles = [dates.format_datetime(ts, s).alias(s) for s in ("iso", "display", "date_only", "time_only", "short")]
    return load_event_sales(spark, d, ["transaction_id", "timestamp"]).select(
        "transaction_id", *styles, dates.clock_time(ts).alias("clock"), dates.short_date(ts).alias("short_date"))


@query("fn_parse", on_dirty("""select transaction_id, l_partkey, l_suppkey, ts_text as text, case when ts_text <> 'not-a-date' then cast(ts_text as timestamp) end as parsed,
  case when ts_text <> 'not-a-date' then cast(ts_text as timestamp) end as tolerant from dirty"""))
def fn_parse(spark, d):
    text = F.col("timestamp")
    return load_dirty_sales(spark, d).select("transaction_id", "l_partkey", "l_suppkey", text.alias("text"),
                                             dates.parse_datetime(text).alias("parsed"), dates.to_datetime(text).alias("tolerant"))


@query("fn_periods", on_sales("""with o as (select distinct cast(ts as date) as day from sales)
select cast(day as timestamp) as start, unnest(generate_series(cast(day as timestamp), cast(day as timestamp) + interval 21 day, interval 7 day)) as period from o"""))
def fn_periods(spark, d):
    days = load_sales(spark, d, ["timestamp"]).select(F.date_trunc("day", "timestamp").alias("start")).distinct()
    return days.select("start", F.explode(dates.time_periods(
        F.col("start"), F.col("start") + F.expr("INTERVAL 21 DAYS"), "weekly")).alias("period"))


_V = "cast(total_amount as double)"
_SCALED = f"{_V}*power(10, cast(transaction_id as bigint) % 6)"


@query("fn_money", on_events(f"""with v as (select transaction_id, {_SCALED} as v from sales)
select transaction_id, round(v/3, 2) as rounded_scaled,
  case when abs(v)>=1e6 then concat('$',format('{{:.1f}}',v/1e6),'M') when abs(v)>=1e3 then concat('$',format('{{:.1f}}',v/1e3),'K') else concat('$',format('{{:,.2f}}',v)) end as money,
  case when v>=1e6 then concat('$',format('{{:.2f}}',v/1e6),'M') when v>=1e3 then concat('$',format('{{:.1f}}',v/1e3),'K') else concat('$',format('{{:.2f}}',v)) end as card,
  case when v>=1e6 then concat(format('{{:.1f}}',v/1e6),'M') when v>=1e3 then concat(format('{{:.1f}}',v/1e3),'K') else format('{{:.0f}}',v) end as axis,
  format('{{:,}}', cast(floor(v) as bigint)) as count_text from v"""))
def fn_money(spark, d):
    v = F.col("total_amount").cast("double") * F.pow(F.lit(10.0), F.col("transaction_id").cast("bigint") % 6)
    rows = load_event_sales(spark, d, ["transaction_id", "total_amount"]).select("transaction_id", v.alias("v"))
    v = F.col("v")
    return rows.select("transaction_id", numbers.round_scaled(v / 3).alias("rounded_scaled"),
                       labels.format_currency(v).alias("money"), labels.format_currency_card(v).alias("card"),
                       labels.format_number_axis(v).alias("axis"), labels.format_count(F.floor(v)).alias("count_text"))


@query("fn_rounding", on_events("""select transaction_id, round(cast(total_amount as decimal(12,2))*cast(0.125 as decimal(4,3)), 2)::double as half_up,
  greatest(0.0, cast(total_amount as double) - 50.0) as clamped from sales"""))
def fn_rounding(spark, d):
    exact = F.col("total_amount") * F.lit(0.125).cast("decimal(4,3)")
    return load_event_sales(spark, d, ["transaction_id", "total_amount"]).select(
        "transaction_id", numbers.round_currency(exact).alias("half_up"),
        numbers.clamp_non_negative(F.col("total_amount").cast("double") - 50.0).alias("clamped"))


@query("fn_growth", on_events("""with v as (select transaction_id, cast(total_amount as double) as cur, cast(unit_price as double) - quantity as prev from sales),
g as (select *, case when prev=0 then (case when cur=0 then 0 else null end) else (cur-prev)/prev end as g from v)
select transaction_id, g as growth, case when prev=0 then 0 else cur/prev end as divided,
  case when prev<>0 and g>0.01 then '↑' when prev<>0 and g < -0.01 then '↓' else '→' end as arrow,
  case when prev=0 and cur<>0 then 'dramatic' when abs(g*100)<1 then 'stable' when abs(g*100)<5 then 'slight' when abs(g*100)<15 then 'moderate' when abs(g*100)<30 then 'significant' else 'dramatic' end as class,
  case when prev>0 then (cur-prev)/prev*100 else 0 end as change,
  case when prev=0 then null when abs(g)<1 then concat(case when g*100>0 then '+' else '' end, format('{:.1f}', g*100), '%') else concat(case when g>0 then '+' else '' end, format('{:.1f}', g), '%') end as percent,
  case when prev>0 and cur>prev then 'up' when prev>0 and cur<prev then 'down' else 'stable' end as word from g"""))
def fn_growth(spark, d):
    cur, prev = F.col("total_amount").cast("double"), F.col("unit_price").cast("double") - F.col("quantity")
    g = numbers.growth_rate(cur, prev)
    change = numbers.change_percentage(cur, prev)
    finite = F.when(g != float("inf"), g)
    return load_event_sales(spark, d, ["transaction_id", "total_amount", "unit_price", "quantity"]).select(
        "transaction_id", finite.alias("growth"), numbers.safe_divide(cur, prev).alias("divided"),
        labels.trend_arrow(cur, prev).alias("arrow"), labels.change_class(g).alias("class"), change.alias("change"),
        labels.format_percentage(finite).alias("percent"), labels.trend_word(change).alias("word"))


@query("fn_bins", on_events("""with v as (select transaction_id, (cast(total_amount as double) - 50)/25 as z from sales),
s as (select *, case when abs(z)>=5 then 'critical' when abs(z)>=4 then 'high' when abs(z)>=3 then 'medium' else 'low' end as severity from v)
select transaction_id, z, severity, concat('severity-', severity) as css,
  case severity when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end as rank from s"""))
def fn_bins(spark, d):
    z = numbers.zscore(F.col("total_amount"), F.lit(50.0), F.lit(25.0))
    rows = load_event_sales(spark, d, ["transaction_id", "total_amount"]).select("transaction_id", z.alias("z"))
    rows = rows.withColumn("severity", labels.severity(F.col("z")))
    return rows.withColumns({"css": labels.severity_class(F.col("severity")), "rank": labels.severity_rank(F.col("severity"))})


@query("fn_label_encode", on_sales("""with k as (select category, dense_rank() over (order by category)-1 as code from (select distinct category from sales))
select s.transaction_id, s.category, cast(k.code as integer) as category_encoded from sales s join k using (category)"""))
def fn_label_encode(spark, d):
    rows = load_sales(spark, d, ["transaction_id", "category"])
    return features.encode(rows, "category", features.fit_labels(rows, "category"))


@query("fn_product_code", on_sales("""select transaction_id, concat('PROD-',upper(substr(category,1,3)),'-',
  case when length(cast(quantity as varchar))<4 then lpad(cast(quantity as varchar),4,'0') else cast(quantity as varchar) end) as code,
  concat(substr(transaction_id,1,15),'...') as short_id from sales"""))
def fn_product_code(spark, d):
    return load_sales(spark, d, ["transaction_id", "category", "quantity"]).select(
        "transaction_id", labels.product_code(F.col("category"), F.col("quantity")).alias("code"),
        labels.short_id(F.col("transaction_id")).alias("short_id"))


def _factor_sql():
    from ..functions import fixed
    def case(key, table):
        return f"case {key} " + " ".join(f"when {k} then cast({v} as double)" for k, v in table.items()) + " else 1.0 end"
    return on_events(f"""select transaction_id, round({case('hour(ts)', fixed.HOUR_FACTORS)}*{case('isodow(ts)-1', fixed.WEEKDAY_FACTORS)}
  *{case('month(ts)', fixed.MONTH_FACTORS)}, 6) as factor from sales""")


@query("fn_seasonal_factor", _factor_sql())
def fn_seasonal_factor(spark, d):
    return load_event_sales(spark, d, ["transaction_id", "timestamp"]).select(
        "transaction_id", F.round(labels.seasonal_factor(F.col("timestamp")), 6).alias("factor"))


# ------------------------------------------------------------------ quality
@query("profile", on_dirty("""select 'row_count' as "check", null as "column", count(*) as "count", 'info' as level from dirty
union all select 'column_count', null, 8, 'info' union all select 'empty', null, 0, 'ok'
union all select 'missing', c, 1, 'error' from (values ('product_id'),('product_name'),('region'),('customer_id'),('payment_method')) t(c)
union all select 'nulls', 'timestamp', 0, 'ok' union all select 'nulls', 'transaction_id', 0, 'ok'
union all select 'nulls', 'category', count(*), case when count(*)>0 then 'error' else 'ok' end from dirty where category is null
union all select 'nulls', 'quantity', count(*), case when count(*)>0 then 'error' else 'ok' end from dirty where quantity_text is null
union all select 'nulls', 'unit_price', count(*), case when count(*)>0 then 'error' else 'ok' end from dirty where unit_price is null
union all select 'nulls', 'total_amount', 0, 'ok'"""))
def profile(spark, d):
    return quality.profile(load_dirty_sales(spark, d))


_NAMES = ["timestamp", "transaction_id", "product_id", "product_name", "category", "quantity", "unit_price",
          "total_amount", "region", "customer_id", "payment_method"]


@query("validate", on_sales(f"""select 'row_count' as "check", null as "column", count(*) as "count", 'info' as level from sales
union all select 'column_count', null, 11, 'info' union all select 'empty', null, 0, 'ok'
union all select 'nulls', c, 0, 'ok' from (values {','.join(f"('{c}')" for c in _NAMES)}) t(c)
union all select 'timestamp_format', 'timestamp', 0, 'ok' union all select 'negative', 'total_amount', 0, 'ok'
union all select 'not_numeric', c, 0, 'ok' from (values ('quantity'),('unit_price'),('total_amount')) t(c)"""))
def validate(spark, d):
    return quality.validate(load_sales(spark, d))


_CLEAN = """with p as (select try_cast(ts_text as timestamp) as ts, transaction_id, try_cast(quantity_text as double) as q, unit_price as pr,
    cast(total_amount as double) as amt, coalesce(category,'Unknown') as category, l_partkey, l_suppkey from dirty where try_cast(ts_text as timestamp) is not null),
fl as (select ts, transaction_id, coalesce(q,(select median(q) from p)) as q, coalesce(pr,(select median(pr) from p)) as pr, amt, category, l_partkey, l_suppkey from p),
dd as (select * from (select *, row_number() over (partition by transaction_id order by ts, l_partkey, l_suppkey, amt, q, pr, category) as k from fl) where k=1),
st as (select quantile_cont(amt,0.01) as lo, quantile_cont(amt,0.99) as hi, median(pr) as mp from dd),
fx as (select ts, transaction_id, case when q<=0 then 1.0 else q end as q, case when pr<=0 then mp else pr end as pr, amt,
    (amt<lo or amt>hi) as is_extreme, category, l_partkey, l_suppkey from dd, st)"""


@query("clean_sales", on_dirty(f"""{_CLEAN} select ts as "timestamp", transaction_id, q as quantity, pr as unit_price,
  case when abs(amt-q*pr)/(q*pr) > 0.1 then q*pr else amt end as total_amount, category, l_partkey, l_suppkey, is_extreme from fx"""))
def clean_sales(spark, d):
    return quality.clean(load_dirty_sales(spark, d), order=["timestamp", "l_partkey", "l_suppkey", "total_amount"])


@query("dedupe_first", on_dirty("""select transaction_id, ts_text as "timestamp", l_partkey, l_suppkey, total_amount from (
  select *, row_number() over (partition by transaction_id order by ts_text, l_partkey, l_suppkey, total_amount) as k from dirty) where k=1"""))
def dedupe_first(spark, d):
    rows = load_dirty_sales(spark, d).select("transaction_id", "timestamp", "l_partkey", "l_suppkey", "total_amount")
    return dedupe.keep_first(rows, "transaction_id", ["timestamp", "l_partkey", "l_suppkey", "total_amount"])


@query("extreme_flag", on_events("""with st as (select quantile_cont(cast(total_amount as double),0.01) as lo, quantile_cont(cast(total_amount as double),0.99) as hi from sales)
select transaction_id, cast(total_amount as double) as total_amount, (total_amount<lo or total_amount>hi) as is_extreme from sales, st"""))
def extreme_flag(spark, d):
    return plain(quality.flag_extremes(load_event_sales(spark, d, ["transaction_id", "total_amount"])))


@query("fill_numeric", on_dirty("""with p as (select transaction_id, l_partkey, l_suppkey, total_amount, try_cast(quantity_text as double) as q, unit_price as pr from dirty)
select transaction_id, l_partkey, l_suppkey, total_amount, coalesce(q,round((select avg(q) from p),4)) as quantity, coalesce(pr,round((select avg(pr) from p),4)) as unit_price from p"""))
def fill_numeric(spark, d):
    rows = load_dirty_sales(spark, d).withColumns({f"raw_{c}": numbers.to_number(F.col(c)) for c in ("quantity", "unit_price")})
    out = quality.fill_numeric(rows, ["quantity", "unit_price"], "mean")
    return out.select("transaction_id", "l_partkey", "l_suppkey", "total_amount", *[
        F.coalesce(f"raw_{c}", F.round(c, 4)).alias(c) for c in ("quantity", "unit_price")])


@query("quantiles", on_sales("""select quantile_cont(cast(total_amount as double),0.01) as p1, quantile_cont(cast(total_amount as double),0.25) as q1,
  median(cast(total_amount as double)) as median, quantile_cont(cast(total_amount as double),0.75) as q3, quantile_cont(cast(total_amount as double),0.99) as p99,
  quantile_cont(cast(total_amount as double),0.75)-quantile_cont(cast(total_amount as double),0.25) as iqr from sales"""))
def quantiles(spark, d):
    q = exact_quantiles(load_sales(spark, d, ["total_amount"]), {"total_amount": [0.01, 0.25, 0.5, 0.75, 0.99]})
    p1, q1, med, q3, p99 = (q["total_amount", p] for p in (0.01, 0.25, 0.5, 0.75, 0.99))
    return spark.createDataFrame([(p1, q1, med, q3, p99, q3 - q1)], "p1 double, q1 double, median double, q3 double, p99 double, iqr double")


@query("engineer_features", on_sales("""with kc as (select category, dense_rank() over (order by category)-1 as c from (select distinct category from sales)),
kr as (select region, dense_rank() over (order by region)-1 as r from (select distinct region from sales))
select transaction_id, cast(hour(ts) as integer) as hour, cast(isodow(ts)-1 as integer) as day_of_week, cast(day(ts) as integer) as day_of_month,
  cast(month(ts) as integer) as month, cast(quarter(ts) as integer) as quarter, cast(week(ts) as integer) as week_of_year, cast(year(ts) as integer) as year,
  case when isodow(ts)>=6 then 1 else 0 end as is_weekend, case when day(ts)=1 then 1 else 0 end as is_month_start,
  case when cast(ts as date)=last_day(ts) then 1 else 0 end as is_month_end,
  case when hour(ts)<6 then 'night' when hour(ts)<12 then 'morning' when hour(ts)<18 then 'afternoon' else 'evening' end as time_of_day,
  cast(kc.c as integer) as category_encoded, cast(kr.r as integer) as region_encoded from sales join kc using (category) join kr using (region)"""))
def engineer_features(spark, d):
    rows = stage(load_sales(spark, d, ["transaction_id", "timestamp", "category", "region"]), "sales")
    return features.engineer(rows).drop("timestamp", "category", "region")


_STD = ["transaction_count", "total_quantity", "unique_customers", "avg_order_value", "day_of_week", "month", "is_weekend"]


@query("standardise", on_sales(f"with {daily_ctes('sales')} select date, "
       + ", ".join(f"round(({c}-avg({c}) over ())/coalesce(nullif(stddev_pop({c}) over (),0),1),4) as {c}" for c in _STD) + ", total_revenue from f"))
def standardise(spark, d):
    rows = _daily(spark, d).select("date", *_STD, "total_revenue")
    return rounded(features.ml_dataset(rows)[0], *_STD)


@query("inference_rows", on_sales(f"with {daily_ctes('sales')} select cast(transaction_count as double) as transaction_count, avg_order_value, cast(0 as double) as not_there from f"))
def inference_rows(spark, d):
    return features.prepare_for_inference(_daily(spark, d), ["transaction_count", "avg_order_value", "not_there"])


@query("prepared_daily", on_dirty(f"""{_CLEAN}, fin as (select ts, transaction_id, q, pr, case when abs(amt-q*pr)/(q*pr) > 0.1 then q*pr else amt end as amt from fx)
select cast(ts as date) as date, count(*) as transaction_count, cast(floor(sum(amt)*100+0.314159) as bigint) as revenue_cents, cast(sum(q) as bigint) as total_quantity, cast(floor(avg(pr)*100+0.314159) as bigint) as price_cents from fin group by 1"""))
def prepared_daily(spark, d):
    rows = load_dirty_sales(spark, d)
    featured, _ = features.pipeline(rows.withColumn("customer_id", F.lit("none")), strict=False,
                                    order=["timestamp", "l_partkey", "l_suppkey", "total_amount"])
    # whole cents, cut where neither halves nor decimal fractions fall: sums of doubles differ in the last digit
    cents = lambda c: F.floor(F.col(c) * 100 + 0.314159)
    return aggregates.daily(featured).select("date", "transaction_count", cents("total_revenue").alias("revenue_cents"),
                                             "total_quantity", cents("avg_unit_price").alias("price_cents"))


@query("inject_events", on_sales("""with r as (select as_of from ref),
e as (select s.*, case when cast(ts as date) = cast((select as_of from r) - interval 30 day as date) then 2.5
   when cast(ts as date) = cast((select as_of from r) - interval 60 day as date) then 1/3.0
   when cast(ts as date) = cast((select as_of from r) - interval 15 day as date) and region='EUROPE' then 0.5 else 1.0 end as m from sales s)
select transaction_id, round(cast(total_amount as double)*m, 4) as total_amount, m<>1.0 as is_anomaly from e"""))
def inject_events(spark, d):
    as_of = latest_sale(spark, d)
    day = lambda n: (as_of - timedelta(days=n)).strftime("%Y-%m-%d")
    rows = load_sales(spark, d, ["timestamp", "transaction_id", "total_amount", "region"])
    out = filters.inject_events(rows, [
        {"type": "spike", "date": day(30), "magnitude": 2.5}, {"type": "drop", "date": day(60), "magnitude": 3.0},
        {"type": "region_drop", "date": day(15), "region": "EUROPE", "magnitude": 2.0}])
    return rounded(out.select("transaction_id", "total_amount", "is_anomaly"), "total_amount")


# ------------------------------------------------------------------ distinct counts from daily sketches
@query("customers_trailing", on_events("""with d as (select distinct cast(ts as date) as date from sales)
select d.date, count(distinct s.customer_id) as customers_7d, m.n as customers_30d from d join sales s on cast(s.ts as date) between d.date - 6 and d.date
  join (select d.date, count(distinct s.customer_id) as n from d join sales s on cast(s.ts as date) between d.date - 29 and d.date group by 1) m on m.date = d.date group by 1, 3"""))
def customers_trailing(spark, d):
    """Distinct customers of the last 7 and 30 days on each day, from one sketch a day."""
    daily = sketches.daily_sketches(load_event_sales(spark, d, ["timestamp", "customer_id"]), "customer_id")
    week, month = (sketches.trailing_distinct(daily, n).withColumnRenamed("n_distinct", f"customers_{n}d") for n in (7, 30))
    return week.join(month, "date")


@query("customers_by_category", on_events("""select category, count(distinct customer_id) as n_distinct from sales
where cast(ts as date) between cast((select as_of from ref) as date) - 13 and cast((select as_of from ref) as date) group by 1"""))
def customers_by_category(spark, d):
    """Distinct customers of each category over the last fourteen calendar days."""
    rows = load_event_sales(spark, d, ["timestamp", "category", "customer_id"])
    last = filters.newest(rows).date()
    return sketches.distinct_between(sketches.daily_sketches(rows, "customer_id", ("category",)), last - timedelta(days=13), last, ("category",))


# ------------------------------------------------------------------ files and display text
@query("export_file", SQL["export_projection"])
def export_file(spark, d):
    """The quoted export written and read again; empty cells are written as quoted empty text."""
    path = files.export_csv(load_sales(spark, d, files.EXPORT_COLUMNS), fresh_path(spark, "export"))
    return spark.read.schema(", ".join(f"{c} string" for c in files.EXPORT_COLUMNS)).option("header", True).option("emptyValue", "").csv(path)


@query("append_transactions", on_events("""select cast(ts as date) as date, count(*) as n, count(distinct transaction_id) as ids, cast(sum(total_amount) as double) as total from sales group by 1"""))
def append_transactions(spark, d):
    """Days of sales appended to a landing table one after the other, by halves of the history, and read as one."""
    rows = load_event_sales(spark, d, ["timestamp", "transaction_id", "total_amount"])
    landing, cut = fresh_path(spark, "landing"), filters.timestamp_literal(filters.newest(rows) - timedelta(days=3))
    for part in (rows.filter(F.col("timestamp") < cut), rows.filter(F.col("timestamp") >= cut)):
        files.add_transactions(spark, part, landing, rows.schema)
    back = files.read_transactions(spark, landing, schema=rows.schema)
    return back.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("n"), F.countDistinct("transaction_id").alias("ids"), F.sum("total_amount").cast("double").alias("total"))


@query("fn_percentage_card", on_events("""with v as (select transaction_id, round(cast(total_amount as double) - 50, 2) as v from sales)
select transaction_id, concat(case when v > 0 then '+' else '' end, format('{:.1f}', v), '%') as signed, concat(format('{:.1f}', v), '%') as plain from v"""))
def fn_percentage_card(spark, d):
    v = F.round(F.col("total_amount").cast("double") - 50, 2)
    return load_event_sales(spark, d, ["transaction_id", "total_amount"]).select(
        "transaction_id", labels.format_percentage_card(v).alias("signed"), labels.format_percentage_card(v, include_sign=False).alias("plain"))
