"""Insight rules, orchestration and job queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import insights
from ..operators.anomaly import report, stats
from ..operators.filters import timestamp_literal, trailing
from ..operators.partials import DailyCells
from ..session import fresh_path, stage
from ..sources.files import read_transactions
from ..sources.star import latest_sale, load_dirty_sales, load_sales
from ..streaming import sinks
from ..streaming.pipeline import read_sales
from . import jobs
from .queries_anomaly import SEVERITY
from .queries_batch import _CLEAN
from .registry import on_dirty, on_sales, plain, query, rounded

COLS = ["timestamp", "transaction_id", "category", "product_name", "region", "total_amount"]
FIGURES = [c for c in COLS if c != "transaction_id"]


def cells(spark, d):
    return insights.summarise(load_sales(spark, d, COLS), latest_sale(spark, d))


def naive_forecast(spark, d):
    """The last seven days repeated: a forecast frame that SQL can reproduce."""
    from ..operators.aggregates import revenue_by
    as_of = latest_sale(spark, d)
    rows = load_sales(spark, d, ["timestamp", "transaction_id", "total_amount"], since=as_of - timedelta(days=6))
    days = revenue_by(rows, F.to_date("timestamp"), "date")
    return days.select(F.date_add("date", 7).alias("date"), F.col("total_revenue").alias("value"))


def joined(spark, d):
    """The sales rows that rules and detection read several times, joined once."""
    return stage(load_sales(spark, d, FIGURES), "sales")


def detected(spark, d, rows=None):
    rows = joined(spark, d) if rows is None else rows
    as_of = latest_sale(spark, d)
    fitted = stats.ColumnStats.fit(rows, ["total_amount"])
    return report.breakdown(stats.detect_by_zscore(trailing(rows, 30, as_of), fitted, threshold=2.0), as_of)


# ------------------------------------------------------------------ SQL
BASE = """cur as (select * from sales where ts >= (select as_of from ref) - interval 30 day),
hist as (select * from sales where ts < (select as_of from ref) - interval 30 day),
tot as (select (select cast(coalesce(sum(total_amount),0) as double) from cur) as cur_rev, (select count(*) from cur) as cur_n,
  (select cast(coalesce(sum(total_amount),0) as double) from hist) as hist_rev, (select count(*) from hist) as hist_n),
cat as (select category, rev, coalesce(rev/sum(rev) over ()*100,0) as pct, row_number() over (order by rev desc, category) as rk from (select category, cast(sum(total_amount) as double) as rev from cur group by 1)),
hcat as (select category, cast(sum(total_amount) as double) as rev from hist group by 1),
reg as (select region, rev, coalesce(rev/sum(rev) over ()*100,0) as pct, row_number() over (order by rev desc, region) as rk from (select region, cast(sum(total_amount) as double) as rev from cur group by 1)),
hreg as (select region, cast(sum(total_amount) as double) as rev from hist group by 1),
prod as (select product_name, rev, row_number() over (order by rev desc, product_name) as rk from (select product_name, cast(sum(total_amount) as double) as rev from cur group by 1)),
day as (select date, rev, row_number() over (order by date desc) as age from (select cast(ts as date) as date, cast(sum(total_amount) as double) as rev from cur group by 1)),
r1 as (select cur_rev as current_revenue, hist_rev as previous_revenue, (cur_rev-hist_rev)/hist_rev as g from tot where cur_n>0 and hist_n>0 and abs((cur_rev-hist_rev)/hist_rev)>0.05),
r4 as (select cat.category, (cat.rev-h.rev)/h.rev as g, cat.rev as current_revenue, h.rev as previous_revenue, cat.rk from cat join hcat h using (category) where cat.rk<=3 and abs((cat.rev-h.rev)/h.rev)>0.15),
r7 as (select reg.region, (reg.rev-h.rev)/h.rev as g, reg.rev as current_revenue, h.rev as previous_revenue, reg.rk from reg join hreg h using (region) where (reg.rev-h.rev)/h.rev < -0.15),
wk as (select sum(case when age<=7 then rev end) as a, sum(case when age between 8 and 14 then rev end) as b, count(*) as n from day),
r8 as (select a, b, (a-b)/b as g from wk where n>=14 and abs((a-b)/b)>0.1),
bst as (select date, rev from day order by rev desc, date limit 1), wst as (select date, rev from day order by rev, date limit 1),
wkd as (select sum(case when isodow(date)>=6 then rev end)/greatest(1,count(case when isodow(date)>=6 then 1 end)) as we,
  sum(case when isodow(date)<6 then rev end)/greatest(1,count(case when isodow(date)<6 then 1 end)) as wd from day),
ast as (select avg(cast(total_amount as double)) as m, stddev_samp(cast(total_amount as double)) as s from sales),
det as (select cur.*, case when abs((cast(total_amount as double)-m)/s)>2 then 1 else 0 end as flag, """ + SEVERITY.format(
    "((cast(total_amount as double)-m)/s)") + """ as severity from cur, ast),
sev as (select coalesce(sum(case when severity='critical' then flag end),0) as crit, coalesce(sum(case when severity='high' then flag end),0) as high, sum(flag) as total from det),
areg as (select region, cast(sum(flag) as bigint) as n, row_number() over (order by sum(flag) desc, region) as rk from det group by 1 having sum(flag)>0),
fc as (select avg(round(rev,2)) as f_avg, round(sum(rev),2) as f_total, count(*) as h from day where date >= cast((select as_of from ref) as date) - 6),
r12 as (select f_avg, f_total, h, c_avg, (f_avg-c_avg)/c_avg as g from fc, (select avg(rev) as c_avg from day))"""


def _pct(e):
    return (f"(case when abs({e})<1 then concat(case when {e}*100>0 then '+' else '' end, format('{{:.1f}}',{e}*100),'%') "
            f"else concat(case when {e}>0 then '+' else '' end, format('{{:.1f}}',{e}),'%') end)")


def _money(e):
    return (f"(case when abs({e})>=1e6 then concat('$',format('{{:.1f}}',{e}/1e6),'M') when abs({e})>=1e3 then "
            f"concat('$',format('{{:.1f}}',{e}/1e3),'K') else concat('$',format('{{:,.2f}}',{e})) end)")


def _class(e):
    return (f"(case when abs({e}*100)<1 then 'stable' when abs({e}*100)<5 then 'slight' when abs({e}*100)<15 then 'moderate' "
            f"when abs({e}*100)<30 then 'significant' else 'dramatic' end)")


_RULES = [
    ("revenue", "performance", f"select 'Revenue '||case when g>0 then 'Up ' else 'Down ' end||{_pct('abs(g)')} as title, "
     f"'Total revenue is '||{_money('current_revenue')}||', which is '||{_pct('g')}||' compared to the previous period ('||{_money('previous_revenue')}||'). This represents a '||{_class('g')}||' change.' as message, "
     "case when abs(g)>0.2 then 2 else 3 end as priority, case when g>0 then 'Continue strategies driving growth' else 'Investigate causes of revenue decline' end as action from r1"),
    ("volume", "performance", f"select format('{{:,}}',cur_n)||' Transactions Processed', 'Processed '||format('{{:,}}',cur_n)||' transactions with an average order value of '||{_money('(cur_rev/cur_n)')}||'.', 5, null from tot where cur_n>0"),
    ("top_category", "product", f"select category||' Leading Sales', category||' is the top-performing category with '||{_money('rev')}||' in revenue, representing '||format('{{:.1f}}',pct)||'% of total sales.', 3, null from cat where rk=1"),
    ("category_growth", "product", f"select category||' Shows Strong '||case when g>0 then 'Growth' else 'Decline' end, category||' category revenue has changed by '||{_pct('g')}||' compared to the previous period.', case when g>0 then 3 else 2 end, null from r4"),
    ("top_products", "product", "select 'Top Selling Products', 'Your best-selling products are: '||string_agg(product_name, ', ' order by rk)||'.', 5, null from prod where rk<=3 having count(*)>0"),
    ("top_region", "regional", f"select region||' Leads Regionally', region||' is the highest-performing region with '||{_money('rev')}||' ('||format('{{:.1f}}',pct)||'% of total).', 5, null from reg where rk=1"),
    ("region_decline", "regional", f"select region||' Underperforming', region||' region is down '||{_pct('abs(g)')}||' compared to the previous period. Immediate attention recommended.', 2, 'Investigate factors affecting '||region||' sales and consider regional promotions.' from r7"),
    ("weekly_trend", "trend", f"select 'Weekly Trend: '||case when g>0 then 'Upward' else 'Downward' end, 'Sales over the last 7 days are '||{_pct('g')}||' compared to the previous week, indicating an '||case when g>0 then 'upward' else 'downward' end||' trend.', 3, null from r8"),
    ("best_worst_day", "trend", f"select 'Daily Performance Variance', 'Best day: '||cast(bst.date as varchar)||' ('||{_money('bst.rev')}||'). Worst day: '||cast(wst.date as varchar)||' ('||{_money('wst.rev')}||').', 5, null from bst, wst where (select count(*) from day)>=7"),
    ("anomaly_severity", "anomaly", "select case when crit>0 then crit||' Critical Anomalies Detected' else high||' High-Priority Anomalies' end, case when crit>0 then 'There are '||crit||' critical anomalies requiring immediate attention. These represent significant deviations from expected patterns.' else 'Detected '||high||' high-priority anomalies that should be reviewed.' end, case when crit>0 then 1 else 2 end, case when crit>0 then 'Review critical anomalies immediately and investigate root causes.' end from sev where crit>0 or high>0"),
    ("anomaly_regions", "anomaly", "select 'Multiple Anomalies in '||region, region||' region has '||n||' detected anomalies, which may indicate a regional issue.', 2, 'Investigate operational issues in '||region||' region.' from areg where rk<=2 and n>=3"),
    ("forecast", "forecast", f"select 'Forecast: '||{_pct('g')}||case when g>0 then ' Increase' else ' Decrease' end||' Expected', 'Our ML model predicts a '||case when g>0 then 'increase' else 'decrease' end||' of '||{_pct('abs(g)')}||' over the next '||h||' days. Projected total: '||{_money('f_total')}||'.', case when abs(g)<0.15 then 3 else 2 end, case when g>0 then 'Prepare for increased demand' else 'Consider promotional activities to boost sales' end from r12"),
    ("weekend", "recommendation", f"select case when we>wd*1.3 then 'Weekend Sales Outperformance' else 'Weekday Sales Dominance' end, case when we>wd*1.3 then 'Weekend sales average '||{_money('we')}||'/day vs '||{_money('wd')}||'/day on weekdays. Consider weekend-focused campaigns.' else 'Weekday sales are stronger ('||{_money('wd')}||'/day) than weekends ('||{_money('we')}||'/day).' end, 4, case when we>wd*1.3 then 'Increase weekend staffing and promotional activities.' else 'Consider weekend promotions to boost off-peak sales.' end from wkd where we>wd*1.3 or wd>we*1.3"),
]


#: Rules of several insights, with the table whose rank orders them.
_RANKED = {"category_growth": "r4", "region_decline": "r7", "anomaly_regions": "areg"}


def _all(skip=()):
    def ranked(rule, sql):
        head, at, tail = sql.rpartition(f" from {_RANKED[rule]}") if rule in _RANKED else (f"select x.*, 0 as rk from ({sql}) x", "", "")
        return f"{head}, rk{at}{tail}" if at else head
    parts = [f"select '{rule}' as rule, '{kind}' as type, {i} as pos, x.* from ({ranked(rule, sql)}) x" for i, (rule, kind, sql) in enumerate(_RULES) if rule not in skip]
    return "every as (" + "\nunion all ".join(parts) + """),
ins as (select rule, type, title, message, cast(priority as integer) as priority, case priority when 1 then 'critical' when 2 then 'high' when 3 then 'medium' when 4 then 'low' else 'info' end as priority_label, action, pos, rk from every)"""


SHOWN = "rule, type, title, message, priority, priority_label, action"
NAMES = SHOWN.split(", ")


def everything(spark, d):
    rows = joined(spark, d)
    return insights.generate(rows, latest_sale(spark, d), breakdown=detected(spark, d, rows), forecast=naive_forecast(spark, d))


@query("insights_all", on_sales(f"with {BASE}, {_all()} select {SHOWN} from ins"))
def insights_all(spark, d):
    return everything(spark, d).select(*NAMES)


@query("insights_top", on_sales(f"with {BASE}, {_all()} select {SHOWN} from ins order by priority, pos, rk limit 5"))
def insights_top(spark, d):
    return insights.top(everything(spark, d)).select(*NAMES)


@query("insights_by_type", on_sales(f"with {BASE}, {_all()} select {SHOWN} from ins where type='regional'"))
def insights_by_type(spark, d):
    return insights.of_type(everything(spark, d), "regional").select(*NAMES)


@query("insights_critical", on_sales(f"with {BASE}, {_all()} select {SHOWN} from ins where priority<=2"))
def insights_critical(spark, d):
    return insights.critical(everything(spark, d)).select(*NAMES)


@query("insights_summary", on_sales(f"""with {BASE}, {_all()}
select 'type' as section, type as key, count(*) as n, bool_or(priority=1) as has_critical, bool_or(priority=2) as has_high from ins group by type
union all select 'priority', priority_label, count(*), bool_or(priority=1), bool_or(priority=2) from ins group by priority_label
union all select 'total', 'all', count(*), bool_or(priority=1), bool_or(priority=2) from ins"""))
def insights_summary(spark, d):
    return insights.overview(everything(spark, d))


# ------------------------------------------------------------------ figures of single rules
@query("insight_revenue", on_sales(f"""with {BASE} select current_revenue, previous_revenue, cur_n as transaction_count, hist_n as previous_count, g as growth_rate,
  case when g>0.01 then '↑' when g < -0.01 then '↓' else '→' end as trend, {_class('g')} as change_class from r1, tot"""))
def insight_revenue(spark, d):
    return insights.revenue_figures(cells(spark, d))


@query("insight_volume", on_sales(f"with {BASE} select cur_rev as current_revenue, hist_rev as previous_revenue, cur_n as transaction_count, hist_n as previous_count, cur_rev/cur_n as avg_order_value from tot where cur_n>0"))
def insight_volume(spark, d):
    return insights.volume_figures(cells(spark, d))


@query("insight_top_category", on_sales(f"with {BASE} select category, rev as revenue, round(pct,6) as percentage, 1 as rank from cat where rk=1"))
def insight_top_category(spark, d):
    return rounded(insights.top_figures(cells(spark, d), "category"), "percentage", digits=6)


@query("insight_category_growth", on_sales(f"with {BASE} select category, g as growth_rate, current_revenue, previous_revenue, cast(rk as integer) as rank from r4"))
def insight_category_growth(spark, d):
    return insights.category_growth_figures(cells(spark, d))


@query("insight_top_products", on_sales(f"with {BASE} select product_name, rev as revenue, cast(rk as integer) as rank from prod where rk<=3"))
def insight_top_products(spark, d):
    return insights.top_product_figures(cells(spark, d))


@query("insight_top_region", on_sales(f"with {BASE} select region, rev as revenue, round(pct,6) as percentage, 1 as rank from reg where rk=1"))
def insight_top_region(spark, d):
    return rounded(insights.top_figures(cells(spark, d), "region"), "percentage", digits=6)


@query("insight_region_decline", on_sales(f"with {BASE} select region, g as growth_rate, current_revenue, previous_revenue, cast(rk as integer) as rank from r7"))
def insight_region_decline(spark, d):
    return insights.region_decline_figures(cells(spark, d))


@query("insight_weekly_trend", on_sales(f"with {BASE} select round(a,2) as recent_7d_total, round(b,2) as previous_7d_total, n as active_days, round((a-b)/b,6) as growth_rate from wk where n>=14 and abs((a-b)/b)>0.1"))
def insight_weekly_trend(spark, d):
    out = rounded(insights.weekly_trend_figures(cells(spark, d)), "recent_7d_total", "previous_7d_total", digits=2)
    return rounded(out, "growth_rate", digits=6)


@query("insight_best_worst", on_sales(f"with {BASE} select bst.date as best_day, bst.rev as best_revenue, wst.date as worst_day, wst.rev as worst_revenue from bst, wst where (select count(*) from day)>=7"))
def insight_best_worst(spark, d):
    return insights.best_worst_figures(cells(spark, d))


@query("insight_anomaly_severity", on_sales(f"with {BASE} select cast(crit as bigint) as critical_count, cast(high as bigint) as high_count, cast(total as bigint) as total_anomalies from sev where crit>0 or high>0"))
def insight_anomaly_severity(spark, d):
    return insights.anomaly_severity_figures(detected(spark, d))


@query("insight_anomaly_regions", on_sales(f"with {BASE} select region, n as anomaly_count, cast(rk as integer) as rank from areg where rk<=2 and n>=3"))
def insight_anomaly_regions(spark, d):
    return insights.anomaly_region_figures(detected(spark, d))


@query("insight_forecast", on_sales(f"with {BASE} select round(f_avg,4) as forecast_daily_avg, f_total as forecast_total, h as horizon_days, round(c_avg,4) as current_daily_avg, round(g,6) as growth_rate from r12"))
def insight_forecast(spark, d):
    out = insights.forecast_figures(cells(spark, d), naive_forecast(spark, d))
    return rounded(rounded(out, "forecast_daily_avg", "current_daily_avg"), "growth_rate", digits=6)


@query("insight_weekend", on_sales(f"with {BASE} select round(we,4) as weekend_avg, round(wd,4) as weekday_avg, case when we>wd*1.3 then 'weekend' else 'weekday' end as better from wkd where we>wd*1.3 or wd>we*1.3"))
def insight_weekend(spark, d):
    return rounded(insights.weekend_figures(cells(spark, d)), "weekend_avg", "weekday_avg")


@query("period_changes", on_sales("""with cur as (select category, cast(sum(total_amount) as double) as c from sales where ts >= (select as_of from ref) - interval 30 day group by 1),
prev as (select category, cast(sum(total_amount) as double) as p from sales where ts >= (select as_of from ref) - interval 60 day and ts < (select as_of from ref) - interval 30 day group by 1)
select category, (c-p)/p as growth_rate, c as current_revenue, p as previous_revenue, cast(row_number() over (order by c desc, category) as integer) as rank from cur join prev using (category)"""))
def period_changes(spark, d):
    """Categories against the window before, instead of all history."""
    as_of = latest_sale(spark, d)
    rows = load_sales(spark, d, COLS, since=as_of - timedelta(days=60))
    return insights.change_figures(insights.summarise(rows, as_of, 30, "previous_window"), "category")


# ------------------------------------------------------------------ jobs
@query("job_refresh_insights", on_sales(f"with {BASE.replace('/s)>2 then 1', '/s)>3 then 1')}, {_all()} select {SHOWN} from ins"))
def job_refresh_insights(spark, d):
    """The job end to end: cleaning, detection, all rules, a new version of the table."""
    rows, forecast = load_sales(spark, d), naive_forecast(spark, d)
    return jobs.refresh_insights(rows, fresh_path(spark, "insights"), latest_sale(spark, d), forecast=forecast).select(*NAMES)


@query("job_refresh_incrementally", on_sales(f"with {BASE.replace('/s)>2 then 1', '/s)>3 then 1')}, {_all()} select {SHOWN} from ins"))
def job_refresh_incrementally(spark, d):
    """Three refreshes as days go by; the last one reads what is new and equals a refresh from all rows."""
    rows, as_of = joined(spark, d), latest_sale(spark, d)
    cells, out = DailyCells(spark, fresh_path(spark, "daily-cells")), fresh_path(spark, "insights")
    cells.update(rows, (as_of - timedelta(days=40)).date())
    cells.update(rows, (as_of - timedelta(days=9)).date())
    return jobs.refresh_insights_incrementally(rows, cells, out, as_of, forecast=naive_forecast(spark, d)).select(*NAMES)


@query("stream_refresh", on_sales(f"with {BASE.replace('/s)>2 then 1', '/s)>3 then 1')}, {_all(skip=('forecast',))} select {SHOWN} from ins"))
def stream_refresh(spark, d):
    """The insight table kept up to date while sales arrive: each batch stores its finished days and refreshes from them."""
    rows, as_of = load_sales(spark, d, COLS), latest_sale(spark, d)
    base = fresh_path(spark, "refresh")
    landing, cells = f"{base}/landing", DailyCells(spark, f"{base}/cells")

    def refresh(batch, batch_id):
        arrived = read_transactions(spark, landing, schema=rows.schema)
        jobs.refresh_insights_incrementally(arrived, cells, f"{base}/insights")
    cut = timestamp_literal(as_of - timedelta(days=20))
    for part in (rows.filter(F.col("timestamp") < cut), rows.filter(F.col("timestamp") >= cut)):
        part.write.mode("append").parquet(landing)
        run = sinks.start_refresh(read_sales(spark, landing, schema=rows.schema), refresh, f"{base}/checkpoint", "1 second")
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    return jobs.newest_version(spark, f"{base}/insights").select(*NAMES)


@query("job_score_anomalies", on_dirty(f"""{_CLEAN}, fin as (select transaction_id, case when abs(amt-q*pr)/(q*pr) > 0.1 then q*pr else amt end as amt from fx),
st as (select avg(amt) as m, stddev_samp(amt) as s from fin)
select transaction_id, round((amt-m)/s,4) as total_amount_zscore, case when abs((amt-m)/s)>3 then 1 else 0 end as is_anomaly from fin, st""".replace("st as (select quantile_cont", "q0 as (select quantile_cont").replace("from dd, st)", "from dd, q0)")))
def job_score_anomalies(spark, d):
    scored = jobs.score_anomalies(load_dirty_sales(spark, d), fresh_path(spark, "scored"),
                                  order=["timestamp", "l_partkey", "l_suppkey", "total_amount"])
    return rounded(scored.select("transaction_id", "total_amount_zscore", "is_anomaly"), "total_amount_zscore")
