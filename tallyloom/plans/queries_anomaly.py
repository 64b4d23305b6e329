"""Detection, report and explanation queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import filters
from ..operators.anomaly import density, report, stats
from ..operators.anomaly.detector import AnomalyDetector, MultiDimensionalDetector
from ..operators.features import Scaler
from ..session import fresh_path
from ..sources.star import load_event_sales, load_sales
from . import jobs
from .registry import on_events, on_sales, query, rounded

FEATURES = ["quantity", "unit_price", "total_amount"]
EVENT_COLS = ["timestamp", "transaction_id", "category", "region", *FEATURES]

_STAT = ", ".join(f"avg(cast({c} as double)) as m_{c}, stddev_samp(cast({c} as double)) as s_{c}" for c in FEATURES)
STATS = f"st as (select {_STAT} from sales)"
Z = {c: f"(cast({c} as double)-m_{c})/s_{c}" for c in FEATURES}
SEVERITY = "case when abs({0})>=5 then 'critical' when abs({0})>=4 then 'high' when abs({0})>=3 then 'medium' else 'low' end"
DETECTED = f"""{STATS}, det as (select s.*, {Z['total_amount']} as z, case when abs({Z['total_amount']})>3 then 1 else 0 end as flag,
  {SEVERITY.format(Z['total_amount'])} as severity from sales s, st)"""


def detected_events(spark, d, columns=EVENT_COLS):
    rows = load_event_sales(spark, d, columns)
    return stats.detect_by_zscore(rows, stats.ColumnStats.fit(rows, ["total_amount"]))


@query("feature_stats", on_sales("\nunion all ".join(
    f"select '{c}' as feature, round(avg(cast({c} as double)),4) as mean, round(stddev_samp(cast({c} as double)),4) as std from sales" for c in FEATURES)))
def feature_stats(spark, d):
    return rounded(stats.ColumnStats.frame(load_sales(spark, d, FEATURES), FEATURES), "mean", "std")


@query("zscore_flags", on_sales(f"""with {DETECTED} select transaction_id, round(z,4) as total_amount_zscore, flag as is_anomaly_zscore,
  flag as is_anomaly, severity from det"""))
def zscore_flags(spark, d):
    rows = load_sales(spark, d, ["transaction_id", "total_amount"])
    out = stats.detect_by_zscore(rows, stats.ColumnStats.fit(rows, ["total_amount"]))
    return rounded(out.drop("total_amount"), "total_amount_zscore")


@query("zscore_flags_daily", on_sales("""with d as (select cast(ts as date) as date, cast(sum(total_amount) as double) as rev from sales group by 1),
st as (select avg(rev) as m, stddev_samp(rev) as s from d)
select date, round((rev-m)/s,4) as total_revenue_zscore, case when abs((rev-m)/s)>2 then 1 else 0 end as is_anomaly_zscore from d, st"""))
def zscore_flags_daily(spark, d):
    from ..operators.aggregates import revenue_by
    days = revenue_by(load_sales(spark, d, ["timestamp", "transaction_id", "total_amount"]), F.to_date("timestamp"), "date")
    out = stats.add_zscore_flags(days, stats.ColumnStats.fit(days, ["total_revenue"]), threshold=2.0)
    return rounded(out.select("date", "total_revenue_zscore", "is_anomaly_zscore"), "total_revenue_zscore")


@query("zscore_outliers", on_events("""with st as (select avg(cast(total_amount as double)) as m, stddev_pop(cast(total_amount as double)) as s from sales)
select transaction_id, cast(total_amount as double) as total_amount from sales, st where abs((cast(total_amount as double)-m)/s)>3"""))
def zscore_outliers(spark, d):
    rows = load_event_sales(spark, d, ["transaction_id", "total_amount"])
    return stats.zscore_outliers(rows, "total_amount").withColumn("total_amount", F.col("total_amount").cast("double"))


_IQR = """with q as (select quantile_cont(cast({c} as double),0.25) as q1, quantile_cont(cast({c} as double),0.75) as q3 from sales)
select transaction_id, cast({c} as double) as {c} from sales, q where {c} < q1-1.5*(q3-q1) or {c} > q3+1.5*(q3-q1)"""


@query("iqr_outliers", on_events(_IQR.format(c="total_amount")))
def iqr_outliers(spark, d):
    rows = load_event_sales(spark, d, ["transaction_id", "total_amount"])
    return stats.iqr_outliers(rows, "total_amount").withColumn("total_amount", F.col("total_amount").cast("double"))


@query("iqr_outliers_sales", on_sales(_IQR.format(c="unit_price")))
def iqr_outliers_sales(spark, d):
    rows = load_sales(spark, d, ["transaction_id", "unit_price"])
    return stats.iqr_outliers(rows, "unit_price").withColumn("unit_price", F.col("unit_price").cast("double"))


@query("anomaly_report", on_events(f"""with {DETECTED}, r as (select *, case when ts >= (select as_of from ref) - interval 24 hour then flag else 0 end as recent from det)
select 'severity' as section, severity as key, cast(sum(flag) as bigint) as anomalies, cast(sum(recent) as bigint) as recent, count(*) as analysed from r group by severity having sum(flag)>0
union all select 'date', cast(cast(ts as date) as varchar), cast(sum(flag) as bigint), cast(sum(recent) as bigint), count(*) from r group by 2 having sum(flag)>0
union all select 'category', category, cast(sum(flag) as bigint), cast(sum(recent) as bigint), count(*) from r group by category having sum(flag)>0
union all select 'region', region, cast(sum(flag) as bigint), cast(sum(recent) as bigint), count(*) from r group by region having sum(flag)>0
union all select 'total', null, cast(sum(flag) as bigint), cast(sum(recent) as bigint), count(*) from r"""))
def anomaly_report(spark, d):
    rows = detected_events(spark, d)
    return report.breakdown(rows, filters.newest(rows))


@query("anomaly_report_summary", on_events(f"""with {DETECTED} select cast(sum(flag) as bigint) as total_anomalies, sum(flag)/count(*)*100 as anomaly_rate,
  cast(sum(case when ts >= (select as_of from ref) - interval 24 hour then flag else 0 end) as bigint) as recent_count_24h,
  cast(sum(case when severity='critical' then flag else 0 end) as bigint) as critical_count,
  cast(sum(case when severity='high' then flag else 0 end) as bigint) as high_count from det"""))
def anomaly_report_summary(spark, d):
    rows = detected_events(spark, d)
    return report.summary(report.breakdown(rows, filters.newest(rows))).select(
        "total_anomalies", "anomaly_rate", "recent_count_24h", "critical_count", "high_count")


@query("anomaly_counts", on_events(f"with {DETECTED} select region, count(*) as anomalies from det where flag=1 group by 1"))
def anomaly_counts(spark, d):
    return report.value_counts(detected_events(spark, d), "region")


@query("anomalies_query", on_events(f"""with {DETECTED} select transaction_id, ts as "timestamp", category, region, round(z,4) as total_amount_zscore, severity
from det where flag=1 and ts >= (select as_of from ref) - interval 7 day"""))
def anomalies_query(spark, d):
    rows = load_event_sales(spark, d, EVENT_COLS)
    fitted = stats.ColumnStats.fit(rows, ["total_amount"])
    recent = filters.trailing(rows, 7, filters.newest(rows))
    out = filters.flagged(stats.detect_by_zscore(recent, fitted))
    return rounded(out.select("transaction_id", "timestamp", "category", "region", "total_amount_zscore", "severity"), "total_amount_zscore")


@query("severity_filter", on_events(f"with {DETECTED} select transaction_id, severity from det where flag=1 and severity='critical'"))
def severity_filter(spark, d):
    return filters.with_severity(filters.flagged(detected_events(spark, d)), "critical").select("transaction_id", "severity")


@query("recent_anomalies", on_events(f"""with {DETECTED} select transaction_id, ts as "timestamp", severity from det where flag=1 and severity in ('high','critical')
order by ts desc, transaction_id desc limit 10"""))
def recent_anomalies(spark, d):
    return report.recent(detected_events(spark, d), 10, "high").select("transaction_id", "timestamp", "severity")


_UNPIVOT = "\nunion all ".join(
    f"select transaction_id, {i} as pos, '{c}' as feature, cast({c} as double) as value, m_{c} as expected, {Z[c]} as z from sales, st"
    for i, c in enumerate(FEATURES))
_ADVICE = """case when feature='total_amount' and z>0 then 'Large transaction detected - verify for fraud or bulk order'
  when feature='total_amount' then 'Unusually small transaction - may indicate pricing error'
  when feature='quantity' and z>0 then 'High volume order - ensure inventory availability'
  when feature='quantity' then 'Low volume despite normal revenue - check pricing'
  else concat('Review ', feature, ' for unusual ', case when z>0 then 'higher' else 'lower' end, ' values') end"""


@query("explain_factors", on_events(f"""with {STATS}, u as ({_UNPIVOT}),
k as (select *, row_number() over (partition by transaction_id order by abs(z) desc, pos) as rank from u where abs(z)>2)
select transaction_id, cast(rank as integer) as rank, feature, value, round(expected,4) as expected, round(z,4) as zscore,
  case when z>0 then 'higher' else 'lower' end as direction, round(abs((value-expected)/expected*100),4) as deviation_percentage,
  first_value({_ADVICE}) over (partition by transaction_id order by rank) as recommendation from k where rank<=5"""))
def explain_factors(spark, d):
    rows = load_event_sales(spark, d, ["transaction_id", *FEATURES])
    told = report.explain(rows, stats.ColumnStats.fit(rows, FEATURES), FEATURES)
    return rounded(report.factor_rows(told, ["transaction_id"]), "expected", "zscore", "deviation_percentage")


@query("explain_summary", on_events(f"""with {STATS}, u as ({_UNPIVOT}),
k as (select *, row_number() over (partition by transaction_id order by abs(z) desc, pos) as rank from u where abs(z)>2),
t as (select transaction_id, string_agg(concat(feature,' is ',format('{{:.1f}}',abs((value-expected)/expected*100)),'% ',case when z>0 then 'higher' else 'lower' end,' than expected'), '; ' order by pos) as explanations from k group by 1)
select s.transaction_id, coalesce('Primary cause: ' || feature || ' is ' || case when z>0 then 'higher' else 'lower' end || ' than normal', 'Unusual pattern detected across multiple features') as summary,
  coalesce(explanations,'') as explanations, coalesce({_ADVICE.replace("else concat", "when feature is not null then concat")}, 'Monitor this data point for recurring patterns') as recommendation
from sales s left join (select * from k where rank=1) f using (transaction_id) left join t using (transaction_id)"""))
def explain_summary(spark, d):
    rows = load_event_sales(spark, d, ["transaction_id", *FEATURES])
    told = report.explain(rows, stats.ColumnStats.fit(rows, FEATURES), FEATURES)
    return told.select("transaction_id", "summary", F.array_join("explanations", "; ").alias("explanations"), "recommendation")


@query("multidim_zscore", on_sales(f"""with {STATS}, f as (select transaction_id,
  case when abs({Z['quantity']})>3 or abs({Z['total_amount']})>3 then 1 else 0 end as anomaly_volume, round(abs({Z['quantity']}),4) as score_volume,
  case when abs({Z['unit_price']})>3 or abs({Z['total_amount']})>3 then 1 else 0 end as anomaly_value,
  round(greatest(abs({Z['unit_price']}), abs({Z['total_amount']})),4) as score_value from sales, st)
select *, case when anomaly_volume+anomaly_value>0 then 1 else 0 end as is_multi_anomaly, anomaly_volume+anomaly_value as anomaly_dimensions from f"""))
def multidim_zscore(spark, d):
    rows = load_sales(spark, d, ["transaction_id", *FEATURES])
    many = (MultiDimensionalDetector().add_dimension("volume", ["quantity"], "zscore")
            .add_dimension("value", ["unit_price", "total_amount"], "zscore").fit(rows))
    return rounded(many.transform(rows).drop(*FEATURES), "score_volume", "score_value")


@query("iqr_detector", on_events("""with q as (select quantile_cont(cast(total_amount as double),0.25) as q1, quantile_cont(cast(total_amount as double),0.75) as q3,
  avg(cast(total_amount as double)) as m, stddev_samp(cast(total_amount as double)) as s from sales),
x as (select transaction_id, greatest(q1-cast(total_amount as double), cast(total_amount as double)-q3, 0)/(q3-q1) as score, abs((cast(total_amount as double)-m)/s)>3 as far from sales, q)
select transaction_id, round(score,4) as anomaly_score, case when score>1.5 or far then 1 else 0 end as is_anomaly from x"""))
def iqr_detector(spark, d):
    rows = load_event_sales(spark, d, ["transaction_id", "total_amount"])
    out = AnomalyDetector("iqr").fit(rows, ["total_amount"]).transform(rows)
    return rounded(out.select("transaction_id", "anomaly_score", "is_anomaly"), "anomaly_score")


def _scaled(columns):
    return ", ".join(f"(cast({c} as double)-avg(cast({c} as double)) over ())/stddev_pop(cast({c} as double)) over () as x{i}" for i, c in enumerate(columns))


@query("dbscan_noise", on_events(f"""with s as (select transaction_id, {_scaled(['quantity', 'total_amount'])} from sales),
p as (select x0, x1, count(*) as w from s group by all),
n as (select a.x0, a.x1, sum(b.w) as near from p a join p b on abs(a.x0-b.x0)<=0.5 and abs(a.x1-b.x1)<=0.5 and (a.x0-b.x0)*(a.x0-b.x0)+(a.x1-b.x1)*(a.x1-b.x1)<=0.25 group by all),
c as (select x0, x1 from n where near>=5),
b as (select distinct a.x0, a.x1 from n a join c on a.near<5 and abs(a.x0-c.x0)<=0.5 and (a.x0-c.x0)*(a.x0-c.x0)+(a.x1-c.x1)*(a.x1-c.x1)<=0.25)
select s.transaction_id, case when n.near<5 and b.x0 is null then 1 else 0 end as is_anomaly_ml
from s join n on s.x0=n.x0 and s.x1=n.x1 left join b on s.x0=b.x0 and s.x1=b.x1"""))
def dbscan_noise(spark, d):
    rows = load_event_sales(spark, d, ["transaction_id", "quantity", "total_amount"])
    scaled = Scaler.fit(rows, ["quantity", "total_amount"]).transform(rows)
    return density.noise_flags(scaled, ["quantity", "total_amount"]).select("transaction_id", "is_anomaly_ml")


@query("dbscan_detector")
def dbscan_detector(spark, d):
    """Three features over all sales; noise joined with the z-score."""
    rows = load_sales(spark, d, ["transaction_id", *FEATURES])
    return AnomalyDetector("dbscan").fit(rows, FEATURES).transform(rows).select(
        "transaction_id", "is_anomaly_ml", "is_anomaly_zscore", "is_anomaly", "severity")


@query("iforest_flags")
def iforest_flags(spark, d):
    """Isolation forest over all sales."""
    rows = load_sales(spark, d, ["transaction_id", *FEATURES])
    fitted = AnomalyDetector("isolation_forest", key=["transaction_id"]).fit(rows, FEATURES)
    return fitted.transform(rows).select("transaction_id", "is_anomaly_ml", "anomaly_score", "is_anomaly_zscore",
                                         "is_anomaly", "severity", "severity_z")


@query("iforest_report")
def iforest_report(spark, d):
    """Forest detection over the last 30 days of events, reported."""
    rows = load_event_sales(spark, d, EVENT_COLS)
    as_of = filters.newest(rows)
    fitted = AnomalyDetector("isolation_forest", key=["transaction_id"]).fit(rows, FEATURES)
    recent = rows.filter(F.col("timestamp") >= as_of - timedelta(days=30))
    return report.breakdown(fitted.transform(recent), as_of)


@query("lof_scores")
def lof_scores(spark, d):
    """Outlier factor of every event against all events; exact neighbours, checked by brute force in the tests."""
    rows = load_event_sales(spark, d, ["transaction_id", "quantity", "total_amount"])
    fitted = AnomalyDetector("lof").fit(rows, ["quantity", "total_amount"])
    return fitted.transform(rows).select("transaction_id", "anomaly_score", "is_anomaly_ml", "is_anomaly_zscore", "is_anomaly", "severity")


@query("detector_round_trip", on_events(f"with {DETECTED} select transaction_id, flag as is_anomaly, round(abs(z),4) as anomaly_score, severity from det"))
def detector_round_trip(spark, d):
    """A detector saved, loaded and applied."""
    rows = load_event_sales(spark, d, ["transaction_id", "total_amount"])
    path = AnomalyDetector("zscore").fit(rows, ["total_amount"]).save(spark, fresh_path(spark, "detector"))
    out = AnomalyDetector.load(spark, path).transform(rows)
    return rounded(out.select("transaction_id", "is_anomaly", "anomaly_score", "severity"), "anomaly_score")


@query("job_train_anomaly")
def job_train_anomaly(spark, d):
    """The training job: isolation forest at 2 % contamination, saved, loaded and applied to all sales."""
    rows = load_sales(spark, d, ["transaction_id", *FEATURES])
    path = fresh_path(spark, "forest")
    jobs.train_anomaly(rows, path)
    return AnomalyDetector.load(spark, path).transform(rows).select("transaction_id", "is_anomaly_ml", "is_anomaly", "severity_z")


@query("model_round_trip", on_events("""select a.algorithm, count(*) as transactions, count(*) as equal from sales, (values ('isolation_forest'), ('lof'), ('iqr'), ('zscore')) a(algorithm) group by 1"""))
def model_round_trip(spark, d):
    """For each method: on how many transactions the detector read back from its tables agrees with the fitted one in score, flags and severity."""
    rows, out = load_event_sales(spark, d, ["transaction_id", *FEATURES]), None
    shown = ["anomaly_score", "is_anomaly_ml", "is_anomaly", "severity"]
    for algorithm in ("isolation_forest", "lof", "iqr", "zscore"):
        fitted = AnomalyDetector(algorithm, key=["transaction_id"]).fit(rows, ["quantity", "total_amount"])
        again = AnomalyDetector.load(spark, fitted.save(spark, fresh_path(spark, "model")))
        a, b = (m.transform(rows).select("transaction_id", F.struct(*shown).alias(name)) for m, name in ((fitted, "a"), (again, "b")))
        part = a.join(b, "transaction_id").agg(F.lit(algorithm).alias("algorithm"), F.count("*").alias("transactions"), F.count_if(F.col("a") == F.col("b")).alias("equal"))
        out = part if out is None else out.unionByName(part)
    return out
