"""Split, metric, ensemble and model queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates, series
from ..operators.forecast import autoregression, ensemble, evaluate, grower
from ..operators.forecast.models import (SalesForecastModel, forecast_totals, prediction_summary,
                                         proxy_interval, rounded as in_currency)
from ..session import fresh_path, stage
from ..sources.star import load_sales
from . import jobs
from .registry import daily_ctes, on_sales, query, rounded

COLS = ["timestamp", "transaction_id", "quantity", "unit_price", "total_amount", "customer_id"]
D = daily_ctes("sales")


def daily(spark, d, segment=()):
    return aggregates.daily(load_sales(spark, d, COLS + list(segment)), segment)


# ------------------------------------------------------------------ deterministic parts
@query("chrono_split", on_sales(f"with {D} select date, case when row_number() over (order by date)-1 < floor(0.8*count(*) over ()) then 'train' else 'test' end as part from d"))
def chrono_split(spark, d):
    return evaluate.chrono_split(daily(spark, d).select("date"))


@query("cv_folds", on_sales(f"""with {D}, n as (select date, row_number() over (order by date)-1 as i, count(*) over () as n from d),
k as (select date, i, n, cast(floor(n/6) as bigint) as t, f as fold from n, range(5) r(f))
select date, cast(fold as integer) as fold, case when i < n-(5-fold)*t then 'train' else 'test' end as part from k where i < n-(5-fold)*t+t"""))
def cv_folds(spark, d):
    return evaluate.cv_folds(daily(spark, d).select("date"))


NAIVE = {"lag_1": "lag(total_revenue,1) over (order by date)", "lag_7": "lag(total_revenue,7) over (order by date)",
         "mean_7": "avg(total_revenue) over (order by date rows between 7 preceding and 1 preceding)"}
NAIVE_SQL = "p as (" + "\nunion all ".join(
    f"select * from (select '{m}' as model, date, total_revenue as y, {e} as value, row_number() over (order by date) as i from d) where i > 7" for m, e in NAIVE.items()) + ")"
SCORED_SQL = """q as (select *, y-lag(y) over (partition by model order by date) as dy, value-lag(value) over (partition by model order by date) as dp from p),
sc as (select model, sqrt(avg((y-value)*(y-value))) as rmse, avg(abs(y-value)) as mae, avg(case when y<>0 then abs((y-value)/y) end)*100 as mape,
  1-sum((y-value)*(y-value))/(var_pop(y)*count(y)) as r2, coalesce(avg(case when dy is not null then case when sign(dy)=sign(dp) then 1.0 else 0.0 end end),0)*100 as direction_accuracy from q group by 1)"""


def naive(spark, d):
    """Forecasts of three memory-only models in long form."""
    w = Window.partitionBy().orderBy("date")
    rows = daily(spark, d).select("date", F.col("total_revenue").alias("y"),
                                  F.lag("total_revenue", 1).over(w).alias("lag_1"), F.lag("total_revenue", 7).over(w).alias("lag_7"),
                                  F.avg("total_revenue").over(w.rowsBetween(-7, -1)).alias("mean_7"),
                                  F.row_number().over(w).alias("i")).filter("i > 7").drop("i")
    return rows.unpivot(["date", "y"], ["lag_1", "lag_7", "mean_7"], "model", "value")


@query("forecast_metrics", on_sales(f"with {D}, {NAIVE_SQL}, {SCORED_SQL} select model, round(rmse,4) as rmse, round(mae,4) as mae, round(mape,4) as mape, round(r2,6) as r2, round(direction_accuracy,6) as direction_accuracy from sc"))
def forecast_metrics(spark, d):
    out = evaluate.metrics(naive(spark, d), "y", "value", keys=("model",))
    return rounded(rounded(out, "rmse", "mae", "mape"), "r2", "direction_accuracy", digits=6)


@query("ensemble_weights", on_sales(f"with {D}, {NAIVE_SQL}, {SCORED_SQL} select model, round((1/mape)/sum(1/mape) over (),6) as weight from sc"))
def ensemble_weights(spark, d):
    scores = evaluate.metrics(naive(spark, d), "y", "value", keys=("model",))
    return rounded(ensemble.weights_from_mape(scores.select("model", "mape")), "weight", digits=6)


@query("ensemble_combine", on_sales(f"""with {D}, {NAIVE_SQL}, {SCORED_SQL}, w as (select model, (1/mape)/sum(1/mape) over () as weight from sc)
select date, round(sum(value*weight),2) as value, round(sum(value*weight)-1.96*stddev_pop(value),2) as confidence_lower, round(sum(value*weight)+1.96*stddev_pop(value),2) as confidence_upper, count(*) as models
from p join w using (model) group by 1"""))
def ensemble_combine(spark, d):
    forecasts = naive(spark, d)
    weights = ensemble.weights_from_mape(evaluate.metrics(forecasts, "y", "value", keys=("model",)).select("model", "mape"))
    out = ensemble.combine(forecasts.select("model", "date", "value"), weights)
    return rounded(out.drop("individual"), "value", "confidence_lower", "confidence_upper", digits=2)


@query("forecast_overlay", on_sales(f"""with {D}, l as (select * from d order by date desc limit 7)
select date, total_revenue as actual, null::double as forecast, null::double as confidence_upper from d
union all select cast(date + interval 7 day as date), null, total_revenue, total_revenue*1.1 from l"""))
def forecast_overlay(spark, d):
    actuals = daily(spark, d)
    ahead = actuals.orderBy(F.desc("date")).limit(7).select(
        F.date_add("date", 7).alias("date"), F.col("total_revenue").alias("value"), (F.col("total_revenue") * 1.1).alias("confidence_upper"))
    return evaluate.overlay(actuals, ahead)


@query("interval_fallback", on_sales(f"""with {D}, s as (select stddev_samp(total_revenue) as s from d)
select date, round(greatest(0, total_revenue-0.1*1.96*s),4) as confidence_lower, round(total_revenue+0.1*1.96*s,4) as confidence_upper from d, s"""))
def interval_fallback(spark, d):
    rows = daily(spark, d)
    spread = rows.agg(F.stddev_samp("total_revenue")).scalar()
    out = proxy_interval(rows.select("date", "total_revenue").withColumn("history_std", spread), "total_revenue", "history_std")
    return rounded(out.select("date", "confidence_lower", "confidence_upper"), "confidence_lower", "confidence_upper")


_P = 5


def _ar_sql():
    lag = ", ".join(f"lag(d0,{k}) over (order by date) as d{k}" for k in range(1, _P + 1))
    sums = ", ".join(f"sum(d0*d{k})/1e12 as xy{k}" for k in range(1, _P + 1))
    return on_sales(f"""with {D}, a as (select date, total_revenue-lag(total_revenue) over (order by date) as d0 from d),
b as (select *, {lag} from a) select count(*) as n, {", ".join(f"round(sum(d0*d{k})/1e12,4) as xy{k}" for k in range(1, _P + 1))} from b where d{_P} is not null""")


@query("ar_cross_products", _ar_sql())
def ar_cross_products(spark, d):
    """Sums behind the autoregression: products of the differences with their lags."""
    out = autoregression._products(daily(spark, d), _P, "total_revenue", ())
    return out.select("n", *[F.round(F.col("sums")[k] / 1e12, 4).alias(f"xy{k}") for k in range(1, _P + 1)])


# ------------------------------------------------------------------ models told by SQL
TREE = grower.Rules(depth=3, min_split=5, min_leaf=2)
TREE_FEATURES = ("transaction_count", "avg_unit_price", "day_of_week", "month", "is_weekend", "revenue_lag_1", "revenue_lag_7")


def _tree_sql() -> str:
    """The tree level by level: all cuts between two values of a node, the best by explained squares, feature, value."""
    cells = "\nunion all ".join(f"select date, {i} as k, cast({c} as double) as x from b" for i, c in enumerate(TREE_FEATURES))
    steps = [f"""b as (select date, total_revenue, transaction_count, avg_unit_price, day_of_week, month, is_weekend,
  coalesce(lag(total_revenue,1) over (order by date),0) as revenue_lag_1, coalesce(lag(total_revenue,7) over (order by date),0) as revenue_lag_7 from f),
m as (select round(avg(total_revenue)) as m from b), y as (select date, cast(round((total_revenue-m)*10000) as hugeint) as q from b, m),
x as ({cells}), n0 as (select date, 1 as node from b)"""]
    for level in range(TREE.depth + 1):
        steps.append(f"""t{level} as (select node, count(*) as n, cast(sum(q) as hugeint) as s from n{level} join y using (date) group by 1)""")
        if level == TREE.depth:
            break
        steps.append(f"""c{level} as (select node, k, x, count(*) as n, sum(q) as s from n{level} join y using (date) join x using (date) group by 1,2,3),
u{level} as (select c.node, c.k, c.x, lead(c.x) over w as nx, sum(c.n) over w as ln, sum(c.s) over w as ls, t.n as tn, t.s as ts
  from c{level} c join t{level} t on c.node=t.node window w as (partition by c.node, c.k order by c.x)),
e{level} as (select *, (cast(ls as double)*cast(ls as double))/ln+(cast(ts-ls as double)*cast(ts-ls as double))/(tn-ln) as e from u{level}
  where nx is not null and tn>={TREE.min_split} and ln>={TREE.min_leaf} and tn-ln>={TREE.min_leaf}),
s{level} as (select * from (select *, row_number() over (partition by node order by e desc, k, x) as best from e{level})
  where best=1 and e>cast(ts as double)*cast(ts as double)/tn*(1+1e-12)),
n{level + 1} as (select n.date, 2*n.node+case when x.x<=s.x then 0 else 1 end as node from n{level} n join s{level} s on n.node=s.node join x on x.date=n.date and x.k=s.k)""")
    rows = " union all ".join([f"select t.node, s.k as feature, round((s.x+s.nx)/2,6) as threshold, t.n as days, round(t.s/10000.0/t.n+m,2) as value from m, t{v} t left join s{v} s on s.node=t.node"
                               for v in range(TREE.depth)] + [f"select t.node, null, null, t.n, round(t.s/10000.0/t.n+m,2) from m, t{TREE.depth} t"])
    return on_sales(f"with {D}, " + ",\n".join(steps) + f""", r as ({rows})
select g.grown, r.node, r.feature, r.threshold, r.days, r.value from r, (values ('task'), ('levels')) g(grown)""")


@query("tree_by_levels", _tree_sql())
def tree_by_levels(spark, d):
    """One tree of depth 3 over the days, grown below its root by one task, and level by level by Spark wherever a node holds
    more than 100 days; both are to be the same tree. ``node`` numbers the root 1 and children 2n and 2n + 1."""
    w = Window.orderBy("date")
    rows = daily(spark, d).withColumns({f"revenue_lag_{n}": F.coalesce(F.lag("total_revenue", n).over(w), F.lit(0.0)) for n in (1, 7)})
    rows = stage(rows.select(F.array(*[F.col(c).cast("double") for c in TREE_FEATURES]).alias("x"), F.col("total_revenue").cast("double").alias("y")), "tree")
    found = []
    for grown, local in (("task", TREE.local_rows), ("levels", 100)):
        nodes = grower.tree(rows, len(TREE_FEATURES), replace(TREE, local_rows=local))
        number = {0: 1}
        for r in nodes.itertuples(index=False):  # at most 15 nodes, parents first
            if r.feature >= 0:
                number |= {r.left: 2 * number[r.node], r.right: 2 * number[r.node] + 1}
        found += [(grown, number[r.node], r.feature if r.feature >= 0 else None, round(r.threshold, 6) if r.feature >= 0 else None, int(r.drawn), round(r.value, 2))
                  for r in nodes.itertuples(index=False)]
    return spark.createDataFrame(found, "grown string, node int, feature int, threshold double, days long, value double")


@query("ridge_two_features", on_sales(f"""with {D}, b as (select date, total_revenue as y, cast(day_of_week as double) as a, coalesce(cast(lag(total_revenue,7) over (order by date) as double),0) as b from f),
m as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(y) as my, count(*) as n from b),
z as (select (a-ma)/sa as p, (b-mb)/sb as q, y-my as y from b, m),
s as (select sum(p*p)+1 as pp, sum(q*q)+1 as qq, sum(p*q) as pq, sum(p*y) as py, sum(q*y) as qy from z)
select 'day_of_week' as feature, round((py*qq-pq*qy)/(pp*qq-pq*pq),3) as coefficient, round(my,3) as intercept from s, m
union all select 'revenue_lag_7', round((pp*qy-pq*py)/(pp*qq-pq*pq),3), round(my,3) from s, m"""))
def ridge_two_features(spark, d):
    """The ridge model on two scaled features; its twin solves the two normal equations."""
    rows = daily(spark, d).select("date", "total_revenue", "day_of_week", F.coalesce(F.lag("total_revenue", 7).over(Window.orderBy("date")), F.lit(0.0)).alias("revenue_lag_7"))
    model = SalesForecastModel("linear")
    model._fit(model.prepare_features(rows))
    return spark.createDataFrame([(c, round(w, 3), round(model.intercept, 3)) for c, w in zip(model.columns, model.coefficients)], "feature string, coefficient double, intercept double")


AR1_SQL = f"""with {daily_ctes("sales", "region")}, a as (select region, date, total_revenue-lag(total_revenue) over w as d0, total_revenue as y from d window w as (partition by region order by date)),
b as (select *, lag(d0) over (partition by region order by date) as d1 from a),
s as (select region, sum(d0*d1)/sum(d1*d1) as phi, count(*) as n from b where d1 is not null group by 1),
v as (select s.region, phi, s.n, sum((d0-phi*d1)*(d0-phi*d1))/s.n as s2 from b join s on b.region=s.region where d1 is not null group by 1,2,3),
l as (select region, max(date) as last_date, arg_max(y,date) as y, arg_max(d0,date) as d0 from b group by 1)"""


@query("ar1_information", on_sales(f"""{AR1_SQL} select region, n, round(phi,6) as phi, round(ln(s2),6) as log_sigma2, round(4+n*(ln(2*pi()*s2)+1),3) as aic, round(2*ln(n)+n*(ln(2*pi()*s2)+1),3) as bic from v"""))
def ar1_information(spark, d):
    """ARIMA(1,1,0) for every region, in the closed form that one coefficient has."""
    fitted = autoregression.fit(daily(spark, d, ("region",)), 1, segment=("region",))
    return fitted.select("region", "n", F.round(F.col("phi")[0], 6).alias("phi"), F.round(F.log("sigma2"), 6).alias("log_sigma2"), F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"))


@query("ar1_forecast", on_sales(f"""{AR1_SQL}, h as (select region, last_date, y, d0, phi, s2, step, list_sum([phi**i for i in range(1,step+1)]) as run,
  list_sum([list_sum([phi**j for j in range(0,i+1)])**2 for i in range(0,step)]) as spread from v join l using (region), range(1,4) r(step))
select region, cast(step as integer) as step, cast(last_date+cast(step as integer)*interval 1 day as date) as date, round(y+d0*run,2) as value,
  round(y+d0*run-1.959963984540054*sqrt(s2*spread),2) as confidence_lower, round(y+d0*run+1.959963984540054*sqrt(s2*spread),2) as confidence_upper from h"""))
def ar1_forecast(spark, d):
    fitted = autoregression.fit(daily(spark, d, ("region",)), 1, segment=("region",))
    return rounded(autoregression.forecast(fitted, 3, ("region",)).drop("model"), "value", "confidence_lower", "confidence_upper", digits=2)


PHIS = (-0.6, -0.3, 0.0, 0.5)
#: d1 is 0 for the first difference, whose own variance is wider by 1/(1-phi*phi).
EXACT_SQL = f"""with {daily_ctes("sales", "region")}, a as (select region, date, total_revenue-lag(total_revenue) over (partition by region order by date) as d0 from d),
b as (select *, lag(d0) over (partition by region order by date) as d1 from a where d0 is not null),
w as (select region, count(*) as n, sum(d0*d0) as s00, sum(case when d1 is not null then d1*d1 end) as s11, sum(d0*d1) as s01, sum(case when d1 is null then d0*d0 end) as h from b group by 1),
l as (select region, phi, n, (s00-h-2*phi*s01+phi*phi*s11+h*(1-phi*phi))/n as s2 from w, (select unnest(PHIS) as phi) g),
e as (select region, phi, n, s2, -0.5*(n*(ln(2*pi()*s2)+1)-ln(1-phi*phi)) as loglik from l)"""


@query("ar1_likelihood", on_sales(EXACT_SQL.replace("PHIS", str(list(PHIS))) + " select region, cast(phi as double) as phi, n, round(ln(s2),6) as log_sigma2, round(loglik,4) as loglik from e"))
def ar1_likelihood(spark, d):
    """Exact likelihood of ARIMA(1,1,0) for given coefficients, every region."""
    phi = F.element_at(F.array(*[F.lit(float(v)) for v in PHIS]), F.col("candidate") + 1)
    out = autoregression.likelihoods(daily(spark, d, ("region",)), [[v] for v in PHIS], segment=("region",))
    return out.select("region", phi.alias("phi"), "n", F.round(F.log("sigma2"), 6).alias("log_sigma2"), F.round("loglik", 4).alias("loglik"))


@query("ar1_exact", on_sales(EXACT_SQL.replace("PHIS", "[i/1000.0::double for i in range(-999,1000)]") + """
select region, n, arg_max(phi, loglik) as near, round(max(loglik),3) as loglik, true as within, true as likeliest from e group by region, n"""))
def ar1_exact(spark, d):
    """The likeliest coefficient of a grid of a thousandth for every region; ``within``: the fitted one lies next to it;
    ``likeliest``: none of the grid is likelier than the fitted one."""
    base = stage(daily(spark, d, ("region",)), "daily")
    fitted = autoregression.fit(base, 1, segment=("region",), exact=True).select("region", F.col("phi")[0].alias("phi"), ((4 - F.col("aic")) / 2).alias("most"))
    grid = [[k / 1000.0] for k in range(-999, 1000)]
    top = (autoregression.likelihoods(base, grid, segment=("region",)).groupBy("region", "n")
           .agg(F.max("loglik").alias("top"), ((F.max_by("candidate", "loglik") - 999) / 1000.0).alias("near")))
    return fitted.join(top, "region").select("region", "n", "near", F.round("top", 3).alias("loglik"), (F.abs(F.col("near") - F.col("phi")) <= 0.001).alias("within"),
                                             (F.col("most") >= F.col("top") - 1e-6).alias("likeliest"))


# ------------------------------------------------------------------ models
def trained(spark, d, algorithm) -> tuple[SalesForecastModel, DataFrame]:
    """A model measured on the newest fifth of the days and then fitted on all of them."""
    frame = stage(series.daily_features(load_sales(spark, d, COLS)), "daily")
    model = SalesForecastModel(algorithm)
    model.train(frame)
    return model, frame


@query("ridge_forecast")
def ridge_forecast(spark, d):
    model, frame = trained(spark, d, "linear")
    return in_currency(model.forecast(frame, 7))


@query("ridge_by_series")
def ridge_by_series(spark, d):
    """One pooled model, a forecast for every region and category."""
    segment = ("region", "category")
    frame = stage(series.daily_features(load_sales(spark, d, COLS + list(segment)), segment), "daily")
    model = SalesForecastModel("linear", segment=segment)
    model.train(frame)
    return in_currency(model.forecast(frame, 7))


@query("ridge_cv_metrics")
def ridge_cv_metrics(spark, d):
    _, frame = trained(spark, d, "linear")
    model = SalesForecastModel("linear")
    model.train_with_cv(frame)
    return model.confidence_report(spark)


@query("rf_forecast")
def rf_forecast(spark, d):
    model, frame = trained(spark, d, "random_forest")
    return in_currency(model.forecast(frame, 7))


@query("rf_predictions")
def rf_predictions(spark, d):
    """Every day predicted with its interval over the trees."""
    model, frame = trained(spark, d, "random_forest")
    return model.predict_rows(frame, confidence=True).select("date", "prediction", "std", "confidence_lower", "confidence_upper")


@query("rf_prediction_summary")
def rf_prediction_summary(spark, d):
    model, frame = trained(spark, d, "random_forest")
    return prediction_summary(model.predict_rows(frame))


@query("feature_importance")
def feature_importance(spark, d):
    return trained(spark, d, "random_forest")[0].feature_importance(spark)


@query("forecast_confidence")
def forecast_confidence(spark, d):
    return trained(spark, d, "random_forest")[0].confidence_report(spark)


@query("forecast_totals")
def totals(spark, d):
    model, frame = trained(spark, d, "random_forest")
    return forecast_totals(model.forecast(frame, 30))


@query("gbt_forecast")
def gbt_forecast(spark, d):
    model, frame = trained(spark, d, "gradient_boosting")
    return in_currency(model.forecast(frame, 7))


@query("ar_forecast")
def ar_forecast(spark, d):
    """ARIMA(5,1,0) for every region."""
    segment = ("region",)
    fitted = autoregression.fit(daily(spark, d, segment), segment=segment)
    return autoregression.forecast(fitted, 7, segment)


@query("ar_information")
def ar_information(spark, d):
    segment = ("region",)
    return autoregression.fit(daily(spark, d, segment), segment=segment).select("region", "n", "sigma2", "aic", "bic")


@query("ensemble_forecast")
def ensemble_forecast(spark, d):
    """Forest, boosting and ARIMA, weighted by inverse MAPE."""
    frame = stage(series.daily_features(load_sales(spark, d, COLS)), "daily")
    return ensemble.EnsembleForecastModel(include_arima=True).train(frame).forecast(frame, 7).drop("individual")


@query("job_train_forecast")
def job_train_forecast(spark, d):
    """The training job end to end with its random forest: clean, features, cross-validation, save, forecast."""
    return jobs.train_forecast(load_sales(spark, d), fresh_path(spark, "job-model"))[1]
