"""Business insights: rules over one shared summary of the sales rows.

``summarise`` reads the rows once and leaves one row per period and category, region, product or
day. Every rule is a small frame of typed figures derived from that summary; ``present`` turns
figures into titled, prioritised rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fixed, labels, numbers
from ..functions.numbers import growth_rate, ratio, round_currency
from ..schema import INSIGHT_SCHEMA
from ..session import stage
from .filters import period_tag

# Rules in reporting order with their thresholds.
REVENUE_CHANGE, REVENUE_HIGH = 0.05, 0.20
CATEGORY_CHANGE, REGION_DROP, WEEK_CHANGE = 0.15, 0.15, 0.10
FORECAST_HIGH, WEEKEND_FACTOR = 0.15, 1.3
REGION_ANOMALIES, TOP_CATEGORIES, TOP_PRODUCTS, TOP_ANOMALY_REGIONS = 3, 3, 3, 2

# Rule order.
RULES = ["revenue", "volume", "top_category", "category_growth", "top_products", "top_region",
         "region_decline", "weekly_trend", "best_worst_day", "anomaly_severity", "anomaly_regions",
         "forecast", "forecast_plain", "weekend"]

# Priorities.
PRIORITIES = {"critical": 1, "high": 2, "medium": 3, "low": 4, "info": 5}

# Texts; names in braces are columns of the rule's figures.
TEXTS = {
    "revenue": ("performance", "Revenue {direction} {size_text}",
                "Total revenue is {current_text}, which is {growth_text} compared to the previous period "
                "({previous_text}). This represents a {change_class} change."),
    "volume": ("performance", "{count_text} Transactions Processed",
               "Processed {count_text} transactions with an average order value of {aov_text}."),
    "top_category": ("product", "{category} Leading Sales",
                     "{category} is the top-performing category with {revenue_text} in revenue, "
                     "representing {share_text}% of total sales."),
    "category_growth": ("product", "{category} Shows Strong {direction}",
                        "{category} category revenue has changed by {growth_text} compared to the previous period."),
    "top_products": ("product", "Top Selling Products", "Your best-selling products are: {names}."),
    "top_region": ("regional", "{region} Leads Regionally",
                   "{region} is the highest-performing region with {revenue_text} ({share_text}% of total)."),
    "region_decline": ("regional", "{region} Underperforming",
                       "{region} region is down {size_text} compared to the previous period. "
                       "Immediate attention recommended."),
    "weekly_trend": ("trend", "Weekly Trend: {direction_title}",
                     "Sales over the last 7 days are {growth_text} compared to the previous week, "
                     "indicating an {direction} trend."),
    "best_worst_day": ("trend", "Daily Performance Variance",
                       "Best day: {best_day} ({best_text}). Worst day: {worst_day} ({worst_text})."),
    "anomaly_severity": ("anomaly", "{title_text}", "{message_text}"),
    "anomaly_regions": ("anomaly", "Multiple Anomalies in {region}",
                        "{region} region has {anomaly_count} detected anomalies, which may indicate a regional issue."),
    "forecast": ("forecast", "Forecast: {growth_text} {direction_title} Expected",
                 "Our ML model predicts a {direction} of {size_text} over the next {horizon_days} days. "
                 "Projected total: {total_text}."),
    "forecast_plain": ("forecast", "{horizon_days}-Day Revenue Forecast",
                       "Projected revenue for the next {horizon_days} days: {total_text} (avg {avg_text}/day)."),
    "weekend": ("recommendation", "{title_text}", "{message_text}"),
}


def summarise(df: DataFrame, as_of: datetime, days: int = 30, baseline: str = "all") -> DataFrame:
    """(dim, period, key, revenue, n) for category, region, product_name and date, in one pass.

    Days and products of the earlier period are not kept apart: no rule asks for them.
    """
    rows = df.withColumn("period", period_tag(days, as_of, baseline)).filter(F.col("period").isNotNull())
    now = F.col("period") == "current"
    rows = rows.select(
        "period", "total_amount", "category", "region",
        F.when(now, F.col("product_name")).alias("product_name") if "product_name" in df.columns
        else F.lit(None).cast("string").alias("product_name"),
        F.when(now, F.to_date("timestamp")).alias("date"))
    dims = ["category", "region", "product_name", "date"]
    sets = [[F.col("period"), F.col(d)] for d in dims]
    out = rows.groupingSets(sets, F.col("period"), *[F.col(d) for d in dims]).agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("n"),
        F.grouping_id().alias("gid"))
    dim, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        mine = F.col("gid") == 15 - 2 ** (3 - i)
        dim, key = F.when(mine, d).otherwise(dim), F.when(mine, F.col(d).cast("string")).otherwise(key)
    return out.select(dim.alias("dim"), "period", key.alias("key"), "revenue", "n")


# ------------------------------------------------------------------- rule figures
def _totals(cells: DataFrame) -> DataFrame:
    now = F.col("period") == "current"
    return cells.filter("dim = 'date'").agg(
        F.coalesce(F.sum(F.when(now, F.col("revenue"))).cast("double"), F.lit(0.0)).alias("current_revenue"),
        F.coalesce(F.sum(F.when(~now, F.col("revenue"))).cast("double"), F.lit(0.0)).alias("previous_revenue"),
        F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("transaction_count"),
        F.coalesce(F.sum(F.when(~now, F.col("n"))), F.lit(0)).alias("previous_count"))


def revenue_figures(cells: DataFrame) -> DataFrame:
    growth = growth_rate(F.col("current_revenue"), F.col("previous_revenue"))
    out = _totals(cells).withColumns({"growth_rate": growth, "trend": labels.trend_arrow(
        F.col("current_revenue"), F.col("previous_revenue")), "change_class": labels.change_class(growth)})
    return out.filter((F.col("transaction_count") > 0) & (F.col("previous_count") > 0)
                      & (F.abs("growth_rate") > REVENUE_CHANGE))


def volume_figures(cells: DataFrame) -> DataFrame:
    return (_totals(cells).filter("transaction_count > 0")
            .withColumn("avg_order_value", ratio(F.col("current_revenue"), F.col("transaction_count"))))


def _ranked(cells: DataFrame, dim: str) -> DataFrame:
    """Current and earlier revenue per key with rank and share of the current total."""
    now = F.col("period") == "current"
    keyed = cells.filter((F.col("dim") == dim) & F.col("key").isNotNull()).groupBy("key").agg(
        F.sum(F.when(now, F.col("revenue"))).cast("double").alias("current_revenue"),
        F.sum(F.when(~now, F.col("revenue"))).cast("double").alias("previous_revenue"))
    everything = Window.partitionBy()
    return keyed.filter(F.col("current_revenue").isNotNull()).withColumns({
        "rank": F.row_number().over(everything.orderBy(F.desc("current_revenue"), "key")),
        "percentage": F.coalesce(ratio(F.col("current_revenue"), F.sum("current_revenue").over(everything)) * 100.0,
                                 F.lit(0.0))}).withColumnRenamed("key", dim)


def top_figures(cells: DataFrame, dim: str) -> DataFrame:
    return _ranked(cells, dim).filter("rank = 1").select(
        dim, F.col("current_revenue").alias("revenue"), "percentage", "rank")


def change_figures(cells: DataFrame, dim: str) -> DataFrame:
    """Growth of every key known in both periods."""
    known = _ranked(cells, dim).filter(F.col("previous_revenue").isNotNull())
    return known.select(dim, growth_rate(F.col("current_revenue"), F.col("previous_revenue")).alias("growth_rate"),
                        "current_revenue", "previous_revenue", "rank")


def category_growth_figures(cells: DataFrame) -> DataFrame:
    return change_figures(cells, "category").filter(
        (F.col("rank") <= TOP_CATEGORIES) & (F.abs("growth_rate") > CATEGORY_CHANGE))


def region_decline_figures(cells: DataFrame) -> DataFrame:
    return change_figures(cells, "region").filter(F.col("growth_rate") < -REGION_DROP)


def top_product_figures(cells: DataFrame) -> DataFrame:
    return (cells.filter("dim = 'product_name' and period = 'current' and key is not null")
            .orderBy(F.desc("revenue"), "key").limit(TOP_PRODUCTS)
            .withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("revenue"), "key")))
            .select(F.col("key").alias("product_name"), F.col("revenue").cast("double").alias("revenue"), "rank"))


def _days(cells: DataFrame) -> DataFrame:
    return cells.filter("dim = 'date' and period = 'current' and key is not null").select(
        F.col("key").cast("date").alias("date"), "revenue", "n")


def weekly_trend_figures(cells: DataFrame) -> DataFrame:
    aged = _days(cells).withColumn("age", F.row_number().over(Window.partitionBy().orderBy(F.desc("date"))))
    out = aged.agg(F.sum(F.when(F.col("age") <= 7, F.col("revenue"))).cast("double").alias("recent_7d_total"),
                   F.sum(F.when(F.col("age").between(8, 14), F.col("revenue"))).cast("double").alias("previous_7d_total"),
                   F.count(F.lit(1)).alias("active_days"))
    out = out.withColumn("growth_rate", growth_rate(F.col("recent_7d_total"), F.col("previous_7d_total")))
    return out.filter((F.col("active_days") >= 14) & (F.abs("growth_rate") > WEEK_CHANGE))


def best_worst_figures(cells: DataFrame) -> DataFrame:
    out = _days(cells).agg(
        F.max(F.struct("revenue", (-F.unix_date("date")).alias("age"), "date")).alias("best"),
        F.min(F.struct("revenue", "date")).alias("worst"), F.count(F.lit(1)).alias("active_days"))
    return out.filter("active_days >= 7").select(
        F.col("best.date").alias("best_day"), F.col("best.revenue").cast("double").alias("best_revenue"),
        F.col("worst.date").alias("worst_day"), F.col("worst.revenue").cast("double").alias("worst_revenue"))


def anomaly_severity_figures(breakdown: DataFrame) -> DataFrame:
    def of(level: str) -> Column:
        mine = (F.col("section") == "severity") & (F.col("key") == level)
        return F.coalesce(F.max(F.when(mine, F.col("anomalies"))), F.lit(0))
    out = breakdown.agg(of("critical").alias("critical_count"), of("high").alias("high_count"),
                        F.max(F.when(F.col("section") == "total", F.col("anomalies"))).alias("total_anomalies"))
    return out.filter((F.col("critical_count") > 0) | (F.col("high_count") > 0))


def anomaly_region_figures(breakdown: DataFrame) -> DataFrame:
    order = [F.desc("anomaly_count"), F.asc("region")]
    top = (breakdown.filter("section = 'region'").select(F.col("key").alias("region"), F.col("anomalies").alias("anomaly_count"))
           .orderBy(*order).limit(TOP_ANOMALY_REGIONS))
    return (top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
            .filter(F.col("anomaly_count") >= REGION_ANOMALIES))


def forecast_figures(cells: DataFrame, forecast: DataFrame) -> DataFrame:
    """Mean forecast day against the mean current day."""
    current = _days(cells).agg(ratio(F.sum("revenue"), F.count("revenue"))).scalar()
    out = forecast.agg(F.avg(round_currency(F.col("value"))).alias("forecast_daily_avg"),
                       round_currency(F.sum("value")).alias("forecast_total"),
                       F.count(F.lit(1)).alias("horizon_days"))
    out = out.withColumn("current_daily_avg", current)
    return out.filter((F.col("horizon_days") > 0) & (F.col("current_daily_avg") > 0)).withColumn(
        "growth_rate", growth_rate(F.col("forecast_daily_avg"), F.col("current_daily_avg")))


def forecast_plain_figures(forecast: DataFrame) -> DataFrame:
    """Without sales to compare with."""
    return forecast.agg(F.avg(round_currency(F.col("value"))).alias("forecast_daily_avg"),
                        round_currency(F.sum("value")).alias("forecast_total"),
                        F.count(F.lit(1)).alias("horizon_days")).filter("horizon_days > 0")


def weekend_figures(cells: DataFrame) -> DataFrame:
    weekend = dates.is_weekend(F.col("date")) == 1
    out = _days(cells).agg(
        ratio(F.sum(F.when(weekend, F.col("revenue"))), F.greatest(F.lit(1), F.count_if(weekend))).alias("weekend_avg"),
        ratio(F.sum(F.when(~weekend, F.col("revenue"))), F.greatest(F.lit(1), F.count_if(~weekend))).alias("weekday_avg"))
    better = F.col("weekend_avg") > F.col("weekday_avg") * WEEKEND_FACTOR
    worse = F.col("weekday_avg") > F.col("weekend_avg") * WEEKEND_FACTOR
    return out.withColumn("better", F.when(better, "weekend").when(worse, "weekday")).filter("better is not null")


# ------------------------------------------------------------------- presentation
def _fill(template: str, figures: DataFrame) -> Column:
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), F.col(name).cast("string")]
    return F.concat(*parts, F.lit(rest))


def _money(c: str) -> Column:
    return labels.format_currency(F.col(c))


def _dressed(rule: str, f: DataFrame) -> tuple[DataFrame, Column | str, Column | None]:
    """Figures with display columns, the priority and the action."""
    growth = F.col("growth_rate")
    up = growth > 0
    texts = {"growth_text": labels.format_percentage(growth), "size_text": labels.format_percentage(F.abs(growth))
             } if "growth_rate" in f.columns else {}
    if rule == "revenue":
        f = f.withColumns({**texts, "direction": F.when(up, "Up").otherwise("Down"),
                           "current_text": _money("current_revenue"), "previous_text": _money("previous_revenue")})
        return (f, F.when(F.abs(growth) > REVENUE_HIGH, "high").otherwise("medium"),
                F.when(up, fixed.INSIGHT_TEXTS["revenue_up_action"]).otherwise(fixed.INSIGHT_TEXTS["revenue_down_action"]))
    if rule == "volume":
        return f.withColumns({"count_text": labels.format_count(F.col("transaction_count")),
                              "aov_text": _money("avg_order_value")}), "info", None
    if rule in ("top_category", "top_region"):
        f = f.withColumns({"revenue_text": _money("revenue"),
                           "share_text": F.translate(F.format_number("percentage", 1), ",", "")})
        return f, "medium" if rule == "top_category" else "info", None
    if rule == "category_growth":
        f = f.withColumns({**texts, "direction": F.when(up, "Growth").otherwise("Decline")})
        return f, F.when(up, "medium").otherwise("high"), None
    if rule == "top_products":
        ordered = F.array_sort(F.collect_list(F.struct("rank", "product_name", "revenue")))  # three rows
        f = f.agg(ordered.alias("top_products")).filter(F.size("top_products") > 0).withColumn(
            "names", F.array_join(F.transform("top_products", lambda p: p["product_name"]), ", "))
        return f.withColumn("top_products", F.to_json("top_products")), "info", None
    if rule == "region_decline":
        return f.withColumns(texts), "high", _fill(fixed.INSIGHT_TEXTS["region_action"], f)
    if rule == "weekly_trend":
        return f.withColumns({**texts, "direction": F.when(up, "upward").otherwise("downward"),
                              "direction_title": F.when(up, "Upward").otherwise("Downward")}), "medium", None
    if rule == "best_worst_day":
        return f.withColumns({"best_text": _money("best_revenue"), "worst_text": _money("worst_revenue")}), "info", None
    if rule == "anomaly_severity":
        critical = F.col("critical_count") > 0
        worded = lambda part: F.when(critical, _fill(fixed.INSIGHT_TEXTS[f"critical_{part}"], f)).otherwise(
            _fill(fixed.INSIGHT_TEXTS[f"high_{part}"], f))
        f = f.withColumns({"title_text": worded("title"), "message_text": worded("message")})
        return (f, F.when(critical, "critical").otherwise("high"), F.when(critical, fixed.INSIGHT_TEXTS["critical_action"]))
    if rule == "anomaly_regions":
        return f, "high", _fill(fixed.INSIGHT_TEXTS["anomaly_region_action"], f)
    if rule == "forecast":
        f = f.withColumns({**texts, "direction": F.when(up, "increase").otherwise("decrease"),
                           "direction_title": F.when(up, "Increase").otherwise("Decrease"),
                           "total_text": _money("forecast_total")})
        return (f, F.when(F.abs(growth) < FORECAST_HIGH, "medium").otherwise("high"),
                F.when(up, fixed.INSIGHT_TEXTS["forecast_up_action"]).otherwise(fixed.INSIGHT_TEXTS["forecast_down_action"]))
    if rule == "forecast_plain":
        return f.withColumns({"total_text": _money("forecast_total"), "avg_text": _money("forecast_daily_avg")}), "medium", None
    weekend, texts = F.col("better") == "weekend", fixed.INSIGHT_TEXTS
    f = f.withColumns({"weekend_text": _money("weekend_avg"), "weekday_text": _money("weekday_avg")})
    either = lambda part: F.when(weekend, _fill(texts[f"weekend_{part}"], f)).otherwise(_fill(texts[f"weekday_{part}"], f))
    return f.withColumns({"title_text": either("title"), "message_text": either("message")}), "low", either("action")


def present(rule: str, figures: DataFrame, as_of: datetime) -> DataFrame:
    """Insight rows of one rule."""
    dressed, priority, action = _dressed(rule, figures)
    kind, title, message = TEXTS[rule]
    label = F.lit(priority) if isinstance(priority, str) else priority
    shown = [c for c in dressed.columns if not c.endswith(("_text", "_title")) and c not in ("rank", "names")]
    data = F.create_map(*[x for c in shown for x in (F.lit(c), F.col(c).cast("string"))])
    level = F.create_map(*[F.lit(x) for p in PRIORITIES.items() for x in p])
    rank = F.col("rank") if "rank" in dressed.columns else F.lit(1)
    out = dressed.select(
        F.lit(rule).alias("rule"), (F.lit(RULES.index(rule) * 1000) + rank).cast("int").alias("seq"),
        _fill(title, dressed).alias("title"), _fill(message, dressed).alias("message"), F.lit(kind).alias("type"),
        F.element_at(level, label).alias("priority"), label.alias("priority_label"), data.alias("data"),
        (action if action is not None else F.lit(None).cast("string")).alias("action"),
        F.lit(str(as_of)).cast("timestamp").alias("timestamp"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INSIGHT_SCHEMA])


def figures(cells: DataFrame, breakdown: DataFrame | None = None, forecast: DataFrame | None = None) -> dict[str, DataFrame]:
    """The figures of every rule that has its inputs."""
    products = cells.filter("dim = 'product_name'")
    # days, categories and regions are a handful of rows in folders of their own: one partition spares the rules their shuffles
    cells = cells.filter("dim <> 'product_name'").coalesce(1)
    out = {
        "revenue": revenue_figures(cells), "volume": volume_figures(cells),
        "top_category": top_figures(cells, "category"), "category_growth": category_growth_figures(cells),
        "top_products": top_product_figures(products), "top_region": top_figures(cells, "region"),
        "region_decline": region_decline_figures(cells), "weekly_trend": weekly_trend_figures(cells),
        "best_worst_day": best_worst_figures(cells),
    }
    if breakdown is not None:
        out["anomaly_severity"] = anomaly_severity_figures(breakdown)
        out["anomaly_regions"] = anomaly_region_figures(breakdown)
    if forecast is not None:
        out["forecast"] = forecast_figures(cells, forecast)
    out["weekend"] = weekend_figures(cells)
    return out


def generate(df: DataFrame, as_of: datetime, days: int = 30, baseline: str = "all",
             breakdown: DataFrame | None = None, forecast: DataFrame | None = None,
             ordered: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """All insights, most urgent first. No current rows, no insights. ``cells``: the summary, if it is at hand."""
    cells = stage(summarise(df, as_of, days, baseline) if cells is None else cells, "cells", by="dim")
    if breakdown is not None:
        breakdown = stage(breakdown, "breakdown")
    rows = None
    for rule, figs in figures(cells, breakdown, forecast).items():
        part = present(rule, figs, as_of)
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy("priority", "seq") if ordered else rows


def top(insights: DataFrame, n: int = 5) -> DataFrame:
    return insights.orderBy("priority", "seq").limit(n)


def of_type(insights: DataFrame, kind: str) -> DataFrame:
    return insights.filter(F.col("type") == kind)


def critical(insights: DataFrame) -> DataFrame:
    return insights.filter(F.col("priority_label").isin("critical", "high"))


def overview(insights: DataFrame) -> DataFrame:
    """Counts by type and by priority, the total and two alarms, in long form."""
    counted = insights.groupingSets([[F.col("type")], [F.col("priority_label")], []],
                                    F.col("type"), F.col("priority_label")).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"),
        F.coalesce(F.bool_or(F.col("priority_label") == "critical"), F.lit(False)).alias("has_critical"),
        F.coalesce(F.bool_or(F.col("priority_label") == "high"), F.lit(False)).alias("has_high"))
    section = F.when(F.col("gid") == 1, "type").when(F.col("gid") == 2, "priority").otherwise("total")
    return counted.select(section.alias("section"), F.coalesce("type", "priority_label", F.lit("all")).alias("key"),
                          "n", "has_critical", "has_high")
