"""Reports, counts and explanations over detected rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.dates import timestamp_literal
from ...functions.numbers import ratio
from .. import filters
from .stats import ColumnStats

SECTIONS = ("severity", "date", "category", "region")


def breakdown(df: DataFrame, as_of: datetime, time_column: str = "timestamp") -> DataFrame:
    """Flagged and analysed rows by severity, day, category, region and in total, in one pass."""
    flag = F.coalesce(F.col("is_anomaly").cast("int"), F.lit(0))
    have = [c for c in SECTIONS if c in df.columns or (c == "date" and time_column in df.columns)]
    rows = df.withColumn("_flag", flag)
    recent = F.lit(0)
    if time_column in df.columns:
        rows = rows.withColumn("date", F.to_date(time_column))
        recent = F.when(F.col(time_column) >= timestamp_literal(as_of - timedelta(hours=24)), F.col("_flag")).otherwise(0)
    rows = rows.select(*have, "_flag", recent.alias("_recent"))
    sets = [[F.col(c)] for c in have] + [[]]
    out = rows.groupingSets(sets, *[F.col(c) for c in have]).agg(
        F.sum("_flag").cast("bigint").alias("anomalies"), F.sum("_recent").cast("bigint").alias("recent"),
        F.count(F.lit(1)).alias("analysed"), F.grouping_id().alias("gid"))
    full = 2 ** len(have) - 1
    section, key = F.lit("total"), F.lit(None).cast("string")
    for i, c in enumerate(have):
        mine = F.col("gid") == full - 2 ** (len(have) - 1 - i)
        section = F.when(mine, c).otherwise(section)
        key = F.when(mine, F.col(c).cast("string")).otherwise(key)
    out = out.select(section.alias("section"), key.alias("key"), "anomalies", "recent", "analysed")
    return out.filter((F.col("section") == "total") | ((F.col("anomalies") > 0) & F.col("key").isNotNull()))


def summary(parts: DataFrame) -> DataFrame:
    """One row from a breakdown: totals, rate and the counts per section as maps."""
    def counts(section: str) -> Column:
        pair = F.struct(F.col("key"), F.col("anomalies"))
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("section") == section, pair))))
    def severe(level: str) -> Column:
        mine = (F.col("section") == "severity") & (F.col("key") == level)
        return F.coalesce(F.max(F.when(mine, F.col("anomalies"))), F.lit(0))
    def overall(c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("section") == "total", F.col(c))), F.lit(0))
    out = parts.agg(
        overall("anomalies").alias("total_anomalies"), overall("analysed").alias("analysed"),
        overall("recent").alias("recent_count_24h"),
        severe("critical").alias("critical_count"), severe("high").alias("high_count"),
        counts("severity").alias("severity_breakdown"), counts("date").alias("daily_counts"),
        counts("category").alias("by_category"), counts("region").alias("by_region"))
    rate = F.coalesce(ratio(F.col("total_anomalies"), F.col("analysed")) * 100.0, F.lit(0.0))
    message = F.when(F.col("total_anomalies") == 0, "No anomalies detected in the dataset")
    return out.withColumns({"anomaly_rate": rate, "message": message}).drop("analysed")


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return (filters.flagged(df).filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("anomalies")).orderBy(F.desc("anomalies"), key))


def recent(df: DataFrame, n: int = 10, minimum: str = "low") -> DataFrame:
    """The newest ``n`` flagged rows of at least the given severity."""
    rows = filters.at_least_severity(filters.flagged(df), minimum)
    return rows.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(n)


def _factors(df: DataFrame, stats: ColumnStats, features: list[str], threshold: float) -> Column:
    """Array of deviating features in feature order, built inside the row."""
    parts = []
    for i, c in enumerate(f for f in features if f in df.columns and stats.usable(f)):
        value, mean = F.col(c).cast("double"), stats.means[c]
        z = stats.z(c)
        pct = F.abs((value - mean) / mean * 100.0) if mean else F.lit(0.0)
        parts.append(F.when(F.abs(z) > threshold, F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("feature"), value.alias("value"),
            F.lit(mean).alias("expected"), z.alias("zscore"),
            F.when(z > 0, "higher").otherwise("lower").alias("direction"),
            pct.alias("deviation_percentage"))))
    return F.array_compact(F.array(*parts))


def explain(df: DataFrame, stats: ColumnStats, features: list[str], threshold: float = 2.0,
            top: int = 5) -> DataFrame:
    """Why each row deviates: summary, texts, ranked factors and advice.

    Everything is computed inside the row with array functions; no join, no shuffle.
    """
    found = _factors(df, stats, features, threshold)
    def by_size(a: Column, b: Column) -> Column:
        x, y = F.abs(a["zscore"]), F.abs(b["zscore"])
        return (F.when(x > y, -1).when(x < y, 1).when(a["position"] < b["position"], -1)
                .when(a["position"] > b["position"], 1).otherwise(0))
    out = df.withColumn("_found", found).withColumn("_ranked", F.array_sort("_found", by_size))
    first = F.try_element_at("_ranked", F.lit(1))
    text = F.transform("_found", lambda f: F.concat(
        f["feature"], F.lit(" is "), F.translate(F.format_number(f["deviation_percentage"], 1), ",", ""),
        F.lit("% "), f["direction"], F.lit(" than expected")))
    advice = F.create_map(*[F.lit(x) for f, d, t in fixed.ADVICE for x in (f"{f}/{d}", t)])
    known = F.try_element_at(advice, F.concat_ws("/", first["feature"], first["direction"]))
    fallback = F.concat(F.lit("Review "), first["feature"], F.lit(" for unusual "), first["direction"], F.lit(" values"))
    return out.withColumns({
        "summary": F.coalesce(F.concat(F.lit("Primary cause: "), first["feature"], F.lit(" is "),
                                       first["direction"], F.lit(" than normal")), F.lit(fixed.SUMMARY_NONE)),
        "explanations": F.slice(text, 1, top),
        "contributing_factors": F.slice("_ranked", 1, top),
        "recommendation": F.coalesce(known, fallback, F.lit(fixed.ADVICE_NONE)),
    }).drop("_found", "_ranked")


def factor_rows(explained: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per contributing factor, rank 1 the strongest."""
    out = explained.select(*keys, "recommendation", F.posexplode("contributing_factors").alias("pos", "f"))
    return out.select(*keys, (F.col("pos") + 1).alias("rank"), "f.feature", "f.value", "f.expected",
                      "f.zscore", "f.direction", "f.deviation_percentage", "recommendation")
