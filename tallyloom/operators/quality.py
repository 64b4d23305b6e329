"""Profiling, validation and cleaning of raw sales rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import dates, numbers
from ..schema import REQUIRED_COLUMNS
from ..session import stage
from .dedupe import keep_first_staged
from .quantiles import exact_quantiles

NUMERIC = ["quantity", "unit_price", "total_amount"]
MIN_JUDGED = 100
RANGE_ROWS = 250_000
CATEGORICAL = ["category", "region", "payment_method"]


def missing_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    """Names only; no data is read."""
    return [c for c in required if c not in df.columns]


def _check(check: str, column: str | None, count: Column, level: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                    count.cast("bigint").alias("count"), level.alias("level"))


def _profile(df: DataFrame, required: list[str]) -> tuple[list[Column], list[Column], Column]:
    """Aggregates, the rows made of them, and whether they show no fault."""
    present, absent = [c for c in required if c in df.columns], missing_columns(df, required)
    totals = [F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in present]]
    size, nulls = F.col("_rows"), {c: F.col(f"_null_{c}") for c in present}
    rows = [_check("row_count", None, size, F.lit("info")),
            _check("column_count", None, F.lit(len(df.columns)), F.lit("info")),
            _check("empty", None, (size == 0).cast("bigint"), F.when(size == 0, "error").otherwise("ok"))]
    rows += [_check("missing", c, F.lit(1), F.lit("error")) for c in absent]
    rows += [_check("nulls", c, n, F.when(n > 0, "error").otherwise("ok")) for c, n in nulls.items()]
    sound = (size > 0) & F.lit(not absent)
    for n in nulls.values():
        sound = sound & (n == 0)
    return totals, rows, sound


def profile(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Row count, column count, missing columns and nulls per required column, in one pass."""
    totals, rows, _ = _profile(df, required)
    return df.agg(*totals).select(F.inline(F.array(*rows)))


def validate(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """The profile, plus type and sign checks that count only when the profile is clean. One pass."""
    types = {f.name: f.dataType for f in df.schema}
    totals, rows, sound = _profile(df, required)
    checks = []
    if "timestamp" in types:
        bad = dates.to_datetime(F.col("timestamp").cast("string")).isNull() & F.col("timestamp").isNotNull()
        checks.append(("timestamp_format", "timestamp", F.count_if(bad), "error"))
    for c in NUMERIC:
        if c in types:
            checks.append(("not_numeric", c, F.max(F.lit(0 if isinstance(types[c], NumericType) else 1)), "error"))
    if "total_amount" in types:
        checks.append(("negative", "total_amount", F.count_if(numbers.to_number(F.col("total_amount")) < 0), "warning"))
    counts = [e.alias(f"_check_{i}") for i, (_, _, e, _) in enumerate(checks)]
    extra = [_check(name, column, F.coalesce(F.col(f"_check_{i}"), F.lit(0)),
                    F.when(F.col(f"_check_{i}") > 0, level).otherwise("ok"))
             for i, (name, column, _, level) in enumerate(checks)]
    every = F.concat(F.array(*rows), F.filter(F.array(*extra), lambda _: sound))
    return df.agg(*totals, *counts).select(F.inline(every))


def is_valid(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> tuple[bool, list[str]]:
    """Verdict and messages; the collected frame has one row per check."""
    rows = validate(df, required).filter(F.col("level").isin("error", "warning")).collect()
    errors = [f"{r['level']}: {r['check']} {r['column'] or ''} ({r['count']})" for r in rows]
    return not any(r["level"] == "error" for r in rows), errors


def fill_numeric(df: DataFrame, columns: list[str], method: str = "mean") -> DataFrame:
    """Coerce to double and fill gaps with the column's mean, median or zero."""
    coerced = df.withColumns({c: numbers.to_number(F.col(c)) for c in columns})
    if method == "zero":
        return coerced.fillna(0.0, subset=columns)
    if method == "median":
        q = exact_quantiles(coerced, {c: [0.5] for c in columns})
        values = {c: q[c, 0.5] for c in columns}
    else:
        row = coerced.agg(*[F.avg(c).alias(c) for c in columns]).first()
        values = {c: row[c] for c in columns}
    return coerced.fillna({c: v for c, v in values.items() if v is not None})


def parse_rows(df: DataFrame) -> DataFrame:
    """Timestamps parsed, rows without one dropped."""
    return (df.withColumn("timestamp", dates.to_datetime(F.col("timestamp").cast("string")))
            .filter(F.col("timestamp").isNotNull()))


def flag_extremes(df: DataFrame, column: str = "total_amount", bounds: tuple[float, float] | None = None) -> DataFrame:
    """``is_extreme`` outside the 1st to 99th percentile; false for all of 100 rows or fewer, too few to judge."""
    if bounds is None:
        q = exact_quantiles(df, {column: [0.01, 0.99]})
        bounds = q[column, 0.01], q[column, 0.99]
    enough = len(df.select(column).take(MIN_JUDGED + 1)) > MIN_JUDGED
    value = F.col(column).cast("double")
    outside = (value < bounds[0]) | (value > bounds[1])
    return df.withColumn("is_extreme", outside if enough else F.lit(False))


def clean(df: DataFrame, order: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """Parse, fill, dedupe, flag extremes, repair signs and amounts.

    The parsed rows are staged once, and the deduplicated ones again; the quantile passes read single
    columns of them, so whatever ``df`` is joined from is read once. ``order`` decides which copy of an id stays (default: timestamp, then all other columns).
    """
    numeric = [c for c in NUMERIC if c in df.columns]
    parsed = stage(parse_rows(df).withColumns({c: numbers.to_number(F.col(c)) for c in numeric}), "parsed")
    filled = fill_numeric(parsed, numeric, "median")
    filled = filled.fillna("Unknown", subset=[c for c in CATEGORICAL if c in df.columns])
    rows = stage(keep_first_staged(filled, "transaction_id", order or ["timestamp"]), "clean")
    q = exact_quantiles(rows, {"total_amount": [0.01, 0.99], "unit_price": [0.5]})
    rows = flag_extremes(rows, bounds=(q["total_amount", 0.01], q["total_amount", 0.99]))
    quantity = F.when(F.col("quantity") <= 0, 1.0).otherwise(F.col("quantity"))
    price = F.when(F.col("unit_price") <= 0, F.lit(q["unit_price", 0.5])).otherwise(F.col("unit_price"))
    rows = rows.withColumns({"quantity": quantity, "unit_price": price})
    expected = F.col("quantity") * F.col("unit_price")
    gap = numbers.ratio(F.abs(F.col("total_amount") - expected), expected)
    rows = rows.withColumn("total_amount", F.when(gap > 0.1, expected).otherwise(F.col("total_amount")))
    return rows.orderBy("timestamp", "transaction_id") if ordered else rows


def forward_fill_rows(df: DataFrame, column: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fill gaps of a raw table from the row before (leading gaps from the first known row).

    A window over the whole table would put it in one task. Instead the table is range-partitioned
    on ``order`` into ranges of about ``range_rows`` rows, however many rows there are, and filled
    inside each range; the few values that cross range borders come from a frame with one row per
    range. ``order`` must be a total order, which also splits any hot timestamp over many ranges.
    """
    coerced = stage(df.withColumn(column, numbers.to_number(F.col(column))), "rows")
    ranges = max(1, math.ceil(coerced.count() / range_rows))
    ranged = stage(coerced.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns(
        {"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    place = F.when(F.col(column).isNotNull(), F.col("_at"))
    edges = ranged.groupBy("_range").agg(F.max_by(column, place).alias("last"), F.min_by(column, place).alias("first"))
    in_order = Window.partitionBy().orderBy("_range")
    carried = edges.select(
        "_range", F.last("last", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("first", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"))
    up = F.last(column, ignorenulls=True).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.repartition(ranges, "_range").join(F.broadcast(carried), "_range").withColumn("_up", up)  # one row per range
    return out.withColumn(column, F.coalesce("_up", "_before", "_first")).select(*df.columns)
