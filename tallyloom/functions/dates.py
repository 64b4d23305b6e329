"""Date and time column functions. Weekdays count from Monday = 0."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted input layouts, tried in this order.
INPUT_LAYOUTS = [
    "yyyy-M-d'T'H:m:s.SSSSSS'Z'",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
]

# Output layouts by name.
OUTPUT_LAYOUTS = {
    "iso": "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "display": "MMMM dd, yyyy hh:mm a",
    "date_only": "yyyy-MM-dd",
    "time_only": "HH:mm:ss",
    "short": "MM/dd/yyyy",
}

PERIOD_STEPS = {
    "hourly": "INTERVAL 1 HOUR",
    "daily": "INTERVAL 1 DAY",
    "weekly": "INTERVAL 7 DAYS",
    "monthly": "INTERVAL 1 MONTH",
}


def parse_datetime(text: Column, strict: bool = False) -> Column:
    """Text to timestamp over the accepted layouts; ``strict`` raises where none fits."""
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in INPUT_LAYOUTS])
    if not strict:
        return parsed
    failed = F.raise_error(F.concat(F.lit("Unable to parse datetime: "), text)).cast("timestamp")
    return F.when(parsed.isNotNull() | text.isNull(), parsed).otherwise(failed)


def to_datetime(text: Column) -> Column:
    """ISO text of any precision to timestamp; anything else becomes null."""
    return text.try_cast("timestamp")


def format_datetime(ts: Column, style: str = "iso") -> Column:
    return F.date_format(ts, OUTPUT_LAYOUTS.get(style, OUTPUT_LAYOUTS["iso"]))


def date_range(days: int, end: Column) -> tuple[Column, Column]:
    """(start, end) of the ``days`` before ``end``."""
    return end - F.make_interval(days=F.lit(days)), end


def time_periods(start: Column, end: Column, granularity: str = "daily") -> Column:
    """Array of period starts from ``start`` up to and including ``end``."""
    return F.sequence(start, end, F.expr(PERIOD_STEPS.get(granularity, PERIOD_STEPS["daily"])))


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def is_month_start(ts: Column) -> Column:
    return (F.day(ts) == 1).cast("int")


def is_month_end(ts: Column) -> Column:
    return (F.to_date(ts) == F.last_day(ts)).cast("int")


def time_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    return (F.when(hour < 6, "night").when(hour < 12, "morning")
            .when(hour < 18, "afternoon").when(hour < 24, "evening"))


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", ts))


def clock_time(ts: Column) -> Column:
    """Two-digit 12-hour clock, as a table cell shows it."""
    return F.coalesce(F.date_format(ts, "hh:mm a"), F.lit("-"))


def short_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d"), F.lit(""))


def timestamp_literal(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp")
