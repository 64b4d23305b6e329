"""Columns that turn numbers into words, codes and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .numbers import ratio


def _plain(value: Column, decimals: int) -> Column:
    return F.translate(F.format_number(value, decimals), ",", "")


def format_currency(value: Column, symbol: str = "$", decimals: int = 2) -> Column:
    """$1.2M, $3.4K or $567.89, by magnitude."""
    value = value.cast("double")
    sign = F.lit(symbol)
    return (F.when(F.abs(value) >= 1e6, F.concat(sign, _plain(value / 1e6, 1), F.lit("M")))
            .when(F.abs(value) >= 1e3, F.concat(sign, _plain(value / 1e3, 1), F.lit("K")))
            .otherwise(F.concat(sign, F.format_number(value, decimals))))


def format_currency_card(value: Column) -> Column:
    """Dashboard card: signed thresholds and two decimals for millions."""
    value = value.cast("double")
    return (F.when(value >= 1e6, F.concat(F.lit("$"), _plain(value / 1e6, 2), F.lit("M")))
            .when(value >= 1e3, F.concat(F.lit("$"), _plain(value / 1e3, 1), F.lit("K")))
            .otherwise(F.concat(F.lit("$"), _plain(value, 2))))


def format_number_axis(value: Column) -> Column:
    """Chart axis: M and K with one decimal, else no decimals."""
    value = value.cast("double")
    return (F.when(value >= 1e6, F.concat(_plain(value / 1e6, 1), F.lit("M")))
            .when(value >= 1e3, F.concat(_plain(value / 1e3, 1), F.lit("K")))
            .otherwise(_plain(value, 0)))


def format_count(value: Column) -> Column:
    """Thousands separators."""
    return F.format_number(value.cast("long"), 0)


def format_percentage(value: Column, decimals: int = 1, include_sign: bool = True,
                      ratio_input: bool = False) -> Column:
    """Percent text. Values at or above 1 count as percent already unless ``ratio_input``."""
    value = value.cast("double")
    pct = value * 100.0 if ratio_input else F.when(F.abs(value) < 1, value * 100.0).otherwise(value)
    sign = F.when(pct > 0, "+").otherwise("") if include_sign else F.lit("")
    number = (F.when(pct == float("inf"), "inf").when(pct == float("-inf"), "-inf")
              .otherwise(_plain(pct, decimals)))
    return F.concat(sign, number, F.lit("%"))


def format_percentage_card(value: Column, include_sign: bool = True) -> Column:
    """Dashboard card: the value is percent already."""
    sign = F.when(value > 0, "+").otherwise("") if include_sign else F.lit("")
    return F.concat(sign, _plain(value.cast("double"), 1), F.lit("%"))


def trend_arrow(current: Column, previous: Column, threshold: float = 0.01) -> Column:
    change = ratio(current - previous, previous)
    return (F.when(change > threshold, "↑").when(change < -threshold, "↓").otherwise("→"))


def trend_word(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").otherwise("stable")


def change_class(value: Column) -> Column:
    pct = F.abs(value * 100.0)
    return (F.when(pct < 1, "stable").when(pct < 5, "slight").when(pct < 15, "moderate")
            .when(pct < 30, "significant").otherwise("dramatic"))


def severity(score: Column) -> Column:
    size = F.abs(score)
    return (F.when(size >= 5, "critical").when(size >= 4, "high").when(size >= 3, "medium")
            .otherwise("low"))


def _lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def severity_rank(level: Column) -> Column:
    return _lookup(level, {name: i for i, name in enumerate(fixed.SEVERITY_ORDER)}, 0)


def severity_class(level: Column) -> Column:
    return _lookup(F.lower(level), fixed.SEVERITY_CLASSES, "severity-low")


def product_code(category: Column, index: Column) -> Column:
    """PROD-ABC-0001; longer numbers keep all their digits."""
    digits = index.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit("PROD-"), F.upper(F.substring(category, 1, 3)), F.lit("-"), padded)


def short_id(value: Column) -> Column:
    return F.concat(F.coalesce(F.substring(value, 1, 15), F.lit("-")), F.lit("..."))


def seasonal_factor(ts: Column) -> Column:
    """Hour x weekday x month multiplier, 1.0 where a table has no entry."""
    return (_lookup(F.hour(ts), fixed.HOUR_FACTORS, 1.0)
            * _lookup(F.weekday(ts), fixed.WEEKDAY_FACTORS, 1.0)
            * _lookup(F.month(ts), fixed.MONTH_FACTORS, 1.0))
