"""Numeric column functions. Division never relies on ANSI errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def round_currency(value: Column, decimals: int = 2) -> Column:
    """Half-up on the shortest decimal text of the value."""
    return F.round(value.cast("double"), decimals)


def round_scaled(value: Column, decimals: int = 2) -> Column:
    """Scale, round half to even, scale back: how array libraries round."""
    scale = float(10 ** decimals)
    return F.rint(value.cast("double") * scale) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    return F.when(denominator == 0, F.lit(default)).otherwise(ratio(numerator, denominator))


def growth_rate(current: Column, previous: Column) -> Column:
    """Relative change; from zero it is 0 or +infinity."""
    current, previous = current.cast("double"), previous.cast("double")
    return (F.when((previous == 0) & (current == 0), F.lit(0.0))
            .when(previous == 0, F.lit(INFINITY))
            .otherwise(ratio(current - previous, previous)))


def percent_change(current: Column, earlier: Column) -> Column:
    """Relative change along a series: x/0 is signed infinity, 0/0 is null."""
    current, earlier = current.cast("double"), earlier.cast("double")
    return (F.when((earlier == 0) & (current > 0), F.lit(INFINITY))
            .when((earlier == 0) & (current < 0), F.lit(-INFINITY))
            .otherwise(ratio(current - earlier, earlier)))


def change_percentage(current: Column, previous: Column) -> Column:
    """Percent change, 0 unless the previous value is positive."""
    return (F.when(previous > 0, ratio(current - previous, previous) * 100.0)
            .otherwise(F.lit(0.0)))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise(
        ratio(value.cast("double") - mean.cast("double"), std))


def clamp_non_negative(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def checked_horizon(days: int, low: int = 1, high: int = 30) -> int:
    """``days`` if it lies within the horizons that recursive forecasts support."""
    if not low <= days <= high:
        raise ValueError(f"a forecast covers {low} to {high} days, not {days}")
    return days


def to_number(value: Column) -> Column:
    """Text or number to double; junk becomes null."""
    return value.try_cast("double")
