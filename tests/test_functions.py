from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, labels, numbers


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def pair(spark, rows, make):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double")
    return [r[0] for r in df.orderBy("i").select(make(F.col("a"), F.col("b"))).collect()]


def test_rounding(spark):
    assert column(spark, [1.005, 2.675, 0.125], "double", numbers.round_currency) == [1.01, 2.68, 0.13]
    assert column(spark, [1.005, 0.125, 0.375, 5.015], "double", numbers.round_scaled) == [1.0, 0.12, 0.38, 5.01]


def test_growth(spark):
    inf = float("inf")
    assert pair(spark, [(0.0, 0.0), (5.0, 0.0), (110.0, 100.0)], numbers.growth_rate) == [0.0, inf, 0.1]
    assert pair(spark, [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (-1.0, 0.0)], numbers.percent_change) == [inf, -1.0, None, -inf]
    assert pair(spark, [(5.0, 0.0), (3.0, 2.0)], numbers.change_percentage) == [0.0, 50.0]
    assert pair(spark, [(5.0, 0.0), (3.0, 2.0)], numbers.safe_divide) == [0.0, 1.5]
    assert pair(spark, [(5.0, 3.0)], lambda a, b: numbers.zscore(a, b, F.lit(0.0))) == [0.0]


def test_words(spark):
    assert column(spark, [0.0, 2.5, 3.0, 4.0, 5.0, -6.0], "double", labels.severity) == [
        "low", "low", "medium", "high", "critical", "critical"]
    assert column(spark, [.005, .03, .10, .20, .50], "double", labels.change_class) == [
        "stable", "slight", "moderate", "significant", "dramatic"]
    assert pair(spark, [(102.0, 100.0), (98.0, 100.0), (100.5, 100.0), (1.0, 0.0)], labels.trend_arrow) == ["↑", "↓", "→", "→"]
    assert column(spark, ["HIGH", "odd", None], "string", labels.severity_class) == ["severity-high", "severity-low", "severity-low"]
    assert column(spark, [1.0, -1.0, 0.0], "double", labels.trend_word) == ["up", "down", "stable"]


def test_money_text(spark):
    assert column(spark, [1234567.0, 12345.0, 567.891, -2500.0], "double", labels.format_currency) == [
        "$1.2M", "$12.3K", "$567.89", "$-2.5K"]
    assert column(spark, [1234567.0, 12345.0, -2500.0], "double", labels.format_currency_card) == ["$1.23M", "$12.3K", "$-2500.00"]
    assert column(spark, [0.12, 1.5, -0.05, float("inf")], "double", labels.format_percentage) == ["+12.0%", "+1.5%", "-5.0%", "+inf%"]
    assert column(spark, [1.5], "double", lambda c: labels.format_percentage(c, ratio_input=True)) == ["+150.0%"]
    assert column(spark, [1234567], "bigint", labels.format_count) == ["1,234,567"]


def test_dates(spark):
    hours = [datetime(2024, 1, 1, h) for h in (0, 5, 6, 12, 18, 23)]
    assert column(spark, hours, "timestamp", dates.time_of_day) == ["night", "night", "morning", "afternoon", "evening", "evening"]
    assert column(spark, [datetime(2021, 1, 3), datetime(2024, 12, 30)], "timestamp", F.weekofyear) == [53, 1]
    assert column(spark, [datetime(2024, 2, 29, 13), datetime(2024, 3, 1)], "timestamp", dates.is_month_end) == [1, 0]
    assert column(spark, [datetime(2024, 1, 6), datetime(2024, 1, 8)], "timestamp", dates.is_weekend) == [1, 0]


def test_parse(spark):
    texts = ["2024-01-05T03:04:05.123Z", "2024-01-05T03:04:05Z", "2024-1-5T3:04:05", "2024-01-05 03:04:05", "2024-01-05", "05.01.2024", None]
    got = column(spark, texts, "string", dates.parse_datetime)
    assert got[0] == datetime(2024, 1, 5, 3, 4, 5, 123000) and got[1:4] == [datetime(2024, 1, 5, 3, 4, 5)] * 3
    assert got[4] == datetime(2024, 1, 5) and got[5:] == [None, None]
    with pytest.raises(Exception, match="Unable to parse datetime"):
        column(spark, ["nope"], "string", lambda c: dates.parse_datetime(c, strict=True))


def test_periods(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31), datetime(2024, 4, 1))], "a timestamp, b timestamp")
    months = df.select(dates.time_periods(F.col("a"), F.col("b"), "monthly")).first()[0]
    assert months == [datetime(2024, 1, 31), datetime(2024, 2, 29), datetime(2024, 3, 31)]
    assert len(df.select(dates.time_periods(F.col("a"), F.col("b"), "other")).first()[0]) == 62


def test_codes(spark):
    df = spark.createDataFrame([("Electronics", 7), ("Books", 12345)], "c string, i int")
    assert [r[0] for r in df.select(labels.product_code(F.col("c"), F.col("i"))).collect()] == ["PROD-ELE-0007", "PROD-BOO-12345"]
    factor = column(spark, [datetime(2024, 12, 7, 19)], "timestamp", labels.seasonal_factor)[0]
    assert abs(factor - 1.4 * 1.3 * 1.5) < 1e-12
