"""Declared schemas; nothing is inferred from data."""

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

SALES_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("unit_price", MONEY),
    T.StructField("total_amount", MONEY),
    T.StructField("region", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("payment_method", T.StringType()),
])

REQUIRED_COLUMNS = [f.name for f in SALES_SCHEMA]

INSIGHT_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("priority_label", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("action", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
