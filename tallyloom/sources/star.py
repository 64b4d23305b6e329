"""Sales views over the star-schema tables and the event table.

A view is composed from the columns asked for: a lookup table is joined only when one of its
columns is needed. Keys of the lookup tables are unique and complete, as in any star schema.
Only region (5 rows) and nation (25 rows), fixed in size at every scale, and the orders after a
cut-off, if few, carry a broadcast hint; orders, customer and part grow with the data, so Catalyst
and AQE choose by measured size.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY

SALES_COLUMNS = ["timestamp", "transaction_id", "product_id", "product_name", "category", "quantity",
                 "unit_price", "total_amount", "region", "customer_id", "payment_method"]
EVENT_COLUMNS = ["timestamp", "transaction_id", "category", "quantity", "unit_price", "total_amount",
                 "region", "customer_id", "payment_method"]


#: Orders after a cut-off that may be broadcast; more of them are joined by shuffle.
BROADCAST_ORDERS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit_price(amount: Column, quantity: Column) -> Column:
    """Whole cents per unit, rounded down: exact in every engine."""
    cents = F.floor(F.round(amount * 100) / quantity).cast("bigint")
    return (cents * F.lit(0.01).cast("decimal(3,2)")).cast(MONEY)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region"))
    joined = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", "region")


def load_sales(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
               since: datetime | None = None) -> DataFrame:
    """One row per order line. ``since`` filters the order scan itself.

    Customers are joined to orders before the lines, and parts last, so the lines are shuffled twice and
    without names; with a ``since`` that leaves few orders, these go to the lines instead.
    """
    wanted = columns or SALES_COLUMNS
    needs = set(wanted)
    df = table(spark, sf_dir, "lineitem")
    if since is not None or needs & {"timestamp", "customer_id", "payment_method", "region"}:
        orders = table(spark, sf_dir, "orders")
        few = False
        if since is not None:
            orders = orders.filter(F.col("o_orderdate") >= F.lit(str(since)).cast("timestamp_ntz"))
            few = orders.count() <= BROADCAST_ORDERS
        if "region" in needs:
            customer = table(spark, sf_dir, "customer")
            customer = customer.join(F.broadcast(_regions(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(F.broadcast(orders) if few else orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if needs & {"product_id", "product_name", "category"}:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    exprs = {
        "timestamp": lambda: F.col("o_orderdate").cast("timestamp"),
        "transaction_id": lambda: F.concat_ws("-", *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]),
        "product_id": lambda: F.concat(F.lit("PROD-"), F.upper(F.substring("p_type", 1, 3)), F.lit("-"),
                                       F.lpad(F.col("p_partkey").cast("string"), 6, "0")),
        "product_name": lambda: F.col("p_name"),
        "category": lambda: F.col("p_type"),
        "quantity": lambda: F.col("l_quantity").cast("bigint"),
        "unit_price": lambda: _unit_price(F.col("l_extendedprice"), F.col("l_quantity")),
        "total_amount": lambda: F.col("l_extendedprice").cast(MONEY),
        "region": lambda: F.col("region"),
        "customer_id": lambda: F.col("o_custkey").cast("string"),
        "payment_method": lambda: F.col("o_orderpriority"),
    }
    return df.select(*[exprs[c]().alias(c) for c in wanted])


def latest_sale(spark: SparkSession, sf_dir: str) -> datetime | None:
    """Timestamp of the newest sale.

    Orders without lines do not count, so the newest order date alone is not enough. The join is
    tried on the newest order date and weeks first and reaches the whole table only if those hold no line.
    """
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    if newest is None:
        return None
    for days in (0, 31, 366, None):
        since = None if days is None else newest - timedelta(days=days)
        found = load_sales(spark, sf_dir, ["timestamp"], since).agg(F.max("timestamp")).first()[0]
        if found is not None:
            return found
    return None


def load_newest_sales(spark: SparkSession, sf_dir: str, rows: int, columns: list[str] | None = None) -> DataFrame:
    """A tail of the sales view that holds at least the newest ``rows`` rows.

    Top-n and page queries need only that tail. Short tails are tried first, each with its start
    pushed into the order scan; the whole view is the last resort.
    """
    newest = latest_sale(spark, sf_dir)
    for days in (7, 31, 366):
        if newest is None:
            break
        start = newest - timedelta(days=days)
        if load_sales(spark, sf_dir, ["timestamp"], start).limit(rows).count() >= rows:
            return load_sales(spark, sf_dir, columns, start)
    return load_sales(spark, sf_dir, columns)


def shape_events(events: DataFrame, customers: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Event rows as sales; works on a batch or a streaming frame.

    ``customers`` holds customer_id, region and payment_method.
    """
    df = events
    wanted = columns or EVENT_COLUMNS
    if set(wanted) & {"region", "payment_method"}:
        df = df.join(customers, F.col("user_id") == F.col("c_custkey"))
    quantity = F.lit(1).cast("bigint") + F.col("event_id") % 5
    exprs = {
        "timestamp": lambda: F.col("ts").cast("timestamp"),
        "transaction_id": lambda: F.col("event_id").cast("string"),
        "category": lambda: F.col("event_type"),
        "quantity": lambda: quantity,
        "unit_price": lambda: _unit_price(F.col("value"), quantity),
        "total_amount": lambda: F.col("value").cast(MONEY),
        "region": lambda: F.col("region"),
        "customer_id": lambda: F.col("user_id").cast("string"),
        "payment_method": lambda: F.col("c_mktsegment"),
    }
    return df.select(*[exprs[c]().alias(c) for c in wanted])


def event_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return customer.join(F.broadcast(_regions(spark, sf_dir)),
                         F.col("c_nationkey") == F.col("n_nationkey")
                         ).select("c_custkey", "region", "c_mktsegment")


def of_known_customers(events: DataFrame, spark: SparkSession, sf_dir: str, columns: list[str] | None) -> DataFrame:
    """Events of customers in the customer table; unchanged where a later join for ``columns`` sees to that."""
    if columns is None or set(columns) & {"region", "payment_method"}:
        return events
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return events.join(keys, F.col("user_id") == F.col("c_custkey"), "left_semi")


def load_event_sales(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """One row per event of a known customer."""
    events = of_known_customers(table(spark, sf_dir, "events"), spark, sf_dir, columns)
    return shape_events(events, event_customers(spark, sf_dir), columns)


def load_dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with planted damage in fixed places, for the cleaning queries."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    df = (line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
          .join(part, F.col("l_partkey") == F.col("p_partkey")))
    key = F.col("l_orderkey")
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    return df.select(
        F.when(key % 101 == 0, "not-a-date")
        .otherwise(F.col("o_orderdate").cast("timestamp").cast("string")).alias("timestamp"),
        F.concat_ws("-", key.cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.when(key % 97 == 0, F.lit(None)).when(key % 89 == 0, "abc").when(key % 83 == 0, "0")
        .otherwise(quantity).alias("quantity"),
        F.when(key % 73 == 0, F.lit(None)).when(key % 79 == 0, -1.0)
        .otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.when(key % 71 == 0, 2 * F.col("l_extendedprice"))
        .otherwise(F.col("l_extendedprice")).alias("total_amount"),
        F.when(key % 67 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("category"),
        "l_partkey", "l_suppkey")
