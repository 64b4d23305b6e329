"""Named queries over the driver tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin_time_zone

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame and its SQL."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_time_zone(spark), sf_dir.rstrip("/"))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round sums of doubles, whose last digit depends on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles for output."""
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")})


# ------------------------------------------------------------------ SQL building blocks
SALES_CTE = """sales as (select cast(o.o_orderdate as timestamp) as ts,
  concat(cast(l.l_orderkey as varchar),'-',cast(l.l_linenumber as varchar),'-',cast(l.l_partkey as varchar),'-',
         cast(l.l_suppkey as varchar)) as transaction_id,
  concat('PROD-',upper(substr(p.p_type,1,3)),'-',lpad(cast(p.p_partkey as varchar),6,'0')) as product_id,
  p.p_name as product_name, p.p_type as category, cast(l.l_quantity as bigint) as quantity,
  cast(cast(floor(round(l.l_extendedprice*100)/l.l_quantity) as bigint)*0.01 as decimal(12,2)) as unit_price,
  cast(l.l_extendedprice as decimal(12,2)) as total_amount,
  r.r_name as region, cast(c.c_custkey as varchar) as customer_id, o.o_orderpriority as payment_method
from lineitem l join orders o on l.l_orderkey=o.o_orderkey
  join customer c on o.o_custkey=c.c_custkey join nation n on c.c_nationkey=n.n_nationkey
  join region r on n.n_regionkey=r.r_regionkey join part p on l.l_partkey=p.p_partkey)"""

EVENTS_CTE = """sales as (select cast(e.ts as timestamp) as ts, cast(e.event_id as varchar) as transaction_id,
  e.event_type as category, 1 + e.event_id % 5 as quantity, cast(e.value as decimal(12,2)) as total_amount,
  cast(cast(floor(round(e.value*100)/(1 + e.event_id % 5)) as bigint)*0.01 as decimal(12,2)) as unit_price,
  r.r_name as region, cast(e.user_id as varchar) as customer_id, c.c_mktsegment as payment_method
from events e join customer c on e.user_id=c.c_custkey
  join nation n on c.c_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey)"""

DIRTY_CTE = """dirty as (select case when l.l_orderkey % 101 = 0 then 'not-a-date'
    else cast(cast(o.o_orderdate as timestamp) as varchar) end as ts_text,
  concat(cast(l.l_orderkey as varchar),'-',cast(l.l_linenumber as varchar)) as transaction_id,
  case when l.l_orderkey % 97 = 0 then null when l.l_orderkey % 89 = 0 then 'abc' when l.l_orderkey % 83 = 0 then '0'
       else cast(cast(l.l_quantity as bigint) as varchar) end as quantity_text,
  case when l.l_orderkey % 73 = 0 then null when l.l_orderkey % 79 = 0 then -1.0
       else l.l_extendedprice/l.l_quantity end as unit_price,
  case when l.l_orderkey % 71 = 0 then 2*l.l_extendedprice else l.l_extendedprice end as total_amount,
  case when l.l_orderkey % 67 = 0 then null else p.p_type end as category, l.l_partkey, l.l_suppkey
from lineitem l join orders o on l.l_orderkey=o.o_orderkey join part p on l.l_partkey=p.p_partkey)"""

REF = "ref as (select max(ts) as as_of from sales)"


def _with(cte: str, body: str) -> str:
    body = body.strip()
    head = f"with {cte}, {REF}" if "sales as" in cte else f"with {cte}"
    return f"{head}, {body[5:]}" if body.lower().startswith("with ") else f"{head} {body}"


def on_sales(body: str) -> str:
    return _with(SALES_CTE, body)


def on_events(body: str) -> str:
    return _with(EVENTS_CTE, body)


def on_dirty(body: str) -> str:
    return _with(DIRTY_CTE, body)


def last_days(days: int) -> str:
    return f"ts >= (select as_of from ref) - interval {days} day"


LAGS, WINDOWS = (1, 7, 14, 30), (7, 14, 30)


def daily_ctes(source: str, segment: str = "") -> str:
    """CTEs d (daily), f (features, unfilled) and g (filled) over rows of ``source``."""
    key = f"{segment}, " if segment else ""
    part = f"partition by {segment} " if segment else ""
    w = f"({part}order by date)"
    made = []
    for n in LAGS:
        made.append((f"revenue_lag_{n}", f"lag(total_revenue,{n}) over {w}"))
        made.append((f"transactions_lag_{n}", f"cast(lag(transaction_count,{n}) over {w} as double)"))
    for n in WINDOWS:
        frame = f"({part}order by date rows between {n - 1} preceding and current row)"
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            made.append((f"revenue_rolling_{name}_{n}d",
                         f"case when count(total_revenue) over {frame} = {n} then {fn}(total_revenue) over {frame} end"))
    for name, n in (("daily_growth_rate", 1), ("week_over_week_change", 7)):
        prev = f"lag(total_revenue,{n}) over {w}"
        made.append((name, f"case when {prev} <> 0 then (total_revenue - {prev})/{prev} end"))
    later = f"({part}order by date rows between current row and unbounded following)"
    filled = ", ".join(
        (f"round(coalesce(first_value({c} ignore nulls) over {later},0),4) as {c}" if "rolling_mean" in c or "rolling_std" in c
         else f"coalesce(first_value({c} ignore nulls) over {later},0) as {c}") for c, _ in made)
    base = ("date, transaction_count, total_revenue, total_quantity, avg_unit_price, unique_customers, avg_order_value, "
            "day_of_week, month, is_weekend")
    return f"""d as (select {key}cast(ts as date) as date, count(transaction_id) as transaction_count,
    cast(sum(total_amount) as double) as total_revenue, cast(sum(quantity) as bigint) as total_quantity,
    cast(sum(unit_price) as double)/count(unit_price) as avg_unit_price, count(distinct customer_id) as unique_customers
  from {source} group by all),
f as (select *, total_revenue/transaction_count as avg_order_value, cast(isodow(date)-1 as integer) as day_of_week,
    cast(month(date) as integer) as month, case when isodow(date)>=6 then 1 else 0 end as is_weekend,
    {', '.join(f'{e} as {c}' for c, e in made)} from d),
g as (select {key}{base}, {filled} from f)"""


ROLLED = tuple(f"revenue_rolling_{k}_{n}d" for n in WINDOWS for k in ("mean", "std"))


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries_anomaly, queries_batch, queries_forecast, queries_insights, queries_stream  # noqa: F401
