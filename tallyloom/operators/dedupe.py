"""One row per key, chosen by a total order.

The choice is a min or max over a struct, so every task first reduces its own rows: a key that
holds a third of the table ships one row per task, and no task sorts the whole group as a window
would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Hashes of repeated keys that may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Share of distinct keys from which looking for the repeated ones pays.
MOSTLY_UNIQUE = 0.95


def _pick(df: DataFrame, key: str, order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in order and c != key]
    row = F.struct(*order, *rest)
    chosen = df.groupBy(key).agg(pick(row).alias("_row"))
    return chosen.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Lowest row in ``order``, remaining columns break ties; null keys count as equal."""
    return _pick(df, key, order, F.min)


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Highest row in ``order``, remaining columns break ties; null keys count as equal."""
    return _pick(df, key, order, F.max)


def keep_first_staged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``keep_first`` of a frame that is cheap to read again.

    Where nearly all keys are distinct, only their hashes are shuffled, to find those that repeat; rows of other keys
    stay where they are. Where many repeat, it is ``keep_first``.
    """
    n, distinct = df.agg(F.count(F.lit(1)), F.approx_count_distinct(key, 0.02)).first()
    if distinct < MOSTLY_UNIQUE * n:
        return keep_first(df, key, order)
    code = F.xxhash64(key)
    counted = df.groupBy(code.alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = stage(counted.filter("_n > 1").select("_code"), "repeated")
    if repeated.count() > BROADCAST_KEYS:
        return keep_first(df, key, order)
    again = code == repeated["_code"]
    several = df.join(F.broadcast(repeated), again, "left_semi")
    return df.join(F.broadcast(repeated), again, "left_anti").unionByName(keep_first(several, key, order))
