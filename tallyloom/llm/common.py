"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Rows of one narrow key column that may be broadcast; a longer list is joined by shuffle instead.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where a lambda inside ``body`` uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def least_hashed(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows of least hash of ``key``: a sample that depends on neither order nor partitioning.

    A cut-off from the count of rows leaves little more than ``size`` rows before they are sorted, however many there are.
    """
    share = min(1.0, (size + 10.0 * math.sqrt(size) + 100.0) / max(rows.count(), 1))
    code = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    return rows.where(code < int((1 << 31) * share)).orderBy(code, key).limit(size)


def sized(keys: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` with a broadcast hint if its counted rows are within ``limit``, else as it is."""
    return F.broadcast(keys) if rows <= limit else keys


def staged_keys(keys: DataFrame, label: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` written to the shared folder, counted there, and hinted for broadcast if short enough."""
    kept = stage(keys, label)
    return sized(kept, kept.count(), limit)


def _sums(values: Column) -> Column:
    """0 and then the running sums; quadratic, for short arrays."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def prefix_sums(values: Column, block: int = 512) -> Column:
    """Running sums of an array of longs: inside blocks, then over the blocks, so long arrays take no quadratic time."""
    blocks = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
                                               lambda b: F.slice(v, b * block + 1, F.lit(block))))
    inside = F.transform(blocks, lambda b: _sums(b))
    shifted = let(inside, lambda p: F.zip_with(p, F.slice(_sums(F.transform(p, lambda x: F.element_at(x, -1))), F.lit(1), F.size(p)),
                                               lambda x, o: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda y: y + o)))
    return F.flatten(shifted)
