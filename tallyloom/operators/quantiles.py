"""Exact quantiles of columns of any size.

The built-in exact ``percentile`` gathers every distinct value in one task. Here a sketch first
brackets each wanted rank, a second pass counts what lies below and inside the bracket, and only
the distinct values inside, about a thousandth of all, are ranked. A bracket that misses its rank
or still holds too many values is narrowed further on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

ACCURACY = 4_000


def exact_quantiles(df: DataFrame, spec: dict[str, list[float]], small: int = 100_000) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles, as {(column, p): value}; None for a column without values.

    Three passes over the needed columns, whatever the number of quantiles: sketch, count, rank.
    A column of at most ``small`` values takes two, the built-in aggregate doing the second.
    """
    value = {c: F.col(c).cast("double") for c in spec}
    margin = 2.0 / ACCURACY
    probs = {c: [x for p in ps for x in (max(0.0, p - margin), min(1.0, p + margin))] for c, ps in spec.items()}
    sketch = df.agg(*[F.count(value[c]).alias(f"n_{c}") for c in spec],
                    *[F.percentile_approx(value[c], probs[c], ACCURACY).alias(f"q_{c}") for c in spec]).first()
    out: dict[tuple[str, float], float | None] = {}
    tiny = [c for c in spec if sketch[f"n_{c}"] <= small]
    if tiny:
        row = df.agg(*[F.percentile(value[c], F.array(*[F.lit(p) for p in spec[c]])).alias(c) for c in tiny]).first()
        out.update({(c, p): (row[c][i] if row[c] else None) for c in tiny for i, p in enumerate(spec[c])})
    wanted = []
    for c in spec:
        n, cuts = sketch[f"n_{c}"], sketch[f"q_{c}"]
        for i, p in enumerate(spec[c] if c not in tiny else []):
            lo = cuts[2 * i] if p - margin > 0 else -math.inf
            hi = cuts[2 * i + 1] if p + margin < 1 else math.inf
            wanted.append((c, p, n, lo, hi))
    if wanted:
        out.update(_bracketed(df, value, wanted, small))
    return out


def _bracketed(df: DataFrame, value: dict[str, Column], wanted: list[tuple], small: int) -> dict[tuple[str, float], float]:
    inside = [value[c].between(lo, hi) for c, _, _, lo, hi in wanted]
    seen = df.agg(*[e.alias(f"{k}{j}") for j, (c, _, _, lo, _) in enumerate(wanted) for k, e in (
        ("b", F.count_if(value[c] < lo)), ("i", F.count_if(inside[j])),
        ("d", F.approx_count_distinct(F.when(inside[j], value[c]))))]).first()
    pairs: dict[int, tuple[float, float]] = {}
    ranks, open_ = {}, []
    for j, (c, p, n, lo, hi) in enumerate(wanted):
        rank = math.floor(p * (n - 1))
        last, below, kept = min(rank + 1, n - 1), seen[f"b{j}"], seen[f"i{j}"]
        ranks[j] = rank
        if not (below <= rank and last < below + kept) or seen[f"d{j}"] > small:
            pairs[j] = _order_pair(df.select(value[c].alias("v")).filter(F.col("v").isNotNull()), rank, n, small)
        elif lo == hi:
            pairs[j] = lo, lo
        else:
            open_.append((j, rank - below, last - below))
    if open_:
        hits = F.array_compact(F.array(*[F.when(inside[j], F.struct(F.lit(j).alias("j"), value[wanted[j][0]].alias("v")))
                                         for j, _, _ in open_]))
        histogram = df.select(F.inline(hits)).groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
        ranked = histogram.withColumn("upto", F.sum("n").over(Window.partitionBy("j").orderBy("v")))
        def above(which: int) -> Column:
            offset = F.element_at(F.create_map(*[F.lit(x) for o in open_ for x in (o[0], o[which])]), F.col("j"))
            return F.min(F.when(F.col("upto") > offset, F.col("v")))
        for r in ranked.groupBy("j").agg(above(1).alias("low"), above(2).alias("high")).collect():
            pairs[r.j] = r.low, r.high
    return {(c, p): pairs[j][0] + (pairs[j][1] - pairs[j][0]) * (p * (n - 1) - ranks[j])
            for j, (c, p, n, _, _) in enumerate(wanted)}


def _order_pair(values: DataFrame, rank: int, n: int, small: int) -> tuple[float, float]:
    """Sorted values number ``rank`` and ``rank + 1`` (from 0) of the column ``v``."""
    lo, hi, below, inside = -math.inf, math.inf, 0, n
    last = min(rank + 1, n - 1)
    while True:
        scope = values.filter(F.col("v").between(lo, hi))
        margin = 2.0 / ACCURACY
        probs = [max(0.0, (rank - below) / inside - margin), min(1.0, (last - below + 1) / inside + margin)]
        cut = scope.agg(F.percentile_approx("v", probs, ACCURACY)).first()[0]
        new = (cut[0] if probs[0] > 0 else lo, cut[1] if probs[1] < 1 else hi)
        within = F.col("v").between(*new)
        less, kept, distinct = scope.agg(F.count_if(F.col("v") < new[0]), F.count_if(within),
                                         F.approx_count_distinct(F.when(within, F.col("v")))).first()
        holds = below + less <= rank and last < below + less + kept
        if not holds or new == (lo, hi):
            break
        (lo, hi), below, inside = new, below + less, kept
        if lo == hi:
            return lo, lo
        if distinct <= small:
            break
    histogram = values.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy().orderBy("v"))
    ranked = histogram.withColumn("upto", upto)
    pair = ranked.agg(F.min(F.when(F.col("upto") > rank - below, F.col("v"))),
                      F.min(F.when(F.col("upto") > last - below, F.col("v")))).first()
    return pair[0], pair[1]


def iqr(df: DataFrame, column: str) -> tuple[float, float, float]:
    """(first quartile, third quartile, range between)."""
    q = exact_quantiles(df, {column: [0.25, 0.75]})
    q1, q3 = q[column, 0.25], q[column, 0.75]
    return q1, q3, q3 - q1


def weighted_quantile(df: DataFrame, value: str, weight: str, p: float) -> float | None:
    """Quantile of ``value`` where each row stands for ``weight`` equal ones.

    The rows are range-partitioned by value; the weights per range, one number each, tell which
    range holds the wanted ranks, and only that range is accumulated.
    """
    rows = df.select(F.col(value).cast("double").alias("v"), F.col(weight).alias("w"))
    rows = rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.sum("w").alias("w"))
    ranged = stage(rows.repartitionByRange("v").withColumn("r", F.spark_partition_id()), "quantile")
    sums = ranged.groupBy("r").agg(F.sum("w").alias("w")).orderBy("r").collect()  # one row per range
    total = sum(s.w for s in sums)
    if not total:
        return None
    position = p * (total - 1)
    rank = math.floor(position)

    def at(k: int) -> float:
        before = 0
        for s in sums:
            if k < before + s.w:
                break
            before += s.w
        upto = F.sum("w").over(Window.partitionBy("r").orderBy("v")) + F.lit(before)
        return ranged.filter(F.col("r") == s.r).withColumn("upto", upto).agg(
            F.min(F.when(F.col("upto") > k, F.col("v")))).first()[0]

    low = at(rank)
    high = at(min(rank + 1, total - 1)) if position > rank else low
    return low + (high - low) * (position - rank)
