"""Local outlier factor with exact nearest neighbours and no all-pairs work.

Distinct training points are split by a grid that is refined only where it is crowded, down to
leaves of a few dozen points. A query first gets an upper bound on its k-th distance from the
smallest box around it that holds more than k rows, then walks down the boxes that can hold
anything nearer, and finally meets only the points of the leaves that remain. Copies of a point
are one row with a weight, so a hot value costs as much as a rare one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...session import stage
from ..features import Scaler

K = 20
LEAF = 32
BITS = 21
STEP = 3
LEVELS = list(range(0, BITS + 1, STEP))


def _cell(corner: list[float], span: float, near: int) -> Column:
    """Integer coordinates on the finest grid over the first ``near`` dimensions of ``x``."""
    top = 2 ** BITS
    axes = [F.least(F.lit(top - 1), F.greatest(F.lit(0), F.floor(
        (F.col("x")[i] - F.lit(corner[i])) * F.lit(top / span)))).cast("bigint") for i in range(near)]
    return F.array(*axes)


def _ancestor(level: Column) -> Column:
    """The cell at a coarser level, addressed as one text key."""
    return F.array_join(F.transform("cell", lambda c: F.floor(
        c / F.pow(F.lit(2.0), F.lit(BITS) - level)).cast("bigint").cast("string")), ",")


def _sum_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _nearest(d: int) -> Column:
    """Distance from ``q`` to the box [lo, hi]."""
    return F.sqrt(_sum_of([F.pow(F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("q")[i],
                                            F.col("q")[i] - F.col("hi")[i]), 2) for i in range(d)]))


def _farthest(d: int) -> Column:
    return F.sqrt(_sum_of([F.pow(F.greatest(F.abs(F.col("q")[i] - F.col("lo")[i]),
                                            F.abs(F.col("q")[i] - F.col("hi")[i])), 2) for i in range(d)]))


def _levels() -> Column:
    return F.explode(F.array(*[F.lit(v) for v in LEVELS])).alias("level")


class NeighbourIndex:
    """Leaves and boxes over distinct points (x array, w weight)."""

    def __init__(self, points: DataFrame, d: int):
        self.d, near = d, min(d, 3)
        edges = points.agg(*[F.min(F.col("x")[i]).alias(f"a{i}") for i in range(near)],
                           *[F.max(F.col("x")[i]).alias(f"b{i}") for i in range(near)]).first()
        self.corner = [edges[f"a{i}"] or 0.0 for i in range(near)]
        self.span = max([edges[f"b{i}"] - edges[f"a{i}"] for i in range(near)] if edges[0] is not None else [0.0]) or 1.0
        self.near = near
        spread = points.withColumn("cell", _cell(self.corner, self.span, near)).select("x", "w", "cell", _levels())
        spread = spread.withColumn("key", _ancestor(F.col("level")))
        cells = spread.groupBy("level", "key").agg(F.count(F.lit(1)).alias("n"))
        crowded = stage(cells.filter(F.col("n") > LEAF), "crowded")
        # a point belongs to the first cell on its path that is not crowded, or to the finest one
        path = spread.join(crowded, ["level", "key"], "left").withColumn(
            "crowded_level", F.when(F.col("n").isNotNull(), F.col("level")).otherwise(-STEP))
        placed = path.groupBy("x", "w", "cell").agg(F.max("crowded_level").alias("crowded_level"))
        leaf_level = F.least(F.lit(BITS), F.col("crowded_level") + STEP)
        self.points = stage(placed.withColumn("level", leaf_level.cast("int"))
                            .withColumn("key", _ancestor(F.col("level"))).select("x", "w", "cell", "level", "key"), "leaves")
        low = [F.min(F.col("x")[i]) for i in range(d)]
        high = [F.max(F.col("x")[i]) for i in range(d)]
        leaves = self.points.groupBy("level", "key").agg(
            F.array(*low).alias("lo"), F.array(*high).alias("hi"), F.sum("w").alias("w"), F.first("cell").alias("cell"))
        up = leaves.select("lo", "hi", "w", "cell", F.col("level").alias("leaf_level"), _levels())
        up = up.filter(F.col("level") <= F.col("leaf_level")).withColumn("key", _ancestor(F.col("level")))
        boxes = up.groupBy("level", "key").agg(
            F.array(*[F.min(F.col("lo")[i]) for i in range(d)]).alias("lo"),
            F.array(*[F.max(F.col("hi")[i]) for i in range(d)]).alias("hi"), F.sum("w").alias("w"),
            F.max(F.col("leaf_level") == F.col("level")).alias("leaf"), F.first("cell").alias("cell"))
        self.boxes = stage(boxes.withColumn("parent", _ancestor(F.greatest(F.lit(0), F.col("level") - STEP))).drop("cell"), "boxes")

    def nearest(self, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(q, x, dist, take): the k nearest rows of every query point; ``take`` counts copies used."""
        d, need = self.d, k + 1
        rows = queries.select(F.col("x").alias("q"), _cell(self.corner, self.span, self.near).alias("cell"))
        paths = rows.select("q", "cell", _levels()).withColumn("key", _ancestor(F.col("level"))).drop("cell")
        full = self.boxes.filter(F.col("w") >= need).drop("parent", "leaf")
        reach = (paths.join(full, ["level", "key"]).groupBy("q").agg(F.min(_farthest(d)).alias("r")))
        start = rows.select("q").join(reach, "q", "left").fillna(float("inf"), subset=["r"])
        open_ = start.withColumns({"key": F.lit(",".join(["0"] * self.near)), "level": F.lit(0)})
        found = []
        for level in LEVELS:
            here = self.boxes.filter(F.col("level") == level).drop("level")
            if level == 0:
                here = here.withColumnRenamed("key", "mine").withColumn("key", F.col("mine"))
            else:
                here = here.withColumnRenamed("key", "mine").withColumnRenamed("parent", "key")
            step = (open_.drop("level").join(here.select("key", "mine", "lo", "hi", "w", "leaf"), "key")
                    .filter(_nearest(d) <= F.col("r") * (1 + 1e-12)).drop("key").withColumnRenamed("mine", "key"))
            found.append(step.filter("leaf").withColumn("level", F.lit(level)))
            open_ = step.filter(~F.col("leaf")).select("q", "r", "key", F.lit(level).alias("level"))
        leaves = reduce(DataFrame.unionByName, found)
        leaves = stage(leaves.select("q", "r", "level", "key", "w", _nearest(d).alias("close"), _farthest(d).alias("far")), "walk")
        # tighten the bound: whole leaves within a distance already hold enough rows
        bins = leaves.withColumn("bin", F.when(F.col("r").isin(0.0, float("inf")), 64).otherwise(
            F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.col("far") / F.col("r") * 64)))).cast("int"))
        upto = F.sum("w").over(Window.partitionBy("q").orderBy("bin"))
        tight = (bins.groupBy("q", "bin").agg(F.sum("w").alias("w"), F.max("far").alias("far"))
                 .withColumn("upto", upto).filter(F.col("upto") >= need)
                 .groupBy("q").agg(F.min_by("bin", "bin").alias("bin")))
        edge = (bins.join(tight.withColumnRenamed("bin", "last"), "q").filter(F.col("bin") <= F.col("last"))
                .groupBy("q").agg(F.max("far").alias("bound")))
        kept = leaves.join(edge, "q", "left").withColumn("bound", F.least(F.col("r"), F.coalesce("bound", "r")))
        kept = kept.filter(F.col("close") <= F.col("bound") * (1 + 1e-12)).select("q", "bound", "level", "key")
        pairs = kept.join(self.points.select("level", "key", "x", "w"), ["level", "key"])
        dist = F.sqrt(_sum_of([F.pow(F.col("q")[i] - F.col("x")[i], 2) for i in range(d)]))
        pairs = pairs.withColumn("dist", dist).filter(F.col("dist") <= F.col("bound") * (1 + 1e-12))
        if exclude_self:
            own = F.col("q") == F.col("x")
            pairs = pairs.withColumn("w", F.when(own, F.col("w") - 1).otherwise(F.col("w"))).filter("w > 0")
        seen = F.sum("w").over(Window.partitionBy("q").orderBy("dist", "x").rowsBetween(Window.unboundedPreceding, 0))
        ranked = pairs.select("q", "x", "dist", "w", (seen - F.col("w")).alias("before")).filter(F.col("before") < k)
        return ranked.select("q", "x", "dist", F.least(F.col("w"), F.lit(k) - F.col("before")).alias("take"))


def _density(near: DataFrame, kdist: DataFrame) -> DataFrame:
    """Local reachability density per query point."""
    reach = F.greatest("dist", "kdist")
    return (near.join(kdist, "x").groupBy("q")
            .agg((1.0 / (F.sum(reach * F.col("take")) / F.sum("take") + 1e-10)).alias("lrd")))


def _factor(near: DataFrame, own: DataFrame, lrd: DataFrame) -> DataFrame:
    around = near.join(lrd, "x").groupBy("q").agg((F.sum(F.col("lrd") * F.col("take")) / F.sum("take")).alias("around"))
    return around.join(own, "q").select("q", (F.col("around") / F.col("lrd")).alias("lof"))


def _distinct(df: DataFrame, cells: list[Column]) -> DataFrame:
    return df.select(F.array(*cells).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))


def fit(scaled: DataFrame, columns: list[str], k: int = K) -> tuple[DataFrame, NeighbourIndex]:
    """Distinct training points with weight, k-distance, density and outlier factor; and their index."""
    points = stage(_distinct(scaled, [F.col(c).cast("double") for c in columns]), "points")
    index = NeighbourIndex(points, len(columns))
    near = stage(index.nearest(points, k, exclude_self=True), "near")
    kdist = near.groupBy("q").agg(F.max("dist").alias("kdist"))
    named = kdist.withColumnRenamed("q", "x")
    own = stage(_density(near, named), "density").withColumnRenamed("q", "x")
    lof = _factor(near, own.withColumnRenamed("x", "q"), own).withColumnRenamed("q", "x")
    out = points.join(named, "x", "left").join(own, "x", "left").join(lof, "x", "left")
    return stage(out.fillna(1.0, subset=["lof"]), "lof"), index


def score(df: DataFrame, reference: DataFrame, columns: list[str], scaler: Scaler, k: int = K,
          index: NeighbourIndex | None = None) -> DataFrame:
    """Adds ``lof`` of each row against the training points; builds their index unless one is given."""
    cells = [scaler.expression(c) for c in columns]
    queries = stage(_distinct(df, cells), "queries")
    index = index or NeighbourIndex(reference.select("x", "w"), len(columns))
    near = stage(index.nearest(queries, k, exclude_self=False), "near")
    own = _density(near, reference.select("x", "kdist"))
    lof = _factor(near, own, reference.select("x", "lrd"))
    keyed = df.withColumn("_x", F.array(*cells))
    return keyed.join(lof.withColumnRenamed("q", "_x"), "_x", "left").drop("_x").fillna(1.0, subset=["lof"])
