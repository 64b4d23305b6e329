"""DBSCAN noise flags, exactly and without all-pairs work.

Points live in cells of side eps / sqrt(d), so all points of one cell are within eps of each
other. A cell with enough rows is dense: all its points are core and need no pair test. Only
points of sparse cells, fewer than ``min_points`` per cell, look at neighbouring cells. Identical
points collapse to one with a weight first, and the points of a crowded cell are salted over
several tasks when sparse neighbours come to meet them.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import stage

SALT_ROWS = 20_000


def noise_flags(df: DataFrame, columns: list[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """Adds ``is_anomaly_ml``: 1 where a row is neither core nor within eps of a core row.

    Neighbour cells are addressed on the first three columns and distances use all of them, so
    up to three columns are the fast case.
    """
    d = len(columns)
    side, near = eps / math.sqrt(d), min(d, 3)
    reach = math.ceil(math.sqrt(d))
    xs = [f"_x{i}" for i in range(d)]
    keyed = df.withColumns({x: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for x, c in zip(xs, columns)})
    cell_of = F.array(*[F.floor(F.col(x) / side) for x in xs])
    points = keyed.groupBy(*xs).agg(F.count(F.lit(1)).alias("w")).withColumn("cell", cell_of)
    cells = points.groupBy("cell").agg(F.sum("w").alias("cell_w"), F.count(F.lit(1)).alias("cell_n"))
    points = stage(points.join(cells, "cell").withColumns({
        "dense": F.col("cell_w") >= min_points, "near": F.slice("cell", 1, near),
        "pid": F.xxhash64(*xs)}), "dbscan")

    sparse = points.filter(~F.col("dense"))
    offsets = F.array(*[F.array(*[F.lit(o).cast("bigint") for o in off])
                        for off in itertools.product(range(-reach, reach + 1), repeat=near)])
    seekers = (sparse.select(*[F.col(x).alias(f"p{x}") for x in xs], F.col("near").alias("home"),
                             F.explode(offsets).alias("off"))
               .withColumn("near", F.zip_with("home", "off", lambda a, b: a + b)).drop("home", "off"))
    slots = F.greatest(F.lit(1), F.ceil(F.col("near_n") / SALT_ROWS)).cast("int")
    sizes = points.groupBy("near").agg(F.count(F.lit(1)).alias("near_n"))
    seekers = (seekers.join(sizes, "near")
               .select("*", F.explode(F.sequence(F.lit(0), slots - 1)).alias("salt")).drop("near_n"))
    targets = (points.join(sizes, "near").withColumn("salt", F.pmod(F.col("pid"), slots).cast("int"))
               .select(*xs, "near", "salt", "w", "dense"))
    gap = sum((F.col(x) - F.col(f"p{x}")) ** 2 for x in xs)
    pairs = seekers.join(targets, ["near", "salt"]).filter(gap <= eps * eps)
    names = [f"p{x}" for x in xs]
    counted = pairs.groupBy(*names).agg(F.sum("w").alias("neighbours"), F.max("dense").alias("meets_dense"))
    core = counted.filter(F.col("neighbours") >= min_points).select(*names)
    # a sparse point that no dense point reaches may still touch a sparse core point
    open_points = counted.filter((F.col("neighbours") < min_points) & ~F.col("meets_dense")).select(*names)
    left = (sparse.join(core, [F.col(x) == F.col(n) for x, n in zip(xs, names)], "left_semi")
            .select(*xs, F.explode(offsets).alias("off"), F.col("near").alias("home"))
            .withColumn("near", F.zip_with("home", "off", lambda a, b: a + b)).drop("home", "off"))
    right = (sparse.join(open_points, [F.col(x) == F.col(n) for x, n in zip(xs, names)], "left_semi")
             .select(*[F.col(x).alias(f"p{x}") for x in xs], "near"))
    touched = left.join(right, "near").filter(gap <= eps * eps).select(*names).distinct()
    noise = (open_points.join(touched, names, "left_anti")
             .select(*[F.col(n).alias(x) for x, n in zip(xs, names)], F.lit(1).alias("is_anomaly_ml")))
    out = keyed.join(noise, xs, "left").drop(*xs)
    return out.fillna(0, subset=["is_anomaly_ml"])
