"""Fitted tree ensembles as plain node arrays.

Spark's models expose only the mean over trees. Intervals need every tree, and a recursive
forecast needs many tiny predictions; both evaluate the node arrays inside the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "value double, weight double")


def node_table(spark: SparkSession, path: str, weights: list[float], first_tree: int = 0) -> DataFrame:
    """Nodes of a Spark ML ensemble saved at ``path``, read from its own Parquet files."""
    n = F.col("nodeData")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("treeID") + 1)
    leaf = n["leftChild"] < 0
    return spark.read.parquet(f"{path}/data").select(
        (F.col("treeID") + first_tree).cast("int").alias("tree"), n["id"].alias("node"),
        F.when(leaf, -1).otherwise(n["split"]["featureIndex"]).alias("feature"),
        F.when(leaf, 0.0).otherwise(F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1))).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"),
        weight.alias("weight"))


class TreeArrays:
    """Rectangular arrays, one row per tree."""

    def __init__(self, nodes: pd.DataFrame):
        trees, width = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
        at = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        def grid(column: str, dtype) -> np.ndarray:
            out = np.zeros((trees, width), dtype)
            out[at] = nodes[column].to_numpy()
            return out
        self.feature, self.left, self.right = (grid(c, np.int32) for c in ("feature", "left", "right"))
        self.threshold, self.value = grid("threshold", float), grid("value", float)
        self.weight = nodes.groupby("tree")["weight"].first().sort_index().to_numpy()

    def per_tree(self, x: np.ndarray) -> np.ndarray:
        """Prediction of every tree for every row: (trees, rows)."""
        t, r = np.arange(len(self.feature))[:, None], np.arange(len(x))[None, :]
        at = np.zeros((len(self.feature), len(x)), np.int32)
        while True:
            f = self.feature[t, at]
            inner = f >= 0
            if not inner.any():
                return self.value[t, at]
            goes_left = x[r, np.where(inner, f, 0)] <= self.threshold[t, at]
            at = np.where(inner, np.where(goes_left, self.left[t, at], self.right[t, at]), at)
