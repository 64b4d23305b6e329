"""Isolation forest (Liu, Ting and Zhou, 2008).

Each tree isolates a small random subsample, which is what the method prescribes; training draws
those rows by hash of a row key, so the choice depends neither on partitioning nor on size. Trees grow in
parallel, one group of at most ``sample`` rows per tree. Scoring is a vectorised pass over the table with the
trees, a few hundred nodes each, broadcast: the cuts of a tree divide the space into a grid, and a row's cell
tells its leaf without walking down, unless the grid would be too large.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...session import stage
from ..quantiles import exact_quantiles

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"
HASH_SPAN = 2 ** 31
#: Cells of a tree's grid; a tree that needs more is walked.
GRID_CELLS = 250_000


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _feature(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def draw(df: DataFrame, columns: list[str], trees: int, sample: int, seed: int, key: list[str]) -> DataFrame:
    """(tree, _h, features): for each tree the ``sample`` rows of least hash(seed, tree, key), at every size of table.

    A row's hashes are compared with a cut-off that leaves about ``sample`` rows a tree as soon as they are made, in one
    compiled loop over the trees.
    """
    n = df.count()
    cut = int(HASH_SPAN * min(1.0, (sample + 10.0 * math.sqrt(sample) + 100.0) / max(n, 1)))
    named = {f"_k{i}": F.col(c) for i, c in enumerate(key)}
    each = df.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), *[e.alias(k) for k, e in named.items()],
                     *[_feature(c).alias(c) for c in columns])
    code = F.pmod(F.xxhash64(F.lit(seed), "tree", *named), F.lit(HASH_SPAN))
    near = each.filter(code < cut).select("tree", code.alias("_h"), *columns)
    least = Window.partitionBy("tree").orderBy("_h", *columns)
    return near.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= sample)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes, todo = [], [(x, 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][side] = me
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_dims = np.flatnonzero(high > low)
        node = {"feature": -1, "threshold": 0.0, "left": -1, "right": -1,
                "path": depth + average_path(len(rows))}
        nodes.append(node)
        if depth < limit and len(rows) > 1 and len(open_dims):
            dim = rng.choice(open_dims)
            cut = rng.uniform(low[dim], high[dim])
            goes_left = rows[:, dim] <= cut
            node["feature"], node["threshold"] = int(dim), float(cut)
            todo.append((rows[~goes_left], depth + 1, me, "right"))
            todo.append((rows[goes_left], depth + 1, me, "left"))
    return nodes


def grow_trees(drawn: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Node table of the forest, one group of at most ``sample`` rows for each tree."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_r")[columns].to_numpy(float)
        nodes = _grow(x, np.random.default_rng([seed, tree]), math.ceil(math.log2(max(len(x), 2))))
        out = pd.DataFrame(nodes)
        out.insert(0, "node", range(len(nodes)))
        out.insert(0, "tree", tree)
        return out[["tree", "node", "feature", "threshold", "left", "right", "path"]]

    return drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def _complete(nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Every tree as a complete binary tree, so a step down is one comparison.

    Leaves above the last level repeat downwards. The extra last cell of ``path`` keeps the value
    of the root: the mean path over the tree's subsample.
    """
    trees = 1 + max(n[0] for n in nodes)
    by_tree: list[dict] = [{} for _ in range(trees)]
    for n in nodes:
        by_tree[n[0]][n[1]] = n
    def depth(tree, node):
        n = tree[node]
        return 0 if n[2] < 0 else 1 + max(depth(tree, n[4]), depth(tree, n[5]))
    levels = max(depth(t, 0) for t in by_tree)
    width = 2 ** (levels + 1) - 1
    feature, cut = np.zeros((trees, width), np.int64), np.full((trees, width), np.inf)
    path = np.zeros((trees, width + 1))
    for t, tree in enumerate(by_tree):
        todo = [(0, 0)]
        while todo:
            at, node = todo.pop()
            _, _, f, c, left, right, p = tree[node]
            path[t, at] = p
            if f >= 0:
                feature[t, at], cut[t, at] = f, c
                todo += [(2 * at + 1, left), (2 * at + 2, right)]
            elif 2 * at + 1 < width:
                todo.append((2 * at + 1, node))
        path[t, -1] = path[t, 0]
    return feature, cut, path, levels


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The last place of each row of ``x`` in one complete tree."""
    base, flat, at = np.arange(len(x)) * x.shape[1], x.ravel(), np.zeros(len(x), np.int64)
    for _ in range(levels):
        at = 2 * at + 1 + (flat[base + feature[at]] > cut[at])
    return at


def _grids(feature: np.ndarray, cut: np.ndarray, path: np.ndarray, levels: int, width: int) -> tuple[list[np.ndarray], list]:
    """All cuts of each feature, and for each tree (steps, leaf of each cell, path lengths), or None if its grid is too large.

    With the number r of all cuts of feature f below a row's value, ``steps[f][r]`` is what f adds to the number of its cell.
    """
    real = np.isfinite(cut)
    cuts = [np.unique(cut[real & (feature == f)]) for f in range(width)]
    trees = []
    for f, c, p in zip(feature, cut, path):
        own = [np.unique(c[np.isfinite(c) & (f == j)]) for j in range(width)]
        sizes = [len(o) + 1 for o in own]
        if math.prod(sizes) > GRID_CELLS:
            trees.append(None)
            continue
        strides = [math.prod(sizes[j + 1:]) for j in range(width)]
        steps = [np.concatenate([[0], np.cumsum(np.isin(a, o))]).astype(np.int32) * s for a, o, s in zip(cuts, own, strides)]
        # a cell stands for the values above its lower cut and up to its upper one, which takes the same ways down
        uppers = [np.concatenate([o, [np.inf]]) for o in own]
        cells = np.stack([g.ravel() for g in np.meshgrid(*uppers, indexing="ij")], axis=1)
        lengths, leaf = np.unique(p[_walk(cells, f, c, levels)], return_inverse=True)
        trees.append((steps, leaf.astype(np.int16), lengths))
    return cuts, trees


@dataclass
class ForestModel:
    columns: list[str]
    nodes: list[tuple]
    threshold: float = 0.5

    def score_column(self, spark: SparkSession) -> Column:
        """Anomaly score in (0, 1], near 1 for rows that isolate quickly."""
        complete = _complete(self.nodes)
        shared = spark.sparkContext.broadcast((complete, _grids(*complete, len(self.columns))))

        @F.pandas_udf("double")
        def score(features: pd.DataFrame) -> pd.Series:
            (feature, cut, path, levels), (cuts, grids) = shared.value
            x = np.ascontiguousarray(features.to_numpy(float))
            total = np.zeros(len(x))
            below = [np.where(np.isnan(v), 0, np.searchsorted(c, v)) for c, v in zip(cuts, x.T)]
            for f, c, p, grid in zip(feature, cut, path, grids):
                if grid is None:
                    total += p[_walk(x, f, c, levels)]
                    continue
                steps, leaf, lengths = grid
                cell = steps[0].take(below[0])
                for s, r in zip(steps[1:], below[1:]):
                    cell += s.take(r)
                total += lengths.take(leaf.take(cell))
            scale = float(path[:, -1].mean()) or 1.0
            return pd.Series(np.power(2.0, -total / len(feature) / scale))

        return score(F.struct(*[_feature(c).alias(c) for c in self.columns]))


def fit_forest(df: DataFrame, columns: list[str], contamination: float = 0.05, trees: int = 100,
               sample: int = 256, seed: int = 42, key: list[str] | None = None) -> ForestModel:
    """Grow the trees and set the threshold at the exact quantile of the training scores."""
    if not key:
        raise ValueError("an isolation forest draws its rows by a row key: pass key=[...]")
    rows = stage(df.select(*dict.fromkeys([*key, *columns])), "forest")
    drawn = draw(rows, columns, trees, sample, seed, key)
    nodes = [tuple(r) for r in grow_trees(drawn, columns, seed).collect()]  # trees x 2 x sample
    model = ForestModel(columns, nodes)
    scores = stage(rows.select(model.score_column(df.sparkSession).alias("score")), "scores")
    model.threshold = exact_quantiles(scores, {"score": [1.0 - contamination]})["score", 1.0 - contamination]
    return model


def detect(df: DataFrame, model: ForestModel) -> DataFrame:
    """``anomaly_score`` above the threshold is positive and flags the row."""
    out = df.withColumn("anomaly_score", model.score_column(df.sparkSession) - model.threshold)
    return out.withColumn("is_anomaly_ml", (F.col("anomaly_score") > 0).cast("int"))
