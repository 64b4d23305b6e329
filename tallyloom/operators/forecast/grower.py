"""Regression trees with exact split candidates and a least number of rows to split.

Rows carry, for each feature, the place of their value among the feature's candidates. A node of more than ``local_rows`` rows
is split by sums over (node, feature, candidate), which Spark adds up for all trees at once, one level a round; a smaller node
is dealt to a task that grows the subtree below it. Both choose by the same sums of whole numbers and the same order of ties,
so neither the layout of the rows nor ``local_rows`` changes a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...session import stage

#: Cumulative shares of the Poisson distribution of mean 1, for the bootstrap.
DRAWS = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(12)]).tolist()
#: A split must lower the sum of squares by more than this share of what the node explains.
LEAST_GAIN = 1e-12
#: Sums of whole-number targets stay below two to this power.
SUM_BITS = 61
GROWN = ("tree int, top long, node int, feature int, threshold double, left int, right int, value double, weight double, gain double")


@dataclass(frozen=True)
class Rules:
    """``min_split`` rows to split a node, ``min_leaf`` rows in each child; repeated draws of one row count once."""

    depth: int = 15
    min_split: int = 2
    min_leaf: int = 1
    local_rows: int = 20_000
    #: A feature of more distinct values is split at so many of its quantiles instead of between all values.
    candidates: int = 4096


class Candidates:
    """Sorted split candidates of each feature: all distinct values, or quantiles of features that have too many."""

    def __init__(self, edges: list[np.ndarray], whole: list[bool]):
        self.edges, self.whole = edges, whole

    @staticmethod
    def of(rows: DataFrame, features: int, rules: Rules) -> "Candidates":
        """Of ``rows`` (x array). At most ``candidates`` values a feature reach the driver."""
        values = stage(rows.select(F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").count(), "values")
        kinds = {r.feature: r["count"] for r in values.groupBy("feature").count().collect()}
        few = [f for f, n in kinds.items() if n <= rules.candidates]
        edges = [np.zeros(1)] * features
        found = values.where(F.col("feature").isin(few)).groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("edges"))
        many = values.where(~F.col("feature").isin(few)).groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile_approx(
            "value", [(k + 1) / rules.candidates for k in range(rules.candidates)], F.lit(10 * rules.candidates)))).alias("edges")) if len(few) < len(kinds) else None
        for r in (found if many is None else found.unionByName(many)).collect():
            edges[r.feature] = np.array(r.edges, float)
        return Candidates(edges, [f in few or f not in kinds for f in range(features)])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) -> places among the candidates."""
        return np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(self.edges)]).astype(np.int16)

    def threshold(self, feature: int, code: int, following: int) -> float:
        """Values up to it go left: the middle between two values, or the quantile itself."""
        e = self.edges[feature]
        return float((e[code] + e[following]) / 2 if self.whole[feature] else e[code])


def grow_in_memory(codes: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, rules: Rules) -> dict[str, np.ndarray]:
    """A tree over ``codes`` (features, rows), level by level; nodes in order of creation, the root first.

    All nodes of a level lie side by side in one order of rows for each feature, so a level is a few passes over arrays.
    """
    target, weight = target.astype(np.int64), weight.astype(np.int64)
    made = {"feature": [-1], "code": [0], "following": [0], "left": [-1], "right": [-1], "gain": [0.0],
            "total": [int((target * weight).sum())], "weight": [int(weight.sum())]}
    order, node = np.argsort(codes, axis=1, kind="stable"), np.zeros(codes.shape[1], np.int64)
    every = np.arange(len(codes))[:, None]
    for _ in range(depth):
        held = order.shape[1]
        if not held:
            break
        owner = node[order[0]]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        sizes = np.diff(np.append(starts, held))
        part = np.repeat(np.arange(len(starts)), sizes)
        sums, draws = np.cumsum((target * weight)[order], axis=1), np.cumsum(weight[order], axis=1)
        before_s, before_w = np.append(0, sums[0])[starts], np.append(0, draws[0])[starts]
        total, mass = sums[0][starts + sizes - 1] - before_s, draws[0][starts + sizes - 1] - before_w
        sums -= before_s[part]
        draws -= before_w[part]
        at, code = np.arange(held) - starts[part] + 1, codes[every, order]
        fits = np.zeros(order.shape, bool)
        fits[:, :-1] = code[:, :-1] != code[:, 1:]
        fits &= (at >= rules.min_leaf) & (sizes[part] - at >= max(rules.min_leaf, 1)) & (sizes >= rules.min_split)[part]
        rest = np.where(fits, mass[part] - draws, 1)
        explained = np.where(fits, sums.astype(float) ** 2 / draws + (total[part] - sums).astype(float) ** 2 / rest, -np.inf)
        tops = np.maximum.reduceat(explained, starts, axis=1)
        feature = tops.argmax(axis=0)
        best, own = tops[feature, np.arange(len(starts))], total.astype(float) ** 2 / mass
        split = np.flatnonzero(best > own * (1 + LEAST_GAIN))
        if not len(split):
            break
        hits = np.flatnonzero((explained[feature[part], np.arange(held)] == best[part]) & np.isin(part, split))
        place = hits[np.unique(part[hits], return_index=True)[1]]
        chosen, ids = feature[split], owner[starts[split]]
        left = len(made["feature"]) + 2 * np.arange(len(split))
        cut = code[chosen, place]
        for i, n in enumerate(ids.tolist()):
            made["feature"][n], made["code"][n], made["following"][n] = int(chosen[i]), int(cut[i]), int(code[chosen[i], place[i] + 1])
            made["left"][n], made["right"][n], made["gain"][n] = int(left[i]), int(left[i]) + 1, float(best[split[i]] - own[split[i]])
        low_s, low_w = sums[chosen, place], draws[chosen, place]
        for a, b in zip(np.column_stack([low_s, total[split] - low_s]).ravel().tolist(), np.column_stack([low_w, mass[split] - low_w]).ravel().tolist()):
            for name, value in (("feature", -1), ("code", 0), ("following", 0), ("left", -1), ("right", -1), ("gain", 0.0), ("total", a), ("weight", b)):
                made[name].append(value)
        among = np.full(len(starts), -1)
        among[split] = np.arange(len(split))
        rows, k = order[0], among[part]
        rows, k = rows[k >= 0], k[k >= 0]
        node[:] = -1
        node[rows] = left[k] + (codes[chosen[k], rows] > cut[k])
        child = node[order]
        order = order[child >= 0].reshape(len(codes), -1)
        order = np.take_along_axis(order, np.argsort(node[order], axis=1, kind="stable"), axis=1)
    return {name: np.array(v) for name, v in made.items()}


def _as_nodes(made: dict[str, np.ndarray], candidates: Candidates, tree: int, top: int, scale: float, middle: float) -> pd.DataFrame:
    inner = made["feature"] >= 0
    cuts = [candidates.threshold(f, c, n) if f >= 0 else 0.0 for f, c, n in zip(made["feature"], made["code"], made["following"])]
    return pd.DataFrame({"tree": tree, "top": top, "node": np.arange(len(inner)), "feature": made["feature"], "threshold": cuts, "left": made["left"],
                         "right": made["right"], "value": middle + made["total"] / made["weight"] / scale, "weight": made["weight"].astype(float),
                         "gain": made["gain"] / scale / scale})


def whole_numbers(rows: DataFrame, target: str, draws: int) -> tuple[float, float]:
    """(scale, middle): ``round((target - middle) * scale)`` has sums below ``2 ** SUM_BITS`` over ``draws`` draws of every row."""
    low, high, mean, n = rows.agg(F.min(target), F.max(target), F.avg(target), F.count(F.lit(1))).first()
    spread = max(high - mean, mean - low, 1e-300)
    return 2.0 ** min(np.floor(SUM_BITS - np.log2(spread * n * draws)), 1000), mean


def _levels(held: DataFrame, candidates: Candidates, rules: Rules, scale: float, middle: float) -> tuple[list[pd.DataFrame], DataFrame]:
    """Split nodes of more than ``local_rows`` rows level by level; their nodes, and the rows of the remaining ones."""
    done, rest = [], None
    key = ["tree", "top"]
    for level in range(rules.depth + 1):
        sizes = held.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum("draws").alias("mass"), F.sum(F.col("q") * F.col("draws")).alias("total"))
        large = stage(sizes.where(F.col("rows") > rules.local_rows), "large")
        if large.isEmpty():
            return done, held if rest is None else rest.unionByName(held)
        small = held.join(large, key, "left_anti")
        rest = small if rest is None else rest.unionByName(small)
        held = held.join(large.select(*key), key, "left_semi")
        cells = (held.select(*key, "draws", "q", F.posexplode("codes").alias("feature", "code")).groupBy(*key, "feature", "code")
                 .agg(F.count(F.lit(1)).alias("n"), F.sum("draws").alias("w"), F.sum(F.col("q") * F.col("draws")).alias("s")))
        w = Window.partitionBy(*key, "feature").orderBy("code")
        up = cells.select(*key, "feature", "code", F.lead("code").over(w).alias("following"), *[F.sum(c).over(w).alias(c) for c in "nws"]).join(large, key)
        d = lambda c: c.cast("double")
        square = lambda c: d(c) * d(c)
        explained = square(F.col("s")) / d(F.col("w")) + square(F.col("total") - F.col("s")) / d(F.col("mass") - F.col("w"))
        best = (up.where(F.col("following").isNotNull() & (F.col("n") >= rules.min_leaf) & (F.col("rows") - F.col("n") >= rules.min_leaf) & (F.col("rows") >= rules.min_split))
                .withColumn("explained", explained).groupBy(*key)
                .agg(F.max_by(F.struct("feature", "code", "following", "explained"), F.struct("explained", -F.col("feature"), -F.col("code"))).alias("b")))
        if level == rules.depth:
            best = best.limit(0)
        own = square(F.col("total")) / d(F.col("mass"))
        nodes = stage(large.join(best, key, "left").select(*key, "mass", "total", F.when(F.col("b.explained") > own * (1 + LEAST_GAIN), F.col("b")).alias("b"), own.alias("own")), "split")
        for r in nodes.collect():  # nodes of over local_rows rows only: part of the model
            value = middle + r.total / r.mass / scale
            inner = r.b is not None
            done.append((r.tree, r.top, 0, r.b.feature if inner else -1, candidates.threshold(r.b.feature, r.b.code, r.b.following) if inner else 0.0,
                         0 if inner else -1, 0 if inner else -1, value, float(r.mass), (r.b.explained - r.own) / scale / scale if inner else 0.0))
        goes = F.element_at("codes", F.col("b.feature") + 1) > F.col("b.code")
        held = stage(held.join(nodes.where("b is not null").select(*key, "b"), key).withColumn("top", 2 * F.col("top") + goes.cast("int")).drop("b"), "level")
    return done, rest


def grow(rows: DataFrame, candidates: Candidates, rules: Rules, scale: float, middle: float) -> pd.DataFrame:
    """Nodes of the trees over ``rows`` (tree, draws, q, codes), as ``GROWN``. ``top`` numbers the nodes that Spark split, the
    root 1 and the children of n 2n and 2n + 1; ``node`` those below a top that one task grew."""
    done, rest = _levels(rows.withColumn("top", F.lit(1).cast("long")), candidates, rules, scale, middle)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(candidates)

    def below(key, pdf):
        codes = np.ascontiguousarray(np.stack(pdf["codes"].to_numpy()).T)
        made = grow_in_memory(codes, pdf["q"].to_numpy(), pdf["draws"].to_numpy(), rules.depth + 1 - int(key[1]).bit_length(), rules)
        return _as_nodes(made, shared.value, int(key[0]), int(key[1]), scale, middle)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grown = rest.repartition(tasks, "tree", "top").groupBy("tree", "top").applyInPandas(below, GROWN).toPandas()
    return pd.concat([pd.DataFrame(done, columns=grown.columns), grown], ignore_index=True) if done else grown


def numbered(grown: pd.DataFrame, tree_weights: list[float] | None = None) -> pd.DataFrame:
    """``grown`` with trees and nodes numbered from 0, the root first; each tree has its weight, or all have the same."""
    parts = []
    for number, (_, tree) in enumerate(grown.sort_values(["tree", "top", "node"]).groupby("tree")):
        place = {k: i for i, k in enumerate(zip(tree["top"], tree["node"]))}
        tops = set(tree["top"])
        def child(top, left, side):
            if left < 0:
                return -1
            return place[(2 * top + side, 0)] if 2 * top in tops else place[(top, left)]
        parts.append(pd.DataFrame({
            "tree": number, "node": range(len(tree)), "feature": tree["feature"].to_numpy(), "threshold": tree["threshold"].to_numpy(),
            "left": [child(t, a, 0) for t, a in zip(tree["top"], tree["left"])], "right": [child(t, a, 1) for t, a in zip(tree["top"], tree["right"])],
            "value": tree["value"].to_numpy(), "weight": tree_weights[number] if tree_weights else 0.0, "gain": tree["gain"].to_numpy(), "drawn": tree["weight"].to_numpy()}))
    nodes = pd.concat(parts, ignore_index=True)
    if not tree_weights:
        nodes["weight"] = 1.0 / len(parts)
    return nodes


def shares(nodes: pd.DataFrame, features: int) -> np.ndarray:
    """Each feature's share of what the splits explain, averaged over trees that have a split."""
    inner = nodes[nodes["feature"] >= 0]
    if inner.empty:
        return np.zeros(features)
    table = inner.pivot_table(index="tree", columns="feature", values="gain", aggfunc="sum", fill_value=0.0)
    return table.div(table.sum(axis=1), axis=0).mean().reindex(range(features), fill_value=0.0).to_numpy()


def coded(rows: DataFrame, candidates: Candidates) -> DataFrame:
    """Adds ``codes`` to rows (x array, ...)."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    @F.pandas_udf("array<smallint>")
    def places(x: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.codes(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)
    return rows.withColumn("codes", places("x"))


def tree(rows: DataFrame, features: int, rules: Rules) -> pd.DataFrame:
    """One tree over all ``rows`` (x array, y double), each taken once."""
    candidates = Candidates.of(rows, features, rules)
    scale, middle = whole_numbers(rows, "y", 1)
    q = F.round((F.col("y") - middle) * F.lit(scale)).cast("long")
    held = coded(rows, candidates).select(F.lit(0).alias("tree"), F.lit(1).cast("long").alias("draws"), q.alias("q"), "codes")
    return numbered(grow(held, candidates, rules, scale, middle))


def forest(rows: DataFrame, features: int, trees: int, rules: Rules, seed: int) -> pd.DataFrame:
    """A random forest over ``rows`` (x array, y double, key long): each row is drawn for each tree by a Poisson number that
    hashes of its ``key`` give, so rows of one key are drawn alike. Trees that drew no row are left out."""
    candidates = Candidates.of(rows, features, rules)
    scale, middle = whole_numbers(rows, "y", len(DRAWS))
    u = F.shiftrightunsigned(F.xxhash64("key", "tree", F.lit(seed)), 11) / F.lit(float(1 << 53))
    draws = sum((u >= F.lit(p)).cast("int") for p in DRAWS)
    q = F.round((F.col("y") - middle) * F.lit(scale)).cast("long")
    base = stage(coded(rows, candidates).select("key", "codes", q.alias("q")), "coded")
    drawn = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("draws", draws.cast("long")).where("draws > 0").drop("key")
    return numbered(grow(drawn, candidates, rules, scale, middle))


def boosted(rows: DataFrame, features: int, trees: int, rate: float, rules: Rules) -> pd.DataFrame:
    """Gradient boosting of squares over ``rows`` (x array, y double): the mean, then trees over what is left, each times ``rate``.

    Up to ``local_rows`` rows are boosted by one task; more rows by a staged round for each tree.
    """
    candidates = Candidates.of(rows, features, rules)
    scale, middle = whole_numbers(rows, "y", 4)
    q = F.round((F.col("y") - middle) * F.lit(scale)).cast("long")
    held = stage(coded(rows, candidates).select("codes", q.alias("q")), "coded")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(candidates)
    weights = [1.0] + [rate] * trees
    mean = pd.DataFrame([(0, 1, 0, -1, 0.0, -1, -1, middle, 1.0, 0.0)], columns=[c.split()[0] for c in GROWN.split(", ")])
    if held.count() <= rules.local_rows:
        def whole(pdf):
            codes, left = np.ascontiguousarray(np.stack(pdf["codes"].to_numpy()).T), pdf["q"].to_numpy()
            out = []
            for tree in range(1, trees + 1):
                made = grow_in_memory(codes, left, np.ones(len(left), np.int64), rules.depth, rules)
                out.append(_as_nodes(made, shared.value, tree, 1, scale, 0.0))
                left = left - _steps(made, codes, rate)
            return pd.concat(out, ignore_index=True)
        grown = held.groupBy(F.lit(0).alias("one")).applyInPandas(whole, GROWN).toPandas()
        return numbered(pd.concat([mean, grown], ignore_index=True), weights)
    parts = [mean]
    for tree in range(1, trees + 1):
        grown = grow(held.select(F.lit(tree).alias("tree"), F.lit(1).cast("long").alias("draws"), "q", "codes"), candidates, rules, scale, 0.0)
        parts.append(grown)
        held = stage(_stepped(held, numbered(grown, [1.0]), candidates, scale * rate), "boosted")
    return numbered(pd.concat(parts, ignore_index=True), weights)


def _steps(made: dict[str, np.ndarray], codes: np.ndarray, rate: float) -> np.ndarray:
    """What a tree takes off the targets of rows, as whole numbers."""
    at, every = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
    while (made["feature"][at] >= 0).any():
        f = made["feature"][at]
        right = codes[np.maximum(f, 0), every] > made["code"][at]
        at = np.where(f < 0, at, np.where(right, made["right"][at], made["left"][at]))
    return np.round(made["total"][at] / made["weight"][at] * rate).astype(np.int64)


def _stepped(held: DataFrame, nodes: pd.DataFrame, candidates: Candidates, step: float) -> DataFrame:
    """``held`` less the prediction of one tree, whose thresholds are told by places among the candidates."""
    edges = [np.searchsorted(candidates.edges[max(f, 0)], t, "right") - 1 for f, t in zip(nodes["feature"], nodes["threshold"])]
    made = {"feature": nodes["feature"].to_numpy(), "code": np.array(edges), "left": nodes["left"].to_numpy(), "right": nodes["right"].to_numpy(),
            "total": nodes["value"].to_numpy(), "weight": np.ones(len(nodes))}
    shared = held.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("long")
    def off(codes: pd.Series) -> pd.Series:
        return pd.Series(_steps(shared.value, np.stack(codes.to_numpy()).T, step)) if len(codes) else pd.Series([], dtype="int64")
    return held.withColumn("q", F.col("q") - off("codes"))
