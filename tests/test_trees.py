"""The tree grower against a plain recursion, over layouts, and level by level against one task."""

import numpy as np
import pandas as pd
import pytest

from tallyloom.operators.forecast import grower
from tallyloom.operators.forecast.grower import Candidates, Rules
from tallyloom.operators.forecast.trees import TreeArrays


def table(n=400, features=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 2)
    x[:, 0] = rng.integers(0, 5, n)
    x[:, 3] = -x[:, 1]  # every split of feature 1 has a twin in feature 3
    return x, 3 * x[:, 1] + np.where(x[:, 0] > 2, 5, 0) + rng.normal(size=n)


def frame(spark, x, y, parts=3):
    rows = [([float(v) for v in r], float(t), i) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "x array<double>, y double, key long").repartition(parts)


def plain(codes, q, w, rows, depth, rules):
    """(feature, code) of the splits, parents first, left before right."""
    if depth == 0 or len(rows) < rules.min_split:
        return []
    explained = lambda r: float((q[r] * w[r]).sum()) ** 2 / w[r].sum()
    best = None
    for f in range(len(codes)):
        for c in np.unique(codes[f, rows])[:-1]:
            low, high = rows[codes[f, rows] <= c], rows[codes[f, rows] > c]
            if min(len(low), len(high)) >= rules.min_leaf and (best is None or explained(low) + explained(high) > best[0]):
                best = explained(low) + explained(high), f, int(c), low, high
    if best is None or best[0] <= explained(rows) * (1 + grower.LEAST_GAIN):
        return []
    return [best[1:3], *plain(codes, q, w, best[3], depth - 1, rules), *plain(codes, q, w, best[4], depth - 1, rules)]


def splits(made, at=0):
    if made["feature"][at] < 0:
        return []
    return [(int(made["feature"][at]), int(made["code"][at])), *splits(made, made["left"][at]), *splits(made, made["right"][at])]


@pytest.mark.parametrize("rules", [Rules(6, 5, 2), Rules(4, 2, 1), Rules(8, 40, 15), Rules(0, 2, 1)])
def test_tree_matches_plain_recursion(rules):
    x, y = table(150)
    codes = np.ascontiguousarray(Candidates([np.unique(c) for c in x.T], [True] * 4).codes(x).T)
    q, w = np.round(y * 2 ** 30).astype(np.int64), np.random.default_rng(2).integers(1, 4, 150)
    made = grower.grow_in_memory(codes, q, w, rules.depth, rules)
    assert splits(made) == plain(codes, q, w, np.arange(150), rules.depth, rules)
    leaves = made["feature"] < 0
    assert made["total"][leaves].sum() == (q * w).sum() and made["weight"][leaves].sum() == w.sum()


@pytest.mark.parametrize("y", [np.zeros(30), np.full(30, 7.25)])
def test_constant_targets_and_single_rows_leave_one_node(spark, y):
    x, _ = table(30)
    for n in (30, 1):
        nodes = grower.tree(frame(spark, x[:n], y[:n]), 4, Rules())
        assert len(nodes) == 1 and nodes["value"][0] == y[0]
        assert not grower.shares(nodes, 4).any()


def same(a: pd.DataFrame, b: pd.DataFrame, x):
    left, right = TreeArrays(a).per_tree(x), TreeArrays(b).per_tree(x)
    assert left.shape == right.shape and np.allclose(left, right, rtol=0, atol=1e-9)


def test_forest_is_the_same_in_any_layout_and_by_levels(spark):
    x, y = table()
    rules = Rules(6, 5, 2)
    one = grower.forest(frame(spark, x, y), 4, 5, rules, 42)
    again = grower.forest(frame(spark, x, y, 7), 4, 5, rules, 42)
    levels = grower.forest(frame(spark, x, y), 4, 5, Rules(6, 5, 2, local_rows=40), 42)
    never_local = grower.forest(frame(spark, x, y), 4, 5, Rules(3, 5, 2, local_rows=0), 42)
    same(one, again, x)
    same(one, levels, x)
    same(never_local, grower.forest(frame(spark, x, y), 4, 5, Rules(3, 5, 2), 42), x)
    assert one["tree"].nunique() == 5 and TreeArrays(one).per_tree(x).std(axis=0).mean() > 0
    assert np.allclose(grower.shares(one, 4).sum(), 1) and np.allclose(grower.shares(one, 4), grower.shares(levels, 4))


def test_boosting_matches_plain_rounds_and_levels(spark):
    x, y = table(200)
    rules = Rules(3, 2, 1)
    nodes = grower.boosted(frame(spark, x, y), 4, 4, 0.5, rules)
    levels = grower.boosted(frame(spark, x, y), 4, 4, 0.5, Rules(3, 2, 1, local_rows=60))
    got = nodes.groupby("tree")["weight"].first().to_numpy() @ TreeArrays(nodes).per_tree(x)
    assert np.allclose(got, levels.groupby("tree")["weight"].first().to_numpy() @ TreeArrays(levels).per_tree(x), atol=1e-9)
    codes, ones = np.ascontiguousarray(Candidates([np.unique(c) for c in x.T], [True] * 4).codes(x).T), np.ones(200, np.int64)
    value = np.full(200, y.mean())
    for _ in range(4):
        made = grower.grow_in_memory(codes, np.round((y - value) * 2 ** 45).astype(np.int64), ones, 3, rules)
        at = np.zeros(200, int)
        for _ in range(3):
            f = made["feature"][at]
            at = np.where(f < 0, at, np.where(codes[np.maximum(f, 0), np.arange(200)] <= made["code"][at], made["left"][at], made["right"][at]))
        value += 0.5 * made["total"][at] / made["weight"][at] / 2 ** 45
    assert np.allclose(got, value, atol=1e-8)


def test_features_of_many_values_split_at_quantiles(spark):
    x, y = table(600)
    rules = Rules(4, 5, 2, candidates=16)
    nodes = grower.tree(frame(spark, x, y), 4, rules)
    found = Candidates.of(frame(spark, x, y), 4, rules)
    assert found.whole == [True, False, False, False] and all(len(e) <= 16 for e in found.edges)
    p = TreeArrays(nodes).per_tree(x)[0]
    assert ((y - p) ** 2).mean() < 0.35 * y.var()
    at_leaf = {v: y[p == v] for v in np.unique(p)}
    assert all(np.isclose(v, rows.mean()) for v, rows in at_leaf.items())
    same(nodes, grower.tree(frame(spark, x, y), 4, Rules(4, 5, 2, local_rows=50, candidates=16)), x)
