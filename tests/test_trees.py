"""Boosting and extremely randomised trees against versions that hold all rows in memory."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import models as M
from tabloom.operators import trees as T


def frame(spark, X, y, parts=3):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(X, y)], ["features", "label"]).repartition(parts)


def data(n=400, seed=1, width=3):
    rng = np.random.default_rng(seed)
    X = np.clip(np.round(rng.normal(size=(n, width)) * 5), -8, 8) / 5  # every value is a bin of its own
    y = 2.0 * (X[:, 0] > 0.2) + X[:, 1] ** 2 + 0.1 * rng.normal(size=n)
    return X, y


def slow_tree(X, g, h, depth, l2, step):
    """Predictions of one second-order tree, grown on sorted values."""
    out = np.full(len(X), -step * g.sum() / (h.sum() + l2))
    if depth == 0:
        return out
    score = lambda a, b: a * a / (b + l2) if b + l2 > 0 else 0.0
    best = (1e-12, None, None)
    for f in range(X.shape[1]):
        for v in np.unique(X[:, f])[:-1]:
            low = X[:, f] <= v
            gain = score(g[low].sum(), h[low].sum()) + score(g[~low].sum(), h[~low].sum()) - score(g.sum(), h.sum())
            if gain > best[0] * (1 + 1e-10):
                best = (gain, f, v)
    if best[1] is None:
        return out
    low = X[:, best[1]] <= best[2]
    for side in (low, ~low):
        out[side] = slow_tree(X[side], g[side], h[side], depth - 1, l2, step)
    return out


def test_softmax_rounds_equal_numpy(spark):
    X, y = data()
    c = (y > np.quantile(y, 0.3)).astype(int) + (y > np.quantile(y, 0.7))
    fit = T.Boosting(3, maxIter=2, maxDepth=2, stepSize=0.3).fit(frame(spark, X, c))
    margin = np.tile(np.log([np.mean(c == k) for k in range(3)]), (len(X), 1))
    for _ in range(2):
        p = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
        margin = margin + np.stack([slow_tree(X, p[:, k] - (c == k), p[:, k] * (1 - p[:, k]), 2, 1.0, 0.3) for k in range(3)], axis=1)
    want = np.exp(margin) / np.exp(margin).sum(axis=1, keepdims=True)
    assert np.allclose(fit.outputs(X), want, atol=1e-9)


def test_logistic_and_squared_rounds_equal_numpy(spark):
    X, y = data(seed=4)
    c = (y > np.median(y)).astype(float)
    fit = T.Boosting(2, maxIter=1, maxDepth=3).fit(frame(spark, X, c))
    p = np.full(len(c), c.mean())
    margin = np.log(c.mean() / (1 - c.mean())) + slow_tree(X, p - c, p * (1 - p), 3, 1.0, 0.1)
    assert np.allclose(fit.outputs(X)[:, 1], 1 / (1 + np.exp(-margin)), atol=1e-9)
    fit = T.Boosting(maxIter=1, maxDepth=3, l2=0.0, stepSize=1.0).fit(frame(spark, X, y))
    assert np.allclose(fit.outputs(X)[:, 0], y.mean() + slow_tree(X, y.mean() - y, np.ones(len(y)), 3, 0.0, 1.0), atol=1e-9)


def test_symmetric_trees_use_one_cut_a_level(spark):
    X, y = data(seed=5)
    tree = T.Boosting(maxIter=1, maxDepth=3, symmetric=True, l2=3.0).fit(frame(spark, X, y)).trees[0]
    level = [0]
    while level:
        cuts = {(tree.feature[n], tree.threshold[n]) for n in level if tree.feature[n] >= 0}
        assert len(cuts) <= 1
        level = [c for n in level if tree.feature[n] >= 0 for c in (tree.left[n], tree.left[n] + 1)]
    # the first cut is that of a plain tree
    assert (tree.feature[0], tree.threshold[0]) == [(t.feature[0], t.threshold[0]) for t in T.Boosting(
        maxIter=1, maxDepth=1, l2=3.0).fit(frame(spark, X, y)).trees][0]


def test_models_do_not_depend_on_the_layout_of_rows(spark, monkeypatch):
    X, y = data(seed=6)
    one = [T.Boosting(maxIter=3, maxDepth=3, subsamplingRate=0.7, featureSubsetStrategy="0.7").fit(frame(spark, X, y, p)) for p in (1, 5)]
    assert np.allclose(one[0].outputs(X), one[1].outputs(X), atol=1e-9)
    monkeypatch.setattr(T, "REFRESH", 1)  # margins written after each round
    monkeypatch.setattr(T, "MOST_CELLS", 100)  # a level in several jobs
    again = T.Boosting(maxIter=3, maxDepth=3, subsamplingRate=0.7, featureSubsetStrategy="0.7").fit(frame(spark, X, y, 2))
    assert np.allclose(one[0].outputs(X), again.outputs(X), atol=1e-9)


def test_drawn_rows_have_the_rate():
    key = np.random.default_rng(0).integers(-2**62, 2**62, 20_000)
    assert abs(T._drawn(key, 42, 3, 0.8).mean() - 0.8) < 0.02
    assert (T._drawn(key, 42, 3, 0.8) != T._drawn(key, 42, 4, 0.8)).any()


@pytest.mark.parametrize("rows", [[], [(Vectors.dense([1.0, 2.0]), 3.0)] * 4])
def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame(rows, "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, label double") \
        if not rows else spark.createDataFrame(rows, ["features", "label"])
    for est in (T.Boosting(maxIter=2), T.ExtraTrees(numTrees=2)):
        if rows:
            assert {r.prediction for r in est.fit(df).transform(df).collect()} == {3.0}


def test_saved_trees_score_alike(spark, tmp_path):
    X, y = data(seed=7)
    df = frame(spark, X, (y > np.median(y)).astype(float))
    for est in (T.Boosting(2, maxIter=2, maxDepth=2), T.ExtraTrees(2, numTrees=3, maxDepth=4)):
        fit = est.fit(df)
        fit.save_rows(f"{tmp_path}/{type(est).__name__}")
        again = T.TreeSum.load_rows(spark, f"{tmp_path}/{type(est).__name__}")
        assert np.array_equal(fit.outputs(X), again.outputs(X)) and again.features == 3
        got = again.transform(df).select("prediction", "probability").collect()
        assert all(r.prediction == float(np.argmax(r.probability.toArray())) for r in got)


def test_brands_beat_the_mean(spark):
    X, y = data(600, seed=8)
    df = frame(spark, X, y)
    for name in ("GradientBoostingRegressor", "XGBRegressor", "CatBoostRegressor", "ExtraTreesRegressor"):
        fit = M.regressor(name, 8).fit(df)
        p = fit.outputs(X)[:, 0]
        assert ((p - y) ** 2).mean() < 0.5 * y.var(), name
        importance = fit.featureImportances.toArray()
        assert importance[2] < 0.2 and abs(importance.sum() - 1) < 1e-9


def test_statistics_see_only_earlier_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), float(rng.integers(0, 9)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    out = T.ordered_target_statistics(df, ["c"], "y", ["id"], 2.0, 3.0)
    order = {r.id: r.h for r in df.select("id", T.hash_order(F.col("id").cast("string"), 42).alias("h")).collect()}
    for r in out.collect():
        before = [y for i, c, y in rows if c == r.c and order[i] < order[r.id] and y is not None]
        assert abs(r.c_stat - (sum(before) + 6.0) / (len(before) + 3.0)) < 1e-9
    whole = {r.value: r.stat for r in T.target_statistics(df, "c", "y", 2.0, 3.0).collect()}
    mine = [y for _, c, y in rows if c is None and y is not None]
    assert abs(whole[None] - (sum(mine) + 6) / (len(mine) + 3)) < 1e-9 and len(whole) == 3


def slow_extra(est, t, X, y, classes, width):
    """(feature, threshold, value) of the nodes of one tree in the order in which they are made."""
    def value(rows):
        return [float(np.mean(y[rows] == c)) for c in range(classes)] if classes else [float(y[rows].mean())]

    def impurity(rows):
        return 1 - sum(p * p for p in value(rows)) if classes else float(y[rows].var())

    nodes, open_ = [[-1, 0.0, value(np.arange(len(y)))]], [(0, np.arange(len(y)))]
    for _ in range(est.getOrDefault("maxDepth")):
        fresh = []
        for node, rows in open_:
            if len(rows) < 5 or impurity(rows) <= 1e-12:
                continue
            best = (1e-12, None, None, None)
            for f in est.candidates(t, node, width):
                lo, hi = X[rows, f].min(), X[rows, f].max()
                cut = lo + T.uniform(42, "cut", t, node, f) * (hi - lo)
                low, high = rows[X[rows, f] <= cut], rows[X[rows, f] > cut]
                if hi > lo and min(len(low), len(high)) >= 2:
                    gain = impurity(rows) * len(rows) - impurity(low) * len(low) - impurity(high) * len(high)
                    if gain > best[0] * (1 + 1e-10):
                        best = (gain, f, cut, (low, high))
            if best[1] is not None:
                nodes[node][:2] = [best[1], best[2]]
                for side in best[3]:
                    fresh.append((len(nodes), side))
                    nodes.append([-1, 0.0, value(side)])
        open_ = fresh
    return nodes


@pytest.mark.parametrize("classes", [None, 3])
def test_same_seed_same_tree_as_in_memory(spark, monkeypatch, classes):
    X, y = data(200, seed=9)
    if classes:
        y = ((y > 0.8).astype(int) + (y > 2)).astype(float)
    est = T.ExtraTrees(classes, numTrees=3, maxDepth=4, block=2, maxFeatures="0.7")
    fit = est.fit(frame(spark, X, y))
    for t, tree in enumerate(fit.trees):
        want = slow_extra(est, t, X, y, classes, 3)
        assert tree.feature == [n[0] for n in want]
        assert np.allclose(tree.threshold, [n[1] for n in want]) and np.allclose(tree.value, [n[2] for n in want])
    monkeypatch.setattr(T, "MOST_CELLS", 60)  # a level in several jobs makes the same nodes, numbered in the same order
    again = est.fit(frame(spark, X, y, 5))
    assert np.allclose(fit.outputs(X), again.outputs(X))


def test_narrow_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    assert T._tasks(900_000, 2) >= 12 and T._tasks(100, 2) == 1
    X, y = data(width=2)
    whole = T.Boosting(maxIter=2, maxDepth=2).fit(frame(spark, X, y, 1)).outputs(X)
    monkeypatch.setattr(T, "TASK_ROWS", 100)
    parts = []
    monkeypatch.setattr(T, "durable", lambda df, label: (parts.append((label, df.rdd.getNumPartitions())), df.cache())[1])
    dealt = T.Boosting(maxIter=2, maxDepth=2).fit(frame(spark, X, y, 1)).outputs(X)
    assert parts[0] == ("binned", 4)
    assert np.allclose(whole, dealt)


def test_matrix_reads_a_slice():
    import pyarrow as pa
    rows = np.arange(12.0).reshape(4, 3)
    column = pa.array([r.tobytes() for r in rows], pa.binary())
    assert (T._matrix(column.slice(1, 2), np.float64, 3) == rows[1:3]).all()
    assert (T._matrix(column.cast(pa.large_binary()).slice(2), np.float64, 3) == rows[2:]).all()
    assert T._matrix(column.slice(4), np.float64, 3).shape == (0, 3)
