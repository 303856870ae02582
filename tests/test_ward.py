"""Ward's clusters against merging one pair at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabloom.operators import neighbours as N


def slow_ward(ids, X):
    groups = [([i], x.astype(float), 1) for i, x in zip(ids, X)]
    C, n, name = np.array([g[1] for g in groups]), np.ones(len(ids)), np.array(ids)
    live, heights, members = np.ones(len(ids), bool), [], {i: [i] for i in ids}
    states = {}
    H = np.sqrt(((C[:, None] - C[None]) ** 2).sum(axis=2))
    np.fill_diagonal(H, np.inf)
    while live.sum() > 1:
        states[int(live.sum())] = {frozenset(m) for m in members.values()}
        i, j = np.unravel_index(H.argmin(), H.shape)
        i, j = min(i, j), max(i, j)
        heights.append(H[i, j])
        C[i], n[i] = (C[i] * n[i] + C[j] * n[j]) / (n[i] + n[j]), n[i] + n[j]
        live[j] = False
        members[name[i]] += members.pop(name[j])
        H[j], H[:, j] = np.inf, np.inf
        row = np.where(live, np.sqrt(2 * n[i] * n / (n[i] + n) * ((C - C[i]) ** 2).sum(axis=1)), np.inf)
        row[i] = np.inf
        H[i], H[:, i] = row, row
    return sorted(heights), states


@pytest.mark.parametrize("finish, cell_rows", [(20, 2000), (60, 40)])
def test_merges_equal_one_pair_at_a_time(spark, finish, cell_rows):
    rng = np.random.default_rng(finish)
    X = np.round(rng.normal(size=(220, 4)) + 3 * rng.integers(0, 4, (220, 1)), 3)
    X[200:] = X[:20]  # copies
    ids = rng.permutation(1000)[:220].tolist()
    points = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, X)], "id long, vec array<double>")
    heights, _ = slow_ward(ids, X)
    got = sorted(r.height for r in N.ward_merges(points, finish, cell_rows).collect())
    assert len(got) == 219 and np.allclose(got, heights, atol=1e-9)


def test_clusters_are_those_of_the_five_last_groups(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(150, 3)) + 2 * rng.integers(0, 5, (150, 1))
    ids = list(range(150))
    rows = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in zip(ids, X)], ["row_id", "features"])
    got = {}
    for r in N.agglomerative(rows, 5, "row_id", finish=30).collect():
        got.setdefault(r.cluster, set()).add(r.row_id)
    assert {frozenset(m) for m in got.values()} == slow_ward(ids, X)[1][5]
    assert sorted(got) == [0, 1, 2, 3, 4] and [min(got[c]) for c in range(5)] == sorted(min(m) for m in got.values())


def test_few_and_equal_rows(spark):
    same = spark.createDataFrame([(i, Vectors.dense([1.0, 2.0])) for i in range(6)], ["row_id", "features"])
    assert N.agglomerative(same, 2, "row_id").select("cluster").distinct().count() == 2
    one = same.limit(1)
    assert N.agglomerative(one, 5, "row_id").collect()[0].cluster == 0


def test_rows_move_once_per_block_of_queries(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(1500, 12))
    X[700:900] = X[3]  # copies
    ref = spark.createDataFrame([(i, x.tolist(), float(i % 3)) for i, x in enumerate(X)], "rid long, vec array<double>, y double")
    ask = spark.createDataFrame([(i, X[i].tolist()) for i in range(0, 1500, 5)], "qid long, vec array<double>")
    seen: list = []
    got = N.nearest(ask, ref, 4, block_rows=800, cell_rows=40, cells_asked=seen).toPandas()
    for qid in range(0, 1500, 5):
        d = np.sqrt(((X - X[qid]) ** 2).sum(axis=1))
        mine = got[got["qid"] == qid].sort_values(["dist", "rid"])
        assert list(zip(mine["dist"], mine["rid"])) == sorted(zip(d, range(1500)))[:4]
    # nearly every cell may hold a better row, yet a query moves once for a zone of cells, of which there are two or three
    assert seen[0].count() <= 3 * 300


def test_clusters_ask_again_only_where_a_merge_touches_them(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(400, 5))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<double>")
    asked: list = []
    got = sorted(r.height for r in N.ward_merges(points, 150, 100, asked).collect())
    assert np.allclose(got, slow_ward(list(range(400)), X)[0], atol=1e-9)
    assert asked[0] == 400 and len(asked) > 1 and all(n < 320 for n in asked[1:])


def test_ids_that_come_twice_still_have_a_nearest_cluster(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(60, 4))
    rows = [(i, x.tolist(), 1.0) for i, x in enumerate(X)] * 3
    for cell_rows in (500, 30):
        got = {r.id: r.other for r in N.nearest_clusters(spark.createDataFrame(rows, "id long, vec array<double>, n double"), cell_rows).collect()}
        d = ((X[:, None] - X[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        assert got == dict(enumerate(d.argmin(axis=1).tolist()))


@pytest.mark.parametrize("direct", [0, 14_000])
def test_few_pairs_meet_without_cells(spark, monkeypatch, direct):
    rng = np.random.default_rng(13)
    X = np.round(rng.normal(size=(130, 4)) + 3 * rng.integers(0, 4, (130, 1)), 3)
    X[120:] = X[:10]  # copies
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<double>")
    written, fitted, write, centres = [], [], N.durable, N._centres
    monkeypatch.setattr(N, "DIRECT", direct, raising=False)
    monkeypatch.setattr(N, "durable", lambda df, label: (written.append(label), write(df, label))[1])
    monkeypatch.setattr(N, "_centres", lambda *a: (fitted.append(1), centres(*a))[1])
    asked: list = []
    got = sorted(r.height for r in N.ward_merges(points, 60, 40, asked).collect())
    assert np.allclose(got, slow_ward(list(range(130)), X)[0], atol=1e-9)
    cells = written.count("cells")
    if direct:  # the first round has more pairs than the bound, the later ones have fewer
        assert len(fitted) == cells == 1 and len(asked) > 1
        assert len(written) <= 2 + 7 + 4 * (len(asked) - 1)
    else:
        assert cells == len(asked)
