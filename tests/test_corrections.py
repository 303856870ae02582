"""Penalties, order selection, null runs, whole files: closed forms and pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import evaluate as E
from tabloom.operators import fits
from tabloom.operators import models as M
from tabloom.operators import windows as W
from tabloom.sources import delimited


def matrix(spark, n=400, scale=50.0, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 2.0]
    y = scale * (3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=n)) + 7
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    return x, y, M.assemble(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")


@pytest.mark.parametrize("alpha", [0.5, 500.0])
def test_ridge_solves_the_normal_equations(spark, alpha):
    x, y, rows = matrix(spark)
    est = M.regressor("Ridge")
    got = est.fit(rows, {est.alpha: alpha})
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
    assert got.coefficients.toArray() == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize(("name", "share"), [("ElasticNet", 0.5), ("Lasso", 1.0)])
def test_elastic_net_is_at_its_minimum(spark, name, share):
    x, y, rows = matrix(spark)
    est = M.regressor(name)
    got = est.fit(rows, {est.alpha: 3.0}).coefficients.toArray()
    xc, yc, n = x - x.mean(axis=0), y - y.mean(), len(y)
    w = np.zeros(2)
    for _ in range(3000):  # coordinate descent on half the mean square plus the penalties
        for j in range(2):
            rest = yc - xc @ w + xc[:, j] * w[j]
            z = xc[:, j] @ rest / n
            w[j] = np.sign(z) * max(abs(z) - 3.0 * share, 0) / (xc[:, j] @ xc[:, j] / n + 3.0 * (1 - share))
    assert got == pytest.approx(w, rel=1e-4)


def test_logistic_penalty_counts_the_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    label = (x + rng.normal(size=300) > 0).astype(float)
    rows = M.assemble(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, label)], "a double, y double"), ["a"], "y")
    est = M.classifier("LogisticRegression")
    got = est.fit(rows, {est.C: 0.05})
    w, b = 0.0, 0.0
    for _ in range(200):  # Newton steps on C * loss + w² / 2
        p = 1 / (1 + np.exp(-(w * x + b)))
        g = np.array([0.05 * ((p - label) @ x) + w, 0.05 * (p - label).sum()])
        s = p * (1 - p)
        h = np.array([[0.05 * (s @ (x * x)) + 1, 0.05 * (s @ x)], [0.05 * (s @ x), 0.05 * s.sum()]])
        w, b = np.array([w, b]) - np.linalg.solve(h, g)
    assert float(got.coefficients[0]) == pytest.approx(w, rel=1e-3) and got.intercept == pytest.approx(b, abs=1e-3)


def test_searches_state_penalties_as_the_models_do(spark):
    _, _, rows = matrix(spark, 120)
    folded = rows.withColumn("fold", (F.monotonically_increasing_id() % 3).cast("int"))
    _, table = M.grid_search(folded, "Ridge", M.regressor("Ridge"), "regression")
    assert sorted(r["params"] for r in table.collect()) == ['{"alpha": 0.1}', '{"alpha": 1.0}', '{"alpha": 10.0}']


def test_fold_metrics_weigh_the_classes(spark):
    pairs = [("0", "0"), ("0", "1"), ("1", "1"), ("1", "1"), ("1", "0"), ("1", "1")]
    df = spark.createDataFrame(pairs, "y string, yhat string")
    got = E.classification_metrics(df, average="weighted").first()
    assert got["precision"] == pytest.approx((2 * 0.5 + 4 * 0.75) / 6)


# ---------------------------------------------------------------- orders

def test_order_does_not_depend_on_the_unit():
    rng = np.random.default_rng(3)
    for k in range(4):
        y = rng.normal(size=120) + (np.arange(120) * 0.05 if k % 2 else 0) + 3
        for fit in (fits.fit_arima_grid, fits.fit_sarima_grid):
            assert len({fit(y * s, 7).order for s in (1e-3, 1.0, 1e5)}) == 1


def test_white_noise_is_forecast_like_its_mean():
    mine, plain = [], []
    for seed in range(20):
        y = np.random.default_rng(seed).normal(size=160) * 1e5
        got = fits.fit_arima_grid(y[:140], 20).out
        mine.append(np.abs(got - y[140:]).mean())
        plain.append(np.abs(y[:140].mean() - y[140:]).mean())
    assert np.mean(mine) <= 1.03 * np.mean(plain)


def test_skipped_series_are_listed(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]
    rows = [("long", d, 10.0 + k % 7) for k, d in enumerate(days)] + [("short", d, 5.0) for d in days[:8]]
    panel = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    skipped = {r["unique_id"]: r["reason"] for r in fits.skipped_series(panel).collect()}
    kept = {r["unique_id"] for r in fits.backtest_fitted(panel).collect()}
    assert kept == {"long"} and set(skipped) == {"short"} and "20 days" in skipped["short"]


# ---------------------------------------------------------------- weighted means

def test_weighted_means_carry_over_null_runs(spark):
    rng = np.random.default_rng(4)
    y = [1.0, 3.0, *[None] * 30, 2.5, None, *rng.normal(size=50).tolist(), *[None] * 400, 8.0]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(len(y))]
    late = [None, None, 4.0, None]
    rows = [("a", d, v, k) for k, (d, v) in enumerate(zip(days, y))] + [("b", days[k], v, k) for k, v in enumerate(late)]
    out = W.ewm(spark.createDataFrame(rows, "unique_id string, ds date, y double, extra int")).toPandas().sort_values(["unique_id", "ds"])
    assert list(out.columns[:4]) == ["unique_id", "ds", "y", "extra"]
    for key, values in (("a", y), ("b", late)):
        mine = out[out["unique_id"] == key]
        for a in W.ALPHAS:
            want = pd.Series(values, dtype=float).ewm(alpha=a, adjust=True).mean()
            np.testing.assert_allclose(mine[f"ewm_{a}"].to_numpy(float), want.to_numpy(), rtol=1e-12)


# ---------------------------------------------------------------- files

def write(tmp_path, data: bytes) -> str:
    path = tmp_path / "file.csv"
    path.write_bytes(data)
    return str(path)


def test_late_bytes_decide_the_encoding(spark, tmp_path):
    path = write(tmp_path, b"id,name\n" + b"".join(b"%d,plain\n" % k for k in range(150)) + "150,café\n".encode("latin-1"))
    assert delimited.sniff(spark, path) == ("latin-1", ",")
    rows = {r["id"]: r["name"] for r in delimited.read_delimited(spark, path, try_encodings=True).collect()}
    assert rows[150] == "café" and len(rows) == 151
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, path)


def test_late_ragged_records_rule_a_separator_out(spark, tmp_path):
    body = b"".join(b"%d;x,y\n" % k for k in range(150))
    path = write(tmp_path, b"a;b,c\n" + body + b"150;p,q,r\n")
    assert delimited.sniff(spark, path) == ("utf-8", ";")
    with pytest.raises(ValueError):
        delimited.detect(spark, write(tmp_path, b"a,b\n1,2\n1,2,3\n1;2;3;4\n1\t2\t3\n1|2|3\n"))


def test_line_breaks_inside_quotes(spark, tmp_path):
    body = b"".join(b'%d,"say ""hi"", then go"\n' % k for k in range(150))
    path = write(tmp_path, b"id,text\n" + body + b'150,"line one\nline two"\n151,5" wide\n')
    rows = {r["id"]: r["text"] for r in delimited.read_delimited(spark, path).collect()}
    assert len(rows) == 152 and rows[150] == "line one\nline two" and rows[3] == 'say "hi", then go' and rows[151] == '5" wide'
    plain = write(tmp_path, b"id,text\n" + body)
    assert not delimited.detect(spark, plain).multi_line


def test_empty_files_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        delimited.sniff(spark, write(tmp_path, b"\n\n"))


# ---------------------------------------------------------------- neighbours

def test_neighbours_in_cells_are_exact_and_few(spark):
    from tabloom.operators import neighbours as N

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 6)) * 20
    points = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 6))
    points[5] = points[9]
    ref = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(points)], "rid long, vec array<double>, y double")
    ask = spark.createDataFrame([(i, (points[i] + 0.01).tolist()) for i in range(0, 1500, 10)] + [(9999, [500.0] * 6)], "qid long, vec array<double>")
    seen: list = []
    got = N.nearest(ask, ref, 4, block_rows=40, cell_rows=100, cells_asked=seen).toPandas()
    for qid, vec in ((r["qid"], r["vec"]) for r in ask.collect()):
        d = np.sqrt(((points - np.array(vec)) ** 2).sum(axis=1))
        want = sorted(zip(d, range(1500)))[:4]
        mine = got[got["qid"] == qid].sort_values(["dist", "rid"])
        assert mine["rid"].tolist() == [i for _, i in want]
    tested = seen[0].agg(F.sum("rows")).first()[0] or 0
    assert tested < 0.2 * 151 * 1500
    assert N.nearest(ask, ref.limit(0), 4).count() == 0


# ---------------------------------------------------------------- runs

@pytest.mark.parametrize("name", ["E16_run_both", "E17_two_target_run"])
def test_registered_runs_are_whole(spark, sf, monkeypatch, name):
    """Full counts of trees and rounds, five folds and the whole search, for every run of the query."""
    from tabloom.plans import registry, runs

    registry.load_all()
    seen = []

    def stop(df, key, task=None, target=None, features=None, algorithms=None, trees=None, folds=5, draws=0):
        seen.append((trees, folds, draws))
        raise ValueError("seen")

    monkeypatch.setattr(runs, "table_run", stop)
    with pytest.raises((ValueError, AttributeError)):
        registry.QUERIES[name](spark, sf)
    assert seen and set(seen) == {(None, 5, None)}


def test_small_table_run_tunes_and_combines(spark):
    from tabloom.plans import runs

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(size=300) * 0.3
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    run = runs.table_run(df, ["id"], "regression", "y", ["a", "b"], folds=3, draws=2)
    names = {r["model"] for r in run.metrics.collect()}
    assert names == {"LinearRegression", "Ridge", "Ridge (tuned)", "KNeighborsRegressor", runs.ENSEMBLE} and not run.errors
    assert run.ensemble is not None and run.best != runs.ENSEMBLE


def test_neighbours_are_a_model(spark, tmp_path):
    from tabloom.operators import neighbours as N

    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) + 6])
    rows = M.assemble(spark.createDataFrame([(float(a), float(b), float(i >= 60)) for i, (a, b) in enumerate(x)], "a double, b double, y double"),
                      ["a", "b"], "y")
    model = M.classifier("KNeighborsClassifier", 2).fit(rows)
    out = model.transform(rows).collect()
    assert all(r["prediction"] == r["label"] and abs(sum(r["probability"]) - 1) < 1e-9 for r in out)
    model.save_rows(str(tmp_path / "rows"))
    again = N.KNeighborsModel.load_rows(spark, str(tmp_path / "rows"))
    assert {r["prediction"] for r in again.transform(rows).collect()} == {0.0, 1.0}


def test_series_run_reports_every_name(spark):
    from tabloom.plans import runs

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(120)]
    panel = spark.createDataFrame([(s, d, 50.0 + 10 * (k % 7) + i) for i, s in enumerate("ab") for k, d in enumerate(days)],
                                  "unique_id string, ds date, y double")
    run = runs.series_run(panel, ["MovingAverage", "SeasonalNaive", "Prophet", "LinearRegressionTS", "LSTM"], test_days=14)
    assert {r["model"] for r in run.metrics.collect()} == {"MovingAverage", "SeasonalNaive", "Prophet", "LinearRegressionTS"}
    assert set(run.errors) == {"LSTM"} and run.best in ("SeasonalNaive", "Prophet", "LinearRegressionTS")


def test_clustering_run_reports_every_name(spark):
    from tabloom.plans import runs

    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(50, 2)) * 0.1, rng.normal(size=(50, 2)) * 0.1 + 5])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    out = runs.clustering_run(df, ["id"], ["a", "b"], k=2)
    found = {r["model"]: r for r in out["metrics"].collect()}
    assert set(found) == {"KMeans", "DBSCAN", "AgglomerativeClustering"} and not out["errors"]
    assert all(found[m]["clusters"] == 2 and found[m]["silhouette"] > 0.9 for m in ("KMeans", "DBSCAN"))


def test_names_of_all_problem_types(spark):
    from tabloom.functions import text as X

    df = spark.createDataFrame([("1. Support Vector machine\n2. knn",)], "t string")
    got = df.select(X.resolve_algorithms("t", X.CLASSIFICATION_ALIASES, X.CLASSIFICATION_NAMES, X.CLASSIFICATION_DEFAULTS)).first()[0]
    assert got == ["SVC", "KNeighborsClassifier"]
    df = spark.createDataFrame([("- Prophet\n- holt-winters\n- seasonal naive",)], "t string")
    got = df.select(X.resolve_algorithms("t", X.SERIES_ALIASES, X.SERIES_NAMES, X.SERIES_DEFAULTS, 5, 3)).first()[0]
    assert got == ["Prophet", "HoltWinters", "SeasonalNaive"]


def test_windows_characters_are_put_right(spark, tmp_path):
    path = write(tmp_path, "id,name\n1,“x” €5\n".encode("cp1252"))
    assert delimited.read_delimited(spark, path, "cp1252").first()["name"] == "“x” €5"
