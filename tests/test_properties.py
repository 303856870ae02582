"""Properties, the paths beyond the size checks, and skewed inputs."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import dense_number, exact_quantiles, with_position
from tabloom.operators import evaluate as E
from tabloom.operators import fits, forecast, neighbours, panel, prep, profile, project, regularise, splits, windows
from tabloom.session import scratch_path
from tabloom.sources import delimited, sinks

D0 = dt.date(2024, 1, 1)


def skewed(spark, n=4000, hot=0.5):
    """Half of the rows share one key, one day and one value."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        busy = rng.random() < hot
        key = "hot" if busy else f"k{rng.randrange(20)}"
        day = 7 if busy and rng.random() < 0.7 else rng.randrange(120)
        value = 1.5 if busy and rng.random() < 0.5 else rng.choice([0.0, -2.25, 1e-9, 3e12, rng.gauss(0, 100)])
        rows.append((i, key, D0 + dt.timedelta(days=day), value))
    return spark.createDataFrame(rows, "id long, k string, ds date, v double")


def test_quantiles_of_skewed_groups(spark):
    df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(df, ["v"], probs, ("k",)).collect()}
    want = df.toPandas().groupby("k")["v"].quantile(probs)
    assert len(got) == len(want)
    for key, q in got.items():
        assert q == pytest.approx(want[key], rel=1e-12, abs=1e-12)


def test_quantiles_of_values_that_share_their_leading_bits(spark):
    rng = random.Random(5)
    stamps = [1_700_000_000 + k for k in range(0, 86_400, 7)] + [1_700_000_000] * 4000
    big = [2.0**60 + rng.randrange(2**20) * 256 for _ in range(3000)]
    odd = [5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.0, -0.0, 1.0, 2.0, 4.0, 0.5, 1 - 2**-53, 2 - 2**-52]
    rows = [("stamps", float(v)) for v in stamps] + [("big", v) for v in big] + [("odd", v) for v in odd] + [(None, v) for v in odd] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(df, ["v"], probs, ("k",)).collect()}
    want = {(r["k"], p): q for r in df.filter("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()
            for p, q in zip(probs, r["q"])}
    assert got == pytest.approx(want, rel=1e-15, abs=0)


def test_profile_and_median_error_against_percentile(spark):
    df = skewed(spark).select("k", F.col("v").alias("y"), (F.col("v") * 0.9 + 1).alias("yhat"))
    described = profile.numeric_describe(df.select("y")).first()
    assert [described[c] for c in ("q25", "q50", "q75")] == df.agg(F.percentile("y", F.array(*map(F.lit, (0.25, 0.5, 0.75))))).first()[0]
    direct = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile(F.abs(F.col("y") - F.col("yhat")), 0.5).alias("m")).collect()}
    assert {r["k"]: r["median_ae"] for r in E.regression_metrics(df, by=("k",)).collect()} == pytest.approx(direct)


def test_positions_equal_row_number(spark):
    df = skewed(spark)
    buckets = [F.trunc("ds", "month"), F.col("ds"), F.shiftright("id", 6)]
    out = with_position(df, ["k"], ["ds", "id"], buckets, "pos", "total")
    w = Window.partitionBy("k")
    check = out.withColumn("want", F.row_number().over(w.orderBy("ds", "id")) - 1).withColumn("n", F.count("id").over(w))
    assert check.filter("pos != want or total != n").count() == 0
    assert check.count() == df.count()


def test_positions_with_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "g string, t int")
    rows = {(r["g"], r["t"]): r["pos"] for r in with_position(df, ["g"], ["t"], F.lit(0)).collect()}
    assert rows == {(None, 1): 0, (None, 3): 1, ("a", 2): 0}


def test_numbering_beyond_one_task(spark):
    values = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    out = dense_number(values, [], "v", "code")
    assert out.filter("v != code").count() == 0 and out.count() == 5000


def test_dedupe_with_a_hot_key(spark):
    df = skewed(spark)
    one = project.dedupe_keep_first(df, ["k", "ds"], ["id"])
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k", "ds").orderBy("id"))).filter("r = 1").drop("r")
    assert one.exceptAll(want).count() == 0 and want.exceptAll(one).count() == 0


def test_chunks_equal_whole_series(spark):
    df = skewed(spark).withColumn("at", F.struct("ds", "id"))
    s = windows.Series(("k",), "at", "v")
    step = lambda d, p: windows.differences(windows.rolling_basic(windows.lags(d, p, (1, 3)), p, (7,)), p, (1,))
    whole = step(df, s).filter("k = 'hot'")
    pieces = windows.in_chunks(df, step, s, 10, [F.trunc("ds", "month"), F.col("ds")], 100).filter("k = 'hot'")
    a, b = (x.select("id", "target_lag_3", "rolling_std_7", "diff_1", "diff2_1").toPandas().set_index("id").sort_index()
            for x in (whole, pieces))
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=1e-6)


def test_splits_cover_and_do_not_overlap(spark):
    df = skewed(spark)
    for out in (splits.train_test_split(df, ["id"]), splits.stratified_split(df, "k", ["id"]),
                splits.holdout_fraction(df, ["k"], ["ds", "id"], [F.trunc("ds", "month"), F.col("ds")])):
        assert out.select("id").distinct().count() == df.count() == out.count()
        assert {r[0] for r in out.select("part").distinct().collect()} == {"train", "test"}
    share = splits.stratified_split(df, "k", ["id"]).groupBy("k").agg(
        F.count_if(F.col("part") == "train").alias("a"), F.floor(F.count("id") * 0.8).alias("b"))
    assert share.filter("a != b").count() == 0


def test_regular_series_have_no_gaps(spark):
    rng = random.Random(5)
    rows = [("s", D0 + dt.timedelta(days=d), float(rng.randrange(100)), None if rng.random() < 0.3 else 1.0)
            for d in sorted(rng.sample(range(300), 200))]
    p = spark.createDataFrame(rows, "unique_id string, ds date, y double, qty double")
    out = regularise.regularise_daily(p)
    gaps = out.withColumn("g", F.date_diff("ds", F.lag("ds").over(Window.partitionBy("unique_id").orderBy("ds"))))
    assert gaps.filter("g != 1").count() == 0
    assert out.filter("y is null or qty is null or y < 0").count() == 0
    # the reference behaviour, step by step in pandas
    pdf = p.toPandas()
    pdf["ds"] = pdf["ds"].astype("datetime64[ns]")
    full = pdf.set_index("ds").reindex(__import__("pandas").date_range(pdf.ds.min(), pdf.ds.max()))
    ratio = 1 - len(pdf) / len(full)
    limit = None if ratio < 0.2 else 5 if ratio < 0.4 else 2
    got = out.orderBy("ds").toPandas()
    for c in ("y", "qty"):
        want = full[c].interpolate(method="linear", limit=limit).ffill(limit=3).bfill(limit=3).fillna(0).clip(lower=0)
        np.testing.assert_allclose(got[c], want)


def test_daily_quality_equals_line_quality(spark):
    df = skewed(spark).filter("abs(v) < 1e6").select(
        "k", F.col("ds").alias("BILLING_DATE"), F.round("v", 2).alias("TOTAL_NET_SALES"), F.lit(1.0).alias("TOTAL_BILLING_QTY"),
        F.lit(2.0).alias("TOTAL_GROSS_MARGIN"), F.lit(1.0).alias("TOTAL_GROSS_SALES"), F.lit(0.0).alias("TOTAL_DISCOUNT"))
    a = panel.series_quality(df, "k").orderBy("unique_id").collect()
    b = panel.series_quality_daily(panel.daily_parts(df, "k")).orderBy("unique_id").collect()
    for x, y in zip(a, b):
        for c in ("total_sales", "avg_sales", "sales_std", "cv", "data_density", "transaction_count", "unique_days"):
            assert x[c] == pytest.approx(y[c], abs=0.011), c


def test_encoders_are_one_to_one(spark):
    df = skewed(spark)
    codes = prep.label_codes(df, "k").collect()
    assert sorted(c["code"] for c in codes) == list(range(len(codes)))
    assert [c["value"] for c in sorted(codes, key=lambda c: c["code"])] == sorted(c["value"] for c in codes)


def test_fitted_scaler_gives_zero_mean(spark):
    df = skewed(spark).filter("abs(v) < 1e6").withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")))
    out = prep.Preprocessor.fit(df, ["v", "k"]).transform(df)
    r = out.agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b"), F.avg("k").alias("c"), F.stddev_pop("k").alias("d")).first()
    assert [r["a"], r["b"], r["c"], r["d"]] == pytest.approx([0, 1, 0, 1], abs=1e-9)


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(40, 5)), rng.normal(size=(150, 5))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vec array<double>")
    ref = spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(r)], "rid long, vec array<double>, y double")
    got = neighbours.nearest(queries, ref, 4, block_rows=30).toPandas()
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    for i in range(len(q)):
        assert sorted(got[got.qid == i].rid) == sorted(np.argsort(d[i])[:4])


def _brute_dbscan(x, eps, m):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core, label, c = near.sum(1) >= m, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], c
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if label[j] < 0:
                        label[j] = c
                        if core[j]:
                            stack.append(j)
            c += 1
    return core, label


def test_density_clusters(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.4, (120, 2)), rng.normal(2.2, 0.4, (100, 2)), rng.uniform(-3, 6, (60, 2)),
                        np.repeat([[0.1, 0.1]], 80, axis=0)])
    rng.shuffle(x)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    got = neighbours.dbscan(points, ["a", "b"], 0.3, 4, piece=25).orderBy("id").toPandas()
    core, label = _brute_dbscan(x, 0.3, 4)
    assert (got.is_core.to_numpy() == core).all()
    assert (got.cluster.to_numpy() == label).all()


def test_components_of_a_long_chain(spark):
    n = 500
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    out = neighbours.components(spark.range(n + 1).withColumnRenamed("id", "node"), edges)
    assert {r["root"] for r in out.filter(f"node < {n}").collect()} == {0}
    assert out.filter(f"node = {n}").first()["root"] == n


def test_ensemble_of_equal_models(spark):
    base = skewed(spark).select("id", F.col("v").alias("y"), (F.col("v") * 0.99).alias("yhat"))
    rows = base.withColumn("model", F.lit("a")).unionByName(base.withColumn("model", F.lit("b")))
    m = E.regression_metrics(rows, by=("model",), median=False)
    out = E.ensemble_regression(rows, m, "id").join(base.withColumnRenamed("yhat", "one"), "id")
    assert out.filter("abs(yhat - one) > 1e-9 * abs(one) + 1e-12").count() == 0
    single = rows.filter("model = 'a'")
    assert E.ensemble_regression(single, m.filter("model = 'a'"), "id").count() == 0


@pytest.mark.parametrize("method", ["mean", "moving_average", "seasonal_naive", "arima", "arima_grid", "sarima_grid",
                                    "exp_smoothing", "trend_season", "features"])
def test_forecast_shape(spark, method):
    rows = [(s, D0 + dt.timedelta(days=i), 50 + i * 0.3 + 10 * ((i % 7) == 5) + s_i)
            for s_i, s in enumerate("abc") for i in range(120)]
    p = spark.createDataFrame(rows, "unique_id string, ds date, y double")
    out = forecast.forecast_panel(p, 9, method)
    assert out.columns == ["unique_id", "ds", "step", "yhat", "lo-80", "hi-80", "lo-90", "hi-90"] or set(
        ["unique_id", "ds", "step", "yhat", "lo-80", "hi-90"]) <= set(out.columns)
    got = out.collect()
    assert len(got) == 27 and all(r["lo-90"] <= r["lo-80"] <= r["yhat"] <= r["hi-80"] <= r["hi-90"] for r in got)
    assert all(0 < r["yhat"] < 300 for r in got)


def test_arima_follows_an_autoregression():
    rng = np.random.default_rng(0)
    y = [0.0]
    for _ in range(3000):
        y.append(0.8 * y[-1] + rng.normal())
    fit = fits.fit_arima(np.array(y) + 5, 3, (1, 0, 0))
    out, sigma = fit.out, fit.sigma
    assert sigma == pytest.approx(1, abs=0.05)
    assert out[0] - np.mean(np.array(y) + 5) == pytest.approx(0.8 * (y[-1] - np.mean(y)), abs=0.1)


def test_delimited_files(spark, tmp_path):
    for sep in ",;\t|":
        f = tmp_path / f"t{ord(sep)}.csv"
        f.write_text(f"a{sep}b\n1{sep}x\n2{sep}NaN\n")
        df = delimited.read_delimited(spark, str(f))
        assert df.columns == ["a", "b"] and df.count() == 2
    latin = tmp_path / "l.csv"
    latin.write_bytes("a;b\n1;é\n".encode("latin-1"))
    assert delimited.read_delimited(spark, str(latin), try_encodings=True).first()["b"] == "é"
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path / "e.csv"))


def test_split_writer_skips_an_empty_part(spark):
    stem = scratch_path(spark, "split")
    record = sinks.write_split(skewed(spark), "v", stem)
    assert record["nan_file"] is None and record["clean_rows"] == 4000
