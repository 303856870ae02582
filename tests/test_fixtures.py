"""Closed-form cases and edge cases."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tabloom.functions import calendar as C
from tabloom.functions.stats import corrected_kurtosis, corrected_skew, paired_corr
from tabloom.operators import evaluate as E
from tabloom.operators import fits, forecast, panel, prep, profile, project, regularise, rules, splits, windows

D0 = dt.date(2024, 1, 1)


def series(spark, values, name="a", start=D0):
    rows = [(name, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double")


def column(df, c, order="ds"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_gap_of_eleven(spark):
    days = [0] + [None] * 11 + [12]
    rows = series(spark, days).filter("y is not null")
    filled = regularise._gaps(rows, ["y"]).select(F.col("day").alias("ds"), regularise._banded("y", F.lit(5)).alias("y"))
    assert column(filled, "y") == [0, 1, 2, 3, 4, 5, 5, 5, 5, 12, 12, 12, 12]


def test_leading_and_trailing_nulls(spark):
    rows = series(spark, [None, None, None, None, None, 4, None, None, None, None, None, None, None, None, None])
    filled = regularise._gaps(rows, ["y"]).select(F.col("day").alias("ds"), regularise._banded("y", F.lit(2)).alias("y"))
    assert column(filled, "y") == [0, 0, 4, 4, 4, 4, 4, 4, 4, 4, 4, 0, 0, 0, 0]


def test_ewm(spark):
    out = column(windows.ewm(series(spark, [1, 2, 4]), alphas=(0.5,)), "ewm_0.5")
    assert out == pytest.approx([1, 5 / 3, 3])


def test_ewm_null_keeps_its_place(spark):
    out = column(windows.ewm(series(spark, [1, None, 4]), alphas=(0.5,)), "ewm_0.5")
    assert out == pytest.approx([1, 1, (0.25 * 1 + 4) / 1.25])


def test_skew_and_kurtosis(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10, 20)], "v double")
    n = F.count("v")
    row = df.agg(corrected_skew(F.skewness("v"), n).alias("s"), corrected_kurtosis(F.kurtosis("v"), n).alias("k")).first()
    assert row["s"] == pytest.approx(1.36545, abs=1e-5)
    assert row["k"] == pytest.approx(1.06457, abs=1e-5)


def test_weekly_bins_end_on_monday(spark):
    out = panel.resample_weekly(series(spark, [1] * 10), "unique_id", "ds", "y")
    assert [(r.ds, r.y) for r in out.orderBy("ds").collect()] == [
        (dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 8), 7), (dt.date(2024, 1, 15), 2)]


def test_half_even(spark):
    assert spark.createDataFrame([(0.125,)], "v double").select(panel.money(F.col("v"))).first()[0] == 0.12


def test_linear_series(spark):
    line = series(spark, [3 * i + 1 for i in range(60)])
    slopes = [v for v in column(windows.rolling_trend(line, windows=(7,)), "trend_7") if v is not None]
    assert slopes == pytest.approx([3.0] * 54)
    ahead = fits.forecast_fitted(line, 5, "exp_smoothing")
    assert column(ahead, "yhat") == pytest.approx([3 * i + 1 for i in range(60, 65)])


def test_constant_column(spark):
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, y double")
    scaled = prep.apply_standard(flat, prep.fit_standard(flat, ["c"]))
    assert {r["c"] for r in scaled.collect()} == {0.0}
    assert flat.agg(paired_corr("c", "y")).first()[0] is None
    p = rules.column_profile(flat)
    kept = rules.filter_features_generic(flat, p, "y", ["c"]).first()
    assert kept["reason"] == "constant"


def test_zero_actuals(spark):
    rows = spark.createDataFrame([("a", D0, 0.0, 1.0), ("a", D0, 0.0, 2.0)], "unique_id string, ds date, y double, yhat double")
    m = forecast.per_series_metrics(rows).first()
    assert m["mape"] is None and m["wape"] is None and m["smape"] == pytest.approx(200) and m["zero_values"] == 2
    assert E.regression_metrics(rows).first()["mape"] is None


def test_empty_null_and_single_rows(spark):
    empty = spark.createDataFrame([], "a double, b string")
    nulls = spark.createDataFrame([(None, None)] * 3, "a double, b string")
    one = spark.createDataFrame([(1.0, "x")], "a double, b string")
    for df in (empty, nulls, one):
        n = df.count()
        assert profile.dataset_profile(df).filter("column = 'a'").first()["n"] == n
        assert profile.numeric_describe(df).count() == 1
        assert profile.quality_scores(df).count() == 1
        assert profile.duplicate_rows(df).first()[0] == max(n - df.distinct().count(), 0)
        assert rules.column_profile(df).count() == 2
        assert profile.categorical_target_profile(df).count() == 2
    assert regularise.regularise_daily(series(spark, [])).count() == 0
    assert windows.all_features(series(spark, [5])).count() == 1


def test_negative_and_null_clamp(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "v double")
    assert [r[0] for r in project.clamp_negative(df, ["v"]).collect()] == [0.0, None, 2.0]


def test_key_never_skips_a_level(spark):
    df = spark.createDataFrame([(None, "s", None, "c", "k")], "BRAND string, MH_SEGMENT string, MH_FAMILY string, MH_CLASS string, MH_BRICK string")
    assert df.select(project.composite_key()).first()[0] == "UNKNOWN_BRAND | s | UNKNOWN | c | k"


def test_binary_metrics_take_the_larger_label(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, yhat int")
    m = E.classification_metrics(rows).first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.75, 1.0, 0.5)
    assert m["f1"] == pytest.approx(2 / 3)


def test_decompose_recovers_a_season(spark):
    y = [10 + 0.5 * i + 3 * math.sin(2 * math.pi * i / 12) for i in range(60)]
    out = windows.seasonal_decompose(series(spark, y))
    got = [r["seasonal"] for r in out.orderBy("ds").limit(12).collect()]
    assert got == pytest.approx([3 * math.sin(2 * math.pi * i / 12) for i in range(12)], abs=1e-9)
    s = windows.seasonality_strength(out).first()
    assert s["seasonality_strength"] > 0.99 and s["has_trend"] == 1


def test_feature_defaults_match_by_name_part():
    names = ["target_lag_1", "target_lag_2", "target_lag_7", "target_lag_10", "rolling_mean_3", "rolling_mean_7", "month"]
    assert splits.ts_feature_defaults(names, ["a", "b", "c", "d"]) == [
        "target_lag_1", "target_lag_7", "target_lag_10", "rolling_mean_3", "month", "a", "b", "c"]


def test_algorithm_defaults():
    assert rules.algorithm_defaults("regression", 500, 3) == ["LinearRegression", "Ridge", "KNeighborsRegressor"]
    assert rules.algorithm_defaults("time_series", 100, 0) == ["ARIMA", "ExponentialSmoothing", "LinearRegressionTS"]
    assert rules.complete_algorithms(["Ridge"], "regression", 5000, 3) == ["Ridge", "RandomForestRegressor", "LinearRegression"]


def test_calendar_is_monday_based(spark):
    row = C.add(spark.createDataFrame([(D0,)], "ds date"), {**C.calendar_columns(F.col("ds")), **C.period_columns(F.col("ds"))}).first()
    assert row["day_of_week"] == 0 and row["is_year_start"] == 1 and row["week_of_year"] == 1
