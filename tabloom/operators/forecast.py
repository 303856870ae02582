"""Forecast contract, native baselines and forecast metrics (Q7–Q15).

All inputs are daily panels: one row per series and date.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.stats import finite
from tabloom.operators.evaluate import r_squared
from tabloom.operators.panel import join_actual_forecast, money
from tabloom.operators.splits import expanding_folds
from tabloom.operators.windows import PANEL, Series

# Fixed value: the interval levels in percent.
LEVELS = (80, 90)


def _z(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 200)


def with_intervals(forecast: DataFrame, levels=LEVELS, sigma: str = "sigma") -> DataFrame:
    """Adds lo-/hi- columns: yhat ± z · residual std · √step."""
    width = F.col(sigma) * F.sqrt(F.col("step").cast("double"))
    cols = {}
    for level in levels:
        cols[f"lo-{level}"] = F.col("yhat") - _z(level) * width
        cols[f"hi-{level}"] = F.col("yhat") + _z(level) * width
    return forecast.withColumns(cols).drop(sigma)


def baseline_fit(train: DataFrame, method: str, season: int = 7, window: int = 7) -> DataFrame:
    """One row per series: its last date, the values the future repeats, the std of in-sample errors.

    mean repeats the mean, moving_average the mean of the last `window` rows, seasonal_naive the
    last `season` rows in turn.
    """
    s = PANEL
    back = F.row_number().over(s.whole.orderBy(F.desc("ds")))
    last_date = F.max("ds").alias("last_date")
    if method == "mean":
        return train.groupBy("unique_id").agg(last_date, F.array(F.avg("y")).alias("values"), F.stddev_samp("y").alias("sigma"))
    if method == "moving_average":
        past = F.avg("y").over(s.ordered.rowsBetween(-window, -1))
        full = F.count("y").over(s.ordered.rowsBetween(-window, -1)) == window
        marked = train.withColumns({"_e": F.when(full, F.col("y") - past), "_b": back})
        return marked.groupBy("unique_id").agg(
            last_date, F.array(F.avg(F.when(F.col("_b") <= window, F.col("y")))).alias("values"),
            F.stddev_samp("_e").alias("sigma"))
    if method == "seasonal_naive":
        marked = train.withColumns({"_e": F.col("y") - F.lag("y", season).over(s.ordered), "_b": back})
        last = F.collect_list(F.when(F.col("_b") <= season, F.struct("ds", "y")))
        return marked.groupBy("unique_id").agg(
            last_date, F.transform(F.array_sort(last), lambda r: r["y"]).alias("values"), F.stddev_samp("_e").alias("sigma"))
    raise ValueError(f"unknown baseline {method!r}")


def forecast_baseline(train: DataFrame, horizon: int, method: str = "seasonal_naive", season: int = 7,
                      window: int = 7, levels=LEVELS) -> DataFrame:
    """Q7: baseline forecasts over the dates after each series' end, from one pass over the history."""
    fit = baseline_fit(train, method, season, window)
    ahead = F.sequence(F.date_add("last_date", 1), F.date_add("last_date", horizon))
    days = fit.select("unique_id", "values", "sigma", F.posexplode(ahead).alias("_at", "ds"))
    repeated = F.element_at("values", (F.col("_at") % F.size("values") + 1).cast("int"))
    rows = days.select("unique_id", "ds", (F.col("_at") + 1).alias("step"), repeated.alias("yhat"), "sigma")
    return with_intervals(rows, levels)


def forecast_panel(train: DataFrame, horizon: int, method: str = "seasonal_naive", levels=LEVELS,
                   future: DataFrame | None = None, covariates: list[str] | None = None) -> DataFrame:
    """Q8: panel in, `unique_id, ds, step, yhat, lo-…, hi-…` out, for any method.

    Covariates are used by the feature method when history and future both hold all of them;
    otherwise the forecast rests on the target only.
    """
    from tabloom.operators import fits, models

    if method in ("mean", "moving_average", "seasonal_naive"):
        return forecast_baseline(train, horizon, method, levels=levels)
    if method == "features":
        known = [c for c in covariates or [] if c in train.columns and future is not None and c in future.columns]
        return models.forecast_with_features(train, horizon, future if known else None, known, levels)
    return with_intervals(fits.forecast_fitted(train, horizon, method), levels)


def forecast_summary_future(forecast: DataFrame) -> DataFrame:
    """Q9: mean and total per series at two decimals, largest total first."""
    return forecast.groupBy("unique_id").agg(
        money(F.avg("yhat")).alias("avg_daily"), money(F.sum("yhat")).alias("total_forecast")
    ).orderBy(F.desc("total_forecast"), "unique_id")


def forecast_metrics(rows: DataFrame, by: tuple[str, ...] = ("unique_id",)) -> DataFrame:
    """Q10: errors over finite rows, with the bounded MAPE.

    Row errors are clipped at 1000 %; rows with actual 0 are left out when more than a tenth of
    the rows are not 0.
    """
    y, p = finite(F.col("y")), finite(F.col("yhat"))
    clean = rows.withColumns({"_y": y, "_p": p}).filter("_y is not null and _p is not null")
    err = F.abs(F.col("_y") - F.col("_p"))
    ratio = F.least(err / F.greatest(F.abs("_y"), F.lit(1e-10)), F.lit(10.0))
    nonzero = F.abs("_y") > 1e-10
    mape = F.when(F.count_if(nonzero) > F.count(F.lit(1)) * 0.1, F.avg(F.when(nonzero, ratio))).otherwise(F.avg(ratio))
    return clean.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.avg(err).alias("mae"), F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.max(err).alias("max_error"),
        F.least(mape * 100, F.lit(1000.0)).alias("mape"), r_squared(F.col("_y"), F.col("_p")).alias("r2"))


def per_series_metrics(rows: DataFrame, by: tuple[str, ...] = ("unique_id",)) -> DataFrame:
    """Q11: MAPE without zero actuals (null if all are 0), sMAPE, WAPE (null if actuals sum to 0)."""
    y, p = F.col("y"), F.col("yhat")
    err = F.abs(y - p)
    return rows.groupBy(*by).agg(
        F.avg(err * err).alias("mse"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.try_divide(err, F.abs(y))) * 100).alias("mape"),
        (F.avg(2 * err / (F.abs(y) + F.abs(p) + 1e-8)) * 100).alias("smape"),
        F.when(F.sum(y) != 0, F.try_divide(F.sum(err), F.sum(F.abs(y))) * 100).alias("wape"),
        F.count(F.lit(1)).alias("data_points"), F.count_if(y != 0).alias("effective_points"),
        F.count_if(y == 0).alias("zero_values"))


def overall_metrics(per_series: DataFrame) -> DataFrame:
    """Q12: means over series; undefined MAPE and WAPE do not take part."""
    means = [F.avg(c).alias(f"avg_{c}") for c in ("mse", "mae", "rmse", "mape", "smape", "wape")]
    return per_series.agg(*means, F.count(F.lit(1)).alias("total_series"), F.sum("data_points").alias("total_points"),
                          F.count_if(F.col("zero_values") > 0).alias("series_with_zeros"))


def bias_metrics(rows: DataFrame) -> DataFrame:
    """Q13: errors and bias per series."""
    y, p = F.col("y"), F.col("yhat")
    err = F.abs(y - p)
    out = rows.groupBy("unique_id").agg(
        F.avg(err * err).alias("mse"), F.avg(err).alias("mae"),
        (F.avg(F.try_divide(err, F.abs(y))) * 100).alias("mape"), F.avg(y).alias("avg_actual"),
        F.avg(p).alias("avg_forecast"), F.count(F.lit(1)).alias("data_points"))
    bias = F.col("avg_forecast") - F.col("avg_actual")
    return out.withColumns({"bias": bias, "bias_pct": F.coalesce(F.try_divide(bias, F.col("avg_actual")) * 100, F.lit(0.0))})


def overall_performance(rows: DataFrame) -> DataFrame:
    """Q13: one row over all series."""
    y, p = F.col("y"), F.col("yhat")
    err = F.abs(y - p)
    return rows.agg(F.avg(err * err).alias("overall_mse"), F.avg(err).alias("overall_mae"),
                    (F.avg(F.try_divide(err, F.abs(y))) * 100).alias("overall_mape"),
                    r_squared(y, p).alias("r2_score"), F.count(F.lit(1)).alias("total_points"))


def forecast_summary(test_rows: DataFrame) -> DataFrame:
    """Q14: per series errors, sizes and means; `test_rows` also carry aic and train_size."""
    y, p = F.col("y"), F.col("yhat")
    return test_rows.groupBy("unique_id").agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.first("aic").alias("aic"),
        F.first("train_size").alias("train_size"), F.count(F.lit(1)).alias("test_size"),
        F.avg(y).alias("avg_actual"), F.avg(p).alias("avg_forecast")).orderBy("mse", "unique_id")


def summary_totals(summary: DataFrame) -> DataFrame:
    """Q14: best, worst and mean errors over the series."""
    return summary.agg(F.min("mse").alias("best_mse"), F.max("mse").alias("worst_mse"), F.avg("mse").alias("avg_mse"),
                       F.avg("mae").alias("avg_mae"))


def evaluate_holdout(split: DataFrame, forecast: DataFrame) -> DataFrame:
    """J1 on the test part: rows with y and yhat."""
    return join_actual_forecast(split.filter(F.col("part") == "test").drop("part"), forecast)


def ts_cross_validate(panel: DataFrame, model: str = "mean", splits: int = 3) -> DataFrame:
    """Q15: mean and population std of the fold errors per series.

    Only ARIMA is refitted per fold; every other model is scored as the mean of the fold's
    training part.
    """
    folds = expanding_folds(panel, splits=splits)
    if model == "arima":
        from tabloom.operators.fits import forecast_fitted
        keyed = folds.withColumn("unique_id", F.concat_ws("\u0001", "unique_id", F.col("fold").cast("string")))
        train, test = keyed.filter("part = 'train'"), keyed.filter("part = 'test'")
        placed = test.withColumn("step", F.row_number().over(PANEL.ordered))
        fitted = forecast_fitted(train, placed.groupBy().agg(F.max("step")).first()[0] or 0, "arima")
        rows = placed.join(fitted.select("unique_id", "step", "yhat"), ["unique_id", "step"])
        err = rows.select(F.split_part("unique_id", F.lit("\u0001"), F.lit(1)).alias("unique_id"), "fold",
                          F.abs(F.col("y") - F.col("yhat")).alias("_e"))
    else:
        piece = Window.partitionBy("unique_id", "fold")
        mean = F.avg(F.when(F.col("part") == "train", F.col("y"))).over(piece)
        err = folds.withColumn("_e", F.abs(F.col("y") - mean)).filter("part = 'test'")
    return err.groupBy("unique_id", "fold").agg(F.avg("_e").alias("_mae")).groupBy("unique_id").agg(
        F.avg("_mae").alias("cv_mae_mean"), F.stddev_pop("_mae").alias("cv_mae_std"))
