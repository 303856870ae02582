"""Per-series model fits (Q1–Q5): the only operators that need Python workers.

Spark groups a daily panel by series and each group is one series, bounded by its days.  ARIMA and seasonal ARIMA have
the exact Gaussian likelihood, exponential smoothing estimates its first states with its weights, trend and season has
bends; all four are in `likelihood`.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import likelihood as L
from tabloom.operators.project import nonzero_filter
from tabloom.operators.splits import holdout_fraction

# The orders and configurations tried by the searches.
ARIMA_GRID = list(itertools.product(range(4), range(3), range(4)))
SEASONAL_GRID = list(itertools.product((0, 1), (0, 1), (0, 1)))
PERIODS_LONG, PERIODS_SHORT = (4, 7, 12, 24), (4, 7)
SMOOTHING_CONFIGS = ((None, None), ("add", None), ("mul", None), ("add", "add"), ("add", "mul"))
SMOOTHING_PERIOD = 12

FORECAST_SCHEMA = "unique_id string, ds date, step int, yhat double, sigma double, aic double, train_size long"


@dataclass
class Fit:
    """A forecast with its spread, its one-step errors, the number of its parameters and its criterion."""

    out: np.ndarray
    sigma: float
    err: np.ndarray
    params: int
    order: tuple = ()
    loglik: float | None = None

    def aic(self) -> float:
        if self.loglik is not None:
            return 2 * self.params - 2 * self.loglik
        return len(self.err) * np.log(max(float(self.err @ self.err) / len(self.err), 1e-300)) + 2 * self.params


def _mean(y: np.ndarray, h: int):
    sd = float(y.std(ddof=1)) if len(y) > 1 else 0.0
    return Fit(np.full(h, y.mean()), sd, y - y.mean(), 1, ("mean",))


def _orders(y: np.ndarray, h: int, orders: list[L.Order], names: list[tuple], rounds: int = L.ROUNDS) -> Fit | None:
    """The forecast of the order with the least criterion; a series without spread goes on as it is."""
    y = np.asarray(y, float)
    fits = L.fit_orders(y, orders, rounds)
    found = [(f["compared"], i) for i, f in enumerate(fits) if f is not None]
    if not found:
        w = orders[0].differenced(y)
        if len(w) < 1 or w.std() > 1e-12 * (1 + abs(y).max()):
            return None
        out, levels = np.full(h, w.mean()), y
        for k in reversed(orders[0].steps()):
            level = list(levels[-k:])
            for v in out:
                level.append(level[-k] + v)
            out = np.array(level[k:])
        return Fit(out, 0.0, np.zeros(len(w)), 1, names[0]) if len(orders[0].steps()) <= 1 else None
    best = min(found)[1]
    out, errors = L.forecast_order(y, fits[best], h)
    if not np.all(np.isfinite(out)):
        return None
    return Fit(out, float(np.sqrt(fits[best]["variance"])), errors, orders[best].free + 1, names[best], fits[best]["loglik"])


def _plain(p: int, d: int, q: int) -> L.Order:
    return L.Order(p, d, q, mean=d == 0)


def fit_arima(y, h, order=(1, 1, 1)):
    return _orders(y, h, [_plain(*order)], [tuple(order)], L.ROUNDS if sum(order) < 10 else 8)


def fit_arima_grid(y, h):
    return _orders(y, h, [_plain(*o) for o in ARIMA_GRID], ARIMA_GRID) or fit_arima(y, h)


def fit_sarima_grid(y, h):
    names = [(P, D, Q, s) for s in (PERIODS_LONG if len(y) > 50 else PERIODS_SHORT) if len(y) > 2 * s for P, D, Q in SEASONAL_GRID]
    if not names:
        return fit_arima(y, h)
    return _orders(y, h, [L.Order(1, 1, 1, *o) for o in names], names) or fit_arima(y, h)


def fit_smoothing(y, h):
    y = np.asarray(y, float)
    best = None
    for config, got in zip(SMOOTHING_CONFIGS, L.fit_smoothing_models(y, list(SMOOTHING_CONFIGS), SMOOTHING_PERIOD)):
        out = L.forecast_smoothing(got, len(y), h, SMOOTHING_PERIOD) if got else None
        if out is None or not np.all(np.isfinite(out)):
            continue
        # the floor of a variance is relative to the series, so the choice does not depend on its unit
        variance = max(got["variance"], 1e-20 * float(y @ y) / len(y), 1e-300)
        made = Fit(out, float(np.sqrt(got["variance"])), got["errors"], got["free"] + 1, config,
                   -0.5 * len(y) * (np.log(2 * np.pi * variance) + 1))
        best = made if best is None or made.aic() < best.aic() - 1e-9 else best
    return best or _mean(y, h)


def fit_trend_season(y, h, days):
    """A trend with bends, ten yearly and three weekly waves; `days` are day numbers of history and future."""
    y = np.asarray(y, float)
    values, weights, sigma = L.fit_trend(y, days)
    return Fit(values[len(y):], sigma, y - values[: len(y)], len(weights), ("trend", "season"))


METHODS = {"arima": fit_arima, "arima_grid": fit_arima_grid, "sarima_grid": fit_sarima_grid,
           "exp_smoothing": fit_smoothing}


def _fit(method: str, y: np.ndarray, h: int, days: np.ndarray, skip_failures: bool, **params):
    try:
        if method == "trend_season":
            return fit_trend_season(y, h, days)
        found = METHODS[method](y, h, **params)
    except (np.linalg.LinAlgError, FloatingPointError, ZeroDivisionError):
        found = None
    return found if found is not None or skip_failures else _mean(y, h)


def _dealt(rows: DataFrame) -> DataFrame:
    """Series dealt to a stated number of tasks: their fits take long though their rows are few, so they are not to be packed."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unique_id")


def forecast_fitted(train: DataFrame, horizon: int, method: str, skip_failures: bool = False, **params) -> DataFrame:
    """Fit each series and forecast the `horizon` days after its end."""
    if method != "trend_season" and method not in METHODS:
        raise ValueError(f"unknown method {method!r}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y = pdf["y"].to_numpy(float)
        days = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]")
        ahead = days[-1] + np.arange(1, horizon + 1)
        with np.errstate(all="ignore"):
            got = _fit(method, y, horizon, np.concatenate([days, ahead]).astype(int), skip_failures, **params)
        if got is None:
            return pd.DataFrame(columns=["unique_id", "ds", "step", "yhat", "sigma", "aic", "train_size"])
        return pd.DataFrame({"unique_id": pdf["unique_id"].iloc[0], "ds": ahead.astype(object),
                             "step": np.arange(1, horizon + 1, dtype="int32"), "yhat": got.out, "sigma": got.sigma,
                             "aic": None if got.order == ("mean",) else got.aic(), "train_size": len(y)})

    rows = train.filter(F.col("y").isNotNull()).select("unique_id", "ds", "y")
    return _dealt(rows).groupBy("unique_id").applyInPandas(one, FORECAST_SCHEMA)


def backtest_attempts(panel: DataFrame, method: str = "arima", min_points: int = 20, fraction: float = 0.8,
                      **params) -> DataFrame:
    """Every series with sales: its test days with yhat, or one row that says why there is no forecast."""
    active = nonzero_filter(panel).select("unique_id", "ds", "y")
    # series that are too short are told by their counts and never reach a Python worker
    sizes = active.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"))
    short = sizes.filter(F.col("n") < min_points).select("unique_id", F.lit(f"fewer than {min_points} days with sales").alias("reason"))
    enough = active.join(sizes.filter(F.col("n") >= min_points), "unique_id", "left_semi")
    split = holdout_fraction(enough, ["unique_id"], ["ds"], F.trunc("ds", "year"), fraction)
    columns = ["unique_id", "ds", "y", "yhat", "aic", "train_size", "reason"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        train, test = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]

        def skipped(why: str) -> pd.DataFrame:
            return pd.DataFrame([[pdf["unique_id"].iloc[0], None, None, None, None, len(train), why]], columns=columns)

        if not len(test) or not len(train):
            return skipped("no days to train on or to test")
        days = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]").astype(int)
        with np.errstate(all="ignore"):
            got = _fit(method, train["y"].to_numpy(float), len(test), days, True, **params)
        if got is None:
            return skipped("the model could not be fitted")
        return pd.DataFrame({"unique_id": pdf["unique_id"].iloc[0], "ds": test["ds"].to_numpy(), "y": test["y"].to_numpy(float),
                             "yhat": got.out, "aic": got.aic(), "train_size": len(train), "reason": None})

    tried = _dealt(split).groupBy("unique_id").applyInPandas(
        one, "unique_id string, ds date, y double, yhat double, aic double, train_size long, reason string")
    return tried.unionByName(short, allowMissingColumns=True)


def backtest_fitted(panel: DataFrame, method: str = "arima", min_points: int = 20, fraction: float = 0.8,
                    **params) -> DataFrame:
    """Q1: days with sales only, first 80 % train, forecasts aligned with the remaining days.

    Output: the test rows with yhat, aic and train_size; `skipped_series` lists the series without a forecast.
    """
    return backtest_attempts(panel, method, min_points, fraction, **params).filter("reason is null").drop("reason")


def skipped_series(panel: DataFrame, method: str = "arima", min_points: int = 20, fraction: float = 0.8, **params) -> DataFrame:
    """Q1: (unique_id, reason) of the series without a forecast."""
    return backtest_attempts(panel, method, min_points, fraction, **params).filter("reason is not null").select("unique_id", "reason")
