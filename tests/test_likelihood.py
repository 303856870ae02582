"""Series models against dense densities, closed forms and planted changes."""

from __future__ import annotations

import numpy as np
import pytest

from tabloom.operators import fits
from tabloom.operators import likelihood as L


def dense(w, ar, ma, constant, variance, long=700):
    """The multivariate normal log density of a stationary series."""
    psi = np.zeros(long)
    psi[0] = 1
    for t in range(1, long):
        psi[t] = (ma[t - 1] if t <= len(ma) else 0.0) + sum(ar[j] * psi[t - j - 1] for j in range(min(len(ar), t)))
    cov = np.array([psi[: long - k] @ psi[k:] for k in range(len(w))]) * variance
    C, z = cov[np.abs(np.subtract.outer(range(len(w)), range(len(w))))], w - constant
    return -0.5 * (len(w) * np.log(2 * np.pi) + np.linalg.slogdet(C)[1] + z @ np.linalg.solve(C, z))


ORDERS = [L.Order(1), L.Order(0, 0, 1), L.Order(2, 0, 3, mean=True), L.Order(1, 0, 1, 1, 0, 1, 4), L.Order(0, 0, 0, 1, 0, 1, 12), L.Order(0, mean=True)]


@pytest.mark.parametrize("order", ORDERS)
def test_likelihood_is_the_dense_density(order):
    rng = np.random.default_rng(3)
    w = rng.normal(size=30).cumsum() * 0.3
    models = [L.polynomials(order, rng.normal(size=order.free) * 0.6) for _ in range(3)]
    got = L.likelihoods(w, models)
    assert np.allclose(got["loglik"], [dense(w, *m, v) for m, v in zip(models, got["variance"])], atol=1e-6)


def test_first_days_have_their_own_density():
    rng = np.random.default_rng(13)
    w, model = rng.normal(size=40), L.polynomials(L.Order(1, 0, 1), np.array([0.5, -0.3]))
    for k in (1, 2, 7):
        assert abs(L.first_days(w, model, k, 1.7, 1.0) - dense(w[:k], *model, 1.7)) < 1e-8


def test_all_weights_are_stationary_and_invertible():
    rng = np.random.default_rng(4)
    for _ in range(50):
        c = L.stationary(rng.normal(size=4) * 2)
        roots = np.roots(np.append(-c[::-1], 1.0))
        assert np.abs(roots).min() > 1


def test_autoregression_has_its_closed_form():
    """The exact likelihood of a centred AR(1) is cubic in its weight."""
    rng = np.random.default_rng(5)
    w = np.zeros(60)
    for t in range(1, 60):
        w[t] = 0.6 * w[t - 1] + rng.normal()
    fit = L.fit_orders(w, [L.Order(1)], 60)[0]
    got = L.polynomials(fit["order"], fit["x"])[0][0]
    grid = np.linspace(-0.999, 0.999, 20001)
    ends, inner, cross = w @ w, w[1:-1] @ w[1:-1], w[1:] @ w[:-1]
    value = -0.5 * len(w) * np.log((ends - 2 * grid * cross + grid**2 * inner) / len(w)) + 0.5 * np.log(1 - grid**2)
    assert abs(got - grid[value.argmax()]) < 2e-3
    assert abs(fit["aic"] - (2 * 2 - 2 * fit["loglik"])) < 1e-9


def test_grid_finds_the_order_and_forecasts_are_expectations():
    rng = np.random.default_rng(6)
    y, e = np.zeros(400), rng.normal(size=400)
    for t in range(1, 400):
        y[t] = 0.7 * y[t - 1] + e[t]
    got = fits.fit_arima_grid(y + 20, 5)
    assert got.order[1] == 0
    one = fits.fit_arima(y + 20, 3, (1, 0, 0))
    step = (one.out[1] - 20) / (one.out[0] - 20)
    assert 0.5 < step < 0.9 and abs(one.sigma - 1) < 0.15
    # the last conditional expectation given all days, by the dense law
    w = y[:40]
    f = L.fit_orders(w, [L.Order(1, 0, 1)])[0]
    ar, ma, _ = L.polynomials(f["order"], f["x"])
    psi = np.zeros(700)
    psi[0] = 1
    psi[1] = ar[0] + ma[0]
    for t in range(2, 700):
        psi[t] = ar[0] * psi[t - 1]
    cov = np.array([psi[: 700 - k] @ psi[k:] for k in range(43)])
    C = cov[np.abs(np.subtract.outer(range(43), range(43)))]
    want = C[40:, :40] @ np.linalg.solve(C[:40, :40], w)
    assert np.allclose(L.forecast_order(w, f, 3)[0], want, atol=1e-6)


def test_seasonal_grid_follows_a_season():
    rng = np.random.default_rng(7)
    y = np.tile([10.0, 12, 15, 11, 9, 20, 22], 30) + rng.normal(size=210) * 0.3
    got = fits.fit_sarima_grid(y[:196], 14)
    assert got.order[3] == 7 and np.abs(got.out - y[196:]).max() < 2


@pytest.mark.parametrize("fit", [lambda y: fits.fit_arima(y, 4), lambda y: fits.fit_smoothing(y, 4), lambda y: fits.fit_sarima_grid(y, 4)])
def test_constant_and_linear_series_go_on(fit):
    assert np.allclose(fit(np.full(60, 7.0)).out, 7)
    assert np.allclose(fit(3 + 2.0 * np.arange(60)).out, 3 + 2.0 * np.arange(60, 64), rtol=1e-4)


def grid_error(y, trend, season, m):
    """The least squared error of usual first states and a grid of weights."""
    import itertools

    x = L.smoothing_start(y, trend, season, m)
    k = 1 + bool(trend) + bool(season)
    tried = np.array([[*np.log(np.array(w) / (1 - np.array(w))), *x[k:]] for w in itertools.product((0.05, 0.2, 0.5, 0.8), repeat=k)])
    with np.errstate(all="ignore"):
        return np.nanmin((L.smoothing_lanes(y, [(trend, season)] * len(tried), m, tried)[0] ** 2).mean(axis=0))


def test_smoothing_is_never_worse_than_a_grid():
    rng = np.random.default_rng(8)
    t = np.arange(150)
    for y in (50 + rng.normal(size=150).cumsum(), 20 + 0.3 * t + 5 * np.sin(t * np.pi / 6) + rng.normal(size=150),
              (10 + 0.1 * t) * (1 + 0.3 * np.cos(t * np.pi / 6)) + 0.1 * rng.normal(size=150)):
        y = np.maximum(y, 1.0)
        got = L.fit_smoothing_models(y, list(fits.SMOOTHING_CONFIGS), 12)
        for (trend, season), f in zip(fits.SMOOTHING_CONFIGS, got):
            assert f["variance"] <= grid_error(y, trend, season, 12) * 1.02, (trend, season)


def test_planted_bend_is_found_and_zero_weight_is_least_squares():
    rng = np.random.default_rng(9)
    days, ahead = np.arange(1500), np.arange(1500, 1520)
    y = 10 + 0.1 * days + 0.5 * np.maximum(0, days - 600) + rng.normal(size=1500) * 0.5
    values, weights, _ = L.fit_trend(y, np.arange(1520))
    places = np.linspace(0, 1199, L.BENDS + 1).round()[1:]
    assert abs(places[np.abs(weights[2: 2 + L.BENDS]).argmax()] - 600) <= 1200 / L.BENDS
    assert np.abs(values[1500:] - (10 + 0.1 * ahead + 0.5 * (ahead - 600))).max() < 5
    X = rng.normal(size=(50, 4))
    z = rng.normal(size=50)
    none = np.zeros(4)
    assert np.allclose(L.descend(X, z, none, none), np.linalg.lstsq(X, z, rcond=None)[0])
    # one column alone is cut by the weight
    b = L.descend(X[:, :1], z, np.array([1.5]), np.zeros(1))[0]
    c = X[:, 0] @ z
    assert abs(b - np.sign(c) * max(abs(c) - 1.5, 0) / (X[:, 0] @ X[:, 0])) < 1e-9


def test_short_series_have_a_forecast_or_none():
    for y in ([5.0], [1.0, 2.0], [3.0, 1.0, 4.0, 1.0, 5.0]):
        y = np.array(y)
        assert fits.fit_arima(y, 2) is None or np.isfinite(fits.fit_arima(y, 2).out).all()
        assert np.isfinite(fits.fit_smoothing(y, 2).out).all()
        assert np.isfinite(fits.fit_trend_season(y, 2, np.arange(len(y) + 2)).out).all()
