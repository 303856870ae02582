"""Likelihoods of one series under many candidate models at once, and their search (Q1–Q5).

Candidates and the steps of their numeric gradients are lanes of one numpy recursion over the days, so a grid of orders
costs little more than one order.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Rounds of the quasi-Newton search, and its bound on the free parameters.
ROUNDS, BOUND = 30, 4.0
STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.03, 0.01])


# ---------------------------------------------------------------- search

def minimise(value: Callable[[list[int], np.ndarray], np.ndarray], starts: list[np.ndarray], rounds: int = ROUNDS,
             bound: float = BOUND) -> list[tuple[np.ndarray, float]]:
    """Bounded BFGS for several functions side by side: (place of the least value, the value) of each.

    `value(which, X)` gives the values of the functions `which` at the rows of X, padded to the longest parameter list.
    """
    size = [len(s) for s in starts]
    width = max([1, *size])
    x = np.array([np.pad(s, (0, width - len(s))) for s in starts], float).reshape(len(starts), width)
    f = value(list(range(len(starts))), x)
    H = np.tile(np.eye(width), (len(starts), 1, 1))
    g = None
    live = [i for i in range(len(starts)) if size[i] and np.isfinite(f[i])]
    for _ in range(rounds):
        if not live:
            break
        new_g = _slopes(value, live, x, f, size)
        if g is not None:
            for i in live:
                s, d = moved[i], new_g[i] - g[i]
                if s @ d > 1e-12:
                    rho = 1 / (s @ d)
                    left = np.eye(width) - rho * np.outer(s, d)
                    H[i] = left @ H[i] @ left.T + rho * np.outer(s, s)
        g, moved, still = new_g, np.zeros_like(x), []
        way = {}
        for i in live:
            d = -H[i] @ g[i]
            if g[i] @ d >= 0:
                H[i] = np.eye(width)
                d = -g[i]
            way[i] = d / max(1.0, np.abs(d).max() / 1.5)
        tried = np.array([np.clip(x[i] + a * way[i], -bound, bound) for i in live for a in STEPS])
        got = value([i for i in live for _ in STEPS], tried).reshape(len(live), len(STEPS))
        got = np.where(np.isfinite(got), got, np.inf)
        for j, i in enumerate(live):
            k = int(got[j].argmin())
            if got[j, k] < f[i] - 1e-7 * (1 + abs(f[i])):
                new = tried[j * len(STEPS) + k]
                moved[i], x[i], f[i] = new - x[i], new, got[j, k]
                still.append(i)
        live = still
    return [(x[i, : size[i]], float(f[i])) for i in range(len(starts))]


def _slopes(value, live, x, f, size, h=1e-5):
    which = [i for i in live for _ in range(size[i])]
    ahead = np.array([x[i] + h * (np.arange(x.shape[1]) == j) for i in live for j in range(size[i])])
    back = np.array([x[i] - h * (np.arange(x.shape[1]) == j) for i in live for j in range(size[i])])
    both = value(which + which, np.vstack([ahead, back]))
    slope = (both[: len(which)] - both[len(which):]) / (2 * h)
    out, at = np.zeros_like(x), 0
    for i in live:
        out[i, : size[i]] = np.where(np.isfinite(slope[at: at + size[i]]), slope[at: at + size[i]], 0.0)
        at += size[i]
    return out


# ---------------------------------------------------------------- seasonal ARIMA

@dataclass(frozen=True)
class Order:
    """Orders of a multiplied model; `mean` adds a constant to the differenced series."""

    p: int = 0
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0
    mean: bool = False

    @property
    def free(self) -> int:
        return self.p + self.q + self.P + self.Q + self.mean

    def differenced(self, y: np.ndarray) -> np.ndarray:
        w = np.asarray(y, float)
        for k in self.steps():
            w = w[k:] - w[:-k]
        return w

    def steps(self) -> list[int]:
        return [1] * self.d + [self.s] * self.D


def stationary(x: np.ndarray) -> np.ndarray:
    """Free numbers to the weights of a stationary recursion, by partial autocorrelations (Durbin-Levinson)."""
    out = np.zeros(0)
    for r in np.tanh(x):
        out = np.append(out - r * out[::-1], r)
    return out


def polynomials(order: Order, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights of earlier values, weights of earlier errors, constant) by lag, the seasonal factors multiplied in."""
    p, q, P, Q = order.p, order.q, order.P, order.Q
    at = np.cumsum([0, p, q, P, Q])
    parts = [x[a:b] for a, b in zip(at, at[1:])]
    spread = lambda c: np.concatenate([[1.0], np.array([np.eye(order.s)[-1] * v for v in c]).ravel()]) if len(c) else np.ones(1)
    ar = np.convolve(np.append(1.0, -stationary(parts[0])), spread(-stationary(parts[2])))
    ma = np.convolve(np.append(1.0, -stationary(parts[1])), spread(-stationary(parts[3])))
    return -ar[1:], ma[1:], float(x[at[4]]) if order.mean else 0.0


def _recursion(U: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """E[t] = U[t] - sum of ma[j] E[t - j - 1], for all lanes: U is (days, lanes), ma (lags, lanes)."""
    used = np.flatnonzero(ma.any(axis=1))
    if not len(used):
        return U.copy()
    reach = used[-1] + 1
    E = np.zeros((len(U) + reach, U.shape[1]))
    weights, back = ma[used], reach - 1 - used
    for t in range(len(U)):
        E[t + reach] = U[t] - np.einsum("jl,jl->l", weights, E[t + back])
    return E[reach:]


def likelihoods(w: np.ndarray, models: list[tuple[np.ndarray, np.ndarray, float]], scale: float = 1.0) -> dict:
    """The exact Gaussian likelihood of a series under each model (weights of values, weights of errors, constant).

    Given what the days before the first one still add to the first days, a vector a with a normal law that follows from
    the weights, the errors are a linear filter of the series: e = e0 - G a.  Integrating a out leaves a quadratic form
    and a determinant no larger than the longest lag.  The error variance is at its best value.
    """
    n, lanes = len(w), len(models)
    la = max([1, *(len(a) for a, _, _ in models)])
    lm = max([1, *(len(m) for _, m, _ in models)])
    r = max(la, lm)
    ar, ma = np.zeros((la, lanes)), np.zeros((lm, lanes))
    for i, (a, m, _) in enumerate(models):
        ar[: len(a), i], ma[: len(m), i] = a, m
    W = w[:, None] - scale * np.array([c for *_, c in models])
    U = W.copy()
    for j in np.flatnonzero(ar[: n - 1].any(axis=1)):
        U[j + 1:] -= ar[j] * W[: n - j - 1]
    lags = min(r, n)
    impulse = np.zeros((n, lanes))
    impulse[0] = 1
    with np.errstate(all="ignore"):
        both = _recursion(np.hstack([U, impulse]), np.hstack([ma, ma]))
    E0, psi = both[:, :lanes], both[:, lanes:]
    K = np.zeros((lanes, r, r))
    b = np.zeros((lanes, r))
    for j in range(lags):
        K[:, 0, j] = K[:, j, 0] = np.einsum("tl,tl->l", psi[j:], psi[: n - j])
        b[:, j] = np.einsum("tl,tl->l", psi[: n - j], E0[j:])
    for i in range(1, lags):
        for j in range(i, lags):
            K[:, i, j] = K[:, j, i] = K[:, i - 1, j - 1] - psi[n - i] * psi[n - j]
    P = _before(ar, ma, r)
    M = np.eye(r) + K @ P
    fine = np.isfinite(M).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    M[~fine], b[~fine] = np.eye(r), 0.0
    sign, logdet = np.linalg.slogdet(M)
    fine &= (sign > 0) & np.isfinite(logdet)
    M[~fine] = np.eye(r)
    solved = np.linalg.solve(M, b[:, :, None])[:, :, 0]
    start = np.einsum("lij,lj->li", P, solved)
    S = np.einsum("tl,tl->l", E0, E0) - np.einsum("li,li->l", b, start)
    with np.errstate(all="ignore"):
        variance = S / n
        loglik = np.where((S > 0) & fine, -0.5 * (n * np.log(2 * np.pi * variance) + n + logdet), -np.inf)
    return {"loglik": loglik, "variance": variance, "errors": E0, "psi": psi, "start": start, "ar": ar, "ma": ma, "W": W}


def first_days(w: np.ndarray, model: tuple, days: int, variance: float, scale: float) -> float:
    """The log density of the first days alone, with the given error variance."""
    if days < 1:
        return 0.0
    got = likelihoods(w[:days], [model], scale)
    # the density at the best variance of these days, moved to the given one
    logdet = -2 * got["loglik"][0] - days * (np.log(2 * np.pi * got["variance"][0]) + 1)
    return float(-0.5 * (days * np.log(2 * np.pi * variance) + logdet + days * got["variance"][0] / variance))


def _before(ar: np.ndarray, ma: np.ndarray, r: int) -> np.ndarray:
    """The covariance of what earlier days add to the first r days, for unit errors, by doubling."""
    lanes = ar.shape[1]
    T = np.zeros((lanes, r, r))
    T[:, : len(ar), 0] = ar.T
    T[:, np.arange(r - 1), np.arange(1, r)] = 1
    # what one error adds to the days after it: the first column moves by T, and the error's own weights
    R = np.zeros((lanes, r))
    R[:, : len(ar)] += ar.T
    R[:, : len(ma)] += ma.T
    total, A = R[:, :, None] * R[:, None, :], T
    for _ in range(40):
        with np.errstate(all="ignore"):
            total = total + A @ total @ A.transpose(0, 2, 1)
            A = A @ A
        if not np.abs(A).max() > 1e-12:
            break
    return total


def fit_orders(y: np.ndarray, orders: list[Order], rounds: int = ROUNDS) -> list[dict | None]:
    """The most likely model of each order; None where a series is too short for it or has no spread.

    Differencing takes days away, and a density changes with the unit of the series.  `compared` is therefore the
    criterion of the days that all orders have, given the days before them; `aic` is that of all days of the order.
    """
    out: list[dict | None] = [None] * len(orders)
    most = max((sum(o.steps()) for o in orders), default=0)
    groups: dict[tuple, list[int]] = {}
    for i, o in enumerate(orders):
        groups.setdefault((o.d, o.D, o.s if o.D or o.P or o.Q else 0, o.mean), []).append(i)
    for group in groups.values():
        w = orders[group[0]].differenced(y)
        group = [i for i in group if len(w) >= max(10, orders[i].free + 3)]
        scale = float(w.std()) if len(w) else 0.0
        if not group or not scale > 1e-12 * (1 + abs(float(np.mean(y)))):
            continue
        # the constant is what is added to the mean of the days, in units of their spread
        centre = float(w.mean()) if orders[group[0]].mean else 0.0
        w = w - centre
        starts = [np.concatenate([np.full(orders[i].p, 0.2), np.full(orders[i].q, 0.1), np.full(orders[i].P, 0.2),
                                  np.full(orders[i].Q, 0.1), [0.0] * orders[i].mean]) for i in group]

        def value(which, X):
            got = likelihoods(w, [polynomials(orders[group[k]], x) for k, x in zip(which, X)], scale)["loglik"]
            return np.where(np.isfinite(got), -got / len(w), np.inf)

        best = minimise(value, starts, rounds)
        final = likelihoods(w, [polynomials(orders[i], x) for i, (x, _) in zip(group, best)], scale)
        for lane, (i, (x, _)) in enumerate(zip(group, best)):
            if np.isfinite(final["loglik"][lane]):
                o, variance = orders[i], float(final["variance"][lane])
                early = first_days(w, polynomials(o, x), most - sum(o.steps()), variance, scale)
                out[i] = {"order": orders[i], "x": x, "loglik": float(final["loglik"][lane]), "variance": variance,
                          "compared": 2 * (o.free + 1) - 2 * (float(final["loglik"][lane]) - early) if np.isfinite(early) else np.inf,
                          "aic": 2 * (orders[i].free + 1) - 2 * float(final["loglik"][lane]), "w": w, "lane": lane, "all": final,
                          "constant": centre + polynomials(orders[i], x)[2] * scale}
    return out


def forecast_order(y: np.ndarray, fit: dict, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(the next h values, the errors of the known days): expectations given all known days."""
    got, lane, order = fit["all"], fit["lane"], fit["order"]
    ar, ma = got["ar"][:, lane], got["ma"][:, lane]
    start, psi, n = got["start"][lane], got["psi"][:, lane], len(fit["w"])
    errors = got["errors"][:, lane].copy()
    for j in range(min(len(start), n)):
        errors[j:] -= start[j] * psi[: n - j]
    past, noise = list(got["W"][:, lane]), list(errors)
    for k in range(h):
        t = n + k
        v = start[t] if t < len(start) else 0.0
        v += sum(ar[j] * past[t - j - 1] for j in np.flatnonzero(ar) if t - j - 1 >= 0)
        v += sum(ma[j] * noise[t - j - 1] for j in np.flatnonzero(ma) if t - j - 1 >= 0)
        past.append(v)
        noise.append(0.0)
    out, levels, w = np.array(past[n:]) + fit["constant"], [], np.asarray(y, float)
    for k in order.steps():
        levels.append((k, w))
        w = w[k:] - w[:-k]
    for k, base in reversed(levels):
        level = list(base[-k:])
        for v in out:
            level.append(level[-k] + v)
        out = np.array(level[k:])
    return out, errors


# ---------------------------------------------------------------- exponential smoothing

#: Weights of 0.05, 0.2, 0.5 and 0.8 as free numbers.
GRID = tuple(float(np.log(w / (1 - w))) for w in (0.05, 0.2, 0.5, 0.8))


def smoothing_lanes(y: np.ndarray, configs: list[tuple], m: int, X: np.ndarray) -> tuple:
    """(errors, level, slope, season) of lanes, each with its (trend, season) and its row of parameters.

    Parameters are the weights as free numbers, then the states before the first day.  A lane without trend or season
    carries one that adds nothing.
    """
    lanes = len(configs)
    weight = lambda x: 1 / (1 + np.exp(-x))
    a, b, g, slope = np.zeros(lanes), np.zeros(lanes), np.zeros(lanes), np.zeros(lanes)
    level, around = np.zeros(lanes), np.zeros((m, lanes))
    for i, (trend, season) in enumerate(configs):
        x = list(X[i])
        a[i] = weight(x.pop(0))
        b[i] = weight(x.pop(0)) if trend else 0.0
        g[i] = weight(x.pop(0)) if season else 0.0
        level[i] = x.pop(0)
        slope[i] = x.pop(0) if trend else 0.0
        if season:
            around[:, i] = x[:m]
    grows = np.array([t == "mul" for t, _ in configs])
    scales = np.array([s == "mul" for _, s in configs])
    errors = np.empty((len(y), lanes))
    for t, v in enumerate(y):
        base = np.where(grows, level * slope, level + slope)
        s = around[t % m]
        errors[t] = v - np.where(scales, base * s, base + s)
        new = base + a * (np.where(scales, v / s, v - s) - base)
        slope = slope + b * (np.where(grows, new / level, new - level) - slope)
        around[t % m] = s + g * (np.where(scales, v / new, v - new) - s)
        level = new
    return errors, level, slope, around


def smoothing_start(y: np.ndarray, trend: str | None, season: str | None, m: int) -> np.ndarray:
    """Usual first states: means of the first seasons, or the first values."""
    weights = [0.0] + ([-2.0] if trend else []) + ([-2.0] if season else [])
    if season:
        level, later = y[:m].mean(), y[m: 2 * m].mean()
        slope = (later - level) / m
        around = list(y[:m] - level if season == "add" else y[:m] / level)
    else:
        level, around = y[0], []
        slope = y[1] / y[0] if trend == "mul" else y[1] - y[0]
        level = level / slope if trend == "mul" and slope else level - slope if trend == "add" else level
    return np.array([*weights, level, *([slope] if trend else []), *around])


def fit_smoothing_models(y: np.ndarray, configs: list[tuple], m: int, rounds: int = 12) -> list[dict | None]:
    """The least squared one-step errors of each (trend, season), over weights and first states; the likelihood is Gaussian."""
    y = np.asarray(y, float)
    unit = float(np.abs(y).mean()) or 1.0
    z, n = y / unit, len(y)
    out: list[dict | None] = [None] * len(configs)
    some = [i for i, (trend, season) in enumerate(configs)
            if n >= 3 and not (season and n <= 2 * m) and not ("mul" in (trend, season) and z.min() <= 0)]
    if not some:
        return out

    def value(which, X):
        with np.errstate(all="ignore"):
            err = smoothing_lanes(z, [configs[some[k]] for k in which], m, X)[0]
            sse = (err * err).sum(axis=0)
            return np.where(np.isfinite(sse), 0.5 * np.log(sse / n + 1e-24), np.inf)

    # the search starts at the best of a grid of weights with the usual first states
    starts = []
    for k, i in enumerate(some):
        first = smoothing_start(z, *configs[i], m)
        free = 1 + sum(c is not None for c in configs[i])
        tried = np.array([[*w, *first[free:]] for w in itertools.product(GRID, repeat=free)])
        starts.append(tried[int(value([k] * len(tried), tried).argmin())])
    best = minimise(value, starts, rounds, 1e6)
    width = max(len(x) for x, _ in best)
    with np.errstate(all="ignore"):
        err, level, slope, around = smoothing_lanes(z, [configs[i] for i in some], m, np.array([np.pad(x, (0, width - len(x))) for x, _ in best]))
    for lane, (i, (x, _)) in enumerate(zip(some, best)):
        trend, season = configs[i]
        variance = float((err[:, lane] ** 2).sum() / n) * unit * unit
        if np.isfinite(variance):
            out[i] = {"trend": trend, "season": season, "x": x, "level": level[lane] * unit, "errors": err[:, lane] * unit, "free": len(x),
                      "slope": slope[lane] * (1 if trend == "mul" else unit), "variance": variance,
                      "around": around[:, lane] * (1 if season == "mul" else unit)}
    return out


def forecast_smoothing(fit: dict, n: int, h: int, m: int) -> np.ndarray:
    steps = np.arange(1, h + 1)
    out = np.full(h, fit["level"])
    if fit["trend"]:
        out = fit["level"] * fit["slope"] ** steps if fit["trend"] == "mul" else fit["level"] + fit["slope"] * steps
    if fit["season"]:
        tail = fit["around"][(n + steps - 1) % m]
        out = out * tail if fit["season"] == "mul" else out + tail
    return out


# ---------------------------------------------------------------- trend with changes and waves

#: Places where the trend may bend, over the first part of the days; the scale of bends and waves, of the series' largest value.
BENDS, BENT_PART, BEND_SCALE, WAVE_SCALE = 25, 0.8, 0.05, 10.0
#: (days of a period, waves).
WAVES = ((365.25, 10), (7.0, 3))


def trend_columns(days: np.ndarray, known: int, bends: int = BENDS) -> tuple[np.ndarray, int]:
    """(columns, number of bend columns): one, time, bends, waves; time is 0 to 1 over the known days."""
    t = np.asarray(days, float)
    span = max(t[known - 1] - t[0], 1.0)
    at = (t - t[0]) / span
    bends = min(bends, max(0, int(known * BENT_PART) - 1))
    places = at[np.linspace(0, int(known * BENT_PART) - 1, bends + 1).round().astype(int)[1:]] if bends else np.zeros(0)
    columns = [np.ones_like(at), at, *(np.maximum(0, at - p) for p in places)]
    for period, waves in WAVES:
        for k in range(1, waves + 1):
            columns += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    return np.column_stack(columns), len(places)


def descend(X: np.ndarray, y: np.ndarray, absolute: np.ndarray, square: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """Least ½|y - Xb|² + absolute·|b| + ½ square·b² by coordinate descent; starts at the solution without absolute weights."""
    G, c = X.T @ X, X.T @ y
    b = np.linalg.lstsq(G + np.diag(square), c, rcond=None)[0]
    if not absolute.any():
        return b
    free = np.flatnonzero(absolute == 0)
    bent = np.flatnonzero(absolute > 0)
    block = np.linalg.pinv(G[np.ix_(free, free)] + np.diag(square[free]))
    for _ in range(sweeps):
        before = b.copy()
        b[free] = block @ (c[free] - G[np.ix_(free, bent)] @ b[bent])
        for j in bent:
            rest = c[j] - G[j] @ b + G[j, j] * b[j]
            b[j] = np.sign(rest) * max(abs(rest) - absolute[j], 0.0) / (G[j, j] + square[j]) if G[j, j] + square[j] > 0 else 0.0
        if np.abs(b - before).max() <= 1e-9 * (1 + np.abs(b).max()):
            break
    return b


def fit_trend(y: np.ndarray, days: np.ndarray, scale: float = BEND_SCALE, bends: int = BENDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(values on all days, weights, error spread): bends have a Laplace, waves a normal law; the error spread is found with them."""
    n = len(y)
    X, bent = trend_columns(days, n, bends)
    unit = float(np.abs(y).max()) or 1.0
    z, past = np.asarray(y, float) / unit, X[:n]
    absolute, square = np.zeros(X.shape[1]), np.zeros(X.shape[1])
    variance = float(np.mean((z - past @ np.linalg.lstsq(past, z, rcond=None)[0]) ** 2))
    for _ in range(3):
        if scale:
            absolute[2: 2 + bent] = variance / scale
        square[2 + bent:] = max(variance, 1e-12) / WAVE_SCALE**2
        b = descend(past, z, absolute, square)
        variance = float(np.mean((z - past @ b) ** 2))
    return X @ b * unit, b * unit, float(np.sqrt(variance)) * unit
