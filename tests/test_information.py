"""The nearest-neighbour estimate of mutual information against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tabloom.operators import rules


def harmonic(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def slow_information(x, y, k=3):
    keep = [i for i in range(len(x)) if x[i] is not None and np.isfinite(x[i]) and y[i] is not None]
    x, y = np.array([x[i] for i in keep], dtype=float), np.array([y[i] for i in keep])
    some = np.isin(y, [c for c in set(y.tolist()) if (y == c).sum() > 1])
    x, y = x[some], y[some]
    total = harmonic(len(x))
    for i in range(len(x)):
        gaps = np.sort(np.abs(x[y == y[i]] - x[i]))[1:]
        near = min(k, len(gaps))
        r = gaps[near - 1]
        m = ((x > x[i] - r) & (x < x[i] + r)).sum() if r > 0 else (x == x[i]).sum()
        total += (harmonic(near) - harmonic(len(gaps) + 1) - harmonic(m)) / len(x)
    return max(total, 0.0)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_nearest_information_by_brute_force(spark, block):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 4, 2000)
    data = {"told": y + rng.normal(0, 0.4, 2000), "noise": rng.normal(0, 1, 2000), "ties": rng.integers(0, 6, 2000).astype(float) + (y == 2)}
    rows = [(f"c{y[i]}", *(float(v[i]) for v in data.values())) for i in range(2000)]
    rows += [("alone", 0.1, 0.2, 0.0), (None, 1.0, 1.0, 1.0), ("c1", None, float("nan"), float("inf")), ("two", 3.0, 3.0, -0.0), ("two", 5.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, "value string, told double, noise double, ties double")
    got = {r["column"]: r["mi"] for r in rules.nearest_information(df, "value", list(data), block=block).collect()}
    for at, name in enumerate(data, 1):
        assert got[name] == pytest.approx(slow_information([r[at] for r in rows], [r[0] for r in rows]), abs=1e-9)
    assert got["told"] > 0.5 > 0.1 > got["noise"]


def test_nearest_information_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (None, 6.0)], "y int, x double")
    assert rules.nearest_information(df, "y", ["x"]).count() == 0
    assert rules.nearest_information(df.limit(0), "y", ["x"]).count() == 0
