"""Names found by matching blocks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tabloom.functions import text as X


def blocks(a: str, b: str) -> int:
    """Letters in matching blocks: the longest common one, the earliest of equal ones, then both sides."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return 0 if not k else k + blocks(a[:i], b[:j]) + blocks(a[i + k:], b[j + k:])


def test_closest_names_have_the_greatest_share_of_blocks(spark):
    rng = random.Random(4)
    names = X.REGRESSION_NAMES
    lines = []
    for _ in range(400):
        name = list(rng.choice(names) if rng.random() < 0.5 else rng.choice(names).lower())
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(name) + 1)
            name[at: at + rng.randint(0, 2)] = rng.choice("aertgoRF ")
        lines.append("".join(name))
    got = spark.createDataFrame([(lines,), (None,), ([],)], "l array<string>").select(X.closest_names(names)(F.col("l"))).collect()
    assert got[1][0] is None and got[2][0] == []
    found = 0
    for line, name in zip(lines, got[0][0]):
        share = {n: 2 * blocks(n, line) / (len(n) + len(line)) for n in names}
        if name is None:
            assert max(share.values()) < 0.6
        else:
            found += 1
            assert share[name] == max(share.values()) >= 0.6
    assert 50 < found < 400


def test_misspelt_line(spark):
    out = spark.createDataFrame([("3) LinearRegresion\n- Random Forest",)], "t string").select(X.resolve_algorithms("t")).first()[0]
    assert out == ["LinearRegression", "RandomForestRegressor"]
