"""Kernel support vectors and a neural regressor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.trees import _dealt, _matrix, _packed, _tasks
from tabloom.session import durable

#: Landmarks of a kernel map; rows are chosen by a hash of their features.
LANDMARKS = 200


# ---------------------------------------------------------------- kernel map

def rbf(X: np.ndarray, L: np.ndarray, gamma: float) -> np.ndarray:
    squares = (X * X).sum(axis=1)[:, None] + (L * L).sum(axis=1)[None] - 2 * X @ L.T
    return np.exp(-gamma * np.maximum(squares, 0))


def nystrom(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """The matrix that turns kernel values against the landmarks into coordinates; their products approximate the kernel."""
    values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
    keep = values > 1e-10 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


class KernelMachine(Estimator):
    """M7: a linear machine on the coordinates of an RBF kernel by Nyström's method.

    gamma is one over the number of features times the variance of all their values.  The landmarks are a bounded choice
    of distinct rows, the smallest by a hash; every row is mapped and enters the linear fit.
    """

    def __init__(self, inner: Estimator, landmarks: int = LANDMARKS, gamma: float | None = None) -> None:
        super().__init__()
        self.inner, self.landmarks, self.gamma = inner, landmarks, gamma

    def _fit(self, rows: DataFrame) -> KernelMachineModel:
        plain = rows.select(vector_to_array("features").alias("f"))
        sums = plain.select(F.size("f").alias("d"), F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("s"),
                            F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x).alias("q"))
        n, d, s, q = sums.agg(F.count(F.lit(1)), F.max("d"), F.sum("s"), F.sum("q")).first()
        if not n:
            raise ValueError("no rows to fit")
        spread = q / (n * d) - (s / (n * d)) ** 2
        gamma = self.gamma or (1 / (d * spread) if spread > 0 else 1.0)
        chosen = plain.distinct().orderBy(F.xxhash64("f"), "f").limit(self.landmarks).collect()
        L = np.array([r["f"] for r in chosen], float)
        mapped = KernelMachineModel(L, gamma, None)
        return KernelMachineModel(L, gamma, self.inner.fit(durable(mapped.mapped(rows), "mapped")))


class KernelMachineModel(Model):
    """Maps `features` and applies the linear model."""

    def __init__(self, landmarks: np.ndarray, gamma: float, inner: Model | None) -> None:
        super().__init__()
        self.landmarks, self.gamma, self.inner = landmarks, gamma, inner

    def coordinates(self, X: np.ndarray) -> np.ndarray:
        return rbf(X, self.landmarks, self.gamma) @ nystrom(self.landmarks, self.gamma)

    def mapped(self, rows: DataFrame) -> DataFrame:
        L, gamma, turn = self.landmarks, self.gamma, nystrom(self.landmarks, self.gamma)

        @F.pandas_udf("array<double>")
        def turned(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            return pd.Series(list(rbf(np.stack(features.to_numpy()).astype(float), L, gamma) @ turn))

        return rows.withColumn("_plain", F.col("features")).withColumn("features", array_to_vector(turned(vector_to_array("features"))))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.inner.transform(self.mapped(dataset)).drop("features").withColumnRenamed("_plain", "features")

    def save_rows(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.landmarks.tolist(), float(self.gamma), f"{type(self.inner).__module__}.{type(self.inner).__name__}")],
                              "landmarks array<array<double>>, gamma double, inner string").write.mode("overwrite").parquet(f"{path}/map")
        self.inner.write().overwrite().save(f"{path}/inner")

    @classmethod
    def load_rows(cls, spark: SparkSession, path: str) -> KernelMachineModel:
        import importlib

        landmarks, gamma, inner = spark.read.parquet(f"{path}/map").first()
        module, name = inner.rsplit(".", 1)
        if not module.startswith("pyspark.ml."):
            raise ValueError(f"not an MLlib model: {inner}")
        return cls(np.array(landmarks), gamma, getattr(importlib.import_module(module), name).load(f"{path}/inner"))


# ---------------------------------------------------------------- neural regression

def unpack(w: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((w[at: at + a * b].reshape(a, b), w[at + a * b: at + a * b + b]))
        at += a * b + b
    return out


def forward(w: np.ndarray, layers: list[int], X: np.ndarray) -> list[np.ndarray]:
    """The values of every layer: rectified inside, plain at the end."""
    values = [X]
    for i, (W, b) in enumerate(parts := unpack(w, layers)):
        z = values[-1] @ W + b
        values.append(np.maximum(z, 0) if i < len(parts) - 1 else z)
    return values


def squared_loss(w: np.ndarray, layers: list[int], X: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(half the sum of squared errors, its gradient) of some rows."""
    values, parts = forward(w, layers, X), unpack(w, layers)
    back = values[-1] - y[:, None]
    loss, grads = 0.5 * float((back * back).sum()), []
    for i in range(len(parts) - 1, -1, -1):
        grads.append(np.concatenate([(values[i].T @ back).ravel(), back.sum(axis=0)]))
        if i:
            back = (back @ parts[i][0].T) * (values[i] > 0)
    return loss, np.concatenate(grads[::-1])


class NeuralRegressor(Estimator):
    """A rectified network fitted by L-BFGS on the mean squared error with a squared penalty.

    Each task sums the gradient of its rows; the sums meet in a few groups before the driver adds them, so what reaches
    it does not grow with the tasks.  Features and label are standardised with the statistics of all rows.
    """

    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "weight of the squared penalty", TypeConverters.toFloat)

    def __init__(self, hidden: tuple[int, ...] = (100, 50), seed: int = 42, groups: int = 16, maxIter: int = 200, alpha: float = 1e-4) -> None:
        super().__init__()
        self.hidden, self.seed, self.groups = tuple(hidden), seed, groups
        self._setDefault(maxIter=200, alpha=1e-4)
        self._set(maxIter=maxIter, alpha=alpha)

    def _fit(self, rows: DataFrame) -> NeuralRegressorModel:
        plain = rows.select(vector_to_array("features").alias("f"), F.col("label").cast("double").alias("y"))
        n, d, mean, sd = plain.agg(F.count(F.lit(1)), F.max(F.size("f")), F.avg("y"), F.stddev_pop("y")).first()
        if not n:
            raise ValueError("no rows to fit")
        stats = {r["pos"]: (r["m"], r["s"] or 1.0) for r in plain.select(F.posexplode("f")).groupBy("pos").agg(
            F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()}  # one row per feature
        centre, scale = (np.array([stats[i][j] for i in range(d)]) for j in (0, 1))
        layers = [d, *self.hidden, 1]
        rng = np.random.default_rng(self.seed)
        w = np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in zip(layers, layers[1:])])
        packed = durable(_dealt(_packed(plain), _tasks(n, 8 * d)), "packed")
        sd = sd or 1.0
        norm = (centre, scale, mean, sd)
        alpha = self.getOrDefault(self.alpha)

        def value(v: np.ndarray) -> tuple[float, np.ndarray]:
            loss, grad = self._summed(packed, v, layers, norm)
            return loss / n + 0.5 * alpha * float(v @ v) / n, grad / n + alpha * v / n

        return NeuralRegressorModel(lbfgs(value, w, self.getOrDefault(self.maxIter)), layers, norm)

    def _summed(self, packed: DataFrame, w: np.ndarray, layers: list[int], norm: tuple) -> tuple[float, np.ndarray]:
        shared = packed.sparkSession.sparkContext.broadcast((w, norm))
        width = layers[0]

        def grads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, (centre, scale, mean, sd) = shared.value
            loss, total = 0.0, np.zeros(len(v))
            for batch in batches:
                if len(batch):
                    X = (_matrix(batch.column(1), np.float64, width) - centre) / scale
                    part = squared_loss(v, layers, X, (batch.column(0).to_numpy() - mean) / sd)
                    loss, total = loss + part[0], total + part[1]
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=["loss", "grad"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.frombuffer(g) for g in table["grad"].to_pylist()], axis=0)
            return pa.table({"loss": [sum(table["loss"].to_pylist())], "grad": pa.array([total.tobytes()], pa.binary())})

        sums = packed.mapInArrow(grads, "loss double, grad binary")
        few = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(self.groups)).alias("g")).applyInArrow(add, "loss double, grad binary")
        got = few.collect()  # one row per group
        return sum(r["loss"] for r in got), np.sum([np.frombuffer(r["grad"]) for r in got], axis=0)


def lbfgs(value, w: np.ndarray, rounds: int, memory: int = 10, tolerance: float = 1e-7) -> np.ndarray:
    """The place of the least value found; steps are halved until the value falls enough."""
    f, g = value(w)
    pairs: list[tuple] = []
    for _ in range(rounds):
        q, used = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        if pairs:
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        else:
            q /= max(1.0, float(np.abs(g).sum()))
        for (s, y), a in zip(pairs, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        step, down = 1.0, float(g @ q)
        if down <= 0:
            break
        for _ in range(12):
            new, slope = value(w - step * q)
            if new <= f - 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = -step * q, slope - g
        if s @ y > 1e-12 * float(y @ y):
            pairs = [*pairs[1 - memory:], (s, y)]
        done = f - new <= tolerance * max(abs(f), abs(new), 1e-12)
        w, f, g = w + s, new, slope
        if done:
            break
    return w


class NeuralRegressorModel(Model):
    """Adds `prediction`."""

    def __init__(self, weights: np.ndarray, layers: list[int], norm: tuple) -> None:
        super().__init__()
        self.weights, self.layers, self.norm = weights, list(layers), norm

    def values(self, X: np.ndarray) -> np.ndarray:
        centre, scale, mean, sd = self.norm
        return forward(self.weights, self.layers, (X - centre) / scale)[-1][:, 0] * sd + mean

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def out(features: pd.Series) -> pd.Series:
            return pd.Series(shared.value.values(np.stack(features.to_numpy()).astype(float)) if len(features) else [], dtype=float)

        return dataset.withColumn("prediction", out(vector_to_array("features")))

    def save_rows(self, path: str) -> None:
        centre, scale, mean, sd = self.norm
        row = (self.weights.tolist(), self.layers, centre.tolist(), scale.tolist(), float(mean), float(sd))
        SparkSession.getActiveSession().createDataFrame(
            [row], "weights array<double>, layers array<int>, centre array<double>, scale array<double>, mean double, sd double").write.mode(
            "overwrite").parquet(path)

    @classmethod
    def load_rows(cls, spark: SparkSession, path: str) -> NeuralRegressorModel:
        r = spark.read.parquet(path).first()
        return cls(np.array(r["weights"]), list(r["layers"]), (np.array(r["centre"]), np.array(r["scale"]), r["mean"], r["sd"]))
