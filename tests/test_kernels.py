"""Kernel machine and neural regressor."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors

from tabloom.operators import kernels as K
from tabloom.operators import models as M


def frame(spark, X, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(X, y)], ["features", "label"]).repartition(3)


def test_ring_is_parted_from_its_centre(spark, tmp_path):
    rng = np.random.default_rng(1)
    angle, radius = rng.uniform(0, 7, 400), np.where(np.arange(400) % 2, 1.0, 3.0) + rng.normal(size=400) * 0.1
    X, y = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1), (np.arange(400) % 2).astype(float)
    df = frame(spark, X, y)
    fit = M.classifier("SVC", 2).fit(df)
    out = fit.transform(df)
    assert out.filter("prediction = label").count() >= 392
    assert {tuple(r.features) for r in out.collect()} == {tuple(x) for x in X}
    assert abs(fit.gamma - 1 / (2 * X.var())) < 1e-9 and len(fit.landmarks) == K.LANDMARKS
    fit.save_rows(str(tmp_path / "svc"))
    again = K.KernelMachineModel.load_rows(spark, str(tmp_path / "svc"))
    assert sorted(r[0] for r in again.transform(df).select("prediction").collect()) == sorted(r[0] for r in out.select("prediction").collect())


def test_products_of_coordinates_are_the_kernel():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 2))
    exact = K.rbf(X, X, 0.5)
    errors = []
    for m in (10, 50, 300):
        Z = K.rbf(X, X[:m], 0.5) @ K.nystrom(X[:m], 0.5)
        errors.append(np.abs(Z @ Z.T - exact).mean())
    assert errors[0] > errors[1] > errors[2] and errors[1] < 0.02 and errors[2] < 1e-5


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(3)
    layers = [3, 5, 4, 1]
    X, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    w = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    _, grad = K.squared_loss(w, layers, X, y)
    for i in range(0, len(w), 3):
        h = 1e-6 * (np.arange(len(w)) == i)
        slope = (K.squared_loss(w + h, layers, X, y)[0] - K.squared_loss(w - h, layers, X, y)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-4 * (1 + abs(slope))


def test_network_fits_a_plane(spark, tmp_path):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(500, 3)) * [1, 10, 100] + 5
    y = 3 * X[:, 0] - 0.5 * X[:, 1] + 0.02 * X[:, 2] + 7
    df = frame(spark, X, y)
    est = K.NeuralRegressor((10, 5), maxIter=40)
    fit = est.fit(df)
    assert ((fit.values(X) - y) ** 2).mean() < 0.02 * y.var()
    fit.save_rows(str(tmp_path / "net"))
    again = K.NeuralRegressorModel.load_rows(spark, str(tmp_path / "net"))
    assert np.array_equal(again.values(X), fit.values(X))
    loss, grad = est._summed(K.durable(K._packed(df.selectExpr("label as y", "features").select(
        K.vector_to_array("features").alias("f"), "y")).repartition(7), "p"), fit.weights, fit.layers, fit.norm)
    centre, scale, mean, sd = fit.norm
    want = K.squared_loss(fit.weights, fit.layers, (X - centre) / scale, (y - mean) / sd)
    assert abs(loss - want[0]) < 1e-9 * (1 + loss) and np.allclose(grad, want[1])


def test_search_finds_the_least_value():
    A = np.diag([1.0, 10.0, 100.0])
    w = K.lbfgs(lambda v: (0.5 * float((v - 1) @ A @ (v - 1)), A @ (v - 1)), np.zeros(3), 60, tolerance=0)
    assert np.allclose(w, 1, atol=1e-4)
