"""MLlib models: constructors, training, search, cross-validation, scoring.

Constructors carry the hyper-parameters of the reference behaviour.  Boosting and extra-trees are grown in
`trees`, the kernel machine and the neural regressor are in `kernels`, the others are MLlib's.
"""

from __future__ import annotations

import itertools
import json
import random

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.calendar import add, calendar_columns, period_columns
from tabloom.operators.evaluate import classification_metrics, regression_metrics
from tabloom.operators.kernels import KernelMachine, NeuralRegressor
from tabloom.operators.neighbours import KNeighbors
from tabloom.operators.splits import future_spine
from tabloom.operators.trees import Boosting, ExtraTrees
from tabloom.operators.windows import PANEL

SEED = 42


class Penalised(Estimator):
    """A linear estimator whose penalty is stated against the sum over the rows that are fitted.

    MLlib penalises the mean, and its squared regression runs on a label divided by its standard
    deviation, so the weights depend on the rows at hand; they are set at each fit, also inside a search
    or a fold.  With n rows and a label deviation s: `alpha` of a ridge is alpha * s / n; of an elastic net
    with share l of the absolute penalty, alpha * (l + (1 - l) * s); the inverse weight `C` is 1 / (C * n).
    """

    alpha = Param(Params._dummy(), "alpha", "weight of the penalty", TypeConverters.toFloat)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "share of the absolute penalty", TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "inverse weight of the penalty", TypeConverters.toFloat)

    def __init__(self, inner: Estimator, kind: str, alpha: float = 1.0, l1Ratio: float = 0.0, C: float = 1.0) -> None:
        super().__init__()
        self.inner, self.kind = inner, kind
        self._setDefault(alpha=alpha, l1Ratio=l1Ratio, C=C)

    def _fit(self, rows: DataFrame) -> Model:
        n, sd = rows.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        n, sd = max(n, 1), sd or 1.0
        alpha, l1 = self.getOrDefault(self.alpha), self.getOrDefault(self.l1Ratio)
        fit = self.inner.copy()
        one = fit.getClassifier() if isinstance(fit, OneVsRest) else fit
        if self.kind == "ridge":
            one.setRegParam(alpha * sd / n)
        elif self.kind == "elastic":
            weight = alpha * (l1 + (1 - l1) * sd)
            one.setRegParam(weight).setElasticNetParam(alpha * l1 / weight if weight else 0.0)
        else:
            one.setRegParam(1.0 / (self.getOrDefault(self.C) * n))
            if one.hasParam("elasticNetParam"):
                one.setElasticNetParam(l1)
        return fit.fit(rows)


# The hyper-parameters of the constructors below.
def regressor(name: str, trees: int | None = None) -> Estimator:
    """M1–M5, M8, M10."""
    flat = {"standardization": False}
    made = {
        "LinearRegression": lambda: LinearRegression(**flat),
        "Ridge": lambda: Penalised(LinearRegression(elasticNetParam=0.0, **flat), "ridge", alpha=1.0),
        "Lasso": lambda: Penalised(LinearRegression(maxIter=2000, **flat), "elastic", alpha=1.0, l1Ratio=1.0),
        "ElasticNet": lambda: Penalised(LinearRegression(maxIter=2000, **flat), "elastic", alpha=1.0, l1Ratio=0.5),
        "HuberRegressor": lambda: LinearRegression(loss="huber", epsilon=1.35, maxIter=1000, **flat),
        "DecisionTreeRegressor": lambda: DecisionTreeRegressor(maxDepth=10, minInstancesPerNode=5, seed=SEED),
        "RandomForestRegressor": lambda: RandomForestRegressor(
            numTrees=trees or 200, maxDepth=15, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=SEED),
        "ExtraTreesRegressor": lambda: ExtraTrees(numTrees=trees or 200, maxDepth=15, minSplit=5, minRows=2, seed=SEED),
        "GradientBoostingRegressor": lambda: Boosting(
            first_order=True, l2=0.0, minRows=2, maxIter=trees or 200, stepSize=0.1, maxDepth=6, subsamplingRate=0.8, seed=SEED),
        "XGBRegressor": lambda: Boosting(
            minWeight=1.0, maxIter=trees or 200, stepSize=0.1, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=SEED),
        "CatBoostRegressor": lambda: Boosting(symmetric=True, l2=3.0, maxIter=trees or 300, stepSize=0.1, maxDepth=6, seed=SEED),
        "KNeighborsRegressor": lambda: KNeighbors(5),
        "MLPRegressor": lambda: NeuralRegressor((100, 50), maxIter=1000, seed=SEED),
    }
    return made[name]()


def classifier(name: str, classes: int = 2, features: int = 1, trees: int | None = None) -> Estimator:
    """M2–M7, M9, M10."""
    def vector():
        one = LinearSVC(maxIter=100, standardization=False)
        return KernelMachine(Penalised(one if classes == 2 else OneVsRest(classifier=one, parallelism=4), "inverse", C=1.0))

    made = {
        "LogisticRegression": lambda: Penalised(LogisticRegression(maxIter=2000, standardization=False), "inverse", C=1.0),
        "DecisionTreeClassifier": lambda: DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=5, seed=SEED),
        "RandomForestClassifier": lambda: RandomForestClassifier(
            numTrees=trees or 200, maxDepth=15, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=SEED),
        "ExtraTreesClassifier": lambda: ExtraTrees(classes, numTrees=trees or 200, maxDepth=15, minSplit=5, minRows=2, seed=SEED),
        "GradientBoostingClassifier": lambda: Boosting(
            classes, first_order=True, l2=0.0, maxIter=trees or 200, stepSize=0.05, maxDepth=3, seed=SEED),
        "XGBClassifier": lambda: Boosting(
            classes, minWeight=1.0, maxIter=trees or 200, stepSize=0.1, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8",
            seed=SEED),
        "SVC": vector,
        "GaussianNB": lambda: NaiveBayes(modelType="gaussian"),
        "KNeighborsClassifier": lambda: KNeighbors(5, classes),
        "MLPClassifier": lambda: MultilayerPerceptronClassifier(layers=[features, 100, 50, classes], maxIter=2000, seed=SEED),
    }
    return made[name]()


def assemble(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Adds the `features` vector and a double `label`; rows without a label go."""
    rows = df.filter(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(rows)


def predictions(model: Model, rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """(keep…, model, y, yhat)."""
    return model.transform(rows).select(*keep, F.lit(name).alias("model"), F.col("label").alias("y"),
                                        F.col("prediction").alias("yhat"))


def class_probabilities(model: Model, rows: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """(keep…, model, y, class, prob); one row per class.  For models that have probabilities."""
    scored = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    return scored.select(*keep, F.lit(name).alias("model"), F.col("label").alias("y"),
                         F.posexplode("_p").alias("class", "prob")).withColumn("class", F.col("class").cast("double"))


def train_models(train: DataFrame, estimators: dict[str, Estimator]) -> tuple[dict[str, Model], dict[str, str]]:
    """Fit each estimator; a failure is recorded and the others go on."""
    fitted, errors = {}, {}
    for name, est in estimators.items():
        try:
            fitted[name] = est.fit(train)
        except Exception as e:  # noqa: BLE001 - any failing algorithm is reported, not fatal
            errors[name] = str(e).split("\n")[0]
    return fitted, errors


def _metrics(rows: DataFrame, task: str, by: tuple[str, ...]) -> DataFrame:
    if task == "regression":
        return regression_metrics(rows, by=by, median=False)
    return classification_metrics(rows, by=by, average="weighted")


def cross_validate(train: DataFrame, estimators: dict[str, Estimator], task: str, fold: str = "fold",
                   folds: int = 5) -> DataFrame:
    """Per model mean and population std of the fold metrics.

    Folds are a column of the input; each fit reads the training table filtered by fold, and all
    fold metrics come from one aggregation.
    """
    parts = []
    for k in range(folds):
        rest, held = train.filter(F.col(fold) != k), train.filter(F.col(fold) == k)
        for name, est in estimators.items():
            parts.append(predictions(est.fit(rest), held, name, [fold]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    per_fold = _metrics(rows, task, ("model", fold))
    names = ("r2", "mse") if task == "regression" else ("accuracy", "precision", "f1")
    label = {"r2": "cv_r2", "mse": "cv_mse", "accuracy": "cv_accuracy", "precision": "cv_precision", "f1": "cv_f1"}
    return per_fold.groupBy("model").agg(*[
        f(n).alias(f"{label[n]}_{s}") for n in names for s, f in (("mean", F.avg), ("std", F.stddev_pop))])


# The search spaces, in MLlib's parameter names (an unlimited depth is MLlib's 30).
GRIDS = {
    "RandomForestRegressor": {"numTrees": [100, 200], "maxDepth": [10, 15, 30], "minInstancesPerNode": [1, 2]},
    "RandomForestClassifier": {"numTrees": [100, 200], "maxDepth": [10, 15, 30], "minInstancesPerNode": [1, 2]},
    "GradientBoostingRegressor": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 6]},
    "GradientBoostingClassifier": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 6]},
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
}
RANDOM_SPACES = {
    "RandomForestRegressor": {"numTrees": [100, 200, 300], "maxDepth": [10, 15, 20, 30], "minInstancesPerNode": [1, 2, 4],
                              "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "RandomForestClassifier": {"numTrees": [100, 200, 300], "maxDepth": [10, 15, 20, 30], "minInstancesPerNode": [1, 2, 4],
                               "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "GradientBoostingRegressor": {"maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1, 0.15],
                                  "maxDepth": [3, 5, 7, 9], "subsamplingRate": [0.7, 0.8, 0.9, 1.0]},
    "XGBRegressor": {"maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1, 0.15], "maxDepth": [3, 5, 7, 9],
                     "subsamplingRate": [0.7, 0.8, 0.9, 1.0], "featureSubsetStrategy": ["0.7", "0.8", "0.9", "1.0"]},
    "Ridge": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
    "Lasso": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0]},
    "LogisticRegression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "l1Ratio": [1.0, 0.0]},
}


def param_maps(est: Estimator, grid: dict[str, list]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    return builder.build()


def draw_params(est: Estimator, space: dict[str, list], draws: int, seed: int = SEED) -> list[dict]:
    """E5: a seeded choice of distinct combinations, all of them if there are fewer."""
    combos = list(itertools.product(*space.values()))
    picked = random.Random(seed).sample(combos, min(draws, len(combos)))
    return [{est.getParam(n): v for n, v in zip(space, c)} for c in picked]


def search(train: DataFrame, est: Estimator, maps: list[dict], task: str, folds: int, fold: str = "fold",
           parallelism: int = 4) -> tuple[Model, DataFrame]:
    """The model refitted with the best parameters, and a table of all combinations.

    Regression is scored by mse, classification by accuracy.  Folds come from the input's column.
    """
    evaluator = RegressionEvaluator(metricName="mse") if task == "regression" else \
        MulticlassClassificationEvaluator(metricName="accuracy")
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=evaluator, foldCol=fold, numFolds=folds,
                        parallelism=parallelism, collectSubModels=False)
    fitted = cv.fit(train)
    rows = [(json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(a), float(s))
            for m, a, s in zip(maps, fitted.avgMetrics, fitted.stdMetrics)]
    table = train.sparkSession.createDataFrame(rows, "params string, mean_score double, std_score double")
    return fitted.bestModel, table


def grid_search(train: DataFrame, name: str, est: Estimator, task: str, folds: int = 3, grid: dict | None = None):
    """The small grid, 3 folds."""
    return search(train, est, param_maps(est, grid or GRIDS[name]), task, folds)


def random_search(train: DataFrame, name: str, est: Estimator, task: str, rows: int, folds: int = 5,
                  space: dict | None = None, draws: int | None = None):
    """E5: 20 draws below 1000 rows, else 50; the table's best three are the report."""
    maps = draw_params(est, space or RANDOM_SPACES[name], draws or (20 if rows < 1000 else 50))
    return search(train, est, maps, task, folds)


def tuned(train: DataFrame, name: str, est: Estimator, task: str, rows: int, folds: int, draws: int | None) -> tuple[Model, Estimator]:
    """E5 for a run: the model refitted with the best drawn parameters, and an estimator that has them."""
    maps = draw_params(est, RANDOM_SPACES[name], draws or (20 if rows < 1000 else 50))
    model, table = search(train, est, maps, task, folds)
    best = top_combinations(table, task, 1).first()["params"]
    chosen = next(m for m in maps if json.dumps({p.name: v for p, v in m.items()}, sort_keys=True) == best)
    return model, est.copy(chosen)


def top_combinations(table: DataFrame, task: str, n: int = 3) -> DataFrame:
    """E5: the best parameter combinations."""
    order = F.asc("mean_score") if task == "regression" else F.desc("mean_score")
    return table.orderBy(order, "params").limit(n)


def feature_importance(model: Model, features: list[str], df: DataFrame) -> DataFrame:
    """Tree importances or absolute coefficients, largest first; no rows if it has none."""
    if hasattr(model, "featureImportances"):
        values = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix"):
        values = list(abs(model.coefficientMatrix.toArray()[0]))
    elif hasattr(model, "coefficients"):
        values = list(abs(model.coefficients.toArray()))
    else:
        values = []
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def rank_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """The features to show."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


# ---------------------------------------------------------------- forecasting on features

def lag_features(panel: DataFrame, shift: int = 1) -> tuple[DataFrame, list[str]]:
    """Q6 inputs known `shift` days ahead: lags, a shifted rolling mean, the calendar.

    Days without a lag take the last one before them, else the first one after them.
    """
    s = PANEL
    lagged = {f"lag_{k}": F.lag("y", k).over(s.ordered) for k in (shift, shift + 6, shift + 13)}
    frame = s.ordered.rowsBetween(-(shift + 6), -shift)
    lagged["rolling_mean_7"] = F.when(F.count("y").over(frame) == 7, F.avg("y").over(frame))
    wide = add(panel.withColumns(lagged), {**calendar_columns(F.col("ds")), "is_weekend": period_columns(F.col("ds"))["is_weekend"]})
    names = [*lagged, "month", "day_of_week", "day", "is_weekend"]
    ahead = s.ordered.rowsBetween(0, Window.unboundedFollowing)
    behind = s.ordered.rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, True).over(behind), F.first(c, True).over(ahead), F.lit(0.0)) for c in lagged}
    return wide.withColumns(filled), names


def forecast_on_features(split: DataFrame, model: str = "LinearRegression", trees: int = 100,
                         features: list[str] | None = None) -> DataFrame:
    """Q6: one global model over all series, fitted on the train part, predicting the test part.

    The series' train mean stands for the series.  Without features the forecast is that mean.
    """
    wide, names = lag_features(split)
    rows = wide.withColumn("series_mean", F.avg(F.when(F.col("part") == "train", F.col("y"))).over(PANEL.whole))
    if features is not None and not features:
        return rows.filter("part = 'test'").select("unique_id", "ds", "y", F.col("series_mean").alias("yhat"))
    ready = assemble(rows, [*(features or names), "series_mean"], "y")
    est = regressor(model, trees)
    if model.startswith("RandomForest"):
        est = est.setMaxDepth(10)
    fitted = est.fit(ready.filter("part = 'train'"))
    return fitted.transform(ready.filter("part = 'test'")).select("unique_id", "ds", "y", F.col("prediction").alias("yhat"))


def forecast_with_features(train: DataFrame, horizon: int, future: DataFrame | None, covariates: list[str], levels) -> DataFrame:
    """Q8 by features: all inputs are known `horizon` days ahead, so one model serves every step."""
    from tabloom.operators.forecast import with_intervals

    days = future_spine(train, horizon, covariates=False)
    if future is not None:
        days = days.join(future.select("unique_id", "ds", *covariates), ["unique_id", "ds"], "left")
    both = train.select("unique_id", "ds", "y", *covariates, F.lit(0).alias("step")).unionByName(
        days.withColumn("y", F.lit(None).cast("double")), allowMissingColumns=True)
    wide, names = lag_features(both.fillna(0, covariates) if covariates else both, horizon)
    wide = wide.withColumn("series_mean", F.avg("y").over(PANEL.whole))  # future rows have no y
    inputs = [*names, *covariates, "series_mean"]
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(wide)
    known = rows.filter("step = 0").withColumn("label", F.col("y"))
    fitted = regressor("LinearRegression").fit(known)
    spread = fitted.transform(known).groupBy("unique_id").agg(
        F.stddev_samp(F.col("y") - F.col("prediction")).alias("sigma"))
    ahead = fitted.transform(rows.filter("step > 0")).join(spread, "unique_id")
    return with_intervals(ahead.select("unique_id", "ds", "step", F.col("prediction").alias("yhat"), "sigma"), levels)
