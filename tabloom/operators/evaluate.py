"""Metrics, model choice and ensembles over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import exact_quantiles


def r_squared(y: Column, yhat: Column) -> Column:
    """1 − residual over total sum of squares; a constant actual gives 1 if met exactly, else 0.

    Null without rows.
    """
    res, tot = F.sum((y - yhat) * (y - yhat)), F.var_pop(y) * F.count(y)
    return F.when(tot > 0, 1 - res / F.when(tot > 0, tot)).when(res == 0, F.lit(1.0)).when(
        F.count(y) > 0, F.lit(0.0))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = (),
                       median: bool = True) -> DataFrame:
    """Mse, rmse, mae, r², median and largest absolute error, and MAPE where no actual is 0."""
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    err = F.abs(a - p)
    zero = F.count_if(a == 0) > 0
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("mae"), r_squared(a, p).alias("r2"), F.max(err).alias("max_error"),
        F.when(~zero, F.avg(F.try_divide(err, F.abs(a)))).alias("mape"))
    if not median:
        return out
    mid = exact_quantiles(df.select(*by, err.alias("_e")), ["_e"], [0.5], by)
    if by:
        return out.join(mid.select(*by, F.col("q").alias("median_ae")), list(by))
    return out.withColumn("median_ae", mid.select("q").scalar())


def percent_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = ()) -> DataFrame:
    """E6, percent variant: MAPE in percent over rows whose actual is not 0."""
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    return df.groupBy(*by).agg((F.avg(F.try_divide(F.abs(a - p), F.abs(a))) * 100).alias("mape_pct"))


def cv_rmse(fold_mse: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """E6, percent variant: roots of the mean and of the population std of the fold MSEs."""
    return fold_mse.groupBy(*by).agg(F.sqrt(F.avg("mse")).alias("cv_rmse_mean"),
                                     F.sqrt(F.stddev_pop("mse")).alias("cv_rmse_std"))


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per actual and predicted class."""
    return df.groupBy(*by, F.col(y).cast("string").alias("y"), F.col(yhat).cast("string").alias("yhat")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = (),
                           average: str = "auto") -> DataFrame:
    """Accuracy, precision, recall, f1 from the confusion counts.

    With two classes the larger label is the positive one; otherwise the classes are weighted by
    their support.  An empty denominator gives 0.
    """
    cm = confusion(df, y, yhat, by)
    per_class = cm.select(
        *by,
        F.explode(F.array(
            F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                     F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("yhat").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("long").alias("hit")))).alias("s"),
    ).groupBy(*by, F.col("s.c").alias("c")).agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hit").alias("hit"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per_class = per_class.withColumns({
        "p": zero(F.try_divide("hit", "predicted")), "r": zero(F.try_divide("hit", "support"))})
    per_class = per_class.withColumn("f", zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    positive = lambda c: F.max_by(c, "c")
    classes = F.count(F.lit(1))

    def pick(c: str) -> Column:
        if average == "weighted":
            return weighted(c)
        return F.when(classes == 2, positive(c)).otherwise(weighted(c))

    return per_class.groupBy(*by).agg(
        F.sum("support").alias("n"), classes.alias("num_classes"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"), pick("p").alias("precision"),
        pick("r").alias("recall"), pick("f").alias("f1"))


def _stability(mean: str, std: str) -> Column:
    m = F.coalesce(F.col(mean), F.lit(0.0))
    return 1 - F.coalesce(F.col(std), F.lit(1.0)) / F.greatest(F.abs(m), F.lit(0.01))


def regression_score(metrics: DataFrame) -> DataFrame:
    """.4 r² + .4 cross-validated r² + .2 stability."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return metrics.withColumn("score", 0.4 * z("r2") + 0.4 * z("cv_r2_mean") + 0.2 * _stability("cv_r2_mean", "cv_r2_std"))


def classification_score(metrics: DataFrame) -> DataFrame:
    """.3 accuracy + .3 f1 + .3 cross-validated accuracy + .1 stability."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return metrics.withColumn(
        "score", 0.3 * z("accuracy") + 0.3 * z("f1") + 0.3 * z("cv_accuracy_mean")
        + 0.1 * _stability("cv_accuracy_mean", "cv_accuracy_std"))


def select_best(metrics: DataFrame, by: str = "score", largest: bool = True, name: str = "model") -> DataFrame:
    """The best model by one column; ties go to the first name."""
    order = F.desc(by) if largest else F.asc(by)
    return metrics.filter(F.col(by).isNotNull()).orderBy(order, name).limit(1)


def eligible_models(metrics: DataFrame, by: str, above: float, most: int = 5, least: int = 2) -> DataFrame:
    """The best models above a limit, or none if fewer than two pass."""
    passed = metrics.filter(F.col(by) > above).orderBy(F.desc(by), "model").limit(most)
    enough = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) >= least
    return passed.withColumn("_ok", enough).filter("_ok").select("model")


def ensemble_regression(predictions: DataFrame, metrics: DataFrame, row: str = "row_id", above: float = 0.3) -> DataFrame:
    """Mean prediction of the eligible models per row."""
    chosen = predictions.join(eligible_models(metrics, "r2", above), "model", "left_semi")
    return chosen.groupBy(row).agg(F.first("y").alias("y"), F.avg("yhat").alias("yhat"))


def ensemble_classification(probabilities: DataFrame, metrics: DataFrame, row: str = "row_id",
                            above: float = 0.6) -> DataFrame:
    """The class with the largest mean probability of the eligible models.

    Input rows: row, model, y, class, prob.  Ties go to the smallest class.
    """
    chosen = probabilities.join(eligible_models(metrics, "accuracy", above), "model", "left_semi")
    mean = chosen.groupBy(row, "class").agg(F.first("y").alias("y"), F.avg("prob").alias("prob"))
    best = F.min_by("class", F.struct(-F.col("prob"), F.col("class")))
    return mean.groupBy(row).agg(F.first("y").alias("y"), best.alias("yhat"), F.max("prob").alias("prob"))


def replace_best(best: DataFrame, ensemble: DataFrame, by: str) -> DataFrame:
    """The ensemble takes over only if strictly better."""
    both = best.select("model", by, F.lit(0).alias("_o")).unionByName(ensemble.select("model", by, F.lit(1).alias("_o")))
    return both.orderBy(F.desc(by), "_o").limit(1).drop("_o")


def compare_models(long: DataFrame, metrics: list[str]) -> DataFrame:
    """(task, model, metric, value) turned into one row per model."""
    return long.groupBy("task", "model").pivot("metric", metrics).agg(F.first("value"))


def suitability(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """How well a target suits each approach.

    `profile`: approach, nunique, n, is_text, is_numeric of the approach's target; `scores`:
    approach, best (accuracy or r²).
    """
    u, ratio = F.col("nunique"), F.try_divide("nunique", "n")
    pts = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    cls = pts(u.between(2, 50), 3.0) + pts(ratio < 0.1, 2.0) + pts(F.col("is_text") == 1, 2.0) + 3 * F.col("best")
    reg = pts(u > 20, 3.0) + pts(ratio > 0.1, 2.0) + pts(F.col("is_numeric") == 1, 2.0) + F.when(
        F.col("best") > 0, 3 * F.col("best")).otherwise(F.lit(0.0))
    both = profile.join(scores, "approach").withColumn(
        "score", F.when(F.col("approach") == "classification", cls).otherwise(reg))
    wide = both.agg(F.max(F.when(F.col("approach") == "classification", F.col("score"))).alias("classification_score"),
                    F.max(F.when(F.col("approach") == "regression", F.col("score"))).alias("regression_score"))
    c, r = F.col("classification_score"), F.col("regression_score")
    return wide.withColumn("recommendation", F.when(c > r + 1, "classification").when(r > c + 1, "regression")
                           .otherwise("both"))


def overfit_indicator(metrics: DataFrame, cv: str = "cv_mean") -> DataFrame:
    """Distance of the cross-validated mean from r²; 0 if either is missing or 0."""
    known = (F.coalesce(F.col(cv), F.lit(0.0)) != 0) & (F.coalesce(F.col("r2"), F.lit(0.0)) != 0)
    return metrics.withColumn("overfit", F.when(known, F.abs(F.col(cv) - F.col("r2"))).otherwise(F.lit(0.0)))


def mape_category(metrics: DataFrame, limits: tuple[float, ...] = (10, 20, 30),
                  names: tuple[str, ...] = ("excellent", "good", "fair", "poor")) -> DataFrame:
    """a label per series from its MAPE."""
    label = F.lit(names[len(limits)])
    for limit, name in reversed(list(zip(limits, names))):
        label = F.when(F.col("mape") < limit, F.lit(name)).otherwise(label)
    return metrics.withColumn("category", F.when(F.col("mape").isNotNull(), label))


def category_counts(labelled: DataFrame) -> DataFrame:
    """series per label."""
    return labelled.groupBy("category").agg(F.count(F.lit(1)).alias("series"))
