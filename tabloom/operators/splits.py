"""Training and test parts, folds, future dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.calendar import add, predictable_columns
from tabloom.functions.ordering import hash_order, with_position
from tabloom.operators.windows import PANEL, Series


def holdout_tail(panel: DataFrame, n: int = 21, s: Series = PANEL) -> DataFrame:
    """`part` is test for the last n rows of each series, else train."""
    back = F.row_number().over(s.whole.orderBy(F.desc(s.time)))
    return panel.withColumn("part", F.when(back <= n, "test").otherwise("train"))


def holdout_fraction(df: DataFrame, group: list[str], order: list[str], bucket: Column | list[Column],
                     fraction: float = 0.8) -> DataFrame:
    """The first ⌊fraction·n⌋ rows by time train, the rest test.

    Without a group the whole table is one sequence; positions come from bucket counts, so it
    is never ordered in one task.
    """
    keyed = df if group else df.withColumn("_all", F.lit(1))
    placed = with_position(keyed, group or ["_all"], order, bucket, "_pos", "_total")
    part = F.when(F.col("_pos") < F.floor(F.col("_total") * F.lit(fraction)), "train").otherwise("test")
    return placed.withColumn("part", part).drop("_pos", "_total", "_all")


def expanding_folds(panel: DataFrame, s: Series = PANEL, splits: int = 3, min_rows: int = 30) -> DataFrame:
    """Each fold trains on everything before its test block; short series have no folds."""
    placed = panel.withColumn("_pos", F.row_number().over(s.ordered) - 1).withColumn("_n", s.length())
    size = F.floor(F.col("_n") / (splits + 1))
    folds = placed.filter(F.col("_n") >= min_rows).withColumn(
        "fold", F.explode(F.array(*[F.lit(i) for i in range(splits)])))
    start = F.col("_n") - (splits - F.col("fold")) * size
    part = F.when(F.col("_pos") < start, "train").when(F.col("_pos") < start + size, "test")
    return folds.withColumn("part", part).filter(F.col("part").isNotNull()).drop("_pos", "_n")


def future_spine(panel: DataFrame, horizon: int, covariates: bool = True) -> DataFrame:
    """The dates after each series' last one, with the covariates known in advance."""
    ends = panel.groupBy("unique_id").agg(F.max("ds").alias("_last"))
    days = ends.select("unique_id", F.posexplode(
        F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias("step", "ds")
    ).withColumn("step", F.col("step") + 1)
    return add(days, predictable_columns(F.col("ds"), future=True)) if covariates else days


def train_context(split: DataFrame, days: int = 30) -> DataFrame:
    """Test rows and the last days of history before each series' test start."""
    start = split.filter(F.col("part") == "test").groupBy("unique_id").agg(F.min("ds").alias("_start"))
    joined = split.join(start, "unique_id")
    keep = (F.col("part") == "test") | (F.col("ds") >= F.date_sub("_start", days))
    return joined.filter(keep).drop("_start")


def ts_feature_defaults(features: list[str], originals: list[str], cap: int = 12) -> list[str]:
    """Lag features naming _1 or _7, the first rolling mean, three calendar columns, originals."""
    chosen = [f for f in features if "lag" in f and ("_1" in f or "_7" in f)]
    chosen += [f for f in features if "rolling_mean" in f][:1]
    chosen += [f for f in ("day_of_week", "month", "is_weekend") if f in features]
    return (chosen + originals[:3])[:cap]


def train_test_split(df: DataFrame, key: list[str], train_tenths: int = 8, seed: int = 42) -> DataFrame:
    """A reproducible split by key hash; no shuffle, and the same rows on every run."""
    slot = hash_order(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), seed) % 10
    return df.withColumn("part", F.when(slot < train_tenths, "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str, key: list[str], fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """The same share of every class, by exact rank of the key hash within the class.

    A class may hold most rows; its ranks come from 4096 hash slices of 256 pieces each.
    """
    hashed = df.withColumn("_h", hash_order(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), seed))
    placed = with_position(hashed, [label], ["_h", *key], [F.shiftright("_h", 48), F.shiftright("_h", 40)], "_pos", "_total")
    part = F.when(F.col("_pos") < F.floor(F.col("_total") * F.lit(fraction)), "train").otherwise("test")
    return placed.withColumn("part", part).drop("_h", "_pos", "_total")


def add_folds(df: DataFrame, key: list[str], folds: int = 5, seed: int = 7) -> DataFrame:
    """A fold number per row for cross-validation, by key hash."""
    h = hash_order(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), seed)
    return df.withColumn("fold", (h % folds).cast("int"))


def add_stratified_folds(df: DataFrame, label: str, key: list[str], folds: int = 5, seed: int = 7) -> DataFrame:
    """Folds with equal shares of every class: the rank within the class, modulo the folds."""
    hashed = df.withColumn("_h", hash_order(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), seed))
    placed = with_position(hashed, [label], ["_h", *key], [F.shiftright("_h", 48), F.shiftright("_h", 40)], "_pos")
    return placed.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_h", "_pos")
