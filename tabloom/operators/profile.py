"""Table profiles.

One scan for counts and moments, one shuffle for everything that needs distinct values.
The results have one row per column, so every later rule works on a tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import hash_order, quantile_columns
from tabloom.session import durable
from tabloom.functions.stats import (
    corrected_skew, describe_dtype, numeric_columns, paired_corr, text_columns, unpivot,
)


def _tall(df: DataFrame, cols: list[str], stats: dict, numbers_only: tuple[str, ...] = ()) -> DataFrame:
    """One aggregation over all columns, turned into one row per column.

    Statistics in `numbers_only` are null for the other columns.
    """
    numbers = set(numeric_columns(df))
    value = lambda c, n, f: F.lit(None).cast("double") if n in numbers_only and c not in numbers else f(F.col(c))
    wide = df.agg(*[
        F.struct(F.lit(c).alias("column"), *[value(c, n, f).alias(n) for n, f in stats.items()]).alias(f"_{i}")
        for i, c in enumerate(cols)
    ])
    return wide.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cols))])))


def value_counts(df: DataFrame, cols: list[str], keep_null: bool = False) -> DataFrame:
    """(column, value, n): the one shuffle behind distinct counts, modes and top values."""
    long = unpivot(df, cols, "string")
    if not keep_null:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """(column, nunique), nulls excluded; HyperLogLog on request."""
    if approximate:
        return _tall(df, cols, {"nunique": lambda c: F.approx_count_distinct(c)})
    found = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found, "column", "left").fillna(0, ["nunique"])


def dataset_profile(df: DataFrame) -> DataFrame:
    """A1: per column position, dtype, rows and missing values."""
    types = {f.name: describe_dtype(f) for f in df.schema.fields}
    tall = _tall(df, df.columns, {
        "n": lambda c: F.count(F.lit(1)),
        "missing": lambda c: F.count_if(c.isNull()),
    })
    dtype = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    where = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    return tall.select("column", where[F.col("column")].alias("position"),
                       dtype[F.col("column")].alias("dtype"), "n", "missing")


def sample_rows(df: DataFrame, key: list[str], n: int = 3) -> DataFrame:
    """A1: a few rows for the report, those with the smallest key hashes, so that every run shows the same."""
    order = hash_order(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_h", order).orderBy("_h", *key).limit(n).drop("_h")


def with_quantiles(df: DataFrame, cols: list[str], stats: dict, probs: dict[str, float]) -> DataFrame:
    """Moments and exact quantiles per column: one scan for the moments, two for the quantiles."""
    return _tall(df, cols, stats).join(quantile_columns(df, cols, probs), "column", "left")


def numeric_describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A2: count, mean, std, min, quartiles (exact), max per numeric column."""
    cols = cols or numeric_columns(df)
    return with_quantiles(df, cols, {
        "count": F.count, "mean": lambda c: F.avg(c.cast("double")),
        "std": lambda c: F.stddev_samp(c.cast("double")),
        "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double")),
    }, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """A3: distinct count and the k most frequent values per text column, ties by value.

    `row_number() <= k` is limited per task before the shuffle, so a column of unique values
    sends k rows per task.
    """
    cols = cols or text_columns(df)
    counts = value_counts(df, cols)
    # counting `n` and not rows keeps both uses of the counts alike, so they are computed once
    nunique = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("nunique"))
    ranked = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return top.join(nunique, "column").select("column", "nunique", "rank", "value", "n")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """A5: rows equal to an earlier row."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def quality_scores(df: DataFrame) -> DataFrame:
    """A4: share of missing cells, share of duplicate rows, number of columns per dtype."""
    width = len(df.columns)
    cells = dataset_profile(df).agg(
        F.max("n").alias("n"), F.sum("missing").alias("missing_cells"),
        *[F.count_if(F.col("dtype") == t).alias(f"{t}_columns") for t in ("int", "float", "object", "datetime")],
    )
    return cells.withColumn("duplicate_rows", duplicate_rows(df).scalar()).select(
        F.coalesce(F.try_divide(F.col("missing_cells"), F.col("n") * width) * 100, F.lit(0.0)).alias("missing_pct"),
        F.coalesce(F.try_divide(F.col("duplicate_rows"), F.col("n")) * 100, F.lit(0.0)).alias("duplicate_pct"),
        "int_columns", "float_columns", "object_columns", "datetime_columns",
    )


def target_analysis(df: DataFrame, target: str) -> DataFrame:
    """Counts, distinct values and range of the target."""
    t = F.col(target)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(t.isNull()).alias("missing_count"),
        F.count(t).alias("valid_count"), F.count_distinct(t).alias("unique_values"),
        F.min(t).alias("min_value"), F.max(t).alias("max_value"), F.avg(t).alias("mean_value"),
    ).withColumns({
        "missing_pct": F.try_divide(F.col("missing_count"), F.col("total_rows")) * 100,
        "valid_pct": F.try_divide(F.col("valid_count"), F.col("total_rows")) * 100,
    })


def cleaning_stats(df: DataFrame, target: str) -> DataFrame:
    """Rows before and after dropping null targets, and the kept target's moments."""
    t = F.col(target).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("original_rows"), F.count(t).alias("clean_rows"),
        F.count_if(t.isNull()).alias("null_rows"),
        F.min(t).alias("target_min"), F.max(t).alias("target_max"),
        F.avg(t).alias("target_mean"), F.stddev_samp(t).alias("target_std"),
    ).withColumn("removed_pct", F.try_divide(F.col("null_rows"), F.col("original_rows")) * 100)


def numeric_target_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """What the regression rules look at, per numeric column."""
    cols = cols or numeric_columns(df)
    d = lambda c: c.cast("double")
    moments = with_quantiles(df, cols, {
        "n": lambda c: F.count(F.lit(1)), "valid": F.count,
        "variance": lambda c: F.var_samp(d(c)), "std": lambda c: F.stddev_samp(d(c)),
        "range": lambda c: F.max(d(c)) - F.min(d(c)), "mean": lambda c: F.avg(d(c)),
    }, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return (
        moments.join(distinct_counts(df, cols), "column")
        .withColumn("unique_ratio", F.try_divide(F.col("nunique"), F.col("n")))
        .withColumn("missing_pct", F.try_divide(F.col("n") - F.col("valid"), F.col("n")) * 100)
        .drop("valid")
    )


def categorical_target_profile(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Distinct count, ratio, missing share, mode (smallest on a tie) and top values."""
    cols = cols or df.columns
    base = _tall(df, cols, {"n": lambda c: F.count(F.lit(1)), "valid": F.count})
    top = top_values(df, cols, k).groupBy("column").agg(
        F.first("nunique").alias("nunique"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("mode"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                    lambda s: F.concat_ws("=", s["value"], s["n"].cast("string"))).alias("_top"),
    )
    return base.join(top, "column", "left").select(
        "column", F.coalesce("nunique", F.lit(0)).alias("nunique"),
        F.coalesce(F.try_divide(F.col("nunique"), F.col("n")), F.lit(0.0)).alias("unique_ratio"),
        (F.try_divide(F.col("n") - F.col("valid"), F.col("n")) * 100).alias("missing_pct"),
        "mode", F.concat_ws("; ", "_top").alias("top_counts"),
        F.concat_ws("; ", F.slice("_top", 1, 3)).alias("top3"),
    )


def feature_moments(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A10: min, max, std and corrected skewness per numeric column."""
    cols = cols or numeric_columns(df)
    d = lambda c: c.cast("double")
    return _tall(df, cols, {
        "min": lambda c: F.min(d(c)), "max": lambda c: F.max(d(c)),
        "std": lambda c: F.stddev_samp(d(c)),
        "skew": lambda c: corrected_skew(F.skewness(d(c)), F.count(c)),
    })


def interaction_candidates(df: DataFrame, cols: list[str] | None = None, low: float = 0.3,
                           high: float = 0.9, first: int = 5) -> DataFrame:
    """The first five column pairs with a moderate |r|, all pairs in one aggregation."""
    cols = cols or numeric_columns(df)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    wide = df.agg(*[paired_corr(cols[i], cols[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    rows = F.array(*[
        F.struct(F.lit(k).alias("order"), F.lit(cols[i]).alias("feature1"), F.lit(cols[j]).alias("feature2"),
                 F.abs(F.col(f"r_{i}_{j}")).alias("correlation"))
        for k, (i, j) in enumerate(pairs)
    ])
    found = wide.select(F.inline(rows)).filter((F.col("correlation") > low) & (F.col("correlation") < high))
    return found.orderBy("order").limit(first).drop("order")


def zero_negative_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zeros and negatives per measure."""
    return _tall(df, cols, {"zeros": lambda c: F.count_if(c == 0), "negatives": lambda c: F.count_if(c < 0)})


def prediction_stats(df: DataFrame, prediction: str) -> DataFrame:
    """Range, mean and population std of the predictions."""
    p = F.col(prediction)
    return df.agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"),
                  F.stddev_pop(p).alias("std"))


def total_error_pct(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Error of the totals in percent."""
    return df.agg((F.try_divide(F.abs(F.sum(prediction) - F.sum(actual)), F.sum(actual)) * 100)
                  .alias("total_error_pct"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the data range, the last one closed on the right.

    The range and the counts come from one table of values with their numbers, so the input runs once.
    """
    counts = durable(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")), "values")
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("long")
    per_bin = counts.groupBy(index.alias("bin")).agg(F.sum("n").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(per_bin, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def dataset_characteristics(df: DataFrame) -> DataFrame:
    """Size, missing share, column kinds, complexity and missing severity."""
    width = len(df.columns)
    complexity = "high" if width > 50 else "medium" if width > 10 else "low"
    share = F.try_divide(F.sum("missing"), F.max("n") * width)
    return dataset_profile(df).agg(
        F.max("n").alias("sample_size"), F.lit(width).cast("long").alias("feature_count"),
        F.coalesce(share * 100, F.lit(0.0)).alias("missing_pct"),
        F.count_if(F.col("dtype") == "object").alias("categorical_features"),
        F.count_if(F.col("dtype").isin("int", "float")).alias("numeric_features"),
        F.lit(complexity).alias("complexity"),
        F.when(share > 0.1, "high").otherwise("low").alias("missing_severity"),
    )
