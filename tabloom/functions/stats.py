"""Expressions whose pandas meaning differs from the Spark default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere; a floating NaN is mapped on ingest."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in floats else F.col(c)
        for c in df.columns
    ])


def corrected_skew(population_skew: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population one; null below three values."""
    n = n.cast("double")
    return F.when(n >= 3, population_skew * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(population_excess: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population_excess + 6))


def paired_corr(x: str | Column, y: str | Column, over=None) -> Column:
    """Pearson r over rows where both sides exist; null when one side is constant."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    x = F.when(y.isNotNull(), x.cast("double"))
    y = F.when(x.isNotNull(), y.cast("double"))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])


def not_below_zero(c: str | Column) -> Column:
    """Negative values become 0 and nulls stay null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def finite(c: Column) -> Column:
    """Infinite and NaN values become null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def describe_dtype(field: T.StructField) -> str:
    """Column type in the four groups the rules distinguish."""
    t = field.dataType
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, T.StringType):
        return "object"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return t.simpleString()


def unpivot(df: DataFrame, cols: list[str], as_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep…, column, value) with one row per cell, cast to a common type."""
    typed = df.select(*keep, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return typed.unpivot(list(keep), cols, "column", "value")
