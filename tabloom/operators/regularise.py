"""Complete daily series from irregular ones (W16, W17), with window expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.stats import not_below_zero
from tabloom.operators.panel import next_date, until_next
from tabloom.operators.project import dedupe_keep_first
from tabloom.operators.windows import PANEL, fill_forward_back

NUMERIC = ("y", "qty", "margin", "gross_sales", "discount")


def _known(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.struct(F.col("ds").alias("d"), F.col(c).cast("double").alias("v")))


def _gaps(one: DataFrame, cols: list[str]) -> DataFrame:
    """Each observed row repeated over the empty days after it (`day`), with the last known value
    (`_p_<c>`) and the next known one (`_q_<c>`) of every column, each with its date.

    Looks at observed rows only; the empty days exist after the windows are done.
    """
    series = Window.partitionBy("unique_id")
    upto = series.orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    after = series.orderBy(F.desc("ds")).rowsBetween(Window.unboundedPreceding, -1)
    rows = one.withColumns({"_next": next_date(),
                            **{f"_p_{c}": F.last(_known(c), ignorenulls=True).over(upto) for c in cols}})
    return until_next(rows.withColumns({f"_q_{c}": F.last(_known(c), ignorenulls=True).over(after) for c in cols}))


def _observed(c: str) -> Column:
    return F.when(F.col("day") == F.col("ds"), F.col(c))


def _banded(c: str, limit: Column) -> Column:
    """Linear up to `limit` steps, then three days forward, three days back, then 0; not below 0.

    `limit` null means no limit.  After the last known value the line stays flat; before the
    first one only the backward fill applies.
    """
    p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
    k = F.date_diff(F.col("day"), p["d"])
    left = F.date_diff(q["d"], F.col("day"))
    step = (q["v"] - p["v"]) / (k + left)
    line = lambda i: F.when(q.isNull(), p["v"]).otherwise(p["v"] + step * i)
    value = (
        F.when(_observed(c).isNotNull(), F.col(c).cast("double"))
        .when(p.isNotNull() & (limit.isNull() | (k <= limit)), line(k))
        .when(p.isNotNull() & (k <= limit + 3), line(limit))
        .when(q.isNotNull() & (left <= 3), q["v"])
        .otherwise(F.lit(0.0))
    )
    return not_below_zero(value)


def _one_per_day(panel: DataFrame, unique: bool) -> DataFrame:
    rest = [c for c in panel.columns if c not in ("unique_id", "ds")]
    return panel if unique else dedupe_keep_first(panel, ["unique_id", "ds"], rest)


def regularise_daily(panel: DataFrame, min_rows: int = 50, max_missing: float = 0.7, unique: bool = False,
                     covariates: list[str] | None = None, fill_covariates: bool = True) -> DataFrame:
    """Complete series with gaps filled by how sparse the series is.

    Below 20 % missing days the line is unlimited, below 40 % it runs 5 steps, else 2.  Series
    that are short or more than 70 % empty are left out.  `unique` says that the panel already
    has one row per series and date, as an aggregated one has.
    """
    numeric = [c for c in NUMERIC if c in panel.columns]
    if covariates is None:
        covariates = [c for c in panel.columns if c not in ("unique_id", "ds", *numeric)]
    rest = [c for c in panel.columns if c not in ("unique_id", "ds")]
    whole = Window.partitionBy("unique_id")
    span = F.date_diff(F.max("ds").over(whole), F.min("ds").over(whole)) + 1
    sized = _one_per_day(panel, unique).withColumn("_rows", F.count(F.lit(1)).over(whole)).withColumn("_span", span)
    sized = sized.withColumn("_missing", (F.col("_span") - F.col("_rows")) / F.col("_span"))
    kept = sized.filter((F.col("_rows") >= min_rows) & (F.col("_missing") <= max_missing))
    limit = F.when(F.col("_missing") < 0.2, F.lit(None).cast("int")).when(F.col("_missing") < 0.4, 5).otherwise(2)
    filled = _gaps(kept, numeric).select(
        "unique_id", F.col("day").alias("ds"),
        *[(_banded(c, limit) if c in numeric else _observed(c)).alias(c) for c in rest])
    if fill_covariates and covariates:
        filled = fill_forward_back(filled, covariates, PANEL).fillna(0, covariates)
    return filled


def regularise_daily_simple(panel: DataFrame, method: str = "interpolate", min_rows: int = 30,
                            unique: bool = False) -> DataFrame:
    """Complete series with one fill method: interpolate, zero or smart_fill; not below 0."""
    one = _one_per_day(panel.select("unique_id", "ds", "y"), unique)
    rows = F.count(F.lit(1)).over(Window.partitionBy("unique_id"))
    kept = one.withColumn("_rows", rows).filter(F.col("_rows") >= min_rows)
    if method == "zero":
        full, y = until_next(kept), F.coalesce(_observed("y"), F.lit(0.0))
    else:
        full = _gaps(kept, ["y"])
        p, q = F.col("_p_y"), F.col("_q_y")
        if method == "interpolate":
            k, left = F.date_diff("day", p["d"]), F.date_diff(q["d"], F.col("day"))
            inner = F.coalesce(_observed("y"), p["v"] + (q["v"] - p["v"]) * k / (k + left))
            y = F.coalesce(inner, p["v"], q["v"], F.lit(0.0))
        elif method == "smart_fill":
            y = F.coalesce(p["v"], q["v"], F.lit(0.0))
        else:
            raise ValueError(f"unknown fill method {method!r}")
    return full.select("unique_id", F.col("day").alias("ds"), not_below_zero(y).alias("y"))


def fix_summary(panel: DataFrame, fixed: DataFrame) -> DataFrame:
    """Points before, days filled and points after per kept series."""
    before = panel.groupBy("unique_id").agg(F.count_distinct("ds").alias("original_points"))
    after = fixed.groupBy("unique_id").agg(F.count(F.lit(1)).alias("final_points"))
    return after.join(before, "unique_id").select(
        "unique_id", "original_points", (F.col("final_points") - F.col("original_points")).alias("missing_filled"),
        "final_points", F.when(F.col("final_points") >= 3, 1).otherwise(0).alias("frequency_fixed"))
