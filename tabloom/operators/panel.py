"""Panels of series: building, quality, rollups, frequency (A12–A27, T, J, U).

A daily panel has one row per series and date.  It is made by an aggregation that combines
in the map tasks, so a product with a third of all billing lines still ends as one row per
day, and every later window over a series is bounded by the number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import quantile_columns
from tabloom.functions.stats import not_below_zero
from tabloom.operators.project import HIERARCHY, composite_key, fill_constant

# Billing measures and their names in the panel.
MEASURES = {
    "TOTAL_NET_SALES": "y", "TOTAL_BILLING_QTY": "qty", "TOTAL_GROSS_MARGIN": "margin",
    "TOTAL_GROSS_SALES": "gross_sales", "TOTAL_DISCOUNT": "discount",
}


def money(c: Column) -> Column:
    """Two decimals, half to even, of a sum whose last bits depend on the order of adding."""
    return F.bround(F.round(c, 6), 2)


def with_product_key(df: DataFrame, levels: tuple[str, ...] = HIERARCHY) -> DataFrame:
    return fill_constant(df, levels).withColumn("PRODUCT_KEY", composite_key(levels))


def daily_panel(df: DataFrame, key: str, ds: str = "BILLING_DATE",
                measures: dict[str, str] = MEASURES, clamp: tuple[str, ...] = ("TOTAL_NET_SALES",),
                ) -> DataFrame:
    """Sums per series and date, negative sales counted as 0."""
    value = lambda c: not_below_zero(c) if c in clamp else F.col(c)
    return (
        df.groupBy(F.col(key).cast("string").alias("unique_id"), F.to_date(ds).alias("ds"))
        .agg(*[F.sum(value(c)).alias(n) for c, n in measures.items()])
        .filter(F.col("y").isNotNull())
    )


def _quality(base: DataFrame) -> DataFrame:
    """Span, density and variation from the rounded sums."""
    mean = F.when(F.col("avg_sales") == 0, F.lit(1.0)).otherwise(F.col("avg_sales"))
    return base.withColumns({
        "data_span_days": F.date_diff("last_date", "first_date") + 1,
        "cv": F.col("sales_std") / mean,
    }).withColumn("data_density", F.col("unique_days") / F.col("data_span_days"))


def series_quality(df: DataFrame, key: str, ds: str = "BILLING_DATE") -> DataFrame:
    """Totals, spread, span, density and variation per series; sums at two decimals."""
    s = not_below_zero("TOTAL_NET_SALES")
    return _quality(df.groupBy(F.col(key).alias("unique_id")).agg(
        money(F.sum(s)).alias("total_sales"), money(F.avg(s)).alias("avg_sales"),
        F.count(s).alias("transaction_count"), money(F.stddev_samp(s)).alias("sales_std"),
        F.min(ds).alias("first_date"), F.max(ds).alias("last_date"),
        F.count_distinct(ds).alias("unique_days"),
        money(F.sum("TOTAL_BILLING_QTY")).alias("total_qty"),
        money(F.sum("TOTAL_GROSS_MARGIN")).alias("total_margin"),
    ))


def daily_parts(df: DataFrame, key: str, ds: str = "BILLING_DATE") -> DataFrame:
    """The daily panel with the line count and spread of each day.

    It is small against the billing lines and holds all that choosing series needs, so a run
    reads the lines once.
    """
    s = not_below_zero("TOTAL_NET_SALES")
    return (
        df.groupBy(F.col(key).cast("string").alias("unique_id"), F.to_date(ds).alias("ds"))
        .agg(*[F.sum(s if c == "TOTAL_NET_SALES" else F.col(c)).alias(n) for c, n in MEASURES.items()],
             F.count(s).alias("lines"), F.var_pop(s).alias("line_var"))
        .filter(F.col("y").isNotNull())
    )


def series_quality_daily(parts: DataFrame) -> DataFrame:
    """A12 from daily parts: the line variance is that within days plus that between day means."""
    n = F.sum("lines")
    mean_of_day = F.col("y") / F.col("lines")
    between = F.col("lines") * (mean_of_day - F.col("_mean")) * (mean_of_day - F.col("_mean"))
    whole = Window.partitionBy("unique_id")
    placed = parts.withColumn("_mean", F.sum("y").over(whole) / F.sum("lines").over(whole))
    spread = F.sqrt(F.try_divide(F.sum(F.col("lines") * F.col("line_var") + between), n - 1))
    return _quality(placed.groupBy("unique_id").agg(
        money(F.sum("y")).alias("total_sales"), money(F.sum("y") / n).alias("avg_sales"),
        n.alias("transaction_count"), money(spread).alias("sales_std"),
        F.min("ds").alias("first_date"), F.max("ds").alias("last_date"), F.count("ds").alias("unique_days"),
        money(F.sum("qty")).alias("total_qty"), money(F.sum("margin")).alias("total_margin"),
    ))


def viable_series(quality: DataFrame, top_n: int = 8) -> DataFrame:
    """The strict rule, or the lenient one when nothing passes; largest sales first.

    Both rules are evaluated in one pass.  The strict rows sort first, and a lenient row stays
    only if the best row is no strict one.
    """
    strict = (
        (F.col("unique_days") >= 60) & (F.col("data_span_days") >= 90) & (F.col("data_density") >= 0.3)
        & (F.col("total_sales") >= 10000) & (F.col("transaction_count") >= 30) & (F.col("cv") < 3)
    )
    lenient = (F.col("unique_days") >= 30) & (F.col("total_sales") >= 5000)
    marked = quality.withColumn("_strict", F.when(strict, 1).otherwise(0)).filter((F.col("_strict") == 1) | lenient)
    best = marked.orderBy(F.desc("_strict"), F.desc("total_sales"), "unique_id").limit(top_n)
    any_strict = F.max("_strict").over(Window.partitionBy(F.lit(1)))
    return best.withColumn("_any", any_strict).filter(F.col("_strict") == F.col("_any")).drop("_strict", "_any")


def viable_series_simple(df: DataFrame, key: str, ds: str = "BILLING_DATE", min_transactions: int = 30,
                         min_days: int = 20, top_n: int = 50) -> DataFrame:
    """Enough lines and days, largest sales first."""
    stats = df.groupBy(F.col(key).alias("unique_id")).agg(
        F.count_distinct(ds).alias("unique_days"), F.count("TOTAL_NET_SALES").alias("transaction_count"),
        money(F.sum("TOTAL_NET_SALES")).alias("total_sales"),
        money(F.avg("TOTAL_NET_SALES")).alias("avg_sales"),
        money(F.sum("TOTAL_BILLING_QTY")).alias("total_qty"),
    )
    keep = (F.col("transaction_count") >= min_transactions) & (F.col("unique_days") >= min_days)
    return stats.filter(keep).orderBy(F.desc("total_sales"), "unique_id").limit(top_n)


def keep_series(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows of the selected series.  The side's size decides the join, by Spark's threshold."""
    return df.join(selected.select(F.col("unique_id").alias(key)), key, "left_semi")


def daily_rollups(df: DataFrame, ds: str = "BILLING_DATE", site: str = "SITE", brand: str = "BRAND") -> DataFrame:
    """Daily totals overall, by site and by brand from one pass."""
    level = F.grouping_id()
    return df.groupingSets([[ds], [ds, site], [ds, brand]], ds, site, brand).agg(
        F.sum("TOTAL_NET_SALES").alias("net_sales"), F.sum("TOTAL_GROSS_SALES").alias("gross_sales"),
        F.sum("TOTAL_BILLING_QTY").alias("qty"), level.alias("_g"),
    ).withColumn(
        "level", F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "site").otherwise("brand")
    ).drop("_g")


def rollup_summary(rollups: DataFrame, site: str = "SITE", brand: str = "BRAND") -> DataFrame:
    """Days and mean daily sales per group of each level."""
    member = F.coalesce(F.col(site).cast("string"), F.col(brand), F.lit("all"))
    return rollups.groupBy("level", member.alias("member")).agg(
        F.count(F.lit(1)).alias("days"), F.avg("net_sales").alias("avg_daily_sales"))


#: Columns that a report matrix may have.
MOST_MEMBERS = 1000


def pivot_daily(panel: DataFrame, members: list[str] | None = None, most: int = MOST_MEMBERS) -> DataFrame:
    """Date × series matrix with 0 for no sales; for reports, compute stays long.

    The members are those of the data unless named.  More than `most` of them raise an error.
    """
    if members is None:
        members = sorted(r[0] for r in panel.select("unique_id").distinct().limit(most + 1).collect() if r[0] is not None)
    if len(members) > most:
        raise ValueError(f"a matrix of more than {most} series; keep the panel long")
    return panel.groupBy("ds").pivot("unique_id", members).agg(F.sum("y")).fillna(0.0)


def week_ending_monday(ds: Column) -> Column:
    """The Monday that closes the week of a date (Tuesday … Monday)."""
    return F.next_day(F.date_sub(ds, 1), "Mon")


def _every_week(weeks: DataFrame) -> DataFrame:
    """Each week repeated over the empty weeks after it, whose values are null."""
    after = F.lead("ds").over(Window.partitionBy("unique_id").orderBy("ds"))
    last = F.coalesce(F.date_sub(after, 7), F.col("ds"))
    full = weeks.withColumn("_last", last).withColumn("_week", F.explode(F.expr("sequence(ds, _last, interval 7 day)")))
    rest = [c for c in weeks.columns if c not in ("unique_id", "ds")]
    own = lambda c: F.when(F.col("_week") == F.col("ds"), F.col(c)).alias(c)
    return full.select("unique_id", F.col("_week").alias("ds"), *[own(c) for c in rest])


def resample_weekly(df: DataFrame, key: str, ds: str, value: str) -> DataFrame:
    """Weekly sums labelled by the closing Monday, empty weeks 0."""
    weeks = df.groupBy(F.col(key).alias("unique_id"), week_ending_monday(F.to_date(ds)).alias("ds")).agg(
        F.sum(value).alias("y"))
    return _every_week(weeks).fillna(0.0, ["y"])


def resample_weekly_covariates(df: DataFrame, key: str, ds: str, holiday: Column) -> DataFrame:
    """Weekly quantity, discount, mean weekday and holiday count; no mean in an empty week."""
    day = F.to_date(ds)
    weeks = df.groupBy(F.col(key).alias("unique_id"), week_ending_monday(day).alias("ds")).agg(
        F.sum("TOTAL_BILLING_QTY").alias("qty"), F.sum("TOTAL_DISCOUNT").alias("discount"),
        F.avg(F.weekday(day)).alias("dayofweek"), F.sum(holiday).alias("is_holiday"))
    return _every_week(weeks).fillna(0, ["qty", "discount", "is_holiday"])


def weekday_totals(df: DataFrame, ds: str = "BILLING_DATE", value: str = "TOTAL_NET_SALES") -> DataFrame:
    """Sales per day name, Monday first."""
    return df.groupBy(F.weekday(ds).alias("weekday"), F.date_format(ds, "EEEE").alias("day_name")).agg(
        F.sum(value).alias("sales")).orderBy("weekday")


def frequency_diagnosis(df: DataFrame, key: str = "unique_id", ds: str = "ds") -> DataFrame:
    """Duplicates, missing days, gaps other than one day, span, points, daily or not.

    Works on counts per date, so repeated dates of one series are never gathered.
    """
    dates = df.groupBy(F.col(key).alias("unique_id"), F.to_date(ds).alias("ds")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("unique_id").orderBy("ds")
    gap = F.date_diff("ds", F.lag("ds").over(w))
    points, copies = F.sum("_n"), F.sum(F.col("_n") - 1)
    span = F.date_diff(F.max("ds"), F.min("ds")) + 1
    odd = F.count_if(F.col("_gap") != 1)
    return dates.withColumn("_gap", gap).groupBy("unique_id").agg(
        copies.alias("duplicates"), (span - points).alias("missing_dates"),
        (odd + copies).alias("irregular_gaps"), span.cast("long").alias("date_range_days"),
        points.alias("actual_data_points"),
        F.when((points >= 3) & (copies == 0) & (odd == 0), 1).otherwise(0).alias("is_daily"),
    )


def frequency_verify(diagnosis: DataFrame) -> DataFrame:
    """How many series are complete daily ones."""
    return diagnosis.agg(F.sum("is_daily").alias("daily_series"), F.count(F.lit(1)).alias("total_series"),
                         (F.avg("is_daily") * 100).alias("success_pct"))


def date_coverage(df: DataFrame, ds: str = "BILLING_DATE") -> DataFrame:
    """Date range, distinct dates and rows per day."""
    per_day = df.groupBy(F.to_date(ds).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(
        F.min("d").alias("min_date"), F.max("d").alias("max_date"),
        F.date_diff(F.max("d"), F.min("d")).alias("span_days"), F.count("d").alias("unique_dates"),
        F.avg("n").alias("avg_rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"))


def dimension_cardinality(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """Distinct members per dimension."""
    from tabloom.operators.profile import distinct_counts
    return distinct_counts(df, cols, approximate)


def history_length_stats(df: DataFrame, key: str, ds: str = "BILLING_DATE") -> DataFrame:
    """Number of series and the min, median and max of their distinct days."""
    days = df.groupBy(key).agg(F.count_distinct(ds).alias("days"))
    mid = quantile_columns(days, ["days"], {"median_days": 0.5}).select("median_days").scalar()
    return days.agg(
        F.count(F.lit(1)).alias("series"), F.min("days").alias("min_days"), F.max("days").alias("max_days"),
    ).withColumn("median_days", mid)


def forecast_target_options(df: DataFrame, ds: str = "BILLING_DATE") -> DataFrame:
    """The three daily series one could forecast, from one daily aggregation."""
    day = df.groupBy(F.to_date(ds).alias("d")).agg(
        F.sum("TOTAL_NET_SALES").alias("daily_total_sales"),
        F.sum("TOTAL_BILLING_QTY").alias("daily_total_quantity"),
        F.count(F.lit(1)).cast("double").alias("daily_transaction_count"))
    long = day.unpivot(["d"], ["daily_total_sales", "daily_total_quantity", "daily_transaction_count"],
                       "option", "v")
    return long.groupBy("option").agg(F.min("d").alias("min_date"), F.max("d").alias("max_date"),
                                      F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


# ---------------------------------------------------------------- joins and top-k

def spine(panel: DataFrame) -> DataFrame:
    """All dates between each series' first and last one."""
    ends = panel.groupBy("unique_id").agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    return ends.select("unique_id", F.explode(F.sequence("_a", "_b")).alias("ds"))


def next_date() -> Column:
    """The date of a series' next row."""
    return F.lead("ds").over(Window.partitionBy("unique_id").orderBy("ds"))


def until_next(panel: DataFrame, after: str = "_next") -> DataFrame:
    """Every row repeated for its own date and the empty dates up to the next row: column `day`.

    The rows of a spine joined with the panel, but from one window over the panel, so the panel is
    computed once and not joined to itself.  Needs one row per series and date; `after` may
    already hold the next date.
    """
    rows = panel if after in panel.columns else panel.withColumn(after, next_date())
    last = F.coalesce(F.date_sub(F.col(after), 1), F.col("ds"))
    return rows.withColumn("day", F.explode(F.sequence(F.col("ds"), last))).drop(after)


def spine_left_join(panel: DataFrame) -> DataFrame:
    """Every date of every series, with the observations where there are any."""
    seen = lambda c: F.when(F.col("day") == F.col("ds"), F.col(c)).alias(c)
    rest = [c for c in panel.columns if c not in ("unique_id", "ds")]
    return until_next(panel).select("unique_id", F.col("day").alias("ds"), *[seen(c) for c in rest])


def join_actual_forecast(actual: DataFrame, forecast: DataFrame, yhat: str = "yhat") -> DataFrame:
    """Actual and forecast rows that share series and date, keys cast first."""
    typed = lambda d: d.withColumns({"ds": F.col("ds").try_cast("date"), "unique_id": F.col("unique_id").cast("string")})
    return typed(actual).join(typed(forecast).select("ds", "unique_id", yhat), ["ds", "unique_id"])


def null_dates(df: DataFrame) -> DataFrame:
    """Rows whose date cannot be read."""
    return df.agg(F.count_if(F.col("ds").try_cast("date").isNull()).alias("null_dates"))


def missing_dates(df: DataFrame, ds: str = "BILLING_DATE", key: str | None = None) -> DataFrame:
    """Calendar dates between first and last without any row, over all rows or per key."""
    keys = [key] if key else []
    seen = df.select(*keys, F.to_date(ds).alias("ds")).distinct()
    ends = seen.groupBy(*keys).agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias("ds")).join(seen, [*keys, "ds"], "left_anti")


def whole_units(panel: DataFrame) -> DataFrame:
    """The panel in whole currency units; sums of whole numbers do not depend on their order.

    Amounts have four decimals.  The shift by half of the last one keeps the cut off the grid.
    """
    return panel.withColumns({c: F.floor(F.col(c) + 0.00005).cast("double")
                              for c in MEASURES.values() if c in panel.columns})


def frequency_share(df: DataFrame, col: str) -> DataFrame:
    """Value → share of the non-null rows."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(col, (F.col("_n") / total).alias(f"{col}_frequency"))


def lookup_share(df: DataFrame, col: str) -> DataFrame:
    """Adds the share of each row's value; a null value has none."""
    return df.join(frequency_share(df, col), col, "left")


def top_n_series(panel: DataFrame, n: int = 20, value: str = "y") -> DataFrame:
    """The largest series by summed value."""
    return panel.groupBy("unique_id").agg(F.sum(value).alias("total")).orderBy(F.desc("total"), "unique_id").limit(n)


def best_series(metrics: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n smallest by a metric."""
    return metrics.filter(F.col(by).isNotNull()).orderBy(F.asc(by), "unique_id").limit(n)


def worst_series(metrics: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n largest by a metric."""
    return metrics.filter(F.col(by).isNotNull()).orderBy(F.desc(by), "unique_id").limit(n)


def series_with_most_points(rows: DataFrame, n: int = 3) -> DataFrame:
    """T4: the series with most evaluation rows."""
    return rows.groupBy("unique_id").agg(F.count(F.lit(1)).alias("points")).orderBy(F.desc("points"), "unique_id").limit(n)


def top_brands(df: DataFrame, n: int = 5, brand: str = "BRAND") -> DataFrame:
    """T5: the largest brands by sales; a missing brand competes as 'nan' and is then left out."""
    return (df.groupBy(F.coalesce(F.col(brand), F.lit("nan")).alias(brand))
            .agg(F.sum("TOTAL_NET_SALES").alias("sales"))
            .orderBy(F.desc("sales"), brand).limit(n).filter(F.col(brand) != "nan"))
