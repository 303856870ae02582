"""Window features of a series.

All features share one partitioning and one order, so Spark plans one shuffle and one sort
for all of them.  Rolling values are null until their window is full, and a feature with
parameter k needs a series longer than k.

A daily panel bounds a series by its days.  For finer data without such a bound,
`in_chunks` cuts a series into overlapping pieces and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tabloom.functions.ordering import with_position
from tabloom.functions.stats import corrected_kurtosis, corrected_skew, paired_corr

# Feature parameters.
LAGS = (1, 2, 3, 5, 7, 10, 14, 21, 30)
ROLLING = (3, 7, 14, 21, 30, 60, 90)
ALPHAS = (0.1, 0.3, 0.5, 0.7, 0.9)
DIFFS = (1, 2, 7, 14, 30)
AUTOCORR = (1, 7, 30)
SHORT_WINDOWS = (7, 14, 30)
MA_PAIRS = ((7, 30), (14, 60))
REGIME = (14, 30)


@dataclass(frozen=True)
class Series:
    """Which columns identify a series, order it and hold its value."""

    ids: tuple[str, ...] = ("unique_id",)
    time: str = "ds"
    value: str = "y"

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.ids)

    @property
    def ordered(self) -> WindowSpec:
        return self.whole.orderBy(self.time)

    def last(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def y(self) -> Column:
        return F.col(self.value)

    def length(self) -> Column:
        return F.count(F.lit(1)).over(self.whole)


PANEL = Series()


def spread(df: DataFrame, s: Series = PANEL) -> DataFrame:
    """Place whole series on all shuffle partitions.

    Rolling windows cost far more per byte than the byte-based merging of small partitions
    assumes.  This is the shuffle the windows need anyway, so it adds none.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *s.ids)


def _full(s: Series, n: int, value: Column, of: Column | None = None) -> Column:
    """`value` where the last n rows all exist and the series is longer than n."""
    filled = F.count(of if of is not None else s.y).over(s.last(n)) == n
    return F.when(filled & (s.length() > n), value)


def lags(df: DataFrame, s: Series = PANEL, periods=LAGS) -> DataFrame:
    """W1."""
    return df.withColumns({f"target_lag_{k}": F.lag(s.y, k).over(s.ordered) for k in periods})


def rolling_basic(df: DataFrame, s: Series = PANEL, windows=ROLLING) -> DataFrame:
    """Mean, sample std, min and max."""
    aggs = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.withColumns({
        f"rolling_{a}_{n}": _full(s, n, f(s.y).over(s.last(n))) for n in windows for a, f in aggs.items()})


def rolling_quantiles(df: DataFrame, s: Series = PANEL, windows=ROLLING) -> DataFrame:
    """Median and quartiles, linear; one sorted list per row and window."""
    out = df
    arrays = {f"_q_{n}": _full(s, n, F.percentile(s.y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
                               .over(s.last(n))) for n in windows}
    out = out.withColumns(arrays)
    names = ("q25", "median", "q75")
    out = out.withColumns({f"rolling_{m}_{n}": F.col(f"_q_{n}")[i] for n in windows for i, m in enumerate(names)})
    return out.drop(*arrays)


def rolling_shape(df: DataFrame, s: Series = PANEL, windows=ROLLING) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis; null without variance."""
    cols = {}
    for n in windows:
        varied = F.min(s.y).over(s.last(n)) < F.max(s.y).over(s.last(n))
        skew = corrected_skew(F.skewness(s.y).over(s.last(n)), F.lit(n))
        kurt = corrected_kurtosis(F.kurtosis(s.y).over(s.last(n)), F.lit(n))
        cols[f"rolling_skew_{n}"] = _full(s, n, F.when(varied, skew))
        cols[f"rolling_kurt_{n}"] = _full(s, n, F.when(varied, kurt))
    return df.withColumns(cols)


def distance_from_rolling(df: DataFrame, s: Series = PANEL, windows=ROLLING) -> DataFrame:
    """Value minus rolling mean and median; needs W2 and W3."""
    return df.withColumns({
        f"dist_from_{a}_{n}": s.y - F.col(f"rolling_{a}_{n}") for n in windows for a in ("mean", "median")})


def ewm(df: DataFrame, s: Series = PANEL, alphas=ALPHAS) -> DataFrame:
    """Adjusted exponentially weighted mean, and the distance from it.

    One fold over each series, which its days bound, carries the mean and the weight behind it for all
    rates at once.  A null value shrinks the weight and leaves the mean as it is; before the first value
    the mean is null.
    """
    rest = [c for c in df.columns if c not in s.ids]
    names = [f"ewm_{a}" for a in alphas]
    rows = df.select(*s.ids, F.struct(s.time, *[c for c in rest if c != s.time]).alias("_row"))
    whole = rows.groupBy(*s.ids).agg(F.array_sort(F.collect_list("_row"), lambda a, b: F.when(
        a[s.time] < b[s.time], -1).when(a[s.time] > b[s.time], 1).otherwise(0)).alias("_rows"))
    null, kind = F.lit(None).cast("double"), "array<struct<" + ",".join(f"`{n}`:double" for n in names) + ">>"
    start = F.struct(F.array(*[null] * len(names)).alias("mean"), F.array(*[F.lit(0.0)] * len(names)).alias("weight"),
                     F.array().cast(kind).alias("out"))

    def step(acc, x):
        v = x[s.value].cast("double")
        shrunk = [acc["weight"][i] * (1.0 - a) for i, a in enumerate(alphas)]
        mean = [F.when(v.isNull(), acc["mean"][i]).otherwise(
            (F.coalesce(acc["mean"][i], F.lit(0.0)) * w + v) / (w + 1.0)) for i, w in enumerate(shrunk)]
        weight = [F.when(v.isNull(), w).otherwise(w + 1.0) for w in shrunk]
        out = F.struct(*[m.alias(n) for m, n in zip(mean, names)])
        return F.struct(F.array(*mean).alias("mean"), F.array(*weight).alias("weight"), F.concat(acc["out"], F.array(out)).alias("out"))

    folded = whole.withColumn("_out", F.aggregate("_rows", start, step, lambda acc: acc["out"]))
    out = folded.select(*s.ids, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_out").alias("e"))).alias("_x")).select(
        *s.ids, "_x.r.*", "_x.e.*")
    return out.select(*df.columns, *[F.col(f"`{n}`") for n in names],
                      *[(s.y - F.col(f"`ewm_{a}`")).alias(f"dist_from_ewm_{a}") for a in alphas])


def differences(df: DataFrame, s: Series = PANEL, periods=DIFFS) -> DataFrame:
    """Difference, relative change (null on a zero base), change of the difference."""
    before = {k: F.lag(s.y, k).over(s.ordered) for k in periods}
    out = df.withColumns({
        **{f"diff_{k}": s.y - before[k] for k in periods},
        **{f"pct_change_{k}": F.try_divide(s.y, before[k]) - 1 for k in periods}})
    return out.withColumns({f"diff2_{k}": F.col(f"diff_{k}") - F.lag(f"diff_{k}", 1).over(s.ordered) for k in periods})


def autocorr(df: DataFrame, s: Series = PANEL, periods=AUTOCORR) -> DataFrame:
    """Correlation with the value k rows earlier, the same for all rows; 0 if undefined."""
    out = df.withColumns({f"_lag_{k}": F.lag(s.y, k).over(s.ordered) for k in periods})
    out = out.withColumns({
        f"autocorr_{k}": F.when(s.length() > k, F.coalesce(paired_corr(s.y, F.col(f"_lag_{k}"), s.whole), F.lit(0.0)))
        for k in periods})
    return out.drop(*[f"_lag_{k}" for k in periods])


def volatility(df: DataFrame, s: Series = PANEL, windows=SHORT_WINDOWS) -> DataFrame:
    """Rolling std of one-step returns."""
    out = df.withColumn("_ret", F.try_divide(s.y, F.lag(s.y, 1).over(s.ordered)) - 1)
    return out.withColumns({
        f"volatility_{n}": _full(s, n, F.stddev_samp("_ret").over(s.last(n)), F.col("_ret")) for n in windows
    }).drop("_ret")


def rolling_trend(df: DataFrame, s: Series = PANEL, windows=SHORT_WINDOWS) -> DataFrame:
    """Least-squares slope against the position."""
    out = df.withColumn("_idx", F.row_number().over(s.ordered).cast("double"))
    return out.withColumns({
        f"trend_{n}": _full(s, n, F.regr_slope(s.y, F.col("_idx")).over(s.last(n))) for n in windows}).drop("_idx")


def ma_ratio_diff(df: DataFrame, s: Series = PANEL, pairs=MA_PAIRS) -> DataFrame:
    """Short against long moving average; needs W2."""
    cols = {}
    for a, b in pairs:
        short, long = F.col(f"rolling_mean_{a}"), F.col(f"rolling_mean_{b}")
        cols[f"ma_ratio_{a}_{b}"] = F.try_divide(short, long + 1e-8)
        cols[f"ma_diff_{a}_{b}"] = short - long
    return df.withColumns(cols)


def zscore_regime(df: DataFrame, s: Series = PANEL, windows=REGIME, limit: float = 1.5) -> DataFrame:
    """Z against the rolling mean and std, and flags for high and low; needs W2."""
    out = df.withColumns({
        f"zscore_{n}": (s.y - F.col(f"rolling_mean_{n}")) / (F.col(f"rolling_std_{n}") + 1e-8) for n in windows})
    flag = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    return out.withColumns({
        **{f"regime_high_{n}": flag(F.col(f"zscore_{n}") > limit) for n in windows},
        **{f"regime_low_{n}": flag(F.col(f"zscore_{n}") < -limit) for n in windows}})


def all_features(df: DataFrame, s: Series = PANEL) -> DataFrame:
    """W1–W12 over one shuffle and one sort; the fold over whole series comes before the rows are sorted."""
    df = spread(df, s)
    for step in (ewm, lags, rolling_basic, rolling_quantiles, rolling_shape, distance_from_rolling, differences,
                 autocorr, volatility, rolling_trend, ma_ratio_diff, zscore_regime):
        df = step(df, s)
    return df


def seasonal_decompose(df: DataFrame, s: Series = PANEL, longest: int = 12) -> DataFrame:
    """Additive trend, seasonal and remainder; series above 24 rows, period 12.

    The trend is a centred moving average, 2×p for an even period; the seasonal is the mean of
    the detrended values per phase, centred on zero.
    """
    p = longest
    data = df.filter(s.y.isNotNull()).withColumn("_n", s.length()).filter(F.col("_n") > 2 * p)
    half = p // 2
    wide = s.ordered.rowsBetween(-half, half)
    full = F.count(s.y).over(wide) == 2 * half + 1
    ends = F.lag(s.y, half).over(s.ordered) + F.lead(s.y, half).over(s.ordered)
    total = F.sum(s.y).over(wide)
    mean = (total - 0.5 * ends) / p if p % 2 == 0 else total / p
    out = data.withColumn("trend", F.when(full, mean)).withColumn(
        "_phase", (F.row_number().over(s.ordered) - 1) % p).withColumn("_det", s.y - F.col("trend"))
    # placed by series already, so the phase windows need no shuffle and no join
    by_phase = Window.partitionBy(*s.ids, "_phase")
    out = out.withColumns({"_pm": F.avg("_det").over(by_phase), "_rows": F.count(F.lit(1)).over(by_phase)})
    centre = F.sum(F.col("_pm") / F.col("_rows")).over(s.whole) / p
    return (
        out.withColumn("seasonal", F.col("_pm") - centre)
        .withColumn("resid", s.y - F.col("trend") - F.col("seasonal"))
        .drop("_n", "_phase", "_det", "_pm", "_rows")
    )


def seasonality_strength(decomposed: DataFrame, s: Series = PANEL, limit: float = 0.3) -> DataFrame:
    """Share of seasonal and trend variance against the remainder, with flags."""
    v = decomposed.groupBy(*s.ids).agg(
        F.var_samp("seasonal").alias("_s"), F.var_samp("trend").alias("_t"), F.var_samp("resid").alias("_r"))
    share = lambda c: F.when(F.col("_r") > 0, F.col(c) / (F.col(c) + F.col("_r"))).otherwise(F.lit(0.0))
    out = v.select(*s.ids, share("_s").alias("seasonality_strength"), share("_t").alias("trend_strength"))
    flag = lambda c: F.when(F.col(c) > limit, 1).otherwise(0)
    return out.withColumns({"has_seasonality": flag("seasonality_strength"), "has_trend": flag("trend_strength")})


def fill_forward_back(df: DataFrame, cols: list[str], s: Series = PANEL) -> DataFrame:
    """Last known value, else the next known one.

    The backward fill runs on the reversed order: a frame that grows from the front costs one
    step per row, one that looks to the end costs the rest of the series per row.
    """
    past = s.ordered.rowsBetween(Window.unboundedPreceding, 0)
    future = s.whole.orderBy(F.desc(s.time)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past),
                                         F.last(c, ignorenulls=True).over(future)) for c in cols})


def lookback_windows(df: DataFrame, s: Series = PANEL, shortest: int = 10, longest: int = 60) -> DataFrame:
    """The previous L values and the next target, L = min(max(10, n // 20), 60) per series."""
    out = df.withColumn("lookback", F.least(F.greatest(F.lit(shortest), F.floor(s.length() / 20)), F.lit(longest))
                        .cast("int"))
    out = out.withColumn("_seen", F.collect_list(s.y).over(s.ordered.rowsBetween(-longest, -1)))
    return (
        out.filter(F.size("_seen") >= F.col("lookback"))
        .withColumn("inputs", F.slice("_seen", F.size("_seen") - F.col("lookback") + 1, F.col("lookback")))
        .select(*s.ids, s.time, "lookback", "inputs", s.y.alias("target"))
    )


def in_chunks(df: DataFrame, step: Callable[[DataFrame, Series], DataFrame], s: Series, lookback: int,
              bucket: Column | list[Column], chunk_rows: int = 1_000_000) -> DataFrame:
    """Run a backward-looking step on a series of any length without one task per series.

    Rows get their position from bucket counts; every chunk also receives the `lookback` rows
    before it, which feed its windows and are dropped again.  The length rule sees chunk
    lengths, so series are taken as longer than the lookback.
    """
    if lookback >= chunk_rows:
        raise ValueError("a chunk must be longer than the lookback")
    placed = with_position(df, list(s.ids), [s.time], bucket, name="_pos")
    own = F.floor(F.col("_pos") / chunk_rows)
    lends = F.col("_pos") % chunk_rows >= chunk_rows - lookback
    spread = placed.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.when(lends, F.array(own, own + 1)).otherwise(F.array(own))))
    piece = Series((*s.ids, "_chunk"), s.time, s.value)
    return step(spread, piece).filter(F.col("_chunk") == F.col("_own")).drop("_pos", "_own", "_chunk")
