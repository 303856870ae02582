"""Projections, filters, cleaning and sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import column_medians, hash_order
from tabloom.functions.stats import corrected_skew, finite, not_below_zero, numeric_columns

# The hierarchy that identifies a product, and the fillers for missing levels.
HIERARCHY = ("BRAND", "MH_SEGMENT", "MH_FAMILY", "MH_CLASS", "MH_BRICK")
FILLERS = {"BRAND": "UNKNOWN_BRAND"}
FILLER = "UNKNOWN"


def select_features(df: DataFrame, features: list[str]) -> DataFrame:
    """The ordered feature list; a missing one is an error."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing required features: {missing}")
    return df.select(*features)


def select_features_default(df: DataFrame, features: list[str], default: float = 0.0) -> DataFrame:
    """As P1, with absent features filled by a constant."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(default).alias(c) for c in features])


def rescale_drop(df: DataFrame, old: str, new: str, factor: float = 1e5) -> DataFrame:
    """`new = old / factor`, and `old` goes."""
    return df.withColumn(new, F.col(old) / F.lit(factor)).drop(old)


def to_panel(df: DataFrame, key: str | Column, ds: str, y: str, measures: dict[str, str] | None = None,
             ) -> DataFrame:
    """Rename to unique_id, ds, y (+ measures), cast, and drop rows without y."""
    key = F.col(key) if isinstance(key, str) else key
    cols = [key.cast("string").alias("unique_id"), F.to_date(F.col(ds)).alias("ds"),
            F.col(y).try_cast("double").alias("y")]
    cols += [F.col(src).try_cast("double").alias(dst) for src, dst in (measures or {}).items()]
    return df.select(*cols).dropna(subset=["y"])


def fill_constant(df: DataFrame, cols: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """Missing hierarchy levels become a named level."""
    return df.fillna({c: FILLERS.get(c, FILLER) for c in cols if c in df.columns})


def composite_key(cols: tuple[str, ...] = HIERARCHY) -> Column:
    """P5: the levels joined by ' | '; a missing level shows as its filler, it is never skipped."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit(FILLERS.get(c, FILLER)))
                                for c in cols])


def clamp_negative(df: DataFrame, cols: list[str]) -> DataFrame:
    """Negative values become 0, nulls stay null."""
    return df.withColumns({c: not_below_zero(c) for c in cols})


def coerce_number(c: str | Column) -> Column:
    """A number, or null where the text is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def coerce_date(c: str | Column) -> Column:
    """A date, or null where the text is none."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("date")


def numeric_target(df: DataFrame, target: str) -> DataFrame:
    """The target as a number with missing values at the exact median."""
    typed = df.withColumn(target, coerce_number(target))
    median = column_medians(typed, [target]).first()[target]
    return typed.withColumn(target, F.coalesce(F.col(target), F.lit(median)))


def split_null_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and rows without a target."""
    return df.filter(F.col(target).isNotNull()), df.filter(F.col(target).isNull())


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """P10: the rows fit for training."""
    return df.filter(F.col(target).isNotNull())


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest in `order`.

    An aggregate and not a window: partial aggregation keeps one candidate per task, so a key
    with very many copies is never gathered.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def clean_engineered(df: DataFrame, new_cols: list[str]) -> DataFrame:
    """In the new numeric columns infinite → null → exact median."""
    cols = [c for c in new_cols if c in numeric_columns(df)]
    cleaned = df.withColumns({c: finite(F.col(c)) for c in cols})
    medians = column_medians(cleaned, cols).first()
    return cleaned.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in cols})


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """N rows without replacement, reproducible: the n smallest key hashes."""
    order = hash_order(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), seed)
    return df.orderBy(order, *key).limit(n)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*[F.asc(c) for c in order]).limit(n)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows in a stated order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def min_history_filter(df: DataFrame, key: str, ds: str, min_days: int = 60) -> DataFrame:
    """Rows of the series with enough distinct dates."""
    days = df.groupBy(key).agg(F.count_distinct(ds).alias("_days"))
    return df.join(days.filter(F.col("_days") >= min_days).select(key), key, "left_semi")


def nonzero_filter(df: DataFrame, y: str = "y") -> DataFrame:
    """Only the days with sales."""
    return df.filter(F.col(y) > 0)


# ---------------------------------------------------------------- derived columns

def price_ratios(net: str = "TOTAL_NET_SALES", qty: str = "TOTAL_BILLING_QTY",
                 discount: str = "TOTAL_DISCOUNT", gross: str = "TOTAL_GROSS_SALES",
                 margin: str = "TOTAL_GROSS_MARGIN") -> dict[str, Column]:
    """three ratios; a zero denominator counts as 1."""
    def over(a: str, b: str) -> Column:
        return F.col(a) / F.when(F.col(b) == 0, F.lit(1.0)).otherwise(F.col(b))
    return {"avg_selling_price": over(net, qty), "discount_rate": over(discount, gross),
            "margin_rate": over(margin, net)}


@dataclass(frozen=True)
class Feature:
    """One engineered column: square, product, ratio, bin or log of existing ones."""

    kind: str
    a: str
    b: str | None = None
    edges: tuple[float, ...] = ()

    @property
    def name(self) -> str:
        return {"square": f"{self.a}_squared", "product": f"{self.a}_{self.b}",
                "ratio": f"{self.a}_per_{self.b}", "bin": f"{self.a}_binned",
                "log": f"{self.a}_log"}[self.kind]

    def column(self) -> Column:
        a = F.col(self.a).cast("double")
        if self.kind == "square":
            return a * a
        if self.kind == "product":
            return a * F.col(self.b)
        if self.kind == "ratio":
            return F.try_divide(a, F.col(self.b).cast("double"))
        if self.kind == "log":
            return F.log1p(F.greatest(a, F.lit(0.0)))
        out = F.lit(0)
        for edge in self.edges:
            out = out + F.when(a >= edge, F.lit(1)).otherwise(F.lit(0))
        return F.when(a.isNotNull(), out)


def engineered_features(df: DataFrame, features: list[Feature]) -> DataFrame:
    """adds the listed columns; rows and existing columns stay as they are."""
    return df.withColumns({f.name: f.column() for f in features if f.name not in df.columns})


def log_skewed_target(df: DataFrame, target: str, limit: float = 1.0) -> tuple[DataFrame, bool]:
    """log1p of the target when its corrected skewness exceeds the limit.

    The flag tells the scorer to invert predictions with expm1.
    """
    t = F.col(target).cast("double")
    skew = df.agg(corrected_skew(F.skewness(t), F.count(t)).alias("s")).first()["s"]
    use = skew is not None and abs(skew) > limit
    return (df.withColumn(target, F.log1p(t)) if use else df), use
