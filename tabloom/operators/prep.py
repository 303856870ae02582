"""Imputation, encoding, scaling: fitted on one table, applied to others.

A fit returns small numbers (one per column) or, for categories, a mapping table.  Applying it
is a projection, plus one join per encoded column.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.ordering import column_medians, dense_number
from tabloom.functions.stats import numeric_columns, text_columns
from tabloom.operators.panel import frequency_share
from tabloom.operators.profile import top_values, value_counts, with_quantiles

#: Distinct categories that one task may number.
ONE_TASK_CATEGORIES = 1_000_000


# ---------------------------------------------------------------- X1 impute

def fit_impute(df: DataFrame, numeric: str = "mean", num_cols: list[str] | None = None,
               cat_cols: list[str] | None = None) -> dict:
    """Mean or exact median per numeric column, most frequent text (smallest on a tie)."""
    num_cols = numeric_columns(df) if num_cols is None else num_cols
    cat_cols = text_columns(df) if cat_cols is None else cat_cols
    fill: dict = {}
    if num_cols:
        if numeric == "mean":
            fill.update(df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in num_cols]).first().asDict())
        elif numeric == "median":
            fill.update(column_medians(df, num_cols).first().asDict())
        else:
            raise ValueError(f"unknown strategy {numeric!r}")
    if cat_cols:
        fill.update({r["column"]: r["value"] for r in top_values(df, cat_cols, 1).collect()})
    return fill


def apply_impute(df: DataFrame, fill: dict) -> DataFrame:
    cols = {}
    for c, v in fill.items():
        base = F.col(c).cast("double") if isinstance(v, (int, float)) else F.col(c)
        cols[c] = base if v is None else F.coalesce(base, F.lit(v))
    return df.withColumns(cols)


# ---------------------------------------------------------------- X2–X4 encode

def category_codes(df: DataFrame, cols: list[str], null_as: str = "nan") -> DataFrame:
    """(column, value, code) for all text columns from one scan, codes 0..k−1 in value order.

    A null is the text 'nan'.
    """
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null_as)).alias(c) for c in cols])
    values = value_counts(text, cols).select("column", "value")
    return dense_number(values, ["column"], "value", "code").select("column", "value", F.col("code").cast("long"))


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code) of one column."""
    return category_codes(df, [col]).select("value", "code")


def apply_codes(df: DataFrame, col: str, codes: DataFrame, null_as: str = "nan") -> DataFrame:
    """Replace a category by its code; an unseen one becomes null."""
    m = codes.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
    joined = df.withColumn("_v", F.coalesce(F.col(col).cast("string"), F.lit(null_as))).join(m, "_v", "left")
    return joined.withColumn(col, F.col("_code")).drop("_v", "_code").select(*df.columns)


def apply_all_codes(df: DataFrame, cols: list[str], codes: DataFrame) -> DataFrame:
    for c in cols:
        df = apply_codes(df, c, codes.filter(F.col("column") == c))
    return df


def label_encode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """X2 on its own data."""
    cols = cols or text_columns(df)
    return apply_all_codes(df, cols, category_codes(df, cols)) if cols else df


def frequency_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """The share of each value among the non-null rows."""
    for c in cols:
        df = df.join(frequency_share(df, c), c, "left")
    return df


def one_hot_top(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Flags for the k most frequent values."""
    top = [r["value"] for r in top_values(df, [col], k).orderBy("rank").collect()]
    flag = lambda v: F.when(F.col(col) == v, F.lit(1)).otherwise(F.lit(0))
    return df.withColumns({f"{col}_{v}": flag(v) for v in top})


# ---------------------------------------------------------------- X5–X7 scale

def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std, a std of 0 counting as 1."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols)
                   for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def apply_standard(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in fit.items()})


def fit_min_max(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Range of the training part."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols)
                      for n, f in (("a", F.min), ("b", F.max))]).first()
    return {c: (row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0) for i, c in enumerate(cols)}


def apply_min_max(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside the training range leave 0..1; a constant column becomes 0."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(a)) / F.lit((b - a) or 1.0) for c, (a, b) in fit.items()})


def outlier_to_median(df: DataFrame, cols: list[str], limit: float = 3.0) -> DataFrame:
    """Values more than three population stds from the mean become the column's median."""
    fit = fit_standard(df, cols)
    medians = column_medians(df, cols).first()
    far = lambda c: F.abs((F.col(c).cast("double") - F.lit(fit[c][0])) / F.lit(fit[c][1])) > limit
    return df.withColumns({c: F.when(far(c), F.lit(medians[c])).otherwise(F.col(c).cast("double")) for c in cols})


# ---------------------------------------------------------------- X8 plan

# Name parts of algorithms that need scaled inputs.
SCALE_SENSITIVE = ("logistic", "svc", "svm", "kneighbors", "neural", "perceptron")


def preprocess_plan(profile: DataFrame, algorithms: list[str]) -> DataFrame:
    """The steps a table needs, from its profile (A1) and the chosen algorithms."""
    scaled = any(part in a.lower() for a in algorithms for part in SCALE_SENSITIVE)
    found = profile.agg(
        (F.sum("missing") > 0).alias("imputation"), (F.count_if(F.col("dtype") == "object") > 0).alias("encoding"),
        F.lit(scaled).alias("scaling"), (F.count_if(F.col("dtype").isin("int", "float")) > 0).alias("outlier_handling"))
    steps = ["imputation", "encoding", "scaling", "outlier_handling"]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("step"), F.col(s).alias("needed"))
                     for i, s in enumerate(steps)])
    return found.select(F.inline(rows)).filter("needed").drop("needed")


# ---------------------------------------------------------------- X9, X10 fitted object

def _filled_scale(df: DataFrame, cols: list[str]) -> tuple[dict, dict]:
    """Medians, and mean and population std after filling nulls with the median, from one profile.

    Filling adds `gaps` copies of the median, which moves mean and variance by a closed formula.
    """
    stats = {"n": lambda c: F.count(F.lit(1)), "valid": F.count, "mean": lambda c: F.avg(c.cast("double")),
             "var": lambda c: F.var_pop(c.cast("double"))}
    medians, scale = {}, {}
    for r in with_quantiles(df, cols, stats, {"median": 0.5}).collect():  # one row per column
        n, valid, mid = r["n"], r["valid"], r["median"] or 0.0
        mean, var, gaps = r["mean"] or 0.0, r["var"] or 0.0, r["n"] - r["valid"]
        new = (valid * mean + gaps * mid) / n if n else 0.0
        spread = (valid * (var + (mean - new) ** 2) + gaps * (mid - new) ** 2) / n if n else 0.0
        medians[r["column"]], scale[r["column"]] = mid, (new, spread ** 0.5 or 1.0)
    return medians, scale


@dataclass
class Preprocessor:
    """Encode, fill with the median, standardise — fitted once and kept.

    X10: scoring uses this object; encoders are not fitted again on the data to score.
    """

    features: list[str]
    text: list[str]
    medians: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    codes: DataFrame | None = None

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> "Preprocessor":
        text = [c for c in text_columns(df) if c in features]
        out = cls(features, text, codes=category_codes(df, text) if text else None)
        out.medians, out.scale = _filled_scale(out._encode(df), features)
        return out

    def _encode(self, df: DataFrame) -> DataFrame:
        return apply_all_codes(df, self.text, self.codes) if self.text else df

    def transform(self, df: DataFrame) -> DataFrame:
        """All other columns stay; the features become standardised doubles."""
        return apply_standard(apply_impute(self._encode(df), self.medians), self.scale)

    def save(self, spark: SparkSession, path: str) -> None:
        meta = json.dumps({"features": self.features, "text": self.text, "medians": self.medians, "scale": self.scale})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        if self.text:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        codes = spark.read.parquet(f"{path}/codes") if meta["text"] else None
        scale = {c: tuple(v) for c, v in meta["scale"].items()}
        return cls(meta["features"], meta["text"], meta["medians"], scale, codes)
