"""Deterministic choice of target, features and algorithms.

The rules read profile tables with one row per column.  Only those tables reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.ordering import column_medians, quantile_columns, with_position
from tabloom.functions.stats import describe_dtype, numeric_columns, paired_corr, text_columns, unpivot
from tabloom.operators.prep import label_encode
from tabloom.operators.profile import _tall, distinct_counts
from tabloom.session import durable

# Name parts that mark likely targets and time columns.
REGRESSION_WORDS = (
    "price", "value", "cost", "amount", "income", "salary", "revenue", "sales", "score", "rating", "age",
    "weight", "height", "distance", "duration", "volume", "area", "size", "total", "sum", "average", "mean", "median",
)
CLASS_WORDS = (
    "class", "category", "type", "status", "label", "outcome", "result", "grade", "level", "group", "segment",
    "tier", "rating", "risk", "approval", "decision", "churn", "fraud", "spam", "sentiment",
)
SERIES_WORDS = ("sales", "price", "demand", "volume", "count", "amount")
TIME_WORDS = ("date", "time", "timestamp", "day", "month", "year", "period")
ID_WORDS = ("id", "index", "key", "uuid", "guid")
# Fixed value: the column that always is the target where it exists.
HOUSE_TARGET = "median_house_value"


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """What the rules need to know per column; `variance` is null for text and dates."""
    numbers = set(numeric_columns(df))
    tall = _tall(df, df.columns, {
        "n": lambda c: F.count(F.lit(1)), "missing": lambda c: F.count_if(c.isNull()),
        "variance": lambda c: F.var_samp(c.cast("double")),
    }, numbers_only=("variance",))
    types = {f.name: describe_dtype(f) for f in df.schema.fields}
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("column")]
    out = tall.join(distinct_counts(df, df.columns, approximate), "column")
    return out.withColumns({
        "position": lookup({c: i for i, c in enumerate(df.columns)}), "dtype": lookup(types),
        "unique_ratio": F.try_divide(F.col("nunique"), F.col("n")),
        "missing_share": F.coalesce(F.try_divide(F.col("missing"), F.col("n")), F.lit(0.0)),
        "is_numeric": lookup({c: int(c in numbers) for c in df.columns}),
        "is_text": lookup({f.name: int(isinstance(f.dataType, T.StringType)) for f in df.schema.fields}),
    })


def has_word(words: tuple[str, ...], name: str = "column") -> Column:
    """the lower-cased name contains one of the words."""
    return F.lower(F.col(name)).rlike("|".join(words))


def word_hits(words: tuple[str, ...], name: str = "column") -> Column:
    """F12, time-series rule: how many of the words the name contains."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(F.lower(F.col(name)), F.lit(w)), 1).otherwise(0)
    return total


def name_keyword_score(profile: DataFrame) -> DataFrame:
    """+10 once per rule, and +10 per word for the time-series rule."""
    once = lambda words: F.when(has_word(words), 10).otherwise(0)
    return profile.select("column", once(REGRESSION_WORDS).alias("regression"), once(CLASS_WORDS).alias("classification"),
                          (word_hits(SERIES_WORDS) * 10).alias("time_series"))


def date_like_strings(df: DataFrame, cols: list[str] | None = None, sample: int = 10) -> DataFrame:
    """text columns whose first ten distinct-ordered values mostly look like dates.

    The sample is the ten smallest values, so that the answer does not depend on file order.
    """
    cols = cols or text_columns(df)
    long = unpivot(df, cols, "string").filter(F.col("value").isNotNull())
    first = Window.partitionBy("column").orderBy("value")
    few = long.distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= sample)
    like = (F.length("value") >= 8) & F.col("value").rlike(r"[-/.]") & F.col("value").rlike(r"\d")
    return few.groupBy("column").agg(F.avg(F.when(like, 1.0).otherwise(0.0)).alias("share")).withColumn(
        "date_like", F.when(F.col("share") >= 0.7, 1).otherwise(0))


# ---------------------------------------------------------------- targets

def problem_type_for_target(profile: DataFrame) -> DataFrame:
    """Numeric with more than 20 distinct values → regression, else classification."""
    return profile.select("column", F.when((F.col("is_numeric") == 1) & (F.col("nunique") > 20), "regression")
                          .otherwise("classification").alias("problem_type"))


def infer_problem_generic(profile: DataFrame) -> DataFrame:
    """Target and problem type from names, else from the last column, as one row."""
    low = F.lower(F.col("column"))
    flag = lambda cond: F.max(F.when(cond, 1).otherwise(0))
    first = lambda cond: F.min_by(F.when(cond, F.col("column")), F.when(cond, F.col("position")))
    is_class = low.rlike("class|label")
    found = profile.agg(
        flag(F.col("column") == HOUSE_TARGET).alias("house"), flag(low == "price").alias("price"),
        flag(low == "target").alias("target"), flag(is_class).alias("class"),
        first(low.contains("price")).alias("price_col"), first(low.contains("target")).alias("target_col"),
        first(is_class).alias("class_col"), F.max_by("column", "position").alias("last_col"))
    pick = (F.when(F.col("house") == 1, HOUSE_TARGET).when(F.col("price") == 1, F.col("price_col"))
            .when(F.col("target") == 1, F.col("target_col")).when(F.col("class") == 1, F.col("class_col"))
            .otherwise(F.col("last_col")))
    named = (F.when((F.col("house") == 1) | (F.col("price") == 1), "regression").when(F.col("target") == 1, None)
             .when(F.col("class") == 1, "classification"))
    chosen = found.select(pick.alias("column"), named.alias("_named"))
    return chosen.join(problem_type_for_target(profile), "column").select(
        F.col("column").alias("target"), F.coalesce("_named", "problem_type").alias("problem_type"))


def score_regression_targets(profile: DataFrame) -> DataFrame:
    """R2: numeric columns by fitness as a regression target."""
    score = (
        F.when(has_word(REGRESSION_WORDS), 10.0).otherwise(0.0)
        + F.when(F.col("unique_ratio") > 0.01, F.col("unique_ratio") * 5).otherwise(0.0)
        + F.when(F.col("variance") > 0, F.least(F.log(F.col("variance") + 1), F.lit(5.0))).otherwise(0.0)
        + F.when(F.col("missing_share") < 0.1, 2.0).otherwise(0.0))
    return profile.filter("is_numeric = 1").select("column", "position", score.alias("score")).orderBy(
        F.desc("score"), "position")


def score_classification_targets(profile: DataFrame) -> DataFrame:
    """Columns by fitness as a classification target."""
    score = (
        F.when(has_word(CLASS_WORDS), 10).otherwise(0) + F.when(F.col("nunique").between(2, 50), 8).otherwise(0)
        + F.when(F.col("unique_ratio") < 0.1, 5).otherwise(0) + F.when(F.col("missing_share") < 0.1, 2).otherwise(0)
        + F.when(F.col("is_text") == 1, 3).otherwise(0))
    return profile.select("column", "position", score.alias("score")).orderBy(F.desc("score"), "position")


def validate_regression_target(profile: DataFrame) -> DataFrame:
    """The strict and the light test."""
    valid = F.col("n") - F.col("missing")
    strict = ((F.col("is_numeric") == 1) & (F.col("variance") >= 1e-10) & (F.col("nunique") >= 10)
              & (F.try_divide("nunique", valid) >= 0.05) & (F.col("missing_share") <= 0.3))
    light = (F.col("is_numeric") == 1) & (F.col("unique_ratio") > 0.005) & (F.col("variance") > 1e-10)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return profile.select("column", flag(strict).alias("strict_ok"), flag(light).alias("light_ok"))


def validate_classification_target(profile: DataFrame) -> DataFrame:
    """2 to 50 classes that are no more than half of the rows."""
    ok = F.col("nunique").between(2, 50) & (F.col("unique_ratio") < 0.5)
    return profile.select("column", F.when(ok, 1).otherwise(0).alias("ok"))


def pick_two_targets(profile: DataFrame) -> DataFrame:
    """The two best-populated columns, numeric before text, earlier before later."""
    score = (F.when(F.col("is_numeric") == 1, 3).when(F.col("is_text") == 1, 2).otherwise(0)
             + F.when(F.col("missing_share") < 0.1, 2).when(F.col("missing_share") < 0.3, 1).otherwise(0))
    return profile.select("column", "position", score.alias("score")).orderBy(F.desc("score"), "position").limit(2)


def infer_time_and_target(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Time column, target and up to five features, one row per role."""
    likely = date_like_strings(df).filter("date_like = 1").select("column", F.lit(1).alias("_pattern")) if text_columns(df) \
        else profile.select("column", F.lit(0).alias("_pattern")).limit(0)
    p = profile.join(likely, "column", "left")
    named = has_word(TIME_WORDS) | (F.col("dtype") == "datetime")
    rank = F.when(named, F.col("position")).when(F.col("_pattern") == 1, F.col("position") + 1000).otherwise(
        F.col("position") + 1000000)
    time = p.orderBy(rank).limit(1).select("column", "position", F.lit("time").alias("role"))
    rest = profile.join(time.select("column"), "column", "left_anti")
    order = F.when(F.col("is_numeric") == 1, word_hits(SERIES_WORDS)).otherwise(-1)
    # without any numeric column the last column is the target
    target = rest.orderBy(F.desc(order), F.when(F.col("is_numeric") == 1, F.col("position")).otherwise(-F.col("position"))
                          ).limit(1).select("column", "position", F.lit("target").alias("role"))
    others = rest.join(target.select("column"), "column", "left_anti").orderBy("position").limit(5)
    return time.unionByName(target).unionByName(others.select("column", "position", F.lit("feature").alias("role")))


# ---------------------------------------------------------------- feature filters

def drop_id_like(profile: DataFrame, target: str, regression: bool = True, cap: int = 20, least: int = 5) -> DataFrame:
    """The features left after dropping id-like and (for regression) high-cardinality text.

    If nothing is left, the first five columns are used.
    """
    others = profile.filter(F.col("column") != target)
    bad = has_word(ID_WORDS) & (F.col("nunique") > 0.8 * F.col("n"))
    if regression:
        bad = bad | ((F.col("is_text") == 1) & (F.col("nunique") > F.least(F.lit(100.0), 0.5 * F.col("n"))))
    good = others.filter(~bad).orderBy("position").limit(cap)
    first = others.orderBy("position").limit(least)
    marked = good.select("column", "position", F.lit(1).alias("_ok")).unionByName(
        first.select("column", "position", F.lit(0).alias("_ok")))
    best = F.max("_ok").over(Window.partitionBy(F.lit(1)))
    return marked.withColumn("_best", best).filter("_ok = _best").select("column", "position")


def target_correlation(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """(column, corr): |r| with the target, all columns in one aggregation."""
    return _tall(df, cols, {"corr": lambda c: F.abs(paired_corr(c, F.col(target)))})


def _encoded(df: DataFrame, cols: list[str]) -> DataFrame:
    words = [c for c in text_columns(df) if c in cols]
    return label_encode(df, words) if words else df


def filter_features_generic(df: DataFrame, profile: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Kept flag and the first reason that excludes each feature.

    If fewer than max(3, 20 %) survive, the 15 most correlated features are kept instead.
    """
    numbers = [c for c in numeric_columns(df) if c in features]
    corr = target_correlation(df, target, numbers)
    t = profile.filter(F.col("column").isin(features)).join(corr, "column", "left")
    high = (F.col("is_text") == 1) & (F.col("nunique") > F.least(F.lit(100.0), 0.5 * F.col("n")))
    reason = (F.when(F.col("missing_share") > 0.5, "missing").when(F.col("nunique") <= 1, "constant")
              .when(high, "high_cardinality").when(F.col("variance") < 1e-8, "near_zero_variance")
              .when(F.col("corr") < 0.01, "low_correlation"))
    return _recover(t.withColumn("reason", reason), "corr", max(3, len(features) * 0.2), min(15, len(features)))


def _recover(t: DataFrame, by: str, fewest: float, top: int) -> DataFrame:
    """Kept = no reason; with too few survivors kept = the best `top` by a score."""
    everyone = Window.partitionBy(F.lit(1))
    ranked = everyone.orderBy(F.desc_nulls_last(by), "position")
    survivors = F.count_if(F.col("reason").isNull()).over(everyone)
    kept = F.when(survivors >= fewest, F.col("reason").isNull()).otherwise(
        (F.row_number().over(ranked) <= top) & F.col(by).isNotNull())
    return t.withColumn("kept", kept.cast("int"))


def mutual_information(df: DataFrame, target: str, features: list[str], classes: bool, bins: int = 10) -> DataFrame:
    """Plug-in dependency between each feature and the target.

    Numbers are cut at exact quantiles, text is taken as it is.  One aggregation over
    (column, bin, class) gives all joint counts.  The values differ from a nearest-neighbour
    estimate; the order of features is comparable.
    """
    cut = [c for c in numeric_columns(df) if c in features or (c == target and not classes)]
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    edges = {r["column"]: sorted({r[q] for q in probs if r[q] is not None})
             for r in quantile_columns(df, cut, probs).collect()} if cut else {}

    def binned(c: str) -> Column:
        if c not in edges:
            return F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        above = F.lit(0)
        for e in edges[c]:
            above = above + F.when(F.col(c).cast("double") > F.lit(e), 1).otherwise(0)
        return F.when(F.col(c).isNull(), "missing").otherwise(above.cast("string"))

    y = F.col(target).cast("string") if classes else binned(target)
    rows = df.select(y.alias("_y"), *[binned(c).alias(c) for c in features])
    joint = rows.unpivot(["_y"], features, "column", "bin").groupBy("column", "bin", "_y").agg(
        F.count(F.lit(1)).alias("n"))
    px = joint.groupBy("column", "bin").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("column", "_y").agg(F.sum("n").alias("ny"))
    total = px.groupBy("column").agg(F.sum("nx").alias("nt"))
    all_ = joint.join(px, ["column", "bin"]).join(py, ["column", "_y"]).join(total, "column")
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))
    return all_.groupBy("column").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def _digamma(n: Column) -> Column:
    """The digamma function of a whole number above 0: six steps up, then the asymptotic series."""
    x = n.cast("double")
    z = x + 6
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    return series - sum((1 / (x + i) for i in range(6)), F.lit(0.0))


def nearest_information(df: DataFrame, target: str, features: list[str], k: int = 3, block: int = 1 << 16) -> DataFrame:
    """(column, mi), the nearest-neighbour estimate of what numeric features tell about a class.

    The radius of a row is the distance to its k-th nearest row of the same class (of fewer, the farthest);
    m counts the rows of all classes that lie nearer, the row itself included, or the equal ones where the
    radius is zero.  mi = psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), not below zero.

    Rows whose feature is null or no finite number or whose class is null, and classes of one row, play no
    part in a column; a column without rows is not listed.  Equal values are counted before they move.  Sorted
    values of a class are cut into blocks that overlap by k, so no class meets in one task, and m comes from
    running counts over ranges of values: no pair of rows is ever formed.
    """
    rows = df.select(F.col(target).alias("_cls"), *features)
    cells = unpivot(rows, features, "double", ("_cls",)).filter(F.col("_cls").isNotNull() & (F.abs("value") < float("inf")))
    # 0.0 turns -0.0 into 0.0: both are one value
    cells = cells.groupBy("column", F.col("_cls").alias("cls"), (F.col("value") + 0.0).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    cells = durable(cells.repartitionByRange("column", "cls", "value").withColumn("_p", F.spark_partition_id()), "cells")
    sizes = cells.groupBy("column", "cls").agg(F.sum("c").alias("n")).filter("n > 1")
    placed = with_position(cells, ["column", "cls"], ["value"], F.col("_p"), "pos").drop("_p").join(sizes, ["column", "cls"])
    home = F.floor(F.col("pos") / block)
    near = placed.withColumn("home", home).withColumn("block", F.explode(F.array_distinct(F.array(
        home, F.floor((F.col("pos") - k) / block), F.floor((F.col("pos") + k) / block)))))
    inside = Window.partitionBy("column", "cls", "block").orderBy("pos")
    rank = F.least(F.lit(k), F.col("n") - 1).cast("int")
    gap = lambda at: F.array_repeat(F.abs(at(F.col("value")) - F.col("value")), F.least(at(F.col("c")), F.lit(k)).cast("int"))
    gaps = [F.array_repeat(F.lit(0.0), F.least(F.col("c") - 1, F.lit(k)).cast("int"))]
    for j in range(1, k + 1):
        for step in (F.lag, F.lead):
            gaps.append(F.coalesce(gap(lambda x: step(x, j).over(inside)), F.array().cast("array<double>")))
    far = near.select("column", "cls", "value", "c", "n", "home", "block", rank.alias("k"),
                      F.array_sort(F.concat(*gaps)).alias("gaps")).filter("block = home")
    far = durable(far.select("column", "cls", "value", "c", "n", "k", F.element_at("gaps", F.col("k")).alias("r")), "radii")
    # at one value: ends that leave it out, the rows, ends that take it in
    none = F.lit(None)
    rows = far.groupBy("column", "value").agg(F.sum("c").alias("w")).select(
        "column", F.col("value").alias("at"), F.lit(1).alias("kind"), "w", none.cast("int").alias("sign"),
        none.cast(cells.schema["cls"].dataType).alias("cls"), none.cast("double").alias("value"))
    end = lambda at, kind, sign: far.select(
        "column", at.alias("at"), F.when(F.col("r") > 0, kind).otherwise(2 - kind).alias("kind"), F.lit(0).cast("long").alias("w"),
        F.lit(sign).alias("sign"), "cls", "value")
    ends = end(F.col("value") - F.col("r"), 2, -1).unionByName(end(F.col("value") + F.col("r"), 0, 1))
    events = durable(rows.unionByName(ends).repartitionByRange("column", "at", "kind").withColumn("_p", F.spark_partition_id()), "events")
    before = events.groupBy("column", "_p").agg(F.sum("w").alias("total")).select(
        "column", "_p", (F.sum("total").over(Window.partitionBy("column").orderBy("_p")) - F.col("total")).alias("before"))
    running = F.sum("w").over(Window.partitionBy("column", "_p").orderBy("at", "kind")) + F.col("before")
    counted = events.join(before, ["column", "_p"]).withColumn("upto", running).filter("sign is not null").groupBy(
        "column", "cls", "value").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    mean = lambda x: F.sum(F.col("c") * _digamma(x)) / F.sum("c")
    mi = _digamma(F.sum("c")) + mean(F.col("k")) - mean(F.col("n")) - mean(F.col("m"))
    return far.join(counted, ["column", "cls", "value"]).groupBy("column").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def filter_features_regression(df: DataFrame, profile: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Correlation on encoded text with the target's median filled in, and R13."""
    coded = _encoded(df.select(*features, target), features)
    numbers = [c for c in numeric_columns(df) if c in features]
    words = [c for c in features if c not in numbers]
    corr = target_correlation(df, target, numbers) if numbers else None
    if words:
        median = column_medians(df, [target]).first()[target]
        full = coded.withColumn(target, F.coalesce(F.col(target).cast("double"), F.lit(median)))
        text = target_correlation(full, target, words)
        corr = text if corr is None else corr.unionByName(text)
    mi = mutual_information(df.filter(F.col(target).isNotNull()), target, features, classes=False)
    t = profile.filter(F.col("column").isin(features)).join(corr, "column", "left").join(mi, "column", "left")
    high = (F.col("is_text") == 1) & (F.col("nunique") > F.least(F.lit(50.0), 0.3 * F.col("n")))
    reason = (F.when(F.col("missing_share") > 0.4, "missing").when(F.col("variance") < 1e-10, "near_zero_variance")
              .when((F.col("corr") < 0.05) & (F.col("mi") < 0.01), "weak").when(high, "high_cardinality"))
    scored = t.withColumns({"reason": reason, "_s": F.coalesce("corr", F.lit(0.0)) + F.coalesce("mi", F.lit(0.0))})
    return _recover(scored, "_s", 3, max(5, len(features) // 3)).drop("_s")


def filter_features_classification(df: DataFrame, profile: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Missing share, dependency on the class, cardinality, constants."""
    mi = mutual_information(df, target, features, classes=True)
    t = profile.filter(F.col("column").isin(features)).join(mi, "column", "left")
    high = (F.col("is_numeric") == 0) & (F.col("nunique") > F.least(F.lit(100.0), 0.3 * F.col("n")))
    reason = (F.when(F.col("missing_share") > 0.4, "missing").when(F.col("mi") < 0.01, "weak")
              .when(high, "high_cardinality").when(F.col("nunique") <= 1, "constant"))
    return _recover(t.withColumn("reason", reason), "mi", 3, max(5, len(features) // 3))


# ---------------------------------------------------------------- univariate scores

def f_scores(df: DataFrame, target: str, features: list[str], classes: bool) -> DataFrame:
    """F statistic per feature; nulls of numbers filled with the mean, text label-encoded."""
    coded = _encoded(df.select(*features, target), features)
    means = coded.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    full = coded.select(F.col(target).alias("_y"), *[
        F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) for c in features])
    if not classes:
        r = _tall(full, features, {"r": lambda c: paired_corr(c, F.col("_y")), "n": F.count})
        r2 = F.col("r") * F.col("r")
        return r.select("column", (F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).alias("f"))
    long = full.unpivot([F.col("_y")], features, "column", "v")
    per = long.groupBy("column", "_y").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    grand = per.groupBy("column").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    d = F.col("m") - F.col("g")
    sums = per.join(grand, "column").groupBy("column").agg(
        F.sum(F.col("n") * d * d).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"),
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("nt"))
    return sums.select("column", F.try_divide(F.col("between") / (F.col("k") - 1),
                                              F.col("within") / (F.col("nt") - F.col("k"))).alias("f"))


def select_k_best(scores: DataFrame, k: int = 12, by: str = "f") -> DataFrame:
    """The k best features."""
    return scores.orderBy(F.desc_nulls_last(by), "column").limit(k)


def chi2_score(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Per class the sum of the encoded values against the class share of the total."""
    filled = df.select(target, *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in features])
    coded = _encoded(filled, features)
    long = coded.unpivot([F.col(target)], features, "column", "v")
    per = long.groupBy("column", target).agg(F.sum("v").cast("double").alias("o"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("column").agg(F.sum("o").alias("t"), F.sum("n").alias("nt"))
    e = F.col("n") / F.col("nt") * F.col("t")
    return per.join(whole, "column").groupBy("column").agg(
        F.sum(F.try_divide((F.col("o") - e) * (F.col("o") - e), e)).alias("chi2"))


# ---------------------------------------------------------------- algorithms

def algorithm_defaults(kind: str, rows: int, features: int) -> list[str]:
    """The algorithms to try for a table of this size."""
    if kind == "regression":
        if rows < 1000:
            return ["LinearRegression", "Ridge", "KNeighborsRegressor"]
        if features > 0.1 * rows:
            return ["Ridge", "Lasso", "RandomForestRegressor"]
        return ["RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression"]
    if kind == "classification":
        if rows < 1000:
            return ["LogisticRegression", "KNeighborsClassifier", "GaussianNB"]
        return ["LogisticRegression", "RandomForestClassifier"] if features > 0.1 * rows else [
            "RandomForestClassifier", "LogisticRegression"]
    if kind == "autonomous":
        if rows > 10000:
            return ["XGBRegressor", "CatBoostRegressor", "RandomForestRegressor", "GradientBoostingRegressor"]
        if rows > 1000:
            return ["RandomForestRegressor", "XGBRegressor", "GradientBoostingRegressor", "Ridge"]
        return ["Ridge", "RandomForestRegressor", "LinearRegression", "ElasticNet"]
    if kind == "time_series":
        if rows < 50:
            return ["MovingAverage", "LinearRegressionTS", "ExponentialSmoothing"]
        if rows < 200:
            return ["ARIMA", "ExponentialSmoothing", "LinearRegressionTS"]
        return ["Prophet", "SARIMAX", "RandomForestTS", "LinearRegressionTS"] if features else [
            "ARIMA", "Prophet", "ExponentialSmoothing", "LSTM"]
    if kind == "clustering":
        return ["KMeans", "DBSCAN", "AgglomerativeClustering"]
    raise ValueError(f"unknown kind {kind!r}")


def complete_algorithms(found: list[str], kind: str, rows: int, features: int) -> list[str]:
    """At most 4 (5 for series) of the found ones, topped up when fewer than 2 (3)."""
    most, least = (5, 3) if kind == "time_series" else (4, 2)
    top_up = {"regression": ["RandomForestRegressor", "LinearRegression"],
              "classification": ["RandomForestClassifier", "LogisticRegression"],
              "time_series": ["ARIMA", "Prophet", "LinearRegressionTS"]}
    chosen = list(dict.fromkeys(found))[:most] or algorithm_defaults(kind, rows, features)
    if len(chosen) < least:
        chosen += [a for a in top_up.get(kind, algorithm_defaults(kind, rows, features)) if a not in chosen]
    return chosen
