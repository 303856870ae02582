"""Cleaning of text responses and algorithm names in them."""

from __future__ import annotations

from difflib import get_close_matches

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that responses use for each regression algorithm, in order of preference.
REGRESSION_ALIASES = {
    "random forest": "RandomForestRegressor",
    "gradient boosting": "GradientBoostingRegressor",
    "linear regression": "LinearRegression",
    "knn": "KNeighborsRegressor",
    "k-neighbors": "KNeighborsRegressor",
    "decision tree": "DecisionTreeRegressor",
}
REGRESSION_NAMES = ("RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression",
                    "KNeighborsRegressor", "DecisionTreeRegressor")
REGRESSION_DEFAULTS = ("RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression")

# The same for classification, clustering and series.
CLASSIFICATION_ALIASES = {
    "random forest": "RandomForestClassifier",
    "gradient boosting": "GradientBoostingClassifier",
    "logistic regression": "LogisticRegression",
    "svc": "SVC",
    "support vector": "SVC",
    "knn": "KNeighborsClassifier",
    "k-neighbors": "KNeighborsClassifier",
    "decision tree": "DecisionTreeClassifier",
}
CLASSIFICATION_NAMES = ("RandomForestClassifier", "GradientBoostingClassifier", "LogisticRegression", "SVC",
                        "KNeighborsClassifier", "DecisionTreeClassifier")
CLASSIFICATION_DEFAULTS = ("RandomForestClassifier", "GradientBoostingClassifier", "LogisticRegression")
CLUSTERING_ALIASES = {"kmeans": "KMeans", "k-means": "KMeans", "dbscan": "DBSCAN", "agglomerative": "AgglomerativeClustering"}
CLUSTERING_NAMES = CLUSTERING_DEFAULTS = ("KMeans", "DBSCAN", "AgglomerativeClustering")
SERIES_ALIASES = {
    "arima": "ARIMA",
    "sarima": "SARIMA",
    "sarimax": "SARIMAX",
    "prophet": "Prophet",
    "exponential smoothing": "ExponentialSmoothing",
    "holt winters": "HoltWinters",
    "holt-winters": "HoltWinters",
    "lstm": "LSTM",
    "gru": "GRU",
    "random forest": "RandomForestTS",
    "linear regression": "LinearRegressionTS",
    "xgboost": "XGBoostTS",
    "ets": "ETS",
    "seasonal naive": "SeasonalNaive",
    "moving average": "MovingAverage",
}
SERIES_NAMES = ("ARIMA", "SARIMA", "Prophet", "ExponentialSmoothing", "HoltWinters", "LSTM", "GRU", "RandomForestTS",
                "LinearRegressionTS", "XGBoostTS", "ETS", "SARIMAX", "SeasonalNaive", "MovingAverage")
SERIES_DEFAULTS = ("ARIMA", "Prophet", "LinearRegressionTS")

# Fixed value: what stands before a name in a list.
_LIST_MARKER = r"^\s*[\-•\d\.\)]*\s*"


def clean_response(text: Column | str) -> Column:
    """drop thinking blocks and code fences, keep the outermost {…}; null if there is none."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.trim(F.regexp_replace(t, r"(?s)<think>.*?</think>", ""))
    tail = lambda c: F.regexp_replace(c, r"```\s*$", "")
    t = (F.when(F.contains(t, F.lit("```json")), tail(F.regexp_replace(t, r"```json\s*", "")))
         .when(F.contains(t, F.lit("```")), tail(F.regexp_replace(t, r"```[a-zA-Z]*\s*", "")))
         .otherwise(t))
    found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parse_response(text: Column | str, schema: str) -> Column:
    """the named fields of the cleaned response; unreadable JSON gives null fields."""
    return F.from_json(clean_response(text), schema, {"mode": "PERMISSIVE"})


def closest_names(names: tuple[str, ...], cutoff: float = 0.6):
    """A function of an array of lines: per line the name with the greatest share of matching blocks, null below the cutoff.

    The share is twice the letters in matching blocks, the longest common block first and then those on both sides of it,
    over the letters of both; capitals differ from small letters.  Ties go to the later name.
    """

    @F.pandas_udf("array<string>")
    def closest(lines: pd.Series) -> pd.Series:
        def of(line):
            found = get_close_matches(line, names, n=1, cutoff=cutoff)
            return found[0] if found else None

        return pd.Series([None if x is None else [of(line) for line in x] for x in lines], dtype=object)

    return closest


def _resolve_line(line: Column, near: Column, aliases: dict[str, str]) -> Column:
    out = near
    for alias, name in reversed(list(aliases.items())):
        out = F.when(F.contains(line, F.lit(alias)), F.lit(name)).otherwise(out)
    return out


def resolve_algorithms(text: Column | str, aliases: dict[str, str] = REGRESSION_ALIASES,
                       names: tuple[str, ...] = REGRESSION_NAMES, defaults: tuple[str, ...] = REGRESSION_DEFAULTS,
                       most: int = 4, least: int = 2, cutoff: float = 0.6) -> Column:
    """F16: canonical names found line by line, distinct, topped up with defaults, at most four.

    A line that contains no alias is compared with the names by matching blocks.
    """
    t = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.lower(F.trim(x)), _LIST_MARKER, ""))
    lines = F.filter(lines, lambda x: (F.length(x) > 0) & ~F.contains(x, F.lit("<think>")) & ~F.contains(x, F.lit("</think>")))
    named = F.zip_with(lines, closest_names(names, cutoff)(lines), lambda x, near: _resolve_line(x, near, aliases))
    found = F.array_distinct(F.filter(named, lambda n: n.isNotNull()))
    extra = F.array(*[F.lit(d) for d in defaults])
    full = F.when(F.size(found) < least, F.array_distinct(F.concat(found, extra))).otherwise(found)
    return F.slice(full, 1, most)
