"""Queries: preprocessing, target and feature rules, text responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import text as X
from tabloom.operators import prep as E
from tabloom.operators import rules as R
from tabloom.operators.profile import dataset_profile
from tabloom.plans.q_profile import PART, part_with_gaps
from tabloom.plans.registry import BRAND_KEY, RETAIL, query, rnd
from tabloom.sources.tables import retail_sales, table

_T = f"WITH t AS ({PART}) "


@query("X1_impute_mean", rnd(_T + """SELECT p_partkey, coalesce(p_brand, (SELECT p_brand FROM t WHERE p_brand IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_brand, coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM t))
    AS p_retailprice FROM t""", "p_retailprice"))
def x1(spark, sf):
    d = part_with_gaps(spark, sf).select("p_partkey", "p_brand", "p_retailprice")
    return E.apply_impute(d, E.fit_impute(d, "mean", ["p_retailprice"], ["p_brand"]))


@query("X1_impute_median", rnd(_T + """SELECT p_partkey, coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5)
    FROM t)) AS p_retailprice FROM t""", "p_retailprice"))
def x1b(spark, sf):
    d = part_with_gaps(spark, sf).select("p_partkey", "p_retailprice")
    return E.apply_impute(d, E.fit_impute(d, "median", ["p_retailprice"], []))


@query("X2_label_encode", _T + """SELECT p_partkey, (SELECT count(DISTINCT coalesce(p_brand, 'nan')) FROM t b
    WHERE coalesce(b.p_brand, 'nan') < coalesce(t.p_brand, 'nan')) AS p_brand, c - 1 AS p_name FROM t
  JOIN (SELECT p_name AS pn, row_number() OVER (ORDER BY p_name) AS c FROM (SELECT DISTINCT p_name FROM t)) ON pn = p_name""")
def x2(spark, sf):
    return E.label_encode(part_with_gaps(spark, sf).select("p_partkey", "p_brand", "p_name"))


@query("X3_frequency_encode", rnd(_T + """SELECT p_partkey, t.p_brand, t.p_type, fb AS p_brand_frequency, ft AS p_type_frequency FROM t
  LEFT JOIN (SELECT p_brand, count(*) / (SELECT count(p_brand) FROM t) AS fb FROM t GROUP BY 1) b ON b.p_brand = t.p_brand
  LEFT JOIN (SELECT p_type, count(*) / (SELECT count(p_type) FROM t) AS ft FROM t GROUP BY 1) k ON k.p_type = t.p_type""",
  "p_brand_frequency p_type_frequency", 8), 8)
def x3(spark, sf):
    return E.frequency_encode(part_with_gaps(spark, sf).select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


@query("X4_one_hot_top5", """WITH top AS (SELECT c_mktsegment AS v FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
  SELECT c_custkey, c_mktsegment, """ + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' AND '{s}' IN (SELECT v FROM top) THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\""
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def x4(spark, sf):
    return E.one_hot_top(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


_LK = "l_orderkey, l_linenumber, l_partkey"


@query("X5_standardise", rnd(f"""SELECT {_LK}, (l_quantity - (SELECT avg(l_quantity) FROM lineitem))
  / (SELECT stddev_pop(l_quantity) FROM lineitem) AS l_quantity, (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))
  / (SELECT stddev_pop(l_extendedprice) FROM lineitem) AS l_extendedprice FROM lineitem""", "l_quantity l_extendedprice", 7), 7)
def x5(spark, sf):
    d = table(spark, sf, "lineitem").select(*_LK.split(", "), "l_quantity", "l_extendedprice")
    return E.apply_standard(d, E.fit_standard(d, ["l_quantity", "l_extendedprice"]))


@query("X6_min_max", rnd("""WITH s AS (SELECT *, CAST('0x' || substr(md5('42|' || o_orderkey), 1, 15) AS BIGINT) % 10 < 8 AS train
    FROM orders), r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM s WHERE train)
  SELECT o_orderkey, (o_totalprice - (SELECT a FROM r)) / (SELECT b - a FROM r) AS o_totalprice FROM s WHERE NOT train""",
  "o_totalprice", 8), 8)
def x6(spark, sf):
    from tabloom.operators.splits import train_test_split
    s = train_test_split(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    fit = E.fit_min_max(s.filter("part = 'train'"), ["o_totalprice"])
    return E.apply_min_max(s.filter("part = 'test'").drop("part"), fit)


@query("X7_outlier_to_median", rnd(f"""WITH v AS (SELECT {_LK}, l_extendedprice * l_discount * l_discount AS v FROM lineitem),
  s AS (SELECT avg(v) AS m, stddev_pop(v) AS s, quantile_cont(v, 0.5) AS q FROM v)
  SELECT {_LK}, CASE WHEN abs((v - m) / s.s) > 3 THEN q ELSE v END AS v FROM v, s""", "v", 7), 7)
def x7(spark, sf):
    d = table(spark, sf, "lineitem").select(*_LK.split(", "), (
        F.col("l_extendedprice") * F.col("l_discount") * F.col("l_discount")).alias("v"))
    return E.outlier_to_median(d, ["v"])


@query("X8_preprocess_plan", _T + """SELECT 1 AS position, 'imputation' AS step FROM t HAVING count(*) * 2 > count(p_brand)
    + count(p_retailprice) UNION ALL SELECT 2, 'encoding' UNION ALL SELECT 3, 'scaling' UNION ALL SELECT 4, 'outlier_handling'""")
def x8(spark, sf):
    return E.preprocess_plan(dataset_profile(part_with_gaps(spark, sf)), ["RandomForestClassifier", "KNeighborsClassifier"])


X9_SQL = _T + """, c AS (SELECT p_partkey, (SELECT count(DISTINCT coalesce(p_brand, 'nan')) FROM t b
    WHERE coalesce(b.p_brand, 'nan') < coalesce(t.p_brand, 'nan'))::DOUBLE AS p_brand, p_size::DOUBLE AS p_size,
    coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM t)) AS p_retailprice FROM t),
  m AS (SELECT avg(p_brand) AS mb, stddev_pop(p_brand) AS sb, avg(p_size) AS ms, stddev_pop(p_size) AS ss,
    avg(p_retailprice) AS mr, stddev_pop(p_retailprice) AS sr FROM c)
  SELECT p_partkey, (p_brand - mb) / sb AS p_brand, (p_size - ms) / ss AS p_size, (p_retailprice - mr) / sr AS p_retailprice
  FROM c, m"""


@query("X9_preprocess_fitted", rnd(X9_SQL, "p_brand p_size p_retailprice", 7), 7)
def x9(spark, sf):
    d = part_with_gaps(spark, sf).select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return E.Preprocessor.fit(d, ["p_brand", "p_size", "p_retailprice"]).transform(d)


@query("X10_scoring_preprocess", rnd(X9_SQL, "p_brand p_size p_retailprice", 7), 7)
def x10(spark, sf):
    """Fitted, written, read back and applied."""
    from tabloom.session import scratch_path
    d = part_with_gaps(spark, sf).select("p_partkey", "p_brand", "p_size", "p_retailprice")
    path = scratch_path(spark, "prep")
    E.Preprocessor.fit(d, ["p_brand", "p_size", "p_retailprice"]).save(spark, path)
    return E.Preprocessor.load(spark, path).transform(d)


# ---------------------------------------------------------------- profiles for the rules

def _tall_sql(src, cols):
    """(column, position, n, missing, nunique, variance, is_numeric, is_text) from plain aggregates."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        var = f"var_samp({c})::DOUBLE" if kind in ("int", "float") else "NULL::DOUBLE"
        parts.append(f"""SELECT '{c}' AS col, {i} AS position, count(*) AS n, count(*) - count({c}) AS missing,
          count(DISTINCT {c}) AS nunique, {var} AS variance, {int(kind in ('int', 'float'))} AS is_numeric,
          {int(kind == 'object')} AS is_text, '{kind}' AS dtype FROM {src}""")
    return " UNION ALL ".join(parts)


ORDERS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "object"), ("o_totalprice", "float"),
          ("o_orderdate", "datetime"), ("o_orderpriority", "object")]
LINES = [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"),
         ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "object"),
         ("l_linestatus", "object"), ("l_shipdate", "datetime")]
PARTS = [("p_partkey", "int"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"), ("p_size", "int"),
         ("p_retailprice", "float")]
EVENTS = [("event_id", "int"), ("ts", "datetime"), ("user_id", "int"), ("event_type", "object"), ("value", "float"),
          ("props", "object")]
O_PROFILE = f"WITH p AS ({_tall_sql('orders', ORDERS)}) "
L_PROFILE = f"WITH p AS ({_tall_sql('lineitem', LINES)}) "
P_PROFILE = f"WITH t AS ({PART}), p AS ({_tall_sql('t', PARTS)}) "
E_PROFILE = f"WITH p AS ({_tall_sql('events', EVENTS)}) "


def profile(spark, sf, name):
    return R.column_profile(part_with_gaps(spark, sf) if name == "part" else table(spark, sf, name))


def _any(words):
    return "regexp_matches(lower(col), '" + "|".join(words) + "')"


@query("F12_name_keyword_score", E_PROFILE + f"""SELECT col AS "column", CASE WHEN {_any(R.REGRESSION_WORDS)} THEN 10 ELSE 0 END
  AS regression, CASE WHEN {_any(R.CLASS_WORDS)} THEN 10 ELSE 0 END AS classification, """ + " + ".join(
    f"CASE WHEN contains(lower(col), '{w}') THEN 10 ELSE 0 END" for w in R.SERIES_WORDS) + " AS time_series FROM p")
def f12(spark, sf):
    return R.name_keyword_score(profile(spark, sf, "events"))


@query("F13_date_like_strings", rnd("""WITH t AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day_text, o_orderstatus, o_orderpriority
    FROM orders), l AS (SELECT DISTINCT 'day_text' AS "column", day_text AS v FROM t UNION SELECT 'o_orderstatus', o_orderstatus
    FROM t UNION SELECT 'o_orderpriority', o_orderpriority FROM t),
  k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v) AS r FROM l)
  SELECT "column", avg(CASE WHEN length(v) >= 8 AND (contains(v, '-') OR contains(v, '/') OR contains(v, '.'))
    AND regexp_matches(v, '[0-9]') THEN 1 ELSE 0 END) AS share, CASE WHEN avg(CASE WHEN length(v) >= 8
    AND (contains(v, '-') OR contains(v, '/') OR contains(v, '.')) AND regexp_matches(v, '[0-9]') THEN 1 ELSE 0 END) >= 0.7
    THEN 1 ELSE 0 END AS date_like FROM k WHERE r <= 10 GROUP BY 1""", "share"))
def f13(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
                                          "o_orderstatus", "o_orderpriority")
    return R.date_like_strings(o)


@query("P17_drop_id_like", L_PROFILE + """SELECT col AS "column", position FROM p WHERE col <> 'l_extendedprice' AND NOT (
    regexp_matches(lower(col), 'id|index|key|uuid|guid') AND nunique > 0.8 * n)
    AND NOT (is_text = 1 AND nunique > least(100, 0.5 * n)) ORDER BY position LIMIT 20""")
def p17(spark, sf):
    return R.drop_id_like(profile(spark, sf, "lineitem"), "l_extendedprice")


@query("P17_drop_id_like_part", P_PROFILE + """SELECT col AS "column", position FROM p WHERE col <> 'p_retailprice' AND NOT (
    regexp_matches(lower(col), 'id|index|key|uuid|guid') AND nunique > 0.8 * n)
    AND NOT (is_text = 1 AND nunique > least(100, 0.5 * n)) ORDER BY position LIMIT 20""")
def p17b(spark, sf):
    return R.drop_id_like(profile(spark, sf, "part"), "p_retailprice")


@query("R1_infer_problem_generic", O_PROFILE + """SELECT 'orders' AS t, col AS target, CASE WHEN is_numeric = 1 AND nunique > 20
    THEN 'regression' ELSE 'classification' END AS problem_type FROM p WHERE position = (SELECT max(position) FROM p)
  UNION ALL SELECT 'embeddings', 'label', 'classification'
  UNION ALL SELECT 'renamed', 'price', 'regression'""")
def r1(spark, sf):
    renamed = table(spark, sf, "part").withColumnRenamed("p_retailprice", "price")
    labelled = table(spark, sf, "embeddings").select("vec_id", "label")
    tables = {"orders": table(spark, sf, "orders"), "embeddings": labelled, "renamed": renamed}
    rows = [R.infer_problem_generic(R.column_profile(d)).withColumn("t", F.lit(n)) for n, d in tables.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("R2_score_regression_targets", rnd(L_PROFILE + f"""SELECT col AS "column", position,
  CASE WHEN {_any(R.REGRESSION_WORDS)} THEN 10 ELSE 0 END + CASE WHEN nunique / n > 0.01 THEN 5 * nunique / n ELSE 0 END
  + CASE WHEN variance > 0 THEN least(ln(variance + 1), 5) ELSE 0 END + CASE WHEN missing / n < 0.1 THEN 2 ELSE 0 END AS score
  FROM p WHERE is_numeric = 1""", "score", 6), 6)
def r2(spark, sf):
    return R.score_regression_targets(profile(spark, sf, "lineitem"))


@query("R3_score_classification_targets", O_PROFILE + f"""SELECT col AS "column", position, CASE WHEN {_any(R.CLASS_WORDS)} THEN 10
  ELSE 0 END + CASE WHEN nunique BETWEEN 2 AND 50 THEN 8 ELSE 0 END + CASE WHEN nunique / n < 0.1 THEN 5 ELSE 0 END
  + CASE WHEN missing / n < 0.1 THEN 2 ELSE 0 END + CASE WHEN is_text = 1 THEN 3 ELSE 0 END AS score FROM p""")
def r3(spark, sf):
    return R.score_classification_targets(profile(spark, sf, "orders"))


@query("R4_validate_regression_target", P_PROFILE + """SELECT col AS "column", CASE WHEN is_numeric = 1 AND variance >= 1e-10
    AND nunique >= 10 AND nunique / (n - missing) >= 0.05 AND missing / n <= 0.3 THEN 1 ELSE 0 END AS strict_ok,
  CASE WHEN is_numeric = 1 AND nunique / n > 0.005 AND variance > 1e-10 THEN 1 ELSE 0 END AS light_ok FROM p""")
def r4(spark, sf):
    return R.validate_regression_target(profile(spark, sf, "part"))


@query("R5_validate_classification_target", O_PROFILE + """SELECT col AS "column", CASE WHEN nunique BETWEEN 2 AND 50
  AND nunique / n < 0.5 THEN 1 ELSE 0 END AS ok FROM p""")
def r5(spark, sf):
    return R.validate_classification_target(profile(spark, sf, "orders"))


@query("R6_problem_type_for_target", L_PROFILE + """SELECT col AS "column", CASE WHEN is_numeric = 1 AND nunique > 20 THEN 'regression'
  ELSE 'classification' END AS problem_type FROM p""")
def r6(spark, sf):
    return R.problem_type_for_target(profile(spark, sf, "lineitem"))


@query("R7_pick_two_targets", O_PROFILE + """SELECT col AS "column", position, CASE WHEN is_numeric = 1 THEN 3 WHEN is_text = 1 THEN 2
  ELSE 0 END + CASE WHEN missing / n < 0.1 THEN 2 WHEN missing / n < 0.3 THEN 1 ELSE 0 END AS score FROM p
  ORDER BY score DESC, position LIMIT 2""")
def r7(spark, sf):
    return R.pick_two_targets(profile(spark, sf, "orders"))


@query("R8_infer_time_and_target", O_PROFILE + """, t AS (SELECT col, position FROM p WHERE dtype = 'datetime' OR regexp_matches(lower(col),
    'date|time|timestamp|day|month|year|period') ORDER BY position LIMIT 1),
  g AS (SELECT col, position FROM p WHERE is_numeric = 1 AND col NOT IN (SELECT col FROM t) ORDER BY
    CASE WHEN regexp_matches(lower(col), 'sales|price|demand|volume|count|amount') THEN 0 ELSE 1 END, position LIMIT 1)
  SELECT col AS "column", position, 'time' AS role FROM t UNION ALL SELECT col, position, 'target' FROM g UNION ALL
  SELECT * FROM (SELECT col, position, 'feature' FROM p WHERE col NOT IN (SELECT col FROM t UNION SELECT col FROM g)
    ORDER BY position LIMIT 5)""")
def r8(spark, sf):
    return R.infer_time_and_target(table(spark, sf, "orders"), profile(spark, sf, "orders"))


_LF = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_LNUM = _LF[:6]


def _corr_sql(src, y, cols, as_=lambda c: c):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, abs(corr({as_(c)}, {y})) AS corr FROM {src}" for c in cols)


_R9_REASON = """CASE WHEN missing / n > 0.5 THEN 'missing' WHEN nunique <= 1 THEN 'constant' WHEN is_text = 1 AND
  nunique > least(100, 0.5 * n) THEN 'high_cardinality' WHEN variance < 1e-8 THEN 'near_zero_variance'
  WHEN corr < 0.01 THEN 'low_correlation' END"""


@query("R9_filter_features_generic", rnd(L_PROFILE + f""", c AS ({_corr_sql('lineitem', 'l_extendedprice', _LNUM)}),
  f AS (SELECT p.col, position, nunique, corr, {_R9_REASON} AS reason FROM p LEFT JOIN c ON c.col = p.col
    WHERE p.col IN ({', '.join(repr(c) for c in _LF)})),
  k AS (SELECT *, count(*) FILTER (reason IS NULL) OVER () AS ok, row_number() OVER (ORDER BY corr DESC NULLS LAST, position) AS r FROM f)
  SELECT col AS "column", nunique, corr, reason, CASE WHEN ok >= 3 THEN CASE WHEN reason IS NULL THEN 1 ELSE 0 END
    ELSE CASE WHEN r <= 8 AND corr IS NOT NULL THEN 1 ELSE 0 END END AS kept FROM k""", "corr", 6), 6)
def r9(spark, sf):
    li = table(spark, sf, "lineitem")
    out = R.filter_features_generic(li, R.column_profile(li), "l_extendedprice", _LF)
    return out.select("column", "nunique", "corr", "reason", "kept")


def _edges(src, c):
    return "[" + ", ".join(f"(SELECT quantile_cont({c}, {i / 10}) FROM {src})" for i in range(1, 10)) + "]"


def _mi_sql(src, features, yexpr):
    """Joint counts per feature, bin and class; `features`: (name, numeric)."""
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS col, " + (f"CAST(len(list_filter(list_distinct({_edges(src, c)}), lambda e: {c} > e)) AS VARCHAR)" if num
                                    else f"coalesce({c}, 'missing')") + f" AS bin, {yexpr} AS yb FROM {src}"
        for c, num in features)
    return f"""r AS ({rows}), j AS (SELECT col, bin, yb, count(*) AS n FROM r GROUP BY ALL),
      w AS (SELECT col, n, sum(n) OVER (PARTITION BY col, bin) AS nx, sum(n) OVER (PARTITION BY col, yb) AS ny,
        sum(n) OVER (PARTITION BY col) AS nt FROM j),
      mi AS (SELECT col, greatest(sum(n / nt * ln(n * nt / (nx * ny))), 0) AS mi FROM w GROUP BY 1)"""


_OF = [("o_custkey", True), ("o_totalprice", True), ("o_orderpriority", False)]


@query("R13_mutual_information", rnd("WITH " + _mi_sql("orders", _OF, "o_orderstatus") + """ SELECT col AS "column", mi FROM mi""",
       "mi", 7), 7)
def r13(spark, sf):
    return R.mutual_information(table(spark, sf, "orders"), "o_orderstatus", [c for c, _ in _OF], classes=True)


def _psi(n):
    """The digamma function of a whole number by its asymptotic series six steps up."""
    z = f"({n} + 6.0)"
    return (f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6)"
            + "".join(f" - 1.0 / ({n} + {i})" for i in range(6)) + ")")


_NEAREST = f"""WITH l AS (SELECT o_orderstatus AS cls, unnest(['o_custkey', 'o_totalprice']) AS col,
    unnest([CAST(o_custkey AS DOUBLE), CAST(o_totalprice AS DOUBLE)]) AS v FROM orders),
  t AS (SELECT *, count(*) OVER (PARTITION BY col, cls) AS n FROM l QUALIFY n > 1),
  d AS (SELECT *, least(3, n - 1) AS k, list_sort(list_filter([{", ".join(f"abs({f}(v, {j}) OVER w - v)" for f in ("lag", "lead")
    for j in (1, 2, 3))}], lambda x: x IS NOT NULL))[least(3, n - 1)] AS r FROM t WINDOW w AS (PARTITION BY col, cls ORDER BY v)),
  u AS (SELECT col, v, CAST(count(*) AS DOUBLE) AS here, sum(count(*)) OVER (PARTITION BY col ORDER BY v) AS upto FROM d GROUP BY 1, 2),
  lo AS (SELECT d.*, coalesce(u.upto, 0) AS below FROM d ASOF LEFT JOIN u ON d.col = u.col AND d.v - d.r >= u.v),
  hi AS (SELECT lo.*, u.upto AS above FROM lo ASOF LEFT JOIN u ON lo.col = u.col AND lo.v + lo.r > u.v),
  m AS (SELECT hi.*, CASE WHEN r > 0 THEN above - below ELSE u.here END AS m FROM hi JOIN u ON hi.col = u.col AND hi.v = u.v)
  SELECT col AS "column", greatest({_psi("count(*)")} + avg({_psi("k")}) - avg({_psi("n")}) - avg({_psi("m")}), 0) AS mi FROM m GROUP BY 1"""


@query("R13_nearest_information", rnd(_NEAREST, "mi", 7), 7)
def r13_nearest(spark, sf):
    return R.nearest_information(table(spark, sf, "orders"), "o_orderstatus", ["o_custkey", "o_totalprice"])


_P10 = ["p_name", "p_brand", "p_type", "p_size"]


@query("R10_filter_features_regression")
def r10(spark, sf):
    part = part_with_gaps(spark, sf)
    out = R.filter_features_regression(part, R.column_profile(part), "p_retailprice", _P10)
    return out.select("column", "nunique", "corr", "mi", "reason", "kept")


@query("R10_encoded_correlation", rnd(_T + """, y AS (SELECT *, coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM t))
    AS y FROM t), b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(p_brand, 'nan') AS v FROM t)),
  k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_type AS v FROM t))
  SELECT 'p_brand' AS "column", abs(corr(code, y)) AS corr FROM y JOIN b ON v = coalesce(p_brand, 'nan')
  UNION ALL SELECT 'p_type', abs(corr(code, y)) FROM y JOIN k ON v = p_type
  UNION ALL SELECT 'p_size', abs(corr(p_size, p_retailprice)) FROM t""", "corr", 6), 6)
def r10b(spark, sf):
    part = part_with_gaps(spark, sf)
    out = R.filter_features_regression(part, R.column_profile(part), "p_retailprice", ["p_brand", "p_type", "p_size"])
    return out.select("column", "corr")


@query("R11_filter_features_classification", rnd(O_PROFILE + ", " + _mi_sql("orders", _OF, "o_orderstatus") + """,
  f AS (SELECT p.col, position, nunique, mi, CASE WHEN missing / n > 0.4 THEN 'missing' WHEN mi < 0.01 THEN 'weak'
    WHEN is_numeric = 0 AND nunique > least(100, 0.3 * n) THEN 'high_cardinality' WHEN nunique <= 1 THEN 'constant' END AS reason
    FROM p JOIN mi USING (col)),
  k AS (SELECT *, count(*) FILTER (reason IS NULL) OVER () AS ok, row_number() OVER (ORDER BY mi DESC, position) AS r FROM f)
  SELECT col AS "column", nunique, mi, reason, CASE WHEN ok >= 3 THEN CASE WHEN reason IS NULL THEN 1 ELSE 0 END
    WHEN r <= 5 THEN 1 ELSE 0 END AS kept FROM k""", "mi", 7), 7)
def r11(spark, sf):
    o = table(spark, sf, "orders")
    out = R.filter_features_classification(o, R.column_profile(o), "o_orderstatus", [c for c, _ in _OF])
    return out.select("column", "nunique", "mi", "reason", "kept")


@query("R12_f_regression", rnd(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2) AS f
    FROM lineitem""" for c in _LNUM), "f"))
def r12(spark, sf):
    return R.select_k_best(R.f_scores(table(spark, sf, "lineitem"), "l_extendedprice", _LNUM, classes=False))


@query("R12_f_classification", rnd("WITH " + ", ".join(f"""g{i} AS (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS s,
    (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)""" for i, c in enumerate(_LNUM)) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM g{i}"""
    for i, c in enumerate(_LNUM)), "f"))
def r12b(spark, sf):
    return R.select_k_best(R.f_scores(table(spark, sf, "lineitem"), "l_returnflag", _LNUM, classes=True))


@query("T3_rank_features", rnd("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS importance FROM lineitem" for c in _LNUM)
    + ") ORDER BY importance DESC, feature LIMIT 2", "importance"))
def t3(spark, sf):
    from tabloom.operators.models import rank_features
    li = table(spark, sf, "lineitem").agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in _LNUM])
    return rank_features(li.unpivot([], _LNUM, "feature", "importance"), 2)


@query("R14_chi2_score", rnd("""WITH c AS (SELECT o_orderstatus AS y, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS v FROM orders),
  g AS (SELECT y, sum(v) AS o, count(*) / (SELECT count(*) FROM c) * (SELECT sum(v) FROM c) AS e FROM c GROUP BY 1)
  SELECT 'o_orderpriority' AS "column", sum((o - e) * (o - e) / e) AS chi2 FROM g""", "chi2"))
def r14(spark, sf):
    return R.chi2_score(table(spark, sf, "orders"), "o_orderstatus", ["o_orderpriority"])


_R15 = {"regression": ["RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression"],
        "classification": ["RandomForestClassifier", "LogisticRegression"],
        "time_series": ["Prophet", "SARIMAX", "RandomForestTS", "LinearRegressionTS"]}


@query("R15_algorithm_defaults", """SELECT kind, position, algorithm FROM (SELECT count(*) AS n FROM orders), (VALUES """ + ", ".join(
    f"('{k}', {i + 1}, '{a}')" for k, v in _R15.items() for i, a in enumerate(v)) + """) v(kind, position, algorithm) WHERE n >= 1000""")
def r15(spark, sf):
    o = table(spark, sf, "orders")
    n = o.count()
    rows = [(k, i + 1, a) for k in _R15 for i, a in enumerate(
        R.complete_algorithms(R.algorithm_defaults(k, n, len(o.columns)), k, n, len(o.columns)))]
    return spark.createDataFrame(rows, "kind string, position int, algorithm string")


# ---------------------------------------------------------------- text responses

def responses(spark, sf):
    """Every conversation row wrapped the way a model would answer."""
    c = table(spark, sf, "conversations")
    body = F.to_json(F.struct(F.col("role").alias("target"), F.col("text").alias("reason"), F.col("turn").alias("n")))
    plain = F.concat(F.lit("Sure: "), body, F.lit(" - done"))
    fenced = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n```json\n"), body, F.lit("\n```"))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, fenced).otherwise(plain).alias("response"))


@query("F15_response_cleanup", """SELECT conv_id, turn, role AS target, text AS reason, turn AS n FROM conversations""")
def f15(spark, sf):
    parsed = X.parse_response("response", "target string, reason string, n long")
    return responses(spark, sf).select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.*")


_LINES = ["- Random Forest", "2. k-neighbors, then a decision tree", "3) LinearRegresion", "nothing"]


@query("F16_alias_resolve", """WITH c AS (SELECT conv_id, turn, ['- Random Forest', '2. k-neighbors, then a decision tree',
    '3) LinearRegresion', 'nothing'][(conv_id + turn) % 4 + 1] || chr(10) || text || chr(10) || '* use gradient boosting' AS t
    FROM conversations),
  l AS (SELECT conv_id, turn, i, regexp_replace(lower(trim(x)), '^\\s*[\\-•\\d\\.\\)]*\\s*', '') AS x FROM (SELECT conv_id, turn,
    unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c)),
  m AS (SELECT conv_id, turn, i, CASE WHEN contains(x, 'random forest') THEN 'RandomForestRegressor'
    WHEN contains(x, 'gradient boosting') THEN 'GradientBoostingRegressor' WHEN contains(x, 'linear regression') THEN 'LinearRegression'
    WHEN contains(x, 'knn') OR contains(x, 'k-neighbors') THEN 'KNeighborsRegressor' WHEN contains(x, 'decision tree')
      THEN 'DecisionTreeRegressor' ELSE (SELECT arg_max(a, s) FROM (SELECT a, 1 - levenshtein(x, lower(a)) / greatest(length(x), length(a)) AS s
        FROM (SELECT unnest(['RandomForestRegressor', 'GradientBoostingRegressor', 'LinearRegression', 'KNeighborsRegressor',
        'DecisionTreeRegressor']) AS a)) WHERE s >= 0.6) END AS a FROM l WHERE x <> ''),
  d AS (SELECT conv_id, turn, a, min(i) AS i FROM m WHERE a IS NOT NULL GROUP BY 1, 2, 3),
  g AS (SELECT conv_id, turn, list(a ORDER BY i) AS f FROM d GROUP BY 1, 2)
  SELECT conv_id, turn, array_to_string((CASE WHEN len(f) < 2 THEN list_concat(f, list_filter(['RandomForestRegressor',
    'GradientBoostingRegressor', 'LinearRegression'], lambda z: NOT list_contains(f, z))) ELSE f END)[1:4], ',') AS algorithms FROM g""")
def f16(spark, sf):
    c = table(spark, sf, "conversations")
    first = F.element_at(F.array(*[F.lit(x) for x in _LINES]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    t = F.concat(first, F.lit("\n"), F.col("text"), F.lit("\n* use gradient boosting"))
    return c.select("conv_id", "turn", F.concat_ws(",", X.resolve_algorithms(t)).alias("algorithms"))
