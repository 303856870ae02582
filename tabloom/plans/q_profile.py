"""Queries: projections, cleaning and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile as A
from tabloom.operators import project as P
from tabloom.operators.panel import MEASURES
from tabloom.plans.registry import BRAND_KEY, RETAIL, query, rnd
from tabloom.sources.tables import retail_sales, table

PART = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS p_brand, p_type, p_size, " \
       "CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS p_retailprice FROM part"


def part_with_gaps(spark, sf):
    """`part` with missing brands and prices (the test tables have no nulls)."""
    return table(spark, sf, "part").withColumns({
        "p_brand": F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")),
        "p_retailprice": F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice"))})


@query("P1_select_features", "SELECT p_size, p_retailprice, p_type FROM part")
def p1(spark, sf):
    return P.select_features(table(spark, sf, "part"), ["p_size", "p_retailprice", "p_type"])


@query("P2_select_features_default", "SELECT p_size, 0.0::DOUBLE AS area, p_retailprice FROM part")
def p2(spark, sf):
    return P.select_features_default(table(spark, sf, "part"), ["p_size", "area", "p_retailprice"])


@query("P3_rescale_drop", rnd("SELECT o_orderkey, o_totalprice / 1e5 AS price_lakhs FROM orders", "price_lakhs", 8), 8)
def p3(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.rescale_drop(orders, "o_totalprice", "price_lakhs")


@query("P4_to_panel", rnd(f"""WITH {RETAIL} SELECT {BRAND_KEY} AS unique_id, BILLING_DATE AS ds, TOTAL_NET_SALES AS y,
  TOTAL_BILLING_QTY AS qty, TOTAL_GROSS_MARGIN AS margin, TOTAL_GROSS_SALES AS gross_sales, TOTAL_DISCOUNT AS discount
  FROM retail WHERE TOTAL_NET_SALES IS NOT NULL""", "y qty margin gross_sales discount"))
def p4(spark, sf):
    sales = P.fill_constant(retail_sales(spark, sf), ("BRAND",))
    rest = {k: v for k, v in MEASURES.items() if v != "y"}
    return P.to_panel(sales, "BRAND", "BILLING_DATE", "TOTAL_NET_SALES", rest)


@query("P5_composite_key", f"""WITH {RETAIL} SELECT {BRAND_KEY} || ' | ' || MH_SEGMENT || ' | ' || MH_FAMILY || ' | '
  || MH_CLASS || ' | ' || MH_BRICK AS product_key, count(*) AS n FROM retail GROUP BY 1""")
def p5(spark, sf):
    return retail_sales(spark, sf).groupBy(P.composite_key().alias("product_key")).agg(F.count(F.lit(1)).alias("n"))


@query("P6_fill_constant", f"""SELECT p_partkey, coalesce(p_brand, 'UNKNOWN') AS p_brand, p_type FROM ({PART})""")
def p6(spark, sf):
    return P.fill_constant(part_with_gaps(spark, sf), ("p_brand", "p_type")).select("p_partkey", "p_brand", "p_type")


@query("P7_clamp_negative", rnd(f"""WITH {RETAIL} SELECT BILL, LINE, ARTICLE,
  CASE WHEN TOTAL_NET_SALES < 0 THEN 0 ELSE TOTAL_NET_SALES END AS TOTAL_NET_SALES,
  CASE WHEN TOTAL_GROSS_MARGIN < 0 THEN 0 ELSE TOTAL_GROSS_MARGIN END AS TOTAL_GROSS_MARGIN FROM retail""",
       "TOTAL_NET_SALES TOTAL_GROSS_MARGIN"))
def p7(spark, sf):
    sales = retail_sales(spark, sf).select("BILL", "LINE", "ARTICLE", "TOTAL_NET_SALES", "TOTAL_GROSS_MARGIN")
    return P.clamp_negative(sales, ["TOTAL_NET_SALES", "TOTAL_GROSS_MARGIN"])


@query("P8_coerce_types", r"""SELECT event_id, TRY_CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS bad_number, TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS day,
  TRY_CAST(event_type AS DATE) AS bad_date FROM events""")
def p8(spark, sf):
    e = table(spark, sf, "events")
    bare = F.replace(F.replace("props", F.lit('{"k": ')), F.lit("}"))
    return e.select("event_id", P.coerce_number(bare).alias("k"), P.coerce_number("event_type").alias("bad_number"),
                    P.coerce_date(F.substring(F.col("ts").cast("string"), 1, 10)).alias("day"),
                    P.coerce_date("event_type").alias("bad_date"))


@query("P8_numeric_target", rnd(f"""SELECT p_partkey, coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5)
  FROM ({PART}))) AS p_retailprice FROM ({PART})""", "p_retailprice"))
def p8b(spark, sf):
    return P.numeric_target(part_with_gaps(spark, sf), "p_retailprice").select("p_partkey", "p_retailprice")


@query("P9_split_null_target", f"""SELECT p_partkey, p_type, p_retailprice,
  CASE WHEN p_retailprice IS NULL THEN 'null' ELSE 'clean' END AS part FROM ({PART})""")
def p9(spark, sf):
    clean, null = P.split_null_target(
        part_with_gaps(spark, sf).select("p_partkey", "p_type", "p_retailprice"), "p_retailprice")
    return clean.withColumn("part", F.lit("clean")).unionByName(null.withColumn("part", F.lit("null")))


@query("P10_drop_missing_target", f"SELECT * FROM ({PART}) WHERE p_retailprice IS NOT NULL")
def p10(spark, sf):
    return P.drop_missing_target(part_with_gaps(spark, sf), "p_retailprice")


@query("P11_dedupe_keep_first", rnd(f"""WITH {RETAIL} SELECT unique_id, ds, y, article FROM (
  SELECT {BRAND_KEY} AS unique_id, BILLING_DATE AS ds, round(TOTAL_NET_SALES, 4) AS y, ARTICLE AS article,
    row_number() OVER (PARTITION BY {BRAND_KEY}, BILLING_DATE
                       ORDER BY BILL, LINE, ARTICLE, round(TOTAL_NET_SALES, 4)) AS rn FROM retail)
  WHERE rn = 1""", "y"))
def p11(spark, sf):
    rows = P.fill_constant(retail_sales(spark, sf), ("BRAND",)).select(
        F.col("BRAND").alias("unique_id"), F.col("BILLING_DATE").alias("ds"),
        F.round("TOTAL_NET_SALES", 4).alias("y"), F.col("ARTICLE").alias("article"), "BILL", "LINE")
    return P.dedupe_keep_first(rows, ["unique_id", "ds"], ["BILL", "LINE", "article", "y"]).drop("BILL", "LINE")


@query("P12_clean_engineered", rnd("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS ratio FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
    coalesce(ratio, (SELECT quantile_cont(ratio, 0.5) FROM e)) AS ratio FROM e""", "ratio"))
def p12(spark, sf):
    li = table(spark, sf, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("l_extendedprice", "l_discount"))
    wide = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", ratio.alias("ratio"))
    return P.clean_engineered(wide, ["ratio"])


@query("P13_sample_n", """SELECT c_custkey, c_acctbal FROM customer
  ORDER BY CAST('0x' || substr(md5('42|' || CAST(c_custkey AS VARCHAR)), 1, 15) AS BIGINT), c_custkey LIMIT 300""")
def p13(spark, sf):
    return P.sample_n(table(spark, sf, "customer"), 300, ["c_custkey"]).select("c_custkey", "c_acctbal")


@query("P14_head_tail", """SELECT 'head' AS side, * FROM (SELECT o_orderkey, o_totalprice FROM orders
  ORDER BY o_totalprice, o_orderkey LIMIT 20)
  UNION ALL SELECT 'tail', * FROM (SELECT o_orderkey, o_totalprice FROM orders
  ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20)""")
def p14(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    order = ["o_totalprice", "o_orderkey"]
    sides = [P.head(o, order, 20).withColumn("side", F.lit("head")),
             P.tail(o, order, 20).withColumn("side", F.lit("tail"))]
    return sides[0].unionByName(sides[1]).select("side", "o_orderkey", "o_totalprice")


@query("P15_min_history_filter", """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
  WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_shipdate) >= 30)""")
def p15(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return P.min_history_filter(li, "l_partkey", "l_shipdate", 30).drop("l_shipdate")


@query("P16_nonzero_filter", rnd(f"""WITH {RETAIL} SELECT BILL, ARTICLE, TOTAL_NET_SALES AS y FROM retail
  WHERE TOTAL_NET_SALES > 0""", "y"))
def p16(spark, sf):
    return P.nonzero_filter(retail_sales(spark, sf).select("BILL", "ARTICLE", F.col("TOTAL_NET_SALES").alias("y")))


@query("F9_price_ratios", rnd(f"""WITH {RETAIL} SELECT BILL, LINE, ARTICLE,
  TOTAL_NET_SALES / CASE WHEN TOTAL_BILLING_QTY = 0 THEN 1 ELSE TOTAL_BILLING_QTY END AS avg_selling_price,
  TOTAL_DISCOUNT / CASE WHEN TOTAL_GROSS_SALES = 0 THEN 1 ELSE TOTAL_GROSS_SALES END AS discount_rate,
  TOTAL_GROSS_MARGIN / CASE WHEN TOTAL_NET_SALES = 0 THEN 1 ELSE TOTAL_NET_SALES END AS margin_rate
  FROM retail""", "avg_selling_price discount_rate margin_rate", 9), 9)
def f9(spark, sf):
    return retail_sales(spark, sf).withColumns(P.price_ratios()).select(
        "BILL", "LINE", "ARTICLE", "avg_selling_price", "discount_rate", "margin_rate")


@query("F10_engineered_features", rnd("""SELECT p_partkey, p_size, p_retailprice,
  CAST(p_size AS DOUBLE) * p_size AS p_size_squared, p_size * p_retailprice AS p_size_p_retailprice,
  CASE WHEN p_size <> 0 THEN p_retailprice / p_size END AS p_retailprice_per_p_size,
  CASE WHEN p_size >= 30 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 10 THEN 1 ELSE 0 END AS p_size_binned,
  ln(1 + greatest(p_retailprice, 0)) AS p_retailprice_log FROM part""",
  "p_size_p_retailprice p_retailprice_per_p_size p_retailprice_log"))
def f10(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return P.engineered_features(part, [
        P.Feature("square", "p_size"), P.Feature("product", "p_size", "p_retailprice"),
        P.Feature("ratio", "p_retailprice", "p_size"), P.Feature("bin", "p_size", edges=(10, 20, 30)),
        P.Feature("log", "p_retailprice")])


@query("F11_log_skewed_target", rnd("""SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN abs((SELECT skewness(l_extendedprice * l_discount * l_discount) FROM lineitem)) > 1
    THEN ln(1 + l_extendedprice * l_discount * l_discount) ELSE l_extendedprice * l_discount * l_discount END AS target,
  abs((SELECT skewness(l_extendedprice * l_discount * l_discount) FROM lineitem)) > 1 AS logged FROM lineitem""",
  "target"))
def f11(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_extendedprice") * F.col("l_discount") * F.col("l_discount")).alias("target"))
    out, logged = P.log_skewed_target(li, "target")
    return out.withColumn("logged", F.lit(logged))


# ---------------------------------------------------------------- profiles

def _union(parts):
    return " UNION ALL ".join(parts)


_PART_COLS = [("p_partkey", "int"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"),
              ("p_size", "int"), ("p_retailprice", "float")]


@query("A1_dataset_profile", f"WITH t AS ({PART}) " + _union(
    f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, count(*) AS n, count(*) - count({c}) AS missing FROM t"
    for i, (c, t) in enumerate(_PART_COLS)))
def a1(spark, sf):
    return A.dataset_profile(part_with_gaps(spark, sf))


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_LI_NUM]


@query("A1_sample_rows", """SELECT p_partkey, p_name FROM part
  ORDER BY CAST('0x' || substr(md5('42|' || p_partkey), 1, 15) AS BIGINT), p_partkey LIMIT 3""")
def a1_sample(spark, sf):
    return A.sample_rows(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"])


@query("A2_numeric_describe", rnd(_union(
    f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
    max({c}) AS max, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75
    FROM lineitem""" for c in _LI_ALL), "mean std min max q25 q50 q75"))
def a2(spark, sf):
    return A.numeric_describe(table(spark, sf, "lineitem"))


def _tops(t, cols, k):
    return _union(f"""SELECT '{c}' AS "column", nunique, rank, value, n FROM (SELECT {c} AS value, count(*) AS n,
      CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank,
      count(*) OVER () AS nunique FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {k}""" for c in cols)


@query("A3_categorical_profile", f"WITH t AS ({PART}) " + _tops("t", ["p_name", "p_brand", "p_type"], 10))
def a3(spark, sf):
    return A.top_values(part_with_gaps(spark, sf), ["p_name", "p_brand", "p_type"], 10)


@query("A4_quality_scores", rnd(f"""WITH t AS (SELECT p_name, p_brand, p_type, p_size, p_retailprice FROM ({PART}))
  SELECT (SELECT count(*) * 5 - count(p_name) - count(p_brand) - count(p_type) - count(p_size) - count(p_retailprice)
    FROM t) * 100.0 / (SELECT count(*) * 5 FROM t) AS missing_pct,
  (SELECT (SELECT count(*) FROM t) - count(*) FROM (SELECT DISTINCT * FROM t)) * 100.0 / (SELECT count(*) FROM t)
    AS duplicate_pct,
  CAST(1 AS BIGINT) AS int_columns, CAST(1 AS BIGINT) AS float_columns, CAST(3 AS BIGINT) AS object_columns,
  CAST(0 AS BIGINT) AS datetime_columns""", "missing_pct duplicate_pct"))
def a4(spark, sf):
    return A.quality_scores(part_with_gaps(spark, sf).drop("p_partkey"))


@query("A5_duplicate_rows", """SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicate_rows
  FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)""")
def a5(spark, sf):
    return A.duplicate_rows(table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("A6_target_analysis", rnd(f"""SELECT count(*) AS total_rows, count(*) - count(p_retailprice) AS missing_count,
  count(p_retailprice) AS valid_count, count(DISTINCT p_retailprice) AS unique_values, min(p_retailprice) AS min_value,
  max(p_retailprice) AS max_value, avg(p_retailprice) AS mean_value,
  (count(*) - count(p_retailprice)) * 100.0 / count(*) AS missing_pct, count(p_retailprice) * 100.0 / count(*) AS valid_pct
  FROM ({PART})""", "min_value max_value mean_value missing_pct valid_pct"))
def a6(spark, sf):
    return A.target_analysis(part_with_gaps(spark, sf), "p_retailprice")


@query("A7_cleaning_stats", rnd(f"""SELECT count(*) AS original_rows, count(p_retailprice) AS clean_rows,
  count(*) - count(p_retailprice) AS null_rows, min(p_retailprice) AS target_min, max(p_retailprice) AS target_max,
  avg(p_retailprice) AS target_mean, stddev_samp(p_retailprice) AS target_std,
  (count(*) - count(p_retailprice)) * 100.0 / count(*) AS removed_pct FROM ({PART})""",
  "target_min target_max target_mean target_std removed_pct"))
def a7(spark, sf):
    return A.cleaning_stats(part_with_gaps(spark, sf), "p_retailprice")


@query("A8_numeric_target_profile", rnd(f"WITH t AS ({PART}) " + _union(
    f"""SELECT '{c}' AS "column", count(*) AS n, var_samp({c}) AS variance, stddev_samp({c}) AS std,
    CAST(max({c}) - min({c}) AS DOUBLE) AS range, avg({c}) AS mean, count(DISTINCT {c}) AS nunique,
    quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS median,
    quantile_cont({c}, 0.75)::DOUBLE AS q75, count(DISTINCT {c}) / count(*) AS unique_ratio,
    (count(*) - count({c})) * 100.0 / count(*) AS missing_pct FROM t"""
    for c in ("p_partkey", "p_size", "p_retailprice")),
    "variance std range mean q25 median q75 unique_ratio missing_pct"))
def a8(spark, sf):
    return A.numeric_target_profile(part_with_gaps(spark, sf))


@query("A9_categorical_target_profile", rnd(f"WITH t AS ({PART}), top AS (" + _tops(
    "t", ["p_brand", "p_type", "p_name"], 10) + """),
  sizes AS (""" + _union(
    f"""SELECT '{c}' AS "column", count(*) AS n, count({c}) AS valid FROM t""" for c in ("p_brand", "p_type", "p_name"))
  + """)
  SELECT sizes."column", any_value(nunique) AS nunique, any_value(nunique) / any_value(sizes.n) AS unique_ratio,
    (any_value(sizes.n) - any_value(valid)) * 100.0 / any_value(sizes.n) AS missing_pct,
    max(value) FILTER (rank = 1) AS mode,
    string_agg(value || '=' || top.n, '; ' ORDER BY rank) AS top_counts,
    string_agg(value || '=' || top.n, '; ' ORDER BY rank) FILTER (rank <= 3) AS top3
  FROM sizes JOIN top ON sizes."column" = top."column" GROUP BY 1""", "unique_ratio missing_pct"))
def a9(spark, sf):
    return A.categorical_target_profile(part_with_gaps(spark, sf), ["p_brand", "p_type", "p_name"])


@query("A10_feature_moments", rnd(_union(
    f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, stddev_samp({c}) AS std,
    skewness({c}) AS skew FROM lineitem""" for c in _LI_NUM), "min max std skew", 6), 6)
def a10(spark, sf):
    return A.feature_moments(table(spark, sf, "lineitem"), _LI_NUM)


_MEASURE_COLS = list(MEASURES)
_PAIRS = [(a, b) for i, a in enumerate(_MEASURE_COLS) for b in _MEASURE_COLS[i + 1:]]


@query("A11_interaction_candidates", rnd(f"WITH {RETAIL}, pairs AS (" + _union(
    f"SELECT {i} AS k, '{a}' AS feature1, '{b}' AS feature2, abs(corr({a}, {b})) AS correlation FROM retail"
    for i, (a, b) in enumerate(_PAIRS)) + """) SELECT feature1, feature2, correlation FROM pairs
  WHERE correlation > 0.3 AND correlation < 0.9 ORDER BY k LIMIT 5""", "correlation", 6), 6)
def a11(spark, sf):
    return A.interaction_candidates(retail_sales(spark, sf), _MEASURE_COLS)


@query("A25_zero_negative_counts", f"WITH {RETAIL} " + _union(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives
    FROM retail""" for c in ("TOTAL_NET_SALES", "TOTAL_DISCOUNT", "TOTAL_BILLING_QTY")))
def a25(spark, sf):
    return A.zero_negative_counts(retail_sales(spark, sf), ["TOTAL_NET_SALES", "TOTAL_DISCOUNT", "TOTAL_BILLING_QTY"])


@query("A31_dataset_characteristics", rnd(f"""WITH t AS ({PART}) SELECT count(*) AS sample_size,
  CAST(6 AS BIGINT) AS feature_count,
  (2 * count(*) - count(p_brand) - count(p_retailprice)) * 100.0 / (6 * count(*)) AS missing_pct,
  CAST(3 AS BIGINT) AS categorical_features, CAST(3 AS BIGINT) AS numeric_features, 'low' AS complexity,
  CASE WHEN (2 * count(*) - count(p_brand) - count(p_retailprice)) / (6 * count(*)) > 0.1 THEN 'high' ELSE 'low' END
    AS missing_severity FROM t""", "missing_pct"))
def a31(spark, sf):
    return A.dataset_characteristics(part_with_gaps(spark, sf))
