"""Queries: window features, regular series, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.ordering import with_position
from tabloom.operators import regularise as G
from tabloom.operators import splits as H
from tabloom.operators import windows as W
from tabloom.plans.q_panel import brand_sales, pair_sales, whole_brand_panel as brand_panel, whole_type_panel
from tabloom.plans.registry import BRAND_KEY, RETAIL, TYPE_KEY, panel_sql, query, rnd
from tabloom.sources.tables import table

TYPED = f"WITH {RETAIL}, {panel_sql(TYPE_KEY, 'raw', whole=True)}, panel AS (SELECT unique_id, ds, y, " \
        "row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS idx, " \
        "count(*) OVER (PARTITION BY unique_id) AS n FROM raw) "
O = "PARTITION BY unique_id ORDER BY ds"


def _frame(n):
    return f"OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n, expr, name):
    return f"CASE WHEN idx >= {n} AND n > {n} THEN {expr} END AS \"{name}\""


def ys(spark, sf):
    return W.spread(whole_type_panel(spark, sf).select("unique_id", "ds", "y"))


def _sql(cols, digits=4):
    names = " ".join(c.rsplit('"', 2)[1] if c.endswith('"') else c.rsplit(" ", 1)[1] for c in cols)
    return rnd(TYPED + "SELECT unique_id, ds, y, " + ", ".join(cols) + " FROM panel", "y " + names, digits)


@query("W1_lags", _sql([f"lag(y, {k}) OVER ({O}) AS target_lag_{k}" for k in W.LAGS]))
def w1(spark, sf):
    return W.lags(ys(spark, sf))


@query("W2_rolling_basic", _sql([_full(n, f"{f}(y) {_frame(n)}", f"rolling_{a}_{n}") for n in W.ROLLING
                                 for a, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]))
def w2(spark, sf):
    return W.rolling_basic(ys(spark, sf))


@query("W3_rolling_quantiles", _sql([_full(n, f"quantile_cont(y, {p}) {_frame(n)}", f"rolling_{a}_{n}") for n in W.ROLLING
                                     for a, p in (("q25", .25), ("median", .5), ("q75", .75))]))
def w3(spark, sf):
    return W.rolling_quantiles(ys(spark, sf))


@query("W4_rolling_shape", _sql([
    _full(n, f"CASE WHEN min(y) {_frame(n)} < max(y) {_frame(n)} THEN {f}(y) {_frame(n)} END", f"rolling_{a}_{n}")
    for n in W.ROLLING for a, f in (("skew", "skewness"), ("kurt", "kurtosis")) if not (n == 3 and a == "kurt")]
    + ["CAST(NULL AS DOUBLE) AS rolling_kurt_3"]))
def w4(spark, sf):
    return W.rolling_shape(ys(spark, sf))


@query("W5_distance_from_rolling", _sql([
    _full(n, f"y - {f} {_frame(n)}", f"dist_from_{a}_{n}") for n in W.ROLLING
    for a, f in (("mean", "avg(y)"), ("median", "quantile_cont(y, 0.5)"))]))
def w5(spark, sf):
    out = W.distance_from_rolling(W.rolling_quantiles(W.rolling_basic(ys(spark, sf))))
    return out.select("unique_id", "ds", "y", *[c for c in out.columns if c.startswith("dist_")])


_EWM = ", ".join(f'sum(b.y * pow({1 - a}, a.idx - b.idx)) / sum(pow({1 - a}, a.idx - b.idx)) AS "ewm_{a}"' for a in W.ALPHAS)


@query("W6_ewm", rnd(TYPED + "SELECT *, " + ", ".join(f'y - "ewm_{a}" AS "dist_from_ewm_{a}"' for a in W.ALPHAS)
       + f""" FROM (SELECT a.unique_id, a.ds, any_value(a.y) AS y, {_EWM} FROM panel a JOIN panel b
  ON a.unique_id = b.unique_id AND b.idx <= a.idx AND b.idx > a.idx - 400 GROUP BY 1, 2)""",
  "y " + " ".join(f"ewm_{a} dist_from_ewm_{a}" for a in W.ALPHAS)))
def w6(spark, sf):
    return W.ewm(ys(spark, sf))


@query("W7_differences", rnd(TYPED + "SELECT unique_id, ds, y, " + ", ".join(
    f"y - lag(y, {k}) OVER ({O}) AS diff_{k}, CASE WHEN lag(y, {k}) OVER ({O}) <> 0 THEN y / lag(y, {k}) OVER ({O}) - 1 END "
    f"AS pct_change_{k}, y - lag(y, {k}) OVER ({O}) - lag(y, 1) OVER ({O}) + lag(y, {k + 1}) OVER ({O}) AS diff2_{k}"
    for k in W.DIFFS) + " FROM panel", "y " + " ".join(f"diff_{k} pct_change_{k} diff2_{k}" for k in W.DIFFS), 3), 3)
def w7(spark, sf):
    return W.differences(ys(spark, sf))


@query("W8_autocorr", rnd(TYPED + """, l AS (SELECT *, """ + ", ".join(f"lag(y, {k}) OVER ({O}) AS l{k}" for k in W.AUTOCORR)
       + " FROM panel), c AS (SELECT unique_id, " + ", ".join(f"corr(y, l{k}) AS autocorr_{k}" for k in W.AUTOCORR)
       + " FROM l GROUP BY 1) SELECT panel.unique_id, ds, y, autocorr_1, autocorr_7, autocorr_30 FROM panel "
       "JOIN c ON c.unique_id = panel.unique_id", "y autocorr_1 autocorr_7 autocorr_30"))
def w8(spark, sf):
    return W.autocorr(ys(spark, sf))


@query("W9_volatility", rnd(TYPED + f""", r AS (SELECT *, CASE WHEN lag(y) OVER ({O}) <> 0 THEN y / lag(y) OVER ({O}) - 1 END
  AS ret FROM panel) SELECT unique_id, ds, y, """ + ", ".join(
    f"CASE WHEN count(ret) {_frame(n)} = {n} AND n > {n} THEN stddev_samp(ret) {_frame(n)} END AS volatility_{n}"
    for n in W.SHORT_WINDOWS) + " FROM r", "y volatility_7 volatility_14 volatility_30", 3), 3)
def w9(spark, sf):
    return W.volatility(ys(spark, sf))


@query("W10_rolling_trend", _sql([_full(n, f"regr_slope(y, idx) {_frame(n)}", f"trend_{n}") for n in W.SHORT_WINDOWS]))
def w10(spark, sf):
    return W.rolling_trend(ys(spark, sf))


@query("W11_ma_ratio_diff", _sql([
    c for a, b in W.MA_PAIRS for c in (
        _full(b, f"avg(y) {_frame(a)} / (avg(y) {_frame(b)} + 1e-8)", f"ma_ratio_{a}_{b}"),
        _full(b, f"avg(y) {_frame(a)} - avg(y) {_frame(b)}", f"ma_diff_{a}_{b}"))]))
def w11(spark, sf):
    out = W.ma_ratio_diff(W.rolling_basic(ys(spark, sf), windows=(7, 14, 30, 60)))
    return out.select("unique_id", "ds", "y", *[c for c in out.columns if c.startswith("ma_")])


@query("W12_zscore_regime", rnd(TYPED + "SELECT *, " + ", ".join(
    f"CASE WHEN zscore_{n} > 1.5 THEN 1 ELSE 0 END AS regime_high_{n}, "
    f"CASE WHEN zscore_{n} < -1.5 THEN 1 ELSE 0 END AS regime_low_{n}" for n in W.REGIME)
    + " FROM (SELECT unique_id, ds, y, " + ", ".join(
    _full(n, f"(y - avg(y) {_frame(n)}) / (stddev_samp(y) {_frame(n)} + 1e-8)", f"zscore_{n}") for n in W.REGIME)
    + " FROM panel)", "y zscore_14 zscore_30"))
def w12(spark, sf):
    out = W.zscore_regime(W.rolling_basic(ys(spark, sf), windows=W.REGIME))
    return out.select("unique_id", "ds", "y", *[c for c in out.columns if c.startswith(("zscore", "regime"))])


DECOMPOSED = TYPED + f""", t AS (SELECT *, CASE WHEN idx > 6 AND idx <= n - 6 THEN (sum(y) OVER ({O}
    ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * (lag(y, 6) OVER ({O}) + lead(y, 6) OVER ({O}))) / 12 END AS trend
    FROM panel WHERE n > 24),
  ph AS (SELECT unique_id, (idx - 1) % 12 AS phase, avg(y - trend) AS pm FROM t GROUP BY 1, 2),
  cen AS (SELECT unique_id, phase, pm - avg(pm) OVER (PARTITION BY unique_id) AS seasonal FROM ph),
  dec AS (SELECT t.unique_id, ds, y, trend, seasonal, y - trend - seasonal AS resid FROM t JOIN cen
    ON t.unique_id = cen.unique_id AND (idx - 1) % 12 = phase)"""


@query("W13_seasonal_decompose", rnd(DECOMPOSED + " SELECT * FROM dec", "y trend seasonal resid"))
def w13(spark, sf):
    return W.seasonal_decompose(ys(spark, sf))


@query("W14_seasonality_strength", rnd(DECOMPOSED + """ SELECT *, CASE WHEN seasonality_strength > 0.3 THEN 1 ELSE 0 END
  AS has_seasonality, CASE WHEN trend_strength > 0.3 THEN 1 ELSE 0 END AS has_trend FROM (
  SELECT unique_id, var_samp(seasonal) / (var_samp(seasonal) + var_samp(resid)) AS seasonality_strength,
  var_samp(trend) / (var_samp(trend) + var_samp(resid)) AS trend_strength FROM dec GROUP BY 1)""",
  "seasonality_strength trend_strength", 6), 6)
def w14(spark, sf):
    return W.seasonality_strength(W.seasonal_decompose(ys(spark, sf)))


SPINE = f"""WITH {RETAIL}, {panel_sql(BRAND_KEY, whole=True)}, sp AS (SELECT unique_id,
    unnest(generate_series(min(ds)::TIMESTAMP, max(ds)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS ds FROM panel GROUP BY 1),
  j AS (SELECT sp.unique_id, sp.ds, y, qty, margin, gross_sales, discount FROM sp LEFT JOIN panel USING (unique_id, ds))"""


@query("W15_fill_forward_back", rnd(SPINE + f"""SELECT unique_id, ds, coalesce(
    last_value(y IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(y IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM j""", "y"))
def w15(spark, sf):
    from tabloom.operators.panel import spine_left_join
    return W.fill_forward_back(spine_left_join(brand_panel(spark, sf).select("unique_id", "ds", "y")), ["y"])


def _filled(c):
    """Linear up to the limit, three days of the last filled value, three days back, then 0."""
    return f"""greatest(CASE WHEN {c} IS NOT NULL THEN {c}
      WHEN lim IS NULL OR k <= lim THEN p_{c} + (q_{c} - p_{c}) * k / (gap + 1)
      WHEN k <= lim + 3 THEN p_{c} + (q_{c} - p_{c}) * lim / (gap + 1)
      WHEN gap - k < 3 THEN q_{c} ELSE 0 END, 0) AS {c}"""


_M = ("y", "qty", "margin", "gross_sales", "discount")
REGULAR = SPINE + """, st AS (SELECT unique_id, count(*) AS rows_, 1 - count(*) / (date_diff('day', min(ds), max(ds)) + 1)
    AS missing FROM panel GROUP BY 1 HAVING count(*) >= 50 AND 1 - count(*) / (date_diff('day', min(ds), max(ds)) + 1) <= 0.7),
  known AS (SELECT unique_id, ds AS d, y, qty, margin, gross_sales, discount,
    lead(ds) OVER (PARTITION BY unique_id ORDER BY ds) AS d2, """ + ", ".join(
    f"lead({c}) OVER (PARTITION BY unique_id ORDER BY ds) AS q_{c}" for c in _M) + """ FROM panel),
  f AS (SELECT j.unique_id, j.ds, CASE WHEN missing < 0.2 THEN NULL WHEN missing < 0.4 THEN 5 ELSE 2 END AS lim,
    date_diff('day', d, j.ds) AS k, date_diff('day', d, d2) - 1 AS gap, """ + ", ".join(
    f"j.{c}, known.{c} AS p_{c}, q_{c}" for c in _M) + """
    FROM j JOIN st ON st.unique_id = j.unique_id JOIN known ON known.unique_id = j.unique_id
      AND j.ds >= d AND (j.ds < d2 OR d2 IS NULL)),
  regular AS (SELECT unique_id, ds, """ + ", ".join(_filled(c) for c in _M) + " FROM f)"


@query("W16_regularise_daily", rnd(REGULAR + " SELECT * FROM regular", " ".join(_M)))
def w16(spark, sf):
    return G.regularise_daily(brand_panel(spark, sf), unique=True)


@query("W17_regularise_methods", rnd(SPINE + """, known AS (SELECT unique_id, ds AS d, y AS p,
    lead(ds) OVER (PARTITION BY unique_id ORDER BY ds) AS d2, lead(y) OVER (PARTITION BY unique_id ORDER BY ds) AS q FROM panel),
  f AS (SELECT j.unique_id, j.ds, j.y, p, q, date_diff('day', d, j.ds) AS k, date_diff('day', d, d2) AS l FROM j JOIN known
    ON known.unique_id = j.unique_id AND j.ds >= d AND (j.ds < d2 OR d2 IS NULL))
  SELECT 'interpolate' AS method, unique_id, ds, coalesce(y, p + (q - p) * k / l) AS y FROM f
  UNION ALL SELECT 'zero', unique_id, ds, coalesce(y, 0) FROM f
  UNION ALL SELECT 'smart_fill', unique_id, ds, coalesce(y, p) FROM f""", "y"))
def w17(spark, sf):
    panel = brand_panel(spark, sf)
    parts = [G.regularise_daily_simple(panel, m, unique=True).withColumn("method", F.lit(m))
             for m in ("interpolate", "zero", "smart_fill")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("W17_fix_summary", SPINE + """, a AS (SELECT unique_id, count(*) AS final_points FROM sp GROUP BY 1),
  b AS (SELECT unique_id, count(*) AS original_points FROM panel GROUP BY 1)
  SELECT unique_id, original_points, final_points - original_points AS missing_filled, final_points, 1 AS frequency_fixed
  FROM a JOIN b USING (unique_id)""")
def w17b(spark, sf):
    panel = brand_panel(spark, sf)
    return G.fix_summary(panel, G.regularise_daily_simple(panel, unique=True))


# ---------------------------------------------------------------- splits

@query("W18_holdout_tail", rnd(TYPED + """SELECT unique_id, ds, y, CASE WHEN n - idx < 21 THEN 'test' ELSE 'train' END AS part
  FROM panel""", "y"))
def w18(spark, sf):
    return H.holdout_tail(ys(spark, sf), 21)


@query("W19_holdout_fraction", """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <=
  floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM events""")
def w19(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    at = [F.date_trunc("hour", "ts"), F.date_trunc("second", "ts")]
    return H.holdout_fraction(e, [], ["ts", "event_id"], at).select("event_id", "part")


@query("W19_holdout_fraction_grouped", """SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type
  ORDER BY ts, event_id) <= floor(0.8 * count(*) OVER (PARTITION BY event_type)) THEN 'train' ELSE 'test' END AS part
  FROM events""")
def w19b(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    out = H.holdout_fraction(e, ["event_type"], ["ts", "event_id"], [F.date_trunc("hour", "ts"), F.date_trunc("second", "ts")])
    return out.select("event_id", "event_type", "part")


@query("W20_expanding_folds", rnd(TYPED + """SELECT unique_id, ds, y, fold, CASE WHEN idx - 1 < n - (3 - fold) * (n // 4)
  THEN 'train' ELSE 'test' END AS part FROM panel, (SELECT unnest([0, 1, 2]) AS fold)
  WHERE n >= 30 AND idx - 1 < n - (3 - fold) * (n // 4) + n // 4""", "y"))
def w20(spark, sf):
    return H.expanding_folds(ys(spark, sf))


@query("W21_lookback_windows", TYPED + f""", l AS (SELECT *, least(greatest(10, n // 20), 60) AS lb,
    list(CAST(round(y * 100) AS BIGINT)) OVER ({O} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS seen FROM panel)
  SELECT unique_id, ds, CAST(lb AS INTEGER) AS lookback, array_to_string(seen[-lb:], ',') AS inputs,
    CAST(round(y * 100) AS BIGINT) AS target FROM l WHERE idx > lb""")
def w21(spark, sf):
    cents = lambda c: F.round(c * 100).cast("long")
    return W.lookback_windows(ys(spark, sf)).withColumns({
        "inputs": F.concat_ws(",", F.transform("inputs", lambda v: cents(v).cast("string"))),
        "target": cents(F.col("target"))})


@query("W22_future_spine", f"""WITH {RETAIL}, {panel_sql(BRAND_KEY)}, e AS (SELECT unique_id, max(ds) AS last FROM panel GROUP BY 1)
  SELECT unique_id, CAST(step AS INTEGER) AS step, ds, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month,
    CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN day(ds) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN day(ds + 1) = 1 THEN 1 ELSE 0 END AS is_month_end,
    CASE WHEN day(ds) = 1 AND month(ds) % 3 = 1 THEN 1 ELSE 0 END AS is_quarter_start,
    CASE WHEN day(ds + 1) = 1 AND month(ds) % 3 = 0 THEN 1 ELSE 0 END AS is_quarter_end,
    CAST(quarter(ds) AS INTEGER) AS quarter, CASE WHEN strftime(ds, '%m-%d') = '01-26' THEN 1 ELSE 0 END AS is_republic_day,
    0 AS is_holi, 0 AS is_diwali, CASE WHEN strftime(ds, '%m-%d') = '08-15' THEN 1 ELSE 0 END AS is_independence_day,
    CASE WHEN strftime(ds, '%m-%d') = '12-25' THEN 1 ELSE 0 END AS is_christmas
  FROM (SELECT unique_id, step, CAST(last + CAST(step AS INTEGER) AS DATE) AS ds FROM e, (SELECT unnest(range(1, 61)) AS step))""")
def w22(spark, sf):
    return H.future_spine(brand_panel(spark, sf), 60)


@query("W23_train_context", rnd(TYPED + """, s AS (SELECT unique_id, ds, y, CASE WHEN n - idx < 21 THEN 'test' ELSE 'train' END
    AS part FROM panel), st AS (SELECT unique_id, min(ds) AS start FROM s WHERE part = 'test' GROUP BY 1)
  SELECT s.* FROM s JOIN st ON s.unique_id = st.unique_id WHERE part = 'test' OR ds >= start - 30""", "y"))
def w23(spark, sf):
    return H.train_context(H.holdout_tail(ys(spark, sf), 21))


@query("W24_ts_feature_defaults")
def w24(spark, sf):
    """The chosen columns, computed: the rule runs over the names of the feature table."""
    from tabloom.functions.calendar import add, calendar_columns, period_columns
    base = brand_panel(spark, sf).select("unique_id", "ds", "y", "qty", "margin")
    wide = add(W.rolling_basic(W.lags(base), windows=(3, 7)), {**calendar_columns(F.col("ds")), **period_columns(F.col("ds"))})
    names = [c for c in wide.columns if c not in base.columns]
    return wide.select("unique_id", "ds", *H.ts_feature_defaults(names, ["qty", "margin"]))


@query("W_long_series_in_chunks", rnd("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)
    AS idx FROM events) SELECT event_id, event_type, value, lag(value, 1) OVER w AS target_lag_1, lag(value, 7) OVER w
    AS target_lag_7, CASE WHEN idx >= 30 THEN avg(value) OVER f END AS rolling_mean_30,
    CASE WHEN idx >= 30 THEN stddev_samp(value) OVER f END AS rolling_std_30 FROM e
  WINDOW w AS (PARTITION BY event_type ORDER BY idx), f AS (PARTITION BY event_type ORDER BY idx ROWS 29 PRECEDING)""",
  "target_lag_1 target_lag_7 rolling_mean_30 rolling_std_30"))
def w_chunks(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    s = W.Series(("event_type",), "at", "value")
    step = lambda d, p: W.rolling_basic(W.lags(d, p, (1, 7)), p, (30,))
    out = W.in_chunks(e, step, s, lookback=30, bucket=[F.date_trunc("hour", F.col("at.ts")), F.date_trunc("second", F.col("at.ts"))],
                      chunk_rows=500)
    return out.select("event_id", "event_type", "value", "target_lag_1", "target_lag_7", "rolling_mean_30", "rolling_std_30")


# ---------------------------------------------------------------- splits of plain tables

_H = "CAST('0x' || substr(md5('42|' || CAST({k} AS VARCHAR)), 1, 15) AS BIGINT)"


@query("E1_train_test_split", f"""SELECT c_custkey, CASE WHEN {_H.format(k='c_custkey')} % 10 < 8 THEN 'train' ELSE 'test' END
  AS part FROM customer""")
def e1(spark, sf):
    return H.train_test_split(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])


@query("E2_stratified_split", f"""SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {_H.format(k='o_orderkey')}, o_orderkey) <= floor(0.8 * count(*) OVER (PARTITION BY o_orderstatus))
  THEN 'train' ELSE 'test' END AS part FROM orders""")
def e2(spark, sf):
    return H.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])
