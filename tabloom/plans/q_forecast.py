"""Queries: forecasts, their metrics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import evaluate as E
from tabloom.operators import forecast as Q
from tabloom.operators import panel as S
from tabloom.operators import regularise as G
from tabloom.operators import splits as H
from tabloom.operators.profile import histogram
from tabloom.plans.q_panel import brand_sales, whole_brand_panel, whole_type_panel
from tabloom.plans.q_windows import REGULAR, TYPED
from tabloom.plans.registry import half_even, query, rnd
from tabloom.session import durable

_Z = {80: 1.2815515655446004, 90: 1.6448536269514722}
_LOHI = ", ".join(f'yhat - {z} * sigma * sqrt(step) AS "lo-{v}", yhat + {z} * sigma * sqrt(step) AS "hi-{v}"'
                  for v, z in _Z.items())
_FC = "yhat lo-80 hi-80 lo-90 hi-90"


def regular(spark, sf):
    return G.regularise_daily(whole_brand_panel(spark, sf), unique=True)


#: Regular brand series, last 21 days held out, seasonal-naive forecast of 7 days, joined.
HELD = REGULAR + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM regular),
  train AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS rb,
    y - lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds) AS e FROM numbered WHERE back > 21),
  ends AS (SELECT unique_id, max(ds) AS last, stddev_samp(e) AS sigma FROM train GROUP BY 1),
  fc AS (SELECT ends.unique_id, CAST(last + CAST(step AS INTEGER) AS DATE) AS ds, CAST(step AS INTEGER) AS step, t.y AS yhat,
    sigma FROM ends, (SELECT unnest(range(1, 8)) AS step) JOIN train t ON t.unique_id = ends.unique_id AND t.rb = 8 - step),
  ev AS (SELECT unique_id, ds, numbered.y, yhat FROM numbered JOIN fc USING (unique_id, ds) WHERE back <= 21)"""


def held_out(spark, sf, method="seasonal_naive"):
    # train and test read the completed series, which is written once
    split = durable(H.holdout_tail(regular(spark, sf).select("unique_id", "ds", "y"), 21), "split")
    fc = Q.forecast_panel(split.filter("part = 'train'").drop("part"), 7, method)
    return Q.evaluate_holdout(split, fc)


@query("Q7_seasonal_naive", rnd(TYPED + f""", t AS (SELECT *, y - lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds) AS e
    FROM panel), f AS (SELECT unique_id, max(ds) AS last, stddev_samp(e) AS sigma, any_value(n) AS n FROM t GROUP BY 1),
  r AS (SELECT f.unique_id, CAST(last + CAST(step AS INTEGER) AS DATE) AS ds, CAST(step AS INTEGER) AS step, p.y AS yhat, sigma
    FROM f, (SELECT unnest(range(1, 15)) AS step) JOIN panel p ON p.unique_id = f.unique_id
      AND p.idx = f.n - 7 + 1 + (step - 1) % 7) SELECT unique_id, ds, step, yhat, {_LOHI} FROM r""", _FC))
def q7(spark, sf):
    return Q.forecast_baseline(whole_type_panel(spark, sf), 14, "seasonal_naive")


@query("Q7_moving_average", rnd(TYPED + f""", t AS (SELECT *, CASE WHEN idx > 7 THEN y - avg(y) OVER (PARTITION BY unique_id
    ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS e FROM panel),
  f AS (SELECT unique_id, max(ds) AS last, stddev_samp(e) AS sigma, avg(y) FILTER (idx > n - 7) AS yhat FROM t GROUP BY 1),
  r AS (SELECT unique_id, CAST(last + CAST(step AS INTEGER) AS DATE) AS ds, CAST(step AS INTEGER) AS step, yhat, sigma
    FROM f, (SELECT unnest(range(1, 15)) AS step)) SELECT unique_id, ds, step, yhat, {_LOHI} FROM r""", _FC))
def q7b(spark, sf):
    return Q.forecast_baseline(whole_type_panel(spark, sf), 14, "moving_average")


@query("Q7_mean", rnd(TYPED + f""", r AS (SELECT unique_id, CAST(last + CAST(step AS INTEGER) AS DATE) AS ds,
    CAST(step AS INTEGER) AS step, yhat, sigma FROM (SELECT unique_id, max(ds) AS last, stddev_samp(y) AS sigma, avg(y) AS yhat
    FROM panel GROUP BY 1), (SELECT unnest(range(1, 15)) AS step)) SELECT unique_id, ds, step, yhat, {_LOHI} FROM r""", _FC))
def q7c(spark, sf):
    return Q.forecast_baseline(whole_type_panel(spark, sf), 14, "mean")


@query("J1_join_actual_forecast", rnd(HELD + " SELECT * FROM ev", "y yhat"))
def j1(spark, sf):
    return held_out(spark, sf)


@query("Q8_forecast_panel", rnd(HELD + f" SELECT unique_id, ds, step, yhat, {_LOHI} FROM fc", _FC, 3), 3)
def q8(spark, sf):
    split = H.holdout_tail(regular(spark, sf).select("unique_id", "ds", "y"), 21)
    return Q.forecast_panel(split.filter("part = 'train'").drop("part"), 7)


@query("Q9_forecast_future", rnd(REGULAR + f""", b AS (SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id
    ORDER BY ds DESC) AS back FROM regular), w AS (SELECT unique_id, avg(y) AS a, 2 * sum(y) AS t FROM b WHERE back <= 7 GROUP BY 1)
  SELECT unique_id, {half_even('a')} AS avg_daily, {half_even('t')} AS total_forecast FROM w""", "avg_daily total_forecast"))
def q9(spark, sf):
    return Q.forecast_summary_future(Q.forecast_panel(regular(spark, sf).select("unique_id", "ds", "y"), 14))


_MAPE10 = """least(100 * CASE WHEN count(*) FILTER (abs(y) > 1e-10) > 0.1 * count(*)
  THEN avg(least(abs(y - yhat) / greatest(abs(y), 1e-10), 10)) FILTER (abs(y) > 1e-10)
  ELSE avg(least(abs(y - yhat) / greatest(abs(y), 1e-10), 10)) END, 1000)"""
_R2 = "CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) END"


@query("Q10_forecast_metrics", rnd(HELD + f""" SELECT unique_id, count(*) AS points, avg(abs(y - yhat)) AS mae,
  avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, max(abs(y - yhat)) AS max_error,
  {_MAPE10} AS mape, {_R2} AS r2 FROM ev GROUP BY 1""", "mae mse rmse max_error mape r2", 3), 3)
def q10(spark, sf):
    return Q.forecast_metrics(held_out(spark, sf))


PER = HELD + """, per AS (SELECT unique_id, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae,
  sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat) / abs(y)) FILTER (y <> 0) * 100 AS mape,
  avg(2 * abs(y - yhat) / (abs(y) + abs(yhat) + 1e-8)) * 100 AS smape,
  CASE WHEN sum(y) <> 0 THEN sum(abs(y - yhat)) / sum(abs(y)) * 100 END AS wape, count(*) AS data_points,
  count(*) FILTER (y <> 0) AS effective_points, count(*) FILTER (y = 0) AS zero_values FROM ev GROUP BY 1)"""
_PERD = "mse mae rmse mape smape wape"


@query("Q11_per_series_metrics", rnd(PER + " SELECT * FROM per", _PERD, 3), 3)
def q11(spark, sf):
    return Q.per_series_metrics(held_out(spark, sf))


@query("Q12_overall_metrics", rnd(PER + " SELECT " + ", ".join(f"avg({c}) AS avg_{c}" for c in _PERD.split())
       + ", count(*) AS total_series, sum(data_points)::BIGINT AS total_points, count(*) FILTER (zero_values > 0) AS "
       "series_with_zeros FROM per", " ".join(f"avg_{c}" for c in _PERD.split()), 3), 3)
def q12(spark, sf):
    return Q.overall_metrics(Q.per_series_metrics(held_out(spark, sf)))


@query("Q13_bias_metrics", rnd(HELD + """ SELECT unique_id, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae,
  avg(abs(y - yhat) / abs(y)) FILTER (y <> 0) * 100 AS mape, avg(y) AS avg_actual, avg(yhat) AS avg_forecast,
  count(*) AS data_points, avg(yhat) - avg(y) AS bias,
  CASE WHEN avg(y) <> 0 THEN (avg(yhat) - avg(y)) / avg(y) * 100 ELSE 0 END AS bias_pct FROM ev GROUP BY 1""",
  "mse mae mape avg_actual avg_forecast bias bias_pct", 3), 3)
def q13(spark, sf):
    return Q.bias_metrics(held_out(spark, sf))


@query("Q13_overall_performance", rnd(HELD + f""" SELECT avg((y - yhat) * (y - yhat)) AS overall_mse,
  avg(abs(y - yhat)) AS overall_mae, avg(abs(y - yhat) / abs(y)) FILTER (y <> 0) * 100 AS overall_mape, {_R2} AS r2_score,
  count(*) AS total_points FROM ev""", "overall_mse overall_mae overall_mape r2_score", 3), 3)
def q13b(spark, sf):
    return Q.overall_performance(held_out(spark, sf))


#: 80/20 by time per series, train mean as the forecast, and its Gaussian AIC.
MEANED = TYPED + """, parts AS (SELECT *, floor(0.8 * n) AS cut FROM panel),
  fit AS (SELECT unique_id, avg(y) AS yhat, count(*) AS train_size, count(*) * ln(var_pop(y)) + 4 AS aic FROM parts
    WHERE idx <= cut GROUP BY 1),
  rows_ AS (SELECT unique_id, ds, y, yhat, aic, train_size FROM parts JOIN fit USING (unique_id) WHERE idx > cut),
  summ AS (SELECT unique_id, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae, any_value(aic) AS aic,
    any_value(train_size) AS train_size, count(*) AS test_size, avg(y) AS avg_actual, avg(yhat) AS avg_forecast FROM rows_ GROUP BY 1)"""


def mean_test_rows(spark, sf):
    split = H.holdout_fraction(whole_type_panel(spark, sf).select("unique_id", "ds", "y"), ["unique_id"], ["ds"],
                               F.trunc("ds", "year"))
    n = F.count(F.lit(1))
    fit = split.filter("part = 'train'").groupBy("unique_id").agg(
        F.avg("y").alias("yhat"), n.alias("train_size"), (n * F.log(F.var_pop("y")) + 4).alias("aic"))
    return split.filter("part = 'test'").drop("part").join(fit, "unique_id")


@query("Q14_forecast_summary", rnd(MEANED + " SELECT * FROM summ", "mse mae aic avg_actual avg_forecast", 1), 1)
def q14(spark, sf):
    return Q.forecast_summary(mean_test_rows(spark, sf))


@query("Q14_summary_totals", rnd(MEANED + " SELECT min(mse) AS best_mse, max(mse) AS worst_mse, avg(mse) AS avg_mse, "
       "avg(mae) AS avg_mae FROM summ", "best_mse worst_mse avg_mse avg_mae", 1), 1)
def q14b(spark, sf):
    return Q.summary_totals(Q.forecast_summary(mean_test_rows(spark, sf)))


@query("Q15_ts_cross_validate", rnd(TYPED + """, f AS (SELECT unique_id, y, fold, idx - 1 < n - (3 - fold) * (n // 4) AS is_train
    FROM panel, (SELECT unnest([0, 1, 2]) AS fold) WHERE n >= 30 AND idx - 1 < n - (3 - fold) * (n // 4) + n // 4),
  m AS (SELECT unique_id, fold, avg(y) AS mean FROM f WHERE is_train GROUP BY 1, 2),
  e AS (SELECT unique_id, fold, avg(abs(y - mean)) AS mae FROM f JOIN m USING (unique_id, fold) WHERE NOT is_train GROUP BY 1, 2)
  SELECT unique_id, avg(mae) AS cv_mae_mean, stddev_pop(mae) AS cv_mae_std FROM e GROUP BY 1""", "cv_mae_mean cv_mae_std", 3), 3)
def q15(spark, sf):
    return Q.ts_cross_validate(whole_type_panel(spark, sf).select("unique_id", "ds", "y"))


@query("F14_mape_category", PER + """ SELECT CASE WHEN mape < 10 THEN 'excellent' WHEN mape < 20 THEN 'good'
  WHEN mape < 30 THEN 'fair' WHEN mape IS NOT NULL THEN 'poor' END AS category, count(*) AS series FROM per GROUP BY 1""")
def f14(spark, sf):
    return E.category_counts(E.mape_category(Q.per_series_metrics(held_out(spark, sf))))


@query("A30_histogram", rnd(PER + """, b AS (SELECT coalesce(min(smape), 0) AS lo, coalesce(max(smape), 1) AS hi FROM per)
  SELECT bin, lo + bin * (hi - lo) / 10 AS lower, (SELECT count(*) FROM per WHERE least(floor((smape - lo) / ((hi - lo) / 10)), 9)
    = bin) AS n FROM b, (SELECT unnest(range(0, 10)) AS bin)""", "lower"))
def a30(spark, sf):
    return histogram(Q.per_series_metrics(held_out(spark, sf)), "smape", 10)


@query("T2_best_series", rnd(PER + " SELECT unique_id, mse, mae, smape FROM per ORDER BY mse, unique_id LIMIT 5", "mse mae smape", 3), 3)
def t2(spark, sf):
    return S.best_series(Q.per_series_metrics(held_out(spark, sf)), "mse").select("unique_id", "mse", "mae", "smape")


@query("T2_best_smape_series", rnd(PER + " SELECT unique_id, mse, mae, smape FROM per ORDER BY smape, unique_id LIMIT 3",
       "mse mae smape", 3), 3)
def t2b(spark, sf):
    return S.best_series(Q.per_series_metrics(held_out(spark, sf)), "smape", 3).select("unique_id", "mse", "mae", "smape")
