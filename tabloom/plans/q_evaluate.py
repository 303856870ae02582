"""Queries: metrics, model choice, ensembles on prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import evaluate as E
from tabloom.operators import profile as A
from tabloom.plans.registry import query, rnd
from tabloom.sources.tables import table

#: Four sets of predictions for every billing line, as fixed formulas of its columns.
PRED = """pred AS (
  SELECT row_number() OVER () AS rid, m.model, y, CASE m.model
    WHEN 'near' THEN floor(y / 1000) * 1000 WHEN 'shrunk' THEN 0.75 * y + 12000 WHEN 'quantity' THEN l_quantity * 1500
    ELSE 38000 END AS yhat, l_orderkey, l_linenumber, l_partkey
  FROM (SELECT l_extendedprice AS y, * FROM lineitem), (SELECT unnest(['near', 'shrunk', 'quantity', 'flat']) AS model) m)"""


def line_predictions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                             F.col("l_extendedprice").alias("y"))
    y = F.col("y")
    made = {"near": F.floor(y / 1000) * 1000.0, "shrunk": 0.75 * y + 12000, "quantity": F.col("l_quantity") * 1500.0,
            "flat": F.lit(38000.0)}
    sets = F.array(*[F.struct(F.lit(n).alias("model"), e.cast("double").alias("yhat")) for n, e in made.items()])
    return li.withColumn("_m", F.explode(sets)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "y", F.col("_m.model").alias("model"), F.col("_m.yhat").alias("yhat"))


_REG = """SELECT model, count(*) AS n, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
  avg(abs(y - yhat)) AS mae, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2,
  max(abs(y - yhat)) AS max_error, CASE WHEN count(*) FILTER (y = 0) = 0 THEN avg(abs(y - yhat) / abs(y)) END AS mape,
  quantile_cont(abs(y - yhat), 0.5) AS median_ae FROM pred GROUP BY model"""


@query("E6_regression_metrics", rnd(f"WITH {PRED} {_REG}", "mse rmse mae r2 max_error mape median_ae", 3), 3)
def e6(spark, sf):
    return E.regression_metrics(line_predictions(spark, sf), by=("model",))


@query("E6_percent_metrics", rnd(f"WITH {PRED} SELECT model, avg(abs(y - yhat) / abs(y)) * 100 AS mape_pct FROM pred "
       "GROUP BY model", "mape_pct"))
def e6b(spark, sf):
    return E.percent_metrics(line_predictions(spark, sf), by=("model",))


#: Three sets of class predictions for every order.
CLS = """cls AS (SELECT o_orderkey, o_orderstatus AS y, m.model, CASE m.model
    WHEN 'price' THEN CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END
    WHEN 'mostly' THEN CASE WHEN o_totalprice < 50000 THEN 'F' ELSE o_orderstatus END ELSE 'O' END AS yhat
  FROM orders, (SELECT unnest(['price', 'mostly', 'constant']) AS model) m)"""


def order_classes(spark, sf):
    o = table(spark, sf, "orders")
    price, y = F.col("o_totalprice"), F.col("o_orderstatus")
    made = {"price": F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P"),
            "mostly": F.when(price < 50000, "F").otherwise(y), "constant": F.lit("O")}
    sets = F.array(*[F.struct(F.lit(n).alias("model"), e.alias("yhat")) for n, e in made.items()])
    return o.select("o_orderkey", y.alias("y"), F.explode(sets).alias("_m")).select(
        "o_orderkey", "y", F.col("_m.model").alias("model"), F.col("_m.yhat").alias("yhat"))


def _cls_sql(src, positive=None):
    pick = (lambda c: f"sum({c} * support) / sum(support)") if positive is None else (
        lambda c: f"max({c}) FILTER (c = '{positive}')")
    return f"""SELECT model, sum(support)::BIGINT AS n, count(*) AS num_classes, sum(hit) / sum(support) AS accuracy,
      {pick('p')} AS precision, {pick('r')} AS recall, {pick('f')} AS f1
    FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (
      SELECT model, c, support, hit, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p,
        CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM (
        SELECT k.model, k.c, count(*) FILTER (y = k.c) AS support, count(*) FILTER (yhat = k.c) AS predicted,
          count(*) FILTER (y = k.c AND yhat = k.c) AS hit
        FROM {src} JOIN (SELECT model, y AS c FROM {src} UNION SELECT model, yhat FROM {src}) k ON k.model = {src}.model
        GROUP BY 1, 2))) GROUP BY model"""


@query("E7_classification_metrics", rnd(f"WITH {CLS} {_cls_sql('cls')}", "accuracy precision recall f1", 6), 6)
def e7(spark, sf):
    return E.classification_metrics(order_classes(spark, sf), by=("model",))


_BIN = """bin AS (SELECT CAST(quality AS VARCHAR) AS y, m.model, CAST(CASE m.model WHEN 'long' THEN
    CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END ELSE 1 - toxic END AS VARCHAR) AS yhat
  FROM labels JOIN documents USING (doc_id), (SELECT unnest(['long', 'clean']) AS model) m)"""


@query("E7_binary_metrics", rnd(f"WITH {_BIN} {_cls_sql('bin', '1')}", "accuracy precision recall f1", 6), 6)
def e7b(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    sets = F.array(F.struct(F.lit("long").alias("model"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("yhat")),
                   F.struct(F.lit("clean").alias("model"), (1 - F.col("toxic")).alias("yhat")))
    rows = d.select(F.col("quality").alias("y"), F.explode(sets).alias("m")).select("y", "m.model", "m.yhat")
    return E.classification_metrics(rows, by=("model",))


#: Fold errors: ten folds by hash of the order, per model.
FOLDED = f"""WITH {PRED}, folds AS (SELECT model, CAST('0x' || substr(md5('7|' || l_orderkey), 1, 15) AS BIGINT) % 5 AS fold,
    y, yhat FROM pred), per_fold AS (SELECT model, fold, avg((y - yhat) * (y - yhat)) AS mse,
    1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2 FROM folds GROUP BY 1, 2),
  cv AS (SELECT model, avg(r2) AS cv_r2_mean, stddev_pop(r2) AS cv_r2_std, avg(mse) AS cv_mse_mean FROM per_fold GROUP BY 1),
  met AS (SELECT * FROM ({_REG}) JOIN cv USING (model))"""


def fold_metrics(spark, sf):
    from tabloom.operators.splits import add_folds
    folded = add_folds(line_predictions(spark, sf), ["l_orderkey"])
    return E.regression_metrics(folded, by=("model", "fold"), median=False)


def model_metrics(spark, sf):
    cv = fold_metrics(spark, sf).groupBy("model").agg(
        F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"), F.avg("mse").alias("cv_mse_mean"))
    return E.regression_metrics(line_predictions(spark, sf), by=("model",)).join(cv, "model")


_SCORE = "0.4 * r2 + 0.4 * cv_r2_mean + 0.2 * (1 - cv_r2_std / greatest(abs(cv_r2_mean), 0.01))"


@query("E6_cv_rmse", rnd(FOLDED + """ SELECT model, sqrt(avg(mse)) AS cv_rmse_mean, sqrt(stddev_pop(mse)) AS cv_rmse_std
  FROM per_fold GROUP BY 1""", "cv_rmse_mean cv_rmse_std", 3), 3)
def e6c(spark, sf):
    return E.cv_rmse(fold_metrics(spark, sf), ("model",))


@query("E9_select_best_regression", rnd(FOLDED + f" SELECT model, r2, cv_r2_mean, {_SCORE} AS score FROM met "
       "ORDER BY score DESC, model LIMIT 1", "r2 cv_r2_mean score", 6), 6)
def e9(spark, sf):
    best = E.select_best(E.regression_score(model_metrics(spark, sf)))
    return best.select("model", "r2", "cv_r2_mean", "score")


@query("E9_select_best_classification", rnd(f"""WITH {CLS}, m AS ({_cls_sql('cls')}), folds AS (SELECT model,
    CAST('0x' || substr(md5('7|' || o_orderkey), 1, 15) AS BIGINT) % 5 AS fold, CASE WHEN y = yhat THEN 1 ELSE 0 END AS hit
    FROM cls), pf AS (SELECT model, fold, avg(hit) AS a FROM folds GROUP BY 1, 2),
  cv AS (SELECT model, avg(a) AS cv_accuracy_mean, stddev_pop(a) AS cv_accuracy_std FROM pf GROUP BY 1)
  SELECT model, accuracy, f1, cv_accuracy_mean, 0.3 * accuracy + 0.3 * f1 + 0.3 * cv_accuracy_mean
    + 0.1 * (1 - cv_accuracy_std / greatest(abs(cv_accuracy_mean), 0.01)) AS score FROM m JOIN cv USING (model)
  ORDER BY score DESC, model LIMIT 1""", "accuracy f1 cv_accuracy_mean score", 6), 6)
def e9b(spark, sf):
    from tabloom.operators.splits import add_folds
    rows = order_classes(spark, sf)
    cv = E.classification_metrics(add_folds(rows, ["o_orderkey"]), by=("model", "fold")).groupBy("model").agg(
        F.avg("accuracy").alias("cv_accuracy_mean"), F.stddev_pop("accuracy").alias("cv_accuracy_std"))
    scored = E.classification_score(E.classification_metrics(rows, by=("model",)).join(cv, "model"))
    return E.select_best(scored).select("model", "accuracy", "f1", "cv_accuracy_mean", "score")


@query("E9_select_smallest_error", rnd(f"WITH {PRED}, m AS ({_REG}) SELECT 'mse' AS rule, model, mse AS value FROM (SELECT * FROM m ORDER BY mse, "
       "model LIMIT 1) UNION ALL SELECT 'mae', model, mae FROM (SELECT * FROM m ORDER BY mae, model LIMIT 1) UNION ALL "
       "SELECT 'r2', model, r2 FROM (SELECT * FROM m ORDER BY r2 DESC, model LIMIT 1)", "value", 3), 3)
def e9c(spark, sf):
    m = E.regression_metrics(line_predictions(spark, sf), by=("model",), median=False)
    pick = lambda c, up: E.select_best(m, c, up).select(F.lit(c).alias("rule"), "model", F.col(c).alias("value"))
    return pick("mse", False).unionByName(pick("mae", False)).unionByName(pick("r2", True))


_ROW = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(round(y * 100) AS BIGINT)"


@query("E10_ensemble_regression", rnd(f"""WITH {PRED}, m AS ({_REG}), top AS (SELECT model FROM m WHERE r2 > 0.3
    ORDER BY r2 DESC, model LIMIT 5) SELECT {_ROW} AS row_id, any_value(y) AS y, avg(yhat) AS yhat FROM pred
  WHERE model IN (SELECT model FROM top) AND (SELECT count(*) FROM top) >= 2 GROUP BY 1""", "y yhat", 6), 6)
def e10(spark, sf):
    rows = line_predictions(spark, sf).withColumn("row_id", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("y") * 100).cast("long")))
    metrics = E.regression_metrics(rows, by=("model",), median=False)
    return E.ensemble_regression(rows, metrics)


_PROB = """prob AS (SELECT o_orderkey AS row_id, o_orderstatus AS y, m.model, k.class,
    CASE m.model WHEN 'sharp' THEN CASE WHEN k.class = o_orderstatus THEN 0.7 ELSE 0.15 END
      WHEN 'price' THEN CASE WHEN k.class = CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O'
        ELSE 'P' END THEN 0.9 ELSE 0.05 END ELSE CASE WHEN k.class = o_orderstatus THEN 0.5 ELSE 0.25 END END AS prob
  FROM orders, (SELECT unnest(['sharp', 'price', 'soft']) AS model) m, (SELECT unnest(['F', 'O', 'P']) AS class) k)"""


def order_probabilities(spark, sf):
    o = table(spark, sf, "orders")
    y, price = F.col("o_orderstatus"), F.col("o_totalprice")
    guess = F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P")
    p = lambda m, c: {"sharp": F.when(y == c, 0.7).otherwise(0.15), "price": F.when(guess == c, 0.9).otherwise(0.05),
                      "soft": F.when(y == c, 0.5).otherwise(0.25)}[m]
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("class"), p(m, c).alias("prob"))
                      for m in ("sharp", "price", "soft") for c in ("F", "O", "P")])
    return o.select(F.col("o_orderkey").alias("row_id"), y.alias("y"), F.explode(cells).alias("m")).select(
        "row_id", "y", "m.model", "m.class", "m.prob")


@query("E10_ensemble_classification", rnd(f"""WITH {_PROB}, hard AS (SELECT row_id, model, y, arg_max(class, prob) AS yhat
    FROM prob GROUP BY ALL), acc AS (SELECT model, avg(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS a FROM hard GROUP BY 1),
  top AS (SELECT model FROM acc WHERE a > 0.6), mean AS (SELECT row_id, class, any_value(y) AS y, avg(prob) AS p FROM prob
    WHERE model IN (SELECT model FROM top) GROUP BY 1, 2)
  SELECT row_id, y, class AS yhat, p AS prob FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) AS r
    FROM mean) WHERE r = 1""", "prob", 6), 6)
def e10b(spark, sf):
    prob = order_probabilities(spark, sf)
    hard = prob.groupBy("row_id", "model").agg(F.first("y").alias("y"), F.max_by("class", "prob").alias("yhat"))
    return E.ensemble_classification(prob, E.classification_metrics(hard, by=("model",)))


@query("E10_replace_best", rnd(f"""WITH {PRED}, m AS ({_REG}), top AS (SELECT model FROM m WHERE r2 > 0.3 ORDER BY r2 DESC, model LIMIT 5),
  en AS (SELECT {_ROW} AS row_id, any_value(y) AS y, avg(yhat) AS yhat FROM pred WHERE model IN (SELECT model FROM top)
    GROUP BY 1), er AS (SELECT 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2 FROM en)
  SELECT model, r2 FROM (SELECT model, r2, 0 AS o FROM m UNION ALL SELECT 'ensemble', r2, 1 FROM er)
  ORDER BY r2 DESC, o LIMIT 1""", "r2", 6), 6)
def e10c(spark, sf):
    rows = line_predictions(spark, sf).withColumn("row_id", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("y") * 100).cast("long")))
    metrics = E.regression_metrics(rows, by=("model",), median=False)
    joint = E.regression_metrics(E.ensemble_regression(rows, metrics), median=False).withColumn("model", F.lit("ensemble"))
    return E.replace_best(E.select_best(metrics, "r2"), joint, "r2")


@query("E12_compare_models", rnd(f"""WITH {PRED}, {CLS} SELECT 'regression' AS task, model, NULL::DOUBLE AS accuracy,
    NULL::DOUBLE AS f1, r2, rmse FROM ({_REG})
  UNION ALL SELECT 'classification', model, accuracy, f1, NULL, NULL FROM ({_cls_sql('cls')})""", "accuracy f1 r2 rmse"))
def e12(spark, sf):
    reg = E.regression_metrics(line_predictions(spark, sf), by=("model",), median=False)
    cls = E.classification_metrics(order_classes(spark, sf), by=("model",))
    long = reg.withColumn("task", F.lit("regression")).unpivot(["task", "model"], ["r2", "rmse"], "metric", "value")
    long = long.unionByName(cls.withColumn("task", F.lit("classification")).unpivot(
        ["task", "model"], ["accuracy", "f1"], "metric", "value"))
    return E.compare_models(long, ["accuracy", "f1", "r2", "rmse"])


@query("E13_suitability", rnd(f"""WITH {PRED}, {CLS}, c AS (SELECT max(accuracy) AS best FROM ({_cls_sql('cls')})),
  r AS (SELECT max(r2) AS best FROM ({_REG})),
  s AS (SELECT (SELECT 3 + 2 + 2 + 3 * best FROM c) AS classification_score,
    (SELECT CASE WHEN count(DISTINCT l_extendedprice) > 20 THEN 3 ELSE 0 END
       + CASE WHEN count(DISTINCT l_extendedprice) / count(*) > 0.1 THEN 2 ELSE 0 END + 2 FROM lineitem)
    + (SELECT CASE WHEN best > 0 THEN 3 * best ELSE 0 END FROM r) AS regression_score)
  SELECT *, CASE WHEN classification_score > regression_score + 1 THEN 'classification'
    WHEN regression_score > classification_score + 1 THEN 'regression' ELSE 'both' END AS recommendation FROM s""",
    "classification_score regression_score"))
def e13(spark, sf):
    best = E.classification_metrics(order_classes(spark, sf), by=("model",)).agg(F.max("accuracy").alias("best"))
    top = E.regression_metrics(line_predictions(spark, sf), by=("model",), median=False).agg(F.max("r2").alias("best"))
    scores = best.withColumn("approach", F.lit("classification")).unionByName(top.withColumn("approach", F.lit("regression")))
    status = A.categorical_target_profile(table(spark, sf, "orders"), ["o_orderstatus"]).select(
        F.lit("classification").alias("approach"), "nunique", (F.col("nunique") / F.col("unique_ratio")).alias("n"),
        F.lit(1).alias("is_text"), F.lit(0).alias("is_numeric"))
    price = A.numeric_target_profile(table(spark, sf, "lineitem"), ["l_extendedprice"]).select(
        F.lit("regression").alias("approach"), "nunique", "n", F.lit(0).alias("is_text"), F.lit(1).alias("is_numeric"))
    return E.suitability(status.unionByName(price), scores)


@query("E14_overfit_indicator", rnd(FOLDED + " SELECT model, r2, cv_r2_mean, CASE WHEN cv_r2_mean <> 0 AND r2 <> 0 THEN "
       "abs(cv_r2_mean - r2) ELSE 0 END AS overfit FROM met", "r2 cv_r2_mean overfit", 6), 6)
def e14(spark, sf):
    return E.overfit_indicator(model_metrics(spark, sf), "cv_r2_mean").select("model", "r2", "cv_r2_mean", "overfit")


@query("A28_prediction_stats", rnd(f"WITH {PRED} SELECT min(yhat) AS min, max(yhat) AS max, avg(yhat) AS mean, "
       "stddev_pop(yhat) AS std FROM pred WHERE model = 'shrunk'", "min max mean std", 3), 3)
def a28(spark, sf):
    return A.prediction_stats(line_predictions(spark, sf).filter("model = 'shrunk'"), "yhat")


@query("A29_total_error_pct", rnd(f"WITH {PRED} SELECT abs(sum(yhat) - sum(y)) / sum(y) * 100 AS total_error_pct FROM pred "
       "WHERE model = 'shrunk'", "total_error_pct"))
def a29(spark, sf):
    return A.total_error_pct(line_predictions(spark, sf).filter("model = 'shrunk'"), "y", "yhat")
