"""Queries: panels, rollups, frequency, joins, top-k, calendar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import calendar as C
from tabloom.operators import panel as S
from tabloom.operators import project as P
from tabloom.plans.registry import BRAND_KEY, RETAIL, TYPE_KEY, half_even, panel_sql, query, rnd
from tabloom.session import durable
from tabloom.sources.tables import retail_sales, table


def brand_sales(spark, sf, **kw):
    return P.fill_constant(retail_sales(spark, sf, **kw), ("BRAND",))


def brand_panel(spark, sf):
    return S.daily_panel(brand_sales(spark, sf), "BRAND")


def type_panel(spark, sf):
    return S.daily_panel(retail_sales(spark, sf), "MH_SEGMENT")


def pair_sales(spark, sf):
    return P.fill_constant(retail_sales(spark, sf)).withColumn("KEY2", F.concat_ws(" | ", "BRAND", "MH_SEGMENT"))


def whole_type_panel(spark, sf):
    return S.whole_units(type_panel(spark, sf))


def whole_brand_panel(spark, sf):
    return S.whole_units(brand_panel(spark, sf))


PAIR_KEY = f"{BRAND_KEY} || ' | ' || MH_SEGMENT"


def quality_sql(key: str) -> str:
    s = "CASE WHEN TOTAL_NET_SALES < 0 THEN 0 ELSE TOTAL_NET_SALES END"
    return f"""SELECT *, CAST(date_diff('day', first_date, last_date) + 1 AS INTEGER) AS data_span_days,
      sales_std / CASE WHEN avg_sales = 0 THEN 1 ELSE avg_sales END AS cv,
      unique_days / (date_diff('day', first_date, last_date) + 1) AS data_density
    FROM (SELECT {key} AS unique_id, {half_even(f'sum({s})')} AS total_sales, {half_even(f'avg({s})')} AS avg_sales,
      count(*) AS transaction_count, {half_even(f'stddev_samp({s})')} AS sales_std, min(BILLING_DATE) AS first_date,
      max(BILLING_DATE) AS last_date, count(DISTINCT BILLING_DATE) AS unique_days,
      {half_even('sum(TOTAL_BILLING_QTY)')} AS total_qty, {half_even('sum(TOTAL_GROSS_MARGIN)')} AS total_margin
      FROM retail GROUP BY 1)"""


_QD = "total_sales avg_sales sales_std total_qty total_margin cv data_density"
_STRICT = ("unique_days >= 60 AND data_span_days >= 90 AND data_density >= 0.3 AND total_sales >= 10000 "
           "AND transaction_count >= 30 AND cv < 3")


@query("A12_series_quality", rnd(f"WITH {RETAIL} {quality_sql(PAIR_KEY)}", _QD))
def a12(spark, sf):
    return S.series_quality(pair_sales(spark, sf), "KEY2")


@query("A12_series_quality_daily", rnd(f"WITH {RETAIL} {quality_sql(PAIR_KEY)}", _QD))
def a12b(spark, sf):
    return S.series_quality_daily(S.daily_parts(pair_sales(spark, sf), "KEY2"))


def _viable_sql(key):
    return rnd(f"""WITH {RETAIL}, q AS ({quality_sql(key)}), strict AS (SELECT * FROM q WHERE {_STRICT}),
  lenient AS (SELECT * FROM q WHERE unique_days >= 30 AND total_sales >= 5000)
  SELECT * FROM (SELECT * FROM strict UNION ALL
    SELECT * FROM lenient WHERE NOT EXISTS (SELECT 1 FROM strict)) ORDER BY total_sales DESC, unique_id LIMIT 8""", _QD)


@query("A13_viable_series", _viable_sql(BRAND_KEY))
def a13(spark, sf):
    return S.viable_series(S.series_quality(brand_sales(spark, sf), "BRAND"))


@query("A13_viable_series_fallback", _viable_sql(PAIR_KEY))
def a13b(spark, sf):
    return S.viable_series(S.series_quality(pair_sales(spark, sf), "KEY2"))


@query("A14_viable_series_simple", rnd(f"""WITH {RETAIL} SELECT {PAIR_KEY} AS unique_id,
  count(DISTINCT BILLING_DATE) AS unique_days, count(TOTAL_NET_SALES) AS transaction_count,
  {half_even('sum(TOTAL_NET_SALES)')} AS total_sales, {half_even('avg(TOTAL_NET_SALES)')} AS avg_sales,
  {half_even('sum(TOTAL_BILLING_QTY)')} AS total_qty FROM retail GROUP BY 1
  HAVING count(TOTAL_NET_SALES) >= 30 AND count(DISTINCT BILLING_DATE) >= 20
  ORDER BY total_sales DESC, unique_id LIMIT 50""", "total_sales avg_sales total_qty"))
def a14(spark, sf):
    return S.viable_series_simple(pair_sales(spark, sf), "KEY2")


_PD = "y qty margin gross_sales discount"


@query("A15_daily_panel", rnd(f"WITH {RETAIL}, {panel_sql(BRAND_KEY)} SELECT * FROM panel", _PD))
def a15(spark, sf):
    return brand_panel(spark, sf)


@query("A16_daily_rollups", rnd(f"""WITH {RETAIL}
  SELECT BILLING_DATE, SITE, BRAND, sum(TOTAL_NET_SALES) AS net_sales, sum(TOTAL_GROSS_SALES) AS gross_sales,
    sum(TOTAL_BILLING_QTY) AS qty,
    CASE WHEN GROUPING(SITE) = 1 AND GROUPING(BRAND) = 1 THEN 'overall' WHEN GROUPING(SITE) = 0 THEN 'site'
      ELSE 'brand' END AS level
  FROM (SELECT * REPLACE ({BRAND_KEY} AS BRAND) FROM retail)
  GROUP BY GROUPING SETS ((BILLING_DATE), (BILLING_DATE, SITE), (BILLING_DATE, BRAND))""", "net_sales gross_sales qty"))
def a16(spark, sf):
    return S.daily_rollups(brand_sales(spark, sf, with_dims=True))


@query("A16_rollup_summary", rnd(f"""WITH {RETAIL}, d AS (
    SELECT 'overall' AS level, 'all' AS member, BILLING_DATE, sum(TOTAL_NET_SALES) AS s FROM retail GROUP BY ALL
    UNION ALL SELECT 'site', CAST(SITE AS VARCHAR), BILLING_DATE, sum(TOTAL_NET_SALES) FROM retail GROUP BY ALL
    UNION ALL SELECT 'brand', {BRAND_KEY}, BILLING_DATE, sum(TOTAL_NET_SALES) FROM retail GROUP BY ALL)
  SELECT level, member, count(*) AS days, avg(s) AS avg_daily_sales FROM d GROUP BY 1, 2""", "avg_daily_sales"))
def a16b(spark, sf):
    return S.rollup_summary(S.daily_rollups(brand_sales(spark, sf, with_dims=True)))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("A17_pivot_daily", rnd(f"WITH {RETAIL}, {panel_sql(TYPE_KEY)} SELECT ds, " + ", ".join(
    f"coalesce(sum(y) FILTER (unique_id = '{t}'), 0) AS \"{t}\"" for t in _TYPES) + " FROM panel GROUP BY ds",
    " ".join(_TYPES)))
def a17(spark, sf):
    return S.pivot_daily(type_panel(spark, sf))


_MONDAY = "CAST(date_trunc('week', {d} - INTERVAL 1 DAY) AS DATE) + 7"


def _weekly_sql(key, aggs, outs):
    return f"""WITH {RETAIL}, w AS (SELECT {key} AS unique_id, {_MONDAY.format(d='BILLING_DATE')} AS ds, {aggs}
    FROM retail GROUP BY 1, 2),
  sp AS (SELECT unique_id, unnest(generate_series(min(ds)::TIMESTAMP, max(ds)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS ds
    FROM w GROUP BY 1) SELECT sp.unique_id, sp.ds, {outs} FROM sp LEFT JOIN w USING (unique_id, ds)"""


@query("A18_resample_weekly", rnd(_weekly_sql(PAIR_KEY, "sum(TOTAL_NET_SALES) AS y", "coalesce(y, 0) AS y"), "y"))
def a18(spark, sf):
    return S.resample_weekly(pair_sales(spark, sf), "KEY2", "BILLING_DATE", "TOTAL_NET_SALES")


# The holiday list of the weekly covariates, and dates inside the test period.
_HOLIDAYS = ["2023-01-26", "2023-08-15", "2024-01-26", "1998-01-26", "1999-08-15"]


@query("A19_resample_weekly_covariates", rnd(_weekly_sql(
    PAIR_KEY, "sum(TOTAL_BILLING_QTY) AS qty, sum(TOTAL_DISCOUNT) AS discount, "
    "avg(isodow(BILLING_DATE) - 1) AS dayofweek, CAST(sum(CASE WHEN BILLING_DATE IN (" + ", ".join(
        f"DATE '{d}'" for d in _HOLIDAYS) + ") THEN 1 ELSE 0 END) AS BIGINT) AS is_holiday",
    "coalesce(qty, 0) AS qty, coalesce(discount, 0) AS discount, dayofweek, coalesce(is_holiday, 0) AS is_holiday"),
    "qty discount dayofweek"))
def a19(spark, sf):
    return S.resample_weekly_covariates(pair_sales(spark, sf), "KEY2", "BILLING_DATE",
                                        C.is_holiday(F.col("BILLING_DATE"), _HOLIDAYS))


@query("A20_weekday_totals", rnd(f"""WITH {RETAIL} SELECT CAST(isodow(BILLING_DATE) - 1 AS INTEGER) AS weekday,
  dayname(BILLING_DATE) AS day_name, sum(TOTAL_NET_SALES) AS sales FROM retail GROUP BY 1, 2""", "sales"))
def a20(spark, sf):
    return S.weekday_totals(retail_sales(spark, sf))


def diagnosis_sql(key):
    return f"""SELECT unique_id, CAST(sum(CASE WHEN gap = 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates,
    date_diff('day', min(ds), max(ds)) + 1 - count(*) AS missing_dates,
    CAST(sum(CASE WHEN gap <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS irregular_gaps,
    date_diff('day', min(ds), max(ds)) + 1 AS date_range_days, count(*) AS actual_data_points,
    CASE WHEN count(*) >= 3 AND coalesce(sum(CASE WHEN gap <> 1 THEN 1 ELSE 0 END), 0) = 0 THEN 1 ELSE 0 END AS is_daily
  FROM (SELECT {key} AS unique_id, BILLING_DATE AS ds,
      date_diff('day', lag(BILLING_DATE) OVER (PARTITION BY {key} ORDER BY BILLING_DATE), BILLING_DATE) AS gap
    FROM retail) GROUP BY 1"""


@query("A21_frequency_diagnosis", f"WITH {RETAIL} {diagnosis_sql(PAIR_KEY)}")
def a21(spark, sf):
    return S.frequency_diagnosis(pair_sales(spark, sf), "KEY2", "BILLING_DATE")


@query("A22_frequency_verify", rnd(f"""WITH {RETAIL}, {panel_sql(BRAND_KEY)}, d AS (SELECT unique_id, count(*) AS n,
    date_diff('day', min(ds), max(ds)) + 1 AS span FROM panel GROUP BY 1)
  SELECT count(*) FILTER (span = n AND n >= 3) + count(*) FILTER (span >= 3) AS daily_series, 2 * count(*) AS total_series,
    (count(*) FILTER (span = n AND n >= 3) + count(*) FILTER (span >= 3)) * 100.0::DOUBLE / (2 * count(*)) AS success_pct
  FROM d""", "success_pct"))
def a22(spark, sf):
    """All series before and after completing them: the first half is irregular."""
    from tabloom.operators.regularise import regularise_daily_simple
    raw = brand_panel(spark, sf).select("unique_id", "ds", "y")
    done = regularise_daily_simple(raw, "zero", min_rows=1, unique=True)
    both = raw.withColumn("unique_id", F.concat(F.lit("raw "), "unique_id")).unionByName(done)
    return S.frequency_verify(S.frequency_diagnosis(both))


@query("A23_date_coverage", rnd(f"""WITH {RETAIL} SELECT min(d) AS min_date, max(d) AS max_date,
  CAST(date_diff('day', min(d), max(d)) AS INTEGER) AS span_days, count(*) AS unique_dates, avg(n) AS avg_rows,
  min(n) AS min_rows, max(n) AS max_rows FROM (SELECT BILLING_DATE AS d, count(*) AS n FROM retail GROUP BY 1)""",
  "avg_rows"))
def a23(spark, sf):
    return S.date_coverage(retail_sales(spark, sf))


@query("A24_dimension_cardinality", f"WITH {RETAIL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique FROM retail" for c in ("SITE", "BRAND", "ARTICLE", "FORMAT_DESC")))
def a24(spark, sf):
    return S.dimension_cardinality(retail_sales(spark, sf, with_dims=True), ["SITE", "BRAND", "ARTICLE", "FORMAT_DESC"])


@query("A26_history_length_stats", rnd(f"""WITH {RETAIL} SELECT count(*) AS series, min(n) AS min_days, max(n) AS max_days,
  quantile_cont(n, 0.5)::DOUBLE AS median_days FROM (SELECT {PAIR_KEY} AS k, count(DISTINCT BILLING_DATE) AS n
  FROM retail GROUP BY 1)""", "median_days"))
def a26(spark, sf):
    return S.history_length_stats(pair_sales(spark, sf), "KEY2")


@query("A27_forecast_target_options", rnd(f"""WITH {RETAIL}, d AS (SELECT BILLING_DATE AS d, sum(TOTAL_NET_SALES) AS a,
    sum(TOTAL_BILLING_QTY) AS b, count(*) AS c FROM retail GROUP BY 1)
  SELECT 'daily_total_sales' AS option, min(d) AS min_date, max(d) AS max_date, avg(a) AS mean, stddev_samp(a) AS std FROM d
  UNION ALL SELECT 'daily_total_quantity', min(d), max(d), avg(b), stddev_samp(b) FROM d
  UNION ALL SELECT 'daily_transaction_count', min(d), max(d), avg(c), stddev_samp(c) FROM d""", "mean std"))
def a27(spark, sf):
    return S.forecast_target_options(retail_sales(spark, sf))


# ---------------------------------------------------------------- joins, top-k

@query("J2_spine_left_join", rnd(f"""WITH {RETAIL}, {panel_sql(BRAND_KEY)},
  sp AS (SELECT unique_id, unnest(generate_series(min(ds)::TIMESTAMP, max(ds)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS ds
    FROM panel GROUP BY 1) SELECT sp.unique_id, sp.ds, y, qty, margin, gross_sales, discount
  FROM sp LEFT JOIN panel USING (unique_id, ds)""", _PD))
def j2(spark, sf):
    return S.spine_left_join(brand_panel(spark, sf))


@query("J3_top_series_semi", rnd(f"""WITH {RETAIL}, {panel_sql(BRAND_KEY)}
  SELECT * FROM panel WHERE unique_id IN (SELECT unique_id FROM panel GROUP BY 1
    ORDER BY round(sum(y), 4) DESC, unique_id LIMIT 5)""", _PD))
def j3(spark, sf):
    panel = durable(brand_panel(spark, sf), "panel")  # ranked and filtered: the lines are read once
    return S.keep_series(panel, S.top_n_series(panel, 5), "unique_id")


@query("J4_lookup_share", rnd(f"""WITH {RETAIL} SELECT BILL, LINE, ARTICLE, r.BRAND, f AS BRAND_frequency FROM retail r
  LEFT JOIN (SELECT BRAND, count(*) / (SELECT count(BRAND) FROM retail) AS f FROM retail WHERE BRAND IS NOT NULL
    GROUP BY 1) s ON r.BRAND = s.BRAND""", "BRAND_frequency", 8), 8)
def j4(spark, sf):
    sales = retail_sales(spark, sf).select("BILL", "LINE", "ARTICLE", "BRAND")
    return S.lookup_share(sales, "BRAND")


@query("J5_missing_dates_anti", f"""WITH {RETAIL}, {panel_sql(BRAND_KEY)}, sp AS (SELECT unique_id,
    unnest(generate_series(min(ds)::TIMESTAMP, max(ds)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS ds FROM panel GROUP BY 1)
  SELECT unique_id AS BRAND, ds FROM sp WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.unique_id = sp.unique_id
    AND p.ds = sp.ds)""")
def j5(spark, sf):
    return S.missing_dates(brand_sales(spark, sf), "BILLING_DATE", "BRAND")


@query("J1_null_dates", "SELECT count(*) FILTER (TRY_CAST(o_comment AS DATE) IS NULL) AS null_dates FROM (SELECT CASE WHEN o_orderkey % 3 = 0 "
       "THEN 'no date' WHEN o_orderkey % 7 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS o_comment FROM orders)")
def j1_null(spark, sf):
    day = F.col("o_orderdate").cast("date").cast("string")
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "no date").when(F.col("o_orderkey") % 7 > 0, day).alias("ds"))
    return S.null_dates(o)


@query("U2_date_set_difference", """SELECT CAST(d AS DATE) AS ds FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE))::TIMESTAMP,
    max(CAST(o_orderdate AS DATE))::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM orders WHERE o_orderstatus = 'P')
  WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P')""")
def u2(spark, sf):
    """Calendar days between the first and the last order in progress on which none was placed."""
    return S.missing_dates(table(spark, sf, "orders").filter("o_orderstatus = 'P'"), "o_orderdate")


@query("T1_top_n_series", rnd(f"""WITH {RETAIL}, {panel_sql(PAIR_KEY)} SELECT unique_id, sum(y) AS total FROM panel
  GROUP BY 1 ORDER BY round(sum(y), 4) DESC, unique_id LIMIT 20""", "total"))
def t1(spark, sf):
    return S.top_n_series(S.daily_panel(pair_sales(spark, sf), "KEY2"))


@query("T2_most_missing_series", f"""WITH {RETAIL} SELECT unique_id, missing_dates, actual_data_points
  FROM ({diagnosis_sql(PAIR_KEY)}) ORDER BY missing_dates DESC, unique_id DESC LIMIT 5""")
def t2(spark, sf):
    d = S.frequency_diagnosis(pair_sales(spark, sf), "KEY2", "BILLING_DATE")
    worst = d.orderBy(F.desc("missing_dates"), F.desc("unique_id")).limit(5)
    return worst.select("unique_id", "missing_dates", "actual_data_points")


@query("T2_worst_series", f"""WITH {RETAIL} SELECT unique_id, missing_dates FROM ({diagnosis_sql(PAIR_KEY)})
  ORDER BY missing_dates DESC, unique_id LIMIT 5""")
def t2_worst(spark, sf):
    d = S.frequency_diagnosis(pair_sales(spark, sf), "KEY2", "BILLING_DATE")
    return S.worst_series(d, "missing_dates").select("unique_id", "missing_dates")


@query("T4_series_with_most_points", f"""WITH {RETAIL}, {panel_sql(PAIR_KEY)} SELECT unique_id, count(*) AS points
  FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def t4(spark, sf):
    return S.series_with_most_points(S.daily_panel(pair_sales(spark, sf), "KEY2"), 5)


@query("T5_top_brands", rnd(f"""WITH {RETAIL} SELECT * FROM (SELECT coalesce(BRAND, 'nan') AS BRAND,
  sum(TOTAL_NET_SALES) AS sales FROM retail GROUP BY 1 ORDER BY round(sum(TOTAL_NET_SALES), 4) DESC, 1 LIMIT 5)
  WHERE BRAND <> 'nan'""", "sales"))
def t5(spark, sf):
    return S.top_brands(retail_sales(spark, sf))


@query("U1_union_series", rnd(f"""WITH {RETAIL}, {panel_sql(TYPE_KEY)}, {panel_sql("'overall'", "everything")}
  SELECT unique_id, ds, y FROM panel UNION ALL SELECT unique_id, ds, y FROM everything""", "y"))
def u1(spark, sf):
    sales = retail_sales(spark, sf)
    whole = S.daily_panel(sales.withColumn("ALL", F.lit("overall")), "ALL")
    return type_panel(spark, sf).select("unique_id", "ds", "y").unionByName(whole.select("unique_id", "ds", "y"))


# ---------------------------------------------------------------- calendar

def _dates(spark, sf):
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("ds")).distinct()


def _event_days(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_date("ts").alias("ds"))


_D = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS ds FROM lineitem"


@query("F1_calendar_features", f"""SELECT ds, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month,
  CAST(day(ds) AS INTEGER) AS day, CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week,
  CAST(dayofyear(ds) AS INTEGER) AS day_of_year, CAST(weekofyear(ds) AS INTEGER) AS week_of_year,
  CAST(quarter(ds) AS INTEGER) AS quarter FROM ({_D})""")
def f1(spark, sf):
    return C.add(_dates(spark, sf), C.calendar_columns(F.col("ds")))


@query("F2_period_flags", f"""SELECT ds, CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN day(ds) = 1 THEN 1 ELSE 0 END AS is_month_start,
  CASE WHEN day(ds + 1) = 1 THEN 1 ELSE 0 END AS is_month_end,
  CASE WHEN day(ds) = 1 AND month(ds) IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS is_quarter_start,
  CASE WHEN day(ds + 1) = 1 AND month(ds + 1) IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS is_quarter_end,
  CASE WHEN day(ds) = 1 AND month(ds) = 1 THEN 1 ELSE 0 END AS is_year_start,
  CASE WHEN day(ds) = 31 AND month(ds) = 12 THEN 1 ELSE 0 END AS is_year_end FROM ({_D})""")
def f2(spark, sf):
    return C.add(_dates(spark, sf), C.period_columns(F.col("ds")))


@query("F3_cyclic_encoding", rnd("SELECT ds, " + ", ".join(
    f"{fn}(2 * pi() * {v} / {p}) AS {n}_{fn}" for n, v, p in (("month", "month(ds)", 12), ("day", "day(ds)", 31),
                                                              ("dow", "(isodow(ds) - 1)", 7)) for fn in ("sin", "cos"))
    + f" FROM ({_D})", "month_sin month_cos day_sin day_cos dow_sin dow_cos", 8), 8)
def f3(spark, sf):
    return C.add(_dates(spark, sf), C.cyclic_columns(F.col("ds")))


@query("F4_days_since", f"""SELECT ds, CAST(date_diff('day', date_trunc('year', ds)::DATE, ds) AS INTEGER)
  AS days_since_year_start, CAST(date_diff('day', date_trunc('month', ds)::DATE, ds) AS INTEGER) AS days_since_month_start
  FROM ({_D})""")
def f4(spark, sf):
    return C.add(_dates(spark, sf), C.elapsed_columns(F.col("ds")))


@query("F5_holiday_flags", "SELECT event_id, CAST(ts AS DATE) AS ds, " + ", ".join(
    f"CASE WHEN CAST(ts AS DATE) = DATE '{d}' THEN 1 ELSE 0 END AS is_{n}" for n, d in C.HOLIDAYS_2024.items())
    + " FROM events")
def f5(spark, sf):
    return C.add(_event_days(spark, sf), C.holiday_columns(F.col("ds")))


@query("F6_holiday_proximity", "SELECT event_id, CAST(ts AS DATE) AS ds, " + ", ".join(
    f"CASE WHEN CAST(ts AS DATE) = DATE '2024-01-26' {op} {k} THEN 1 ELSE 0 END AS days_{w}_republic_day_{k}"
    for k in (1, 2, 3) for op, w in (("-", "before"), ("+", "after"))) + " FROM events")
def f6(spark, sf):
    return C.add(_event_days(spark, sf),
                 C.proximity_columns(F.col("ds"), "republic_day", C.HOLIDAYS_2024["republic_day"]))


@query("F7_recurring_holidays", "SELECT ds, " + ", ".join(
    f"CASE WHEN strftime(ds, '%m-%d') = '{d}' THEN 1 ELSE 0 END AS is_{n}" for n, d in C.RECURRING_HOLIDAYS.items())
    + f", 0 AS is_holi, 0 AS is_diwali FROM ({_D})")
def f7(spark, sf):
    return C.add(_dates(spark, sf), C.recurring_columns(F.col("ds")))


@query("F8_is_holiday", "SELECT event_id, CASE WHEN CAST(ts AS DATE) IN (DATE '2024-01-26', DATE '2024-01-01') "
       "THEN 1 ELSE 0 END AS is_holiday FROM events")
def f8(spark, sf):
    return _event_days(spark, sf).select(
        "event_id", C.is_holiday(F.col("ds"), ["2024-01-26", "2024-01-01"]).alias("is_holiday"))
