"""Query registry: each operator on the test tables, with an independent SQL statement."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("q_profile", "q_panel", "q_windows", "q_rules", "q_evaluate", "q_forecast", "q_models", "q_sources")


def query(name: str, sql: str | None = None, digits: int = 4) -> Callable[[Query], Query]:
    """Register a query; its doubles are rounded for the comparison with the SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        (F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(f"`{c}`")
        for c in df.columns
    ])


def rnd(sql: str, cols: str, digits: int = 4) -> str:
    """The SQL statement with the named double columns rounded."""
    star = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in cols.split())
    return f"SELECT * REPLACE ({star}) FROM ({sql})"


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tabloom.plans.{m}")


# ---------------------------------------------------------------- shared SQL pieces

#: The retail view (see tabloom.sources.tables.retail_sales).
RETAIL = """retail AS (
  SELECT CAST(l_shipdate AS DATE) AS BILLING_DATE,
    CASE WHEN p_partkey % 17 <> 0 THEN p_brand END AS BRAND, p_type AS MH_SEGMENT,
    split_part(p_name, ' ', 1) AS MH_FAMILY,
    'S' || CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) AS MH_CLASS,
    split_part(p_name, ' ', -1) AS MH_BRICK, s_nationkey AS SITE, o_orderpriority AS FORMAT_DESC,
    l_partkey AS ARTICLE,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice * (1 - l_discount) AS TOTAL_NET_SALES,
    l_extendedprice AS TOTAL_GROSS_SALES, l_extendedprice * l_discount AS TOTAL_DISCOUNT,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice * (1 - l_discount)
      - 0.6 * l_extendedprice AS TOTAL_GROSS_MARGIN,
    l_quantity AS TOTAL_BILLING_QTY, l_orderkey AS BILL, l_linenumber AS LINE
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN supplier ON s_suppkey = l_suppkey)"""

BRAND_KEY = "coalesce(BRAND, 'UNKNOWN_BRAND')"
TYPE_KEY = "MH_SEGMENT"


def panel_sql(key: str, name: str = "panel", whole: bool = False) -> str:
    """The daily panel as a common table expression; needs RETAIL before it."""
    cut = (lambda e: f"CAST(floor({e} + 0.00005) AS DOUBLE)") if whole else (lambda e: e)
    return f"""{name} AS (
  SELECT {key} AS unique_id, BILLING_DATE AS ds, {cut('sum(greatest(TOTAL_NET_SALES, 0))')} AS y,
    {cut('sum(TOTAL_BILLING_QTY)')} AS qty, {cut('sum(TOTAL_GROSS_MARGIN)')} AS margin,
    {cut('sum(TOTAL_GROSS_SALES)')} AS gross_sales, {cut('sum(TOTAL_DISCOUNT)')} AS discount
  FROM retail GROUP BY 1, 2)"""


def half_even(expr: str) -> str:
    """Two decimals, half to even, after removing summation noise beyond six decimals."""
    t = f"CAST(round(abs({expr}) * 1e6) AS BIGINT)"
    up = f"CASE WHEN {t} % 10000 > 5000 OR ({t} % 10000 = 5000 AND ({t} // 10000) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(sign({expr}) * (({t} // 10000) + {up}) / 100.0)"
