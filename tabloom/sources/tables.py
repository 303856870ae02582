"""The test tables and the retail view built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_sales(spark: SparkSession, sf_dir: str, with_dims: bool = False) -> DataFrame:
    """Billing lines with the product hierarchy; site and format only on request.

    Joins that no column needs are left out, because an inner join is never pruned.
    BRAND is null for one part in seventeen, so that the null paths are exercised.
    Returned goods count negative.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("BRAND"),
        F.col("p_type").alias("MH_SEGMENT"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("MH_FAMILY"),
        F.concat(F.lit("S"), F.floor(F.col("p_size") / 10).cast("string")).alias("MH_CLASS"),
        F.split_part("p_name", F.lit(" "), F.lit(-1)).alias("MH_BRICK"),
    )
    rows = li.join(part, "l_partkey")
    extra = []
    if with_dims:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("FORMAT_DESC")
        )
        supplier = table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("SITE")
        )
        rows = rows.join(orders, "l_orderkey").join(supplier, "l_suppkey")
        extra = ["SITE", "FORMAT_DESC"]
    net = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    net = F.when(F.col("l_returnflag") == "R", -net).otherwise(net)
    return rows.select(
        F.to_date("l_shipdate").alias("BILLING_DATE"),
        "BRAND", "MH_SEGMENT", "MH_FAMILY", "MH_CLASS", "MH_BRICK", *extra,
        F.col("l_partkey").alias("ARTICLE"),
        net.alias("TOTAL_NET_SALES"),
        F.col("l_extendedprice").alias("TOTAL_GROSS_SALES"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("TOTAL_DISCOUNT"),
        (net - F.lit(0.6) * F.col("l_extendedprice")).alias("TOTAL_GROSS_MARGIN"),
        F.col("l_quantity").alias("TOTAL_BILLING_QTY"),
        F.col("l_orderkey").alias("BILL"),
        F.col("l_linenumber").alias("LINE"),
    )
