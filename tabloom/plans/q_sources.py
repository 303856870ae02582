"""Queries: reading and writing files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators.project import Feature, engineered_features
from tabloom.plans.q_panel import brand_panel
from tabloom.plans.q_profile import PART, part_with_gaps
from tabloom.plans.registry import BRAND_KEY, RETAIL, panel_sql, query, rnd
from tabloom.session import scratch_path
from tabloom.sources import delimited, sinks
from tabloom.sources.tables import table


def _csv(spark, df, sep, encoding="UTF-8"):
    path = scratch_path(spark, "csv")
    df.write.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


@query("S1_read_delimited", "SELECT p_partkey::INTEGER AS p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def s1(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    return delimited.read_delimited(spark, _csv(spark, part, ";"))


@query("S2_read_delimited_encodings", "SELECT l.doc_id::INTEGER AS doc_id, quality, 'é' || source AS source "
       "FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def s2(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "quality", F.concat(F.lit("é"), "source").alias("source"))
    return delimited.read_delimited(spark, _csv(spark, d, "|", "ISO-8859-1"), try_encodings=True)


@query("S3_read_sorted_by_time", "SELECT o_orderkey::INTEGER AS o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders")
def s3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    return delimited.read_sorted_by_time(spark, _csv(spark, o, "\t"), "o_orderdate")


@query("S4_write_enhanced", rnd("SELECT p_partkey, p_size, p_retailprice, CAST(p_size AS DOUBLE) * p_size AS p_size_squared, "
       "ln(1 + p_retailprice) AS p_retailprice_log FROM part", "p_retailprice_log"))
def s4(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    stem = scratch_path(spark, "part")
    wide = engineered_features(part, [Feature("square", "p_size"), Feature("log", "p_retailprice")])
    sinks.write_enhanced(part, wide, stem)
    return spark.read.parquet(f"{stem}_enhanced")


@query("S5_write_split", f"SELECT *, CASE WHEN p_retailprice IS NULL THEN 'null' ELSE 'clean' END AS part FROM ({PART})")
def s5(spark, sf):
    stem = scratch_path(spark, "part")
    record = sinks.write_split(part_with_gaps(spark, sf), "p_retailprice", stem)
    clean = spark.read.parquet(record["clean_file"]).withColumn("part", F.lit("clean"))
    return clean.unionByName(spark.read.parquet(record["nan_file"]).withColumn("part", F.lit("null")))


@query("S6_write_predictions", rnd("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity * 1500 AS "
       "predicted_l_extendedprice FROM lineitem", "predicted_l_extendedprice"))
def s6(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                             (F.col("l_quantity") * 1500).alias("prediction"))
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(li, "l_extendedprice", path)
    return spark.read.parquet(path)


@query("S8_feature_manifest", "SELECT p_type, p_size, p_retailprice FROM part")
def s8(spark, sf):
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(spark, ["p_type", "p_size", "p_retailprice"], path)
    return table(spark, sf, "part").select(*sinks.read_manifest(spark, path))


@query("S9_write_results", rnd(f"WITH {RETAIL}, {panel_sql(BRAND_KEY)} SELECT unique_id, ds, y FROM panel", "y"))
def s9(spark, sf):
    path = scratch_path(spark, "results")
    panel = brand_panel(spark, sf).select("unique_id", "ds", "y")
    sinks.write_results(panel, path)
    return spark.read.option("header", True).schema(panel.schema).csv(path)
