"""The driver's tables read as the engine's domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as part rows. The pair of order and line number repeats, so it is not an id."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("assembly_id"), F.col("l_partkey").alias("part_id"), F.col("p_name").alias("mark"), F.col("p_type").alias("profile"),
        F.col("p_brand").alias("material"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("weight"),
    )


def assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("assembly_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("mark"), F.col("o_orderstatus").alias("position_code"),
        F.col("o_totalprice").cast("double").alias("weight"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (assembly, part)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("assembly_id"), F.col("l_partkey").alias("part_id")).distinct()


def bolts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).where(F.col("mark").contains("bolt")).select(
        F.col("part_id").alias("bolt_id"), F.col("mark").alias("bolt_name"), F.col("material").alias("standard"), F.lit(None).cast("double").alias("length"),
        F.lit(None).cast("double").alias("diameter"), "quantity", "assembly_id",
    )


def bolt_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (bolt, part): suppliers read as bolts of the parts of their lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bolt_id"), F.col("l_partkey").alias("part_id")).distinct()
