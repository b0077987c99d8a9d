"""The retail tables, derived from the star schema of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Attribute columns of an article, their place in the hierarchy, and the hierarchy's relations.
CORE_TYPES = ("product_group_name", "product_type_name", "garment_group_name", "colour_group_name", "graphical_appearance_name")
OTHER_TYPES = ("perceived_colour_master_name", "index_group_name", "index_name", "section_name", "department_name")
ATTRIBUTES = (*CORE_TYPES, *OTHER_TYPES)
LEVELS = {
    "product_group_name": "parent",
    "product_type_name": "child",
    "perceived_colour_master_name": "parent",
    "colour_group_name": "child",
    "index_group_name": "parent",
    "index_name": "parent_child",
    "section_name": "parent_child",
    "department_name": "child",
    "garment_group_name": "flat",
    "graphical_appearance_name": "flat",
}
RELATIONS = (
    ("product_group_name", "product_type_name", "product_group_contains_type"),
    ("perceived_colour_master_name", "colour_group_name", "colour_master_contains_colour"),
    ("index_group_name", "index_name", "index_group_contains_index"),
    ("index_name", "section_name", "index_contains_section"),
    ("section_name", "department_name", "section_contains_department"),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str):
    """An id as text with leading zeros, so that text order is numeric order."""
    return F.lpad(F.col(column).cast("string"), 10, "0")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.to_date("o_orderdate").alias("t_dat"),
        key("o_custkey").alias("customer_id"),
        key("l_partkey").alias("article_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_linenumber") % 2 + 1).cast("int").alias("sales_channel_id"),
    )


def first_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of the first order that has a line, as one row (column ``first``): dates and keys are all that is read."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").join(lines.hint("merge"), "o_orderkey", "left_semi").agg(F.min("o_orderdate").cast("date").alias("first"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long")
    return read(spark, sf_dir, "part").select(
        key("p_partkey").alias("article_id"),
        F.col("p_name").alias("product_code"),
        F.col("p_name").alias("prod_name"),
        F.col("p_type").alias("product_group_name"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("product_type_name"),
        F.concat(F.lit("size_"), F.floor(F.col("p_size") / 10).cast("string")).alias("garment_group_name"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("colour_group_name"),
        F.col("p_brand").alias("graphical_appearance_name"),
        F.substring("p_name", 1, 1).alias("perceived_colour_master_name"),
        F.concat(F.lit("G"), (n % 3).cast("string")).alias("index_group_name"),
        F.concat(F.lit("I"), (n % 6).cast("string")).alias("index_name"),
        F.concat(F.lit("S"), (n % 12).cast("string")).alias("section_name"),
        F.col("p_brand").alias("department_name"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = F.when(F.col("c_nationkey") % 3 == 0, "Regularly").when(F.col("c_nationkey") % 3 == 1, "NONE").otherwise("  ")
    return read(spark, sf_dir, "customer").select(
        key("c_custkey").alias("customer_id"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 125).cast("string")).alias("age"),
        F.col("c_mktsegment").alias("club_member_status"),
        news.alias("news_frequency"),
    )
