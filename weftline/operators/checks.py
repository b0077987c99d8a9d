"""Data-quality checks: frames of violation counts, 0 meaning that the check passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of each column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot([], columns, "column_name", "n_violations")


def not_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.coalesce(F.trim(c), F.lit("")) == "").alias(c) for c in columns]).unpivot([], columns, "column_name", "n_violations")


def unique_key(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n_violations"))


def failing(df: DataFrame, rule) -> DataFrame:
    return df.agg(F.count_if(rule).alias("n_violations"))


def not_finite(columns: list[str]):
    return reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in columns])


def functional_dependency(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    return df.select(key, *values).distinct().groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n_violations"))


def heat_formulas(heat: DataFrame) -> DataFrame:
    """Totals, shares, logs and ranks recomputed."""
    w = Window.partitionBy("week_id", "attr_type")
    total = F.sum("heat_cnt").over(w)
    share = F.coalesce(F.try_divide(F.col("heat_cnt"), total), F.lit(0.0))
    rank = F.row_number().over(w.orderBy(F.desc("heat_cnt"), "attr_id"))
    bad = (total != F.col("type_total_heat")) | (F.abs(share - F.col("heat_share")) > 1e-9) | (F.abs(F.log1p("heat_cnt") - F.col("log_heat")) > 1e-9) | (rank != F.col("rank_in_type"))
    return heat.withColumn("bad", bad).agg(F.count_if("bad").alias("n_violations"))


def share_sums(predictions: DataFrame) -> DataFrame:
    """Predicted shares lie in [0, 1] and sum to 1 in every group (or are all 0)."""
    g = predictions.groupBy("model_name", "split", "week_id", "attr_type").agg(F.sum("pred_share_t1").alias("s"), F.min("pred_share_t1").alias("low"), F.max("pred_share_t1").alias("high"))
    return failing(g, (F.col("low") < 0) | (F.col("high") > 1 + 1e-9) | ((F.abs(F.col("s") - 1) > 1e-6) & (F.col("high") > 0)))
