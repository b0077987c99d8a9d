"""Expressions and small frame helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def top_k(df: DataFrame, partition: list, order: list, k: int, name: str = "rn") -> DataFrame:
    """The first k rows of each partition, with their number; planned as a group limit before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn(name, number.cast("long")).where(F.col(name) <= k)


def average_rank(value: Column, partition: list) -> Column:
    """Rank of a value within its partition; ties share the mean of their ranks."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (ties - 1) / 2


def minmax(value: str, partition: list) -> Column:
    """(x - min) / (max - min) within the partition; 0 where all are equal."""
    w = Window.partitionBy(*partition)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - low, high - low))


def rank_norm(rank: Column, cap: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cap - rank + 1) / cap))


def log_growth(after: Column, before: Column, epsilon: float = EPSILON) -> Column:
    return F.log((after + epsilon) / (before + epsilon))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def half_up(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded to 12 digits and then to fewer: the order of a sum may put a value that is half-way in exact terms on either side, and here it goes up."""
    return df.select(*[F.round(F.round(c, 12), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
