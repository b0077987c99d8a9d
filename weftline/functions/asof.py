"""Lookups along time: running totals, and the last row at or before a time, by one sort instead of a range join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, keys: list[str], time: str, values: list[str], block: int | None = None) -> DataFrame:
    """``df`` (one row per keys and time) with each of ``values`` summed up to and including the row's time.

    block: a key with very many times is cut into blocks of so many units of time. Each block is summed by itself, and only the blocks' totals, a row each, are summed by key.
    """
    if block is None:
        w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.sum(c).over(w) for c in values})
    cut = df.withColumn("_block", F.floor(F.col(time) / block))
    inside = running_totals(cut, [*keys, "_block"], time, values)
    totals = cut.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in values])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumns({f"_{c}": F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)) for c in values})
    joined = inside.join(before, [*keys, "_block"])
    return joined.withColumns({c: F.col(c) + F.col(f"_{c}") for c in values}).select(*df.columns)


def _looked_up(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], inclusive: bool) -> DataFrame:
    """left with _found: the struct of ``columns`` of the last right row at or before (inclusive) or before the row's time."""
    none = lambda df, names: F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType)
    asked = left.select(*keys, F.col(time).alias("_time"), F.lit(1 if inclusive else -1).alias("_side"), F.struct(*left.columns).alias("_row"), none(right, columns).alias("_value"))
    known = right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, time]]))
    known = known.select(*keys, F.col(time).alias("_time"), F.lit(0).alias("_side"), none(left, left.columns).alias("_row"), F.struct(*columns).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_time", "_side")
    found = asked.union(known).withColumn("_found", F.last("_value", ignorenulls=True).over(w))
    return found.where("_side <> 0").select("_row.*", "_found")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], block: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the right row of equal keys that has the greatest time not after the left row's; null where there is none.

    Both have ``keys`` and ``time``; ``right`` has one row per keys and time. Rows of the two meet in one sort by key, so neither is copied. A null key or time of either side finds nothing.
    block: times of a key are sorted in blocks of so many units, and what a block lacks comes from the last row of an earlier one, so that a hot key is many tasks.
    """
    if block is None:
        found = _looked_up(left, right, keys, time, columns, inclusive=True)
        return found.select(*left.columns, *[F.when(F.col(time).isNotNull(), F.col("_found")[c]).alias(c) for c in columns])
    at = F.floor(F.col(time) / block)
    cut_left, cut_right = left.withColumn("_block", at), right.withColumn("_block", at)
    inside = _looked_up(cut_left, cut_right, [*keys, "_block"], time, columns, inclusive=True).withColumnRenamed("_found", "_inside")
    lasts = cut_right.where(F.col(time).isNotNull()).groupBy(*keys, "_block").agg(F.max_by(F.struct(*columns), time).alias("_last")).select(*keys, "_block", "_last.*")
    asked = cut_left.select(*keys, "_block").distinct()
    earlier = _looked_up(asked, lasts, keys, "_block", columns, inclusive=False).withColumnRenamed("_found", "_earlier")
    same: Column = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_block"]])
    joined = inside.alias("a").join(earlier.alias("b"), same, "left")
    value = F.coalesce(F.col("_inside"), F.col("_earlier"))
    return joined.select(*[F.col(f"a.{c}") for c in left.columns], *[F.when(F.col(f"a.{time}").isNotNull(), value[c]).alias(c) for c in columns])


def last_points(points: DataFrame, marks: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    """The points that are among the last ``n`` at or before any of the marks of their keys, each once.

    Going back in time, a point counts from the nearest mark that is not before it; so one sort of points and marks decides, and no point is copied for each mark.
    """
    none = F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType)
    rows = points.select(*keys, F.col(time).alias("_time"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("_row"))
    rows = rows.union(marks.select(*keys, F.col(time).alias("_time"), F.lit(0), none))
    back = Window.partitionBy(*keys).orderBy(F.desc("_time"), "_point").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_count", F.sum("_point").over(back))
    after = F.last(F.when(F.col("_point") == 0, F.col("_count")), ignorenulls=True).over(back)
    return counted.withColumn("_after", after).where((F.col("_point") == 1) & (F.col("_count") - F.col("_after") <= n)).select("_row.*")
