"""Exact order statistics of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.written import written


def exact_quantiles(df: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """A row per group with the named quantiles of ``value``, interpolated between the two nearest values; null values are passed over.

    Rows are dealt out by ranges of (group, value), with a hash that splits equal values too, and sorted where they lie. Counting each range gives the place of every
    rank, and only the rows at these places are read again; so no task holds a group. The sorted rows are written, which fixes the places for reruns.
    """
    rows = df.select(*group, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL")
    rows = rows.withColumn("_tie", F.xxhash64("_value", F.monotonically_increasing_id()))
    order = [*group, "_value", "_tie"]
    sorted_rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*group, "_value", F.monotonically_increasing_id().alias("_at")), "sorted")
    ranges = sorted_rows.groupBy(*group, F.expr("_at >> 33").alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    placed = ranges.withColumns({"_before": F.sum("_n").over(whole.orderBy("_part")) - F.col("_n"), "_total": F.sum("_n").over(whole)})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()]))
    position = F.col("_q.q") * (F.col("_total") - 1)
    low, high = F.floor(position).cast("long"), F.ceil(position).cast("long")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("high"), low.alias("rank")), F.struct(F.lit(1).alias("high"), high.alias("rank"))))
    wanted = placed.withColumn("_q", asked).withColumn("_end", ends).where("_end.rank >= _before AND _end.rank < _before + _n")
    wanted = wanted.select(*group, F.col("_q.name").alias("_name"), F.col("_end.high").alias("_high"), (position - low).alias("_part_of"), (F.col("_first") + F.col("_end.rank") - F.col("_before")).alias("_at"))
    values = wanted.join(sorted_rows.select("_at", "_value"), "_at")
    both = values.groupBy(*group, "_name", "_part_of").agg(F.max(F.when(F.col("_high") == 0, F.col("_value"))).alias("_low"), F.max(F.when(F.col("_high") == 1, F.col("_value"))).alias("_up"))
    found = both.withColumn("_found", F.col("_low") + (F.col("_up") - F.col("_low")) * F.col("_part_of"))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == name, F.col("_found"))).alias(name) for name in quantiles])
