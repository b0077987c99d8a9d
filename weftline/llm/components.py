"""Connected components by alternating large-star and small-star steps, as DataFrame joins.

Each step links neighbours to the least neighbour seen; the edges shrink to stars around each component's least node in a
logarithmic number of rounds. Every round is written to the shared folder and the one before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Saved


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (u long, v long), any direction, repeats and loops allowed. Returns (node, component) for every node
    with an edge to another one; component is the least node reachable. No edges: no rows."""
    now = Saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(now.read())
    while True:
        following = Saved(_small_star(_large_star(now.read())), "edges")
        now.drop()
        now, last = following, seen
        seen = _signature(now.read())
        if seen == last:
            return now.read().select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.read().select("v", "v").distinct())
