"""Sharding by a hierarchical weighted hash tree.

Nodes of three levels (region, rack, shard) have weights. A row descends from the root: at each node every
child draws ln(u) / weight, with u a hash of the row's id and the child, and the greatest draw wins. A child's draw
depends on its own weight alone, so when weights change, rows move only into subtrees that grew or out of those that
shrank. A tree grows by a shard as a region of its own: rows move into that shard and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS_PER_RACK, RACKS_PER_REGION = 5, 4


def tree(n_shards: int) -> list[tuple[int, int, int, float]]:
    """(region, rack, shard, weight) of n shards of equal weight, in whole racks and regions as far as they go."""
    return [(i // (SHARDS_PER_RACK * RACKS_PER_REGION), i // SHARDS_PER_RACK, i, 1.0) for i in range(n_shards)]


def grown(nodes: list[tuple[int, int, int, float]], weight: float = 1.0) -> list[tuple[int, int, int, float]]:
    """The tree with one more shard, in a new rack of a new region."""
    region, rack, shard = (max(x[k] for x in nodes) + 1 for k in range(3))
    return [*nodes, (region, rack, shard, weight)]


def _draw(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the greatest draw; all children have weights over 0."""
    draws = []
    for child, weight in sorted(children.items()):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((F.log(u) / F.lit(weight)).alias("draw"), F.lit(child).alias("child")))
    return F.greatest(*draws)["child"] if len(draws) > 1 else F.lit(next(iter(children)))


def shard_of(key: Column, nodes: list[tuple[int, int, int, float]]) -> Column:
    """The shard of a row: an expression over its key, evaluated level by level."""
    nodes = [x for x in nodes if x[3] > 0]
    below: dict[tuple, dict[int, float]] = {}
    for region, rack, shard, weight in nodes:
        for parent, child in (((), region), ((region,), rack), ((region, rack), shard)):
            below.setdefault(parent, {}).setdefault(child, 0.0)
            below[parent][child] += weight

    def descend(parent: tuple) -> Column:
        level = ("region", "rack", "shard")[len(parent)]
        won = _draw(key, level, below[parent])
        if len(parent) == 2:
            return won
        out = None
        for child in below[parent]:
            out = F.when(won == child, descend((*parent, child))) if out is None else out.when(won == child, descend((*parent, child)))
        return out

    return descend(())


def shard_documents(documents: DataFrame, n_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``documents`` (doc_id, text).

    The law is ``key``: doc_id and the number of shards decide. Slots number a shard's rows from 0 without gaps:
    rows are counted by (shard, hash bucket), a bucket starts after the earlier ones, and rows are numbered inside it
    by doc_id, so that no task sees a whole shard, nor all texts of a null or often repeated doc_id; only rows equal in both meet. Null texts count as empty and a null doc_id hashes like any
    other value; repeated rows get a slot each; an empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    nodes = tree(n_shards)
    key = F.col("doc_id").cast("long")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(
        "doc_id",
        (F.length(body).cast("long") + 16).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, nodes).cast("int").alias("shard"),
        shard_of(key, grown(nodes)).cast("int").alias("grown_shard"),
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("inside", inside)
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("first") + F.col("inside")).alias("slot"), "grown_shard")
