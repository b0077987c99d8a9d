import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftline.llm import sharding


def test_slots_and_growth(spark, odd_documents):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    for df in (odd_documents.select("doc_id", "text", "bucket", F.lit(1).alias("slot")), many):
        rows = sharding.shard_documents(df, 40).collect()
        assert len(rows) == df.count()
        slots = defaultdict(list)
        texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        for r in rows:
            data = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
            assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
            slots[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 3000 / 41 * 0.6 < moved < 3000 / 41 * 1.5
    assert min(map(len, slots.values())) > 40


def test_key_decides(spark):
    a = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    b = spark.createDataFrame([(i, "y" * i) for i in range(20, 70)], "doc_id long, text string")
    at = [{r.doc_id: r.shard for r in sharding.shard_documents(x, 40).collect()} for x in (a, b)]
    assert all(at[0][i] == at[1][i] for i in range(20, 50))


def test_weights_move_rows_only_into_grown_subtrees(spark):
    nodes = sharding.tree(40)
    heavier = [(r, k, s, 3.0 if s == 7 else w) for r, k, s, w in nodes]
    rows = spark.range(4000).select(sharding.shard_of(F.col("id"), nodes).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).collect()
    rack, region = {s: k for _, k, s, _ in nodes}, {s: r for r, _, s, _ in nodes}
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved
    for a, b in moved:
        assert region[b] == region[7]  # into the region whose weight grew
        assert region[a] != region[7] or rack[b] == rack[7]  # within it, into the rack
        assert rack[a] != rack[7] or b == 7  # within that, into the shard alone
    share = sum(r.b == 7 for r in rows) / len(rows)
    assert 2 / 42 < share < 4 / 42


def test_rows_without_an_id_are_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    out = sharding.shard_documents(df.union(df), 40)
    rows = out.collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(8000))
    assert max(Counter(r.part for r in out.select(F.spark_partition_id().alias("part")).collect()).values()) < 8000


def test_draws_against_brute_force(spark):
    """The shard of an id is where the greatest draw wins on every level."""
    nodes = [(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 1, 2, 0.5), (1, 2, 3, 1.5), (1, 3, 4, 0.0)]
    ids = [None, 0, -5, *range(1, 200)]
    keys = spark.createDataFrame([(x,) for x in ids], "id long")
    names = {"region": {0: 3.5, 1: 1.5}, "rack": {0: 3.0, 1: 0.5, 2: 1.5}, "shard": {0: 1.0, 1: 2.0, 2: 0.5, 3: 1.5}}
    hashes = [F.xxhash64("id", F.lit(level), F.lit(child)).alias(f"{level}{child}") for level, children in names.items() for child in children]
    for row in keys.select("id", sharding.shard_of(F.col("id"), nodes).alias("shard"), *hashes).collect():

        def best(level, children):
            return max(children, key=lambda c: math.log(((row[f"{level}{c}"] % (1 << 64) >> 11) + 0.5) / (1 << 53)) / names[level][c])

        region = best("region", [0, 1])
        rack = best("rack", {0: [0, 1], 1: [2]}[region])
        assert row["shard"] == best("shard", {0: [0, 1], 1: [2], 2: [3]}[rack])


def test_nothing(no_documents):
    assert sharding.shard_documents(no_documents, 40).count() == 0
