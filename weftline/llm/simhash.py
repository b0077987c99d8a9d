"""SimHash near-duplicates: Golay fuzzy hashing of fingerprint segments.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints at most two bits apart have, by
pigeonhole, a segment without errors whose successor (in a circle) has one error at most: the key is the first
segment as it is with a Golay index of the second, about sixteen keys a fingerprint, each over 33 bits. Fingerprints that share a key are
joined and verified. Only distinct fingerprints take part, so exact copies cost nothing.

A key with more than ``FULL`` fingerprints isn't joined with itself. Its fingerprints meet at midpoints instead: each
goes to itself and its 64 one-bit neighbours, and any two that meet are at most two bits apart, so all link to the least. At most 65
fingerprints meet at a point: the work is linear in the group and no link is lost.

Texts of a Jaccard similarity of 0.8 differ in about ten of 64 bits, where Golay keys select nothing. A caller that asks for
a similarity therefore gets further links from the texts' shingle hashes, verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import golay
from weftline.llm.common import Saved, small, text_of
from weftline.llm.components import connected_components

SEED, MAX_DISTANCE, FULL, HUBS, TURNS = 42, 2, 16, 4, 2
#: Values that shingles are counted by, and how many of them one row holds.
BUCKETS, CHUNK = 1 << 22, 1 << 12
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 of each shingle of the words between ASCII white space, A-Z lower-cased; fewer words are one shingle, none none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    rows = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.array([xxh64_intdigest(x, SEED) for x in rows], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if over half the hashes have it; no hashes: zero."""
    n, out = len(hashes), 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    for bit in range(8):  # bits bit, bit + 8, ... are summed in byte lanes, at most 255 rows at a time
        sums = ((padded >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * sums > n):
            out |= 1 << (8 * int(lane) + bit)
    return out


def fingerprint(text: str, shingle: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (a signed 64-bit integer) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = np.array([fingerprint(text, shingle) for text in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _distinct(text: str, shingle: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingle hashes, the distinct ones in ascending (unsigned) order, and a hash of these as the set's id."""
    from xxhash import xxh64_intdigest

    hashes = shingle_hashes(text, shingle)
    distinct = np.unique(hashes)
    return hashes, distinct.view(np.int64), xxh64_intdigest(distinct.tobytes(), SEED)


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind)))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def shingle_levels(documents: DataFrame, shingle: int) -> np.ndarray:
    """How common shingles are: a level for each of BUCKETS values of their hashes' low bits, from the number of texts that
    hold one of them. Any order of shingles finds all pairs; by rising level the heads hold what few texts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(total, _distinct(text, shingle)[1] & (BUCKETS - 1), 1)
        rows = np.minimum(total, 255).astype(np.uint8).reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["chunk", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for counts in group.column("counts").to_pylist():
            total += np.frombuffer(counts, np.uint8)
        levels = (2 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()
        return pa.table({"chunk": group.column("chunk")[:1], "counts": pa.array([levels], pa.binary())})

    counted = documents.select(text_of().alias("text")).mapInArrow(run, "chunk int, counts binary")
    out = np.zeros((BUCKETS // CHUNK, CHUNK), np.uint8)
    for row in counted.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():  # BUCKETS bytes in all
        out[row.chunk] = np.frombuffer(row.counts, np.uint8)
    return out.reshape(-1)


def shingle_heads(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, h (the text's hash, as Spark's xxhash64 has it), fp, id (of the set of shingles), n (its size) and head of every row: the rarest hashes of the set, so many that
    two sets of at least the similarity share one of them."""
    shared = documents.sparkSession.sparkContext.broadcast(shingle_levels(documents, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        levels = shared.value
        for batch in small(batches):
            fps, ids, sizes, heads = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes, distinct, set_id = _distinct(text, shingle)
                fps.append(fingerprint_of(hashes))
                ids.append(set_id)
                sizes.append(len(distinct))
                order = np.argsort(levels[distinct & (BUCKETS - 1)], kind="stable")  # equals stay by hash
                heads.append(distinct[order[: len(distinct) - math.ceil(similarity * len(distinct) - 1e-9) + 1]])
            texts = [xxh64_intdigest(text.encode(), SEED) for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), _longs(texts), _longs(fps), _longs(ids), pa.array(sizes, pa.int32()), _lists(heads, np.int64)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "id", "n", "head"])

    rows = documents.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long, id long, n int, head array<long>")


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """id and shingles (the distinct hashes' low 32 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [_distinct(text, shingle)[1:] for text in batch.column(0).to_pylist()]
            columns = [_longs([set_id for _, set_id in sets]), _lists([np.unique(x.astype(np.int32)) for x, _ in sets], np.int32)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles"])

    return documents.select(text_of().alias("text")).mapInArrow(run, "id long, shingles array<int>")


def _golay_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        parts = [(fps >> low) & ((1 << bits) - 1) for low, bits in SEGMENTS]
        for k, part in enumerate(parts):
            row, index = golay.keys(parts[(k + 1) % 3])
            yield pa.RecordBatch.from_arrays([pa.array(part[row] | index << 22 | k << 34), pa.array(fps[row])], names=["bucket", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints at most two bits apart; their components are those of all such pairs."""
    keyed = fps.select("fp").mapInArrow(_golay_keys, "bucket long, fp long")
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = Saved(keyed.join(shared, "bucket"), "golay").read()
    few = met.where(F.col("n") <= FULL)
    a, b = few.select("bucket", F.col("fp").alias("u")), few.select("bucket", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE
    pairs = a.join(b, (a.bucket == b.bucket) & (F.col("u") < F.col("v")) & near).select("u", "v")
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda bit: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    at = met.where(F.col("n") > FULL).select("fp").distinct().select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    least = at.groupBy("point").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.union(at.join(least, "point").where("fp <> least").select("fp", "least"))


def similar_links(documents: DataFrame, heads: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (u, v) between the fingerprints of shingle sets; heads: shingle_heads of the documents. Their components are those of all
    pairs of at least the similarity (Jaccard).

    Sets that share a head hash are candidates, less those that sizes or the hash's places in both orders rule out, and are verified on whole
    sets. Where at most ``FULL`` share a hash all are compared with all. Where more do, each set is first compared with ``HUBS`` others of
    the group; from then on only pairs that no chain of links joins yet are open, and all of these are compared. So a group of near
    copies costs no pairs beyond its hubs', and no link between components is lost.

    The sets themselves are taken from the texts again, for sets with a shared head hash alone, as to store them all costs more than the texts.
    """
    keyed = heads.select("id", "n", F.posexplode("head").alias("pos", "key"))
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = Saved(keyed.join(repeated, "key", "left_semi").distinct(), "heads").read()  # exact copies are one from here on
    sharers = met.groupBy("key").agg(F.count(F.lit(1)).alias("sharers")).where("sharers > 1")
    known = met.join(sharers, "key").withColumn("weight", F.sum("sharers").over(Window.partitionBy("id")))
    known = Saved(known, "shared-heads").read()
    needed = known.select("id").distinct()
    # copies are dropped where they are read, so that none of a crowd of them meets the others before
    sets = Saved(shingle_sets(documents, shingle).dropDuplicates(["id"]).join(needed, "id", "left_semi"), "sets").read()

    def side(rows: DataFrame, x: str, *more: str) -> DataFrame:
        return rows.select("key", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"pos{x}"), *[F.col(c).alias(f"{c}{x}") for c in more])

    sized = F.least("nu", "nv") >= F.greatest("nu", "nv") * similarity - 1e-9
    # at the first hash that both have, all others they share come later in both
    placed = F.least(F.col("nu") - F.col("posu"), F.col("nv") - F.col("posv")) >= similarity / (1 + similarity) * (F.col("nu") + F.col("nv")) - 1e-9

    def alike(pairs: DataFrame) -> DataFrame:
        both = Saved(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates").read()
        for x in ("u", "v"):
            both = both.join(sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")), x)
        common = F.size(F.array_intersect("set_u", "set_v"))
        return Saved(both.where(common >= similarity * (F.size("set_u") + F.size("set_v") - common) - 1e-9).select("u", "v"), "similar").read()

    few = known.where(F.col("sharers") <= FULL)
    a, b = side(few, "u"), side(few, "v")
    edges = alike(a.join(b, (a.key == b.key) & (F.col("u") < F.col("v")) & sized & placed).select("u", "v"))
    many = known.where(F.col("sharers") > FULL)
    crowded = not many.isEmpty()
    for turn in range(TURNS + 1 if crowded else 0):
        found = connected_components(edges).select(F.col("node").alias("id"), "component")
        grouped = Saved(many.join(found, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"), "crowded").read()
        parts = grouped.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
        split = parts.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).where("q < s * s")
        pairs, members = split.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.sum("s")).first()
        if not pairs:
            break
        rows = grouped.join(split, "key", "left_semi")
        if last := turn == TURNS or pairs <= 2 * HUBS * members:
            other = rows
        else:
            draw = F.xxhash64("key", "id", F.lit(turn))
            best = F.max(F.struct("weight", draw.alias("draw"), "id", "n", "pos", "part") if turn == 0 else F.struct(draw.alias("draw"), "id", "n", "pos", "part"))
            other = rows.groupBy("key", F.pmod(F.xxhash64("part"), F.lit(HUBS)).alias("salt")).agg(best.alias("hub")).select("key", "hub.*")
        a, b = side(rows, "u", "part"), side(other, "v", "part")
        once = F.col("u") < F.col("v") if last else F.col("u") != F.col("v")
        edges = edges.union(alike(a.join(b, (a.key == b.key) & (F.col("partu") != F.col("partv")) & once & sized & placed).select("u", "v")))
        if last:
            break
    nodes = heads.groupBy("id").agg(F.min("fp").alias("fp"))
    for x in ("u", "v"):
        edges = edges.join(nodes.select(F.col("id").alias(x), F.col("fp").alias(f"fp_{x}")), x)
    same = heads.select("id", F.col("fp").alias("u")).distinct().join(nodes.select("id", F.col("fp").alias("v")), "id").where("u <> v")
    return edges.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")).union(same.select("u", "v"))


def _rooted(documents: DataFrame, shingle: int, similarity: float | None, least) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and fp, root and the group's least for each distinct fingerprint; ``least``: what a row is ordered by."""
    docs = Saved(fingerprints(documents, shingle) if similarity is None else shingle_heads(documents, shingle, similarity), "fingerprints").read()
    nodes = Saved(docs.groupBy("fp").agg(F.min(least).alias("least")), "fps").read()
    edges = links(nodes) if similarity is None else links(nodes).union(similar_links(documents, docs, shingle, similarity))
    found = connected_components(edges).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    return docs, rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("least")), "root")


def near_duplicates(documents: DataFrame, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row of ``documents`` (doc_id, text).

    component_id is the least doc_id reachable by links (itself included). Fingerprints link at two bits or fewer; with a ``similarity``,
    texts whose sets of shingles have at least that Jaccard similarity link as well. Texts without words have fingerprint zero and link like
    any other; rows with a null doc_id link too but are nobody's least; where all ids of a component are null it is null. Repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    docs, rooted = _rooted(documents, shingle, similarity, F.col("doc_id"))
    return docs.join(rooted, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def one_of_each(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The rows of ``documents`` (doc_id, text) that stay, all columns as they are: one of each group of near_duplicates.

    That of the least doc_id stays; where two texts have it, the one of lesser hash; of rows equal in doc_id and text, any one. A
    null doc_id comes last. Null texts count as empty, and all texts without words are one group. An empty table gives no rows.
    """
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    docs, rooted = _rooted(documents, shingle, similarity, least)
    key = ["doc_id", "h"]
    keyed = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"))

    def on(other: DataFrame):
        return keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed["h"] == other["h"])

    later = Saved(docs.join(rooted, "fp").where(least != F.col("least")).select(*key).distinct(), "later").read()
    again = Saved(docs.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*key), "repeated").read()
    if again.isEmpty():
        return keyed.join(later, on(later), "left_anti").select("row.*")
    gone = Saved(later.union(again).distinct(), "gone").read()
    stay = again.join(later, again["doc_id"].eqNullSafe(later["doc_id"]) & (again["h"] == later["h"]), "left_anti")
    once = keyed.join(stay, on(stay), "left_semi").groupBy(*key).agg(F.any_value("row").alias("row")).select("row.*")
    return keyed.join(gone, on(gone), "left_anti").select("row.*").union(once)


def hex16(fp):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
