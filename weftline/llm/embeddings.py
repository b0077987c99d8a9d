"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Centroids are fitted on at most ``SAMPLE`` vectors; every vector is assigned. A vector's home is the cell of greatest cosine. It
visits each cell whose border with its home lies nearer than a pair at the threshold reaches across: such a pair
differs by a chord r = sqrt(2 - 2 threshold), and along one direction of d dimensions by r / sqrt(d) in standard deviation, of which
``REACH`` are allowed for on each side: as either vector may visit the other's home, only a pair that lies further than twice that apart along
the border's direction can be missed. Vectors of a cell are compared with its other members and its visitors; a pair of two homes is counted in
one cell only. Cells are cut into blocks of about ``BLOCK`` vectors, and each pair of blocks is one task's matrix product,
so a crowded cell becomes more tasks, not larger ones. A task returns link counts and a spanning forest of its links, never
all pairs. Equal vectors are compared once, with their number. Vectors are compared with those of their length only; a length that few
vectors have is one cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Saved
from weftline.llm.components import connected_components

THRESHOLD, SAMPLE, PER_CELL, MAX_CELLS, ROUNDS, REACH, BLOCK, MIN_SHARE = 0.95, 20_000, 400, 1024, 8, 2.0, 1000, 0.01
ASSIGNED = "d int, cell int, home int, cid long, m long, vector binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=1e-300)  # squares stay finite
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty cell takes the vector farthest from its centroid."""
    centroids = sample[np.random.default_rng(0).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        cosines = sample @ centroids.T
        cell = cosines.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norms < 1e-12)
        sums[empty] = sample[np.argsort(cosines.max(1))[: len(empty)]]
        centroids = unit(sums)
    return centroids


def visits(x: np.ndarray, centroids: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and whether it belongs to or visits each cell."""
    cosines = x @ centroids.T
    home = cosines.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    behind = cosines[np.arange(len(x)), home, None] - cosines
    return home, behind <= margin * apart[home]


def forest(links: np.ndarray) -> np.ndarray:
    """Of each node of a symmetric link matrix, the least node it is connected with."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _unpack(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimension)


def valid(column: str):
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.size(column) > 0, F.lit(False)) & F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do two of different
    lengths. Repeated rows are vectors of their own and link
    with each other. A null vec_id is nobody's least id. An empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = rows.where(valid("embedding"))
    classes = Saved(ok.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m")).withColumn("cid", F.monotonically_increasing_id()).withColumn("d", F.size("embedding")), "vectors").read()
    n = classes.count()
    # at most 1 / MIN_SHARE lengths have so many vectors; each gets centroids from its part of the sample
    often = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(PER_CELL, MIN_SHARE * n)).collect()
    fitted = {}
    for length in often:
        drawn = classes.where(F.col("d") == length.d).select("embedding").orderBy(F.xxhash64("embedding")).limit(max(16, sample * length.n // n)).collect()
        points = unit(np.array([r.embedding for r in drawn], np.float64))
        fitted[length.d] = kmeans(points, max(1, min(length.n // PER_CELL, len(points) // 16, MAX_CELLS)))
    shared = spark.sparkContext.broadcast(fitted)

    def placed_at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x.shape[1]
        if d not in shared.value:
            return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
        return visits(x, shared.value[d], REACH * math.sqrt(2 - 2 * threshold) / math.sqrt(d))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                x = unit(flat[offsets[rows][:, None] + np.arange(d)])
                home, inside = placed_at(x)
                at, cell = np.nonzero(inside)
                data = [x[i].tobytes() for i in at]
                take = pa.array(rows[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[at].astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(data, pa.binary())], names=["d", "cell", "home", "cid", "m", "vector"])

    assigned = Saved(classes.select("cid", "m", "embedding").mapInArrow(assign, ASSIGNED), "assigned").read()
    own = F.col("cell") == F.col("home")
    blocks = lambda x: F.ceil(F.greatest(F.lit(1), F.count_if(x)) / block).cast("int")
    sizes = assigned.groupBy("d", "cell").agg(blocks(own).alias("nh"), blocks(~own).alias("nv"))
    placed = assigned.join(sizes, ["d", "cell"]).withColumn("own", own).withColumn("b", F.pmod(F.xxhash64("cid"), F.when(own, F.col("nh")).otherwise(F.col("nv"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    inner = placed.where("own").withColumn("o", F.explode(upto("nh"))).select("d", "cell", F.lit(0).alias("kind"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "own", "b", "home", "cid", "m", "vector")
    outer = placed.withColumn("o", F.explode(F.when(F.col("own"), upto("nv")).otherwise(upto("nh")))).select("d", "cell", F.lit(1).alias("kind"), F.when(F.col("own"), F.col("b")).otherwise(F.col("o")).alias("i"), F.when(F.col("own"), F.col("o")).otherwise(F.col("b")).alias("j"), "own", "b", "home", "cid", "m", "vector")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        dimension, cell, kind, i, j = (x.as_py() for x in key)
        table = table.combine_chunks()
        x = _unpack(table["vector"], dimension)
        cid, m, b, home, mine = (table[c].to_numpy() for c in ("cid", "m", "b", "home", "own"))
        if kind == 0:
            left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        else:
            left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        links = x[left] @ x[right].T >= threshold
        if kind == 1 and links.any():  # a pair of two homes counts in the later cell, if the vector of the earlier one visits it
            inside = placed_at(x[left])[1]
            links &= (home[right] < cell)[None, :] | ~inside[:, home[right]]
        whole = np.zeros((len(x), len(x)), bool)
        whole[np.ix_(left, right)] = links
        whole |= whole.T
        np.fill_diagonal(whole, False)
        n_links = whole @ m
        hit = np.flatnonzero(n_links)
        return pa.table({"cid": cid[hit], "n": n_links[hit].astype(np.int64), "root": cid[forest(whole)][hit]})

    kind = "cid long, n long, root long"
    found = Saved(inner.union(outer).groupBy("d", "cell", "kind", "i", "j").applyInArrow(compare, kind), "links").read()
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    components = connected_components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    tied = classes.join(components.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    leasts = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    known = tied.join(leasts, "root").join(counts, "cid", "left").select("embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    linked = ok.join(known, "embedding").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.union(rows.where(~valid("embedding")).select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True)))
