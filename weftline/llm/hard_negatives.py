"""Hard negatives by exact search over an inverted multi-index.

Vectors become whole numbers, so that inner products are exact. Each vector is cut into two halves; each half has a codebook (k-means, fitted on
a bounded sample), and a pair of codewords is a cell. No score in a cell exceeds the sum of two half bounds: the anchor's product with the
half's codeword plus its norm times the codeword's radius, the greatest distance of any row from it. A heap takes the cells of an anchor by
that sum, from the greatest on (multi-sequence order).

The search for positives first visits cells with about ``FIRST`` rows, which gives a floor for the last positive's score, and then just
the further cells whose bound reaches it: what no bound reaches is certified. Each positive then opens a window of scores for its negatives; again
the first cells raise the window's floor, and only cells whose bound reaches the floor are visited.

Equal vectors of one label are one class with its least ids, as many as any list can use; so repeated rows cost nothing, neither as anchors nor as rows.
Cells of one codeword of the first half lie together, so an anchor goes there once, with the list of the cells it visits. A crowded codeword is cut into blocks
of about ``BLOCK`` classes, and the visitors of a block into parts of about ``VISITORS`` (fewer of long vectors); in them each cell meets its visitors in products of ``PRODUCT`` by ``PRODUCT``.
So memory doesn't grow with anchors, rows or cells, and what is dealt is not each pair of anchor and cell.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expr import top_k
from weftline.llm.common import Saved

#: Rows, and numbers, that the codebooks are fitted on; rows a cell on average; rows of the first visits; lengths with a smaller share of all rows are one cell.
SAMPLE, NUMBERS, PER_CELL, FIRST, MIN_SHARE, ROUNDS = 20_000, 1 << 23, 400, 4096, 0.01, 8
#: Classes of a block and visitors of a part, if vectors have up to WIDE numbers; sides of a product; found ones that are held before the best are taken; visits of a written batch.
BLOCK, VISITORS, WIDE, PRODUCT, HELD, WRITTEN = 16_384, 8192, 64, 1024, 1 << 19, 4096
LIMIT = float(1 << 62)
NO_ID = np.iinfo(np.int64).max
FAR = np.iinfo(np.int64).min


def codebook(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means; an empty codeword takes the point farthest from its own."""
    centres = points[np.random.default_rng(0).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        apart = (centres**2).sum(1) - 2 * points @ centres.T
        nearest = apart.argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, points)
        centres = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = points[np.argsort(-(apart.min(1) + (points**2).sum(1)))[: len(empty)]]
    return centres


def by_bound(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs (i, j) from the greatest u[i] + v[j] on, by a heap over the two sorted sequences."""
    a, b = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    heap = [(-(u[a[0]] + v[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(u[a[i]] + v[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(u[a[i + 1]] + v[b[0]]), i + 1, 0))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no partial sum passes 2^53."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), np.int64)
    norms = [math.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0.0)) for x in (left, right)]
    if norms[0] * norms[1] < 1 << 52:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k greatest scores that fit; of equal ones the first columns."""
    many = np.flatnonzero(np.count_nonzero(fits, axis=1) > k)
    if len(many):
        masked = np.where(fits[many], scores[many], FAR)
        last = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        fits = fits.copy()
        fits[many] &= masked >= last[:, None]
    r, c = np.nonzero(fits)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    starts = np.searchsorted(r, r)
    few = np.arange(len(r)) - starts < k
    return r[few], c[few]


class Best:
    """The k greatest scores of each group, of equal ones those of the least ids; holds HELD or k a group."""

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.room = k, [], 0, HELD

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray, least: np.ndarray) -> None:
        self.parts.append((group, score, row, least))
        self.held += len(group)
        if self.held > self.room:
            self.parts = [self.found()]
            self.held = len(self.parts[0][0])
            self.room = max(HELD, 2 * self.held)

    def found(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        group, score, row, least = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((least, -score, group))
        group = group[order]
        few = np.arange(len(group)) - np.searchsorted(group, group) < self.k
        return group[few], score[order][few], row[order][few], least[order][few]


def finite(column: str) -> Column:
    number = lambda x: x.cast("double")
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))), F.lit(False))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, d) if d else np.zeros((len(column), 0), np.int32)


class Index:
    """Classes of equal rows, dealt to the cells of an inverted multi-index.

    ``placed``: d, cell, block, cid, label, ids, vector. Codebooks, radii and the cells' sizes of frequent lengths are held by
    the driver: at most SAMPLE / 16 codewords a half, and 1 / MIN_SHARE lengths.
    """

    def __init__(self, classes: DataFrame, per_cell: int = PER_CELL, sample: int = SAMPLE, block: int = BLOCK):
        spark = classes.sparkSession
        n = classes.count()
        often = classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where((F.col("d") > 0) & (F.col("n") >= max(per_cell, MIN_SHARE * n))).collect()
        self.books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in often:
            rows = max(64, min(sample * r.n // n, NUMBERS // r.d))
            drawn = classes.where(F.col("d") == r.d).select("v").orderBy(F.xxhash64("v")).limit(rows).toArrow()["v"].combine_chunks()
            points = drawn.values.to_numpy().astype(np.float64).reshape(-1, r.d)
            k = max(1, min(math.ceil(math.sqrt(r.n / per_cell)), len(points) // 16))
            self.books[r.d] = codebook(points[:, : r.d // 2], k), codebook(points[:, r.d // 2 :], k)
        books = spark.sparkContext.broadcast(self.books)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("v")
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                lengths = np.diff(offsets)
                for d in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == d)
                    x = flat[offsets[rows][:, None] + np.arange(d)].astype(np.int32)
                    at, far = [], []
                    for half, part in enumerate((x[:, : d // 2], x[:, d // 2 :])):
                        y, centres = part.astype(np.float64), books.value[d][half] if d in books.value else np.zeros((1, part.shape[1]))
                        nearest = ((centres**2).sum(1) - 2 * y @ centres.T).argmin(1)
                        at.append(nearest.astype(np.int32))
                        far.append(np.sqrt(((y - centres[nearest]) ** 2).sum(1)))
                    take = pa.array(rows)
                    vectors = pa.array([v.tobytes() for v in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d, np.int32)), pa.array(at[0]), pa.array(at[1]), pa.array(far[0]), pa.array(far[1]), batch.column("cid").take(take), batch.column("label").take(take), batch.column("ids").take(take), vectors], names=["d", "i", "j", "far1", "far2", "cid", "label", "ids", "vector"])

        placed = Saved(classes.select("cid", "label", "ids", "v").mapInArrow(assign, "d int, i int, j int, far1 double, far2 double, cid long, label long, ids array<long>, vector binary"), "placed").read()
        self.sizes = Saved(placed.groupBy("d", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("far1").alias("r1"), F.max("far2").alias("r2")), "cells").read()
        large = F.col("n") * F.greatest("d", F.lit(WIDE)) / (WIDE * block)
        blocks = self.sizes.groupBy("d", "i").agg(F.sum("n").alias("n")).select("d", "i", F.ceil(large).cast("int").alias("blocks"))
        self.blocks = blocks
        self.placed = placed.join(F.broadcast(blocks), ["d", "i"]).select("d", "i", "j", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("b"), "cid", "label", "ids", "vector")
        self.cells = {}
        for r in self.sizes.where(F.col("d").isin(list(self.books))).collect() if self.books else []:
            radii, n = self.cells.setdefault(r.d, ([np.zeros(len(x)) for x in self.books[r.d]], {}))
            radii[0][r.i], radii[1][r.j] = max(radii[0][r.i], r.r1), max(radii[1][r.j], r.r2)
            n[r.i, r.j] = r.n
        self.shared = spark.sparkContext.broadcast((self.books, self.cells))

    def visit(self, asks: DataFrame, search: Callable, schema: str, floor: str | None, first: int, visitors: int = VISITORS) -> DataFrame:
        """Each ask (aid, d, label, vector and more) meets cells: without a floor the first ones, with about ``first`` rows; with one, the
        further cells whose bound reaches the floor (null: all of them). ``search`` takes the rows of a block and a part of its visitors."""
        shared = self.shared

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, cells = shared.value
            there = {}
            for d, (_, n) in cells.items():
                there[d] = np.zeros([len(x) for x in books[d]], bool)
                there[d][tuple(zip(*n, strict=True))] = True
            for batch in batches:
                at: list[int] = []
                first_half: list[int] = []
                lists: list[bytes] = []

                def visits(batch=batch, at=at, first_half=first_half, lists=lists) -> pa.RecordBatch:
                    out = batch.take(pa.array(at, pa.int64()))
                    out = pa.RecordBatch.from_arrays([pa.array(first_half, pa.int32()), pa.array(lists, pa.binary()), *out.columns], names=["i", "js", *batch.schema.names])
                    for x in (at, first_half, lists):
                        x.clear()
                    return out

                floors = batch.column(floor).to_pylist() if floor else [None] * batch.num_rows
                for k, (d, data, least) in enumerate(zip(batch.column("d").to_pylist(), batch.column("vector").to_pylist(), floors, strict=True)):
                    if d not in cells:  # a rare length is one cell
                        seen = np.zeros((1, 1), bool) if floor else np.ones((1, 1), bool)
                    else:
                        radii, n = cells[d]
                        x = np.frombuffer(data, np.int32).astype(np.float64)
                        halves = x[: d // 2], x[d // 2 :]
                        u, v = (c @ y + np.linalg.norm(y) * r for c, y, r in zip(books[d], halves, radii, strict=True))
                        early, met = np.zeros(there[d].shape, bool), 0
                        for _, i, j in by_bound(u, v):
                            early[i, j] = True
                            met += n.get((i, j), 0)
                            if met >= first:
                                break
                        seen = there[d] & (early ^ bool(floor))
                        if least is not None:
                            slack = 1 + 1e-9 * np.linalg.norm(x) * (np.abs(u).max() + np.abs(v).max() + 1)
                            seen &= u[:, None] + v[None, :] + slack >= least
                    for i in np.flatnonzero(seen.any(1)).tolist():
                        at.append(k)
                        first_half.append(i)
                        lists.append(np.flatnonzero(seen[i]).astype(np.int32).tobytes())
                        if len(at) >= max(1, WRITTEN * WIDE // max(d, WIDE)):
                            yield visits()
                if at:
                    yield visits()

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asks.schema)
        visits = Saved(asks.mapInArrow(order, f"i int, js binary, {fields}"), "visits").read()
        many = F.count(F.lit(1)) * F.greatest("d", F.lit(WIDE)) / (WIDE * visitors)
        parts = visits.groupBy("d", "i").agg(F.ceil(many).cast("int").alias("parts"))
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        keys = ["d", "i", "b", "p"]
        # a row for each codeword is broadcast, by hint: files of visits, which repeat vectors, are far smaller than their rows, and Spark would collect these
        come = visits.join(F.broadcast(parts.join(F.broadcast(self.blocks), ["d", "i"])), ["d", "i"]).withColumn("p", F.pmod(F.xxhash64("aid"), "parts").cast("int")).withColumn("b", upto("blocks")).drop("blocks", "parts")
        rows = self.placed.join(F.broadcast(parts), ["d", "i"]).withColumn("p", upto("parts")).drop("parts")
        return rows.groupBy(*keys).cogroup(come.groupBy(*keys)).applyInArrow(search, schema)


def _meetings(rows: pa.Table, visits: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(visitors, rows, the rows' least ids, scores, whether labels are equal) of each product: a slice of a cell's rows by their least id, so that the first
    of equal scores is the right one, and a slice of the cell's visitors. Both are positions."""
    if not rows.num_rows or not visits.num_rows:
        return
    least = np.array([NO_ID if x is None else x for x in pc.list_element(rows["ids"], 0).to_pylist()], np.int64)
    d, cell, labels, asked = rows["d"][0].as_py(), rows["j"].to_numpy(), rows["label"].to_numpy(), visits["label"].to_numpy()
    lists = [np.frombuffer(x, np.int32) for x in visits["js"].to_pylist()]
    at, where = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    order = np.argsort(where, kind="stable")
    at, where = at[order], where[order]
    by_cell = np.lexsort((least, cell))
    x, y = _vectors(visits["vector"], d), _vectors(rows["vector"], d)
    side = max(64, PRODUCT * WIDE // max(d, WIDE))
    for j in np.unique(cell).tolist():
        come = at[np.searchsorted(where, j) : np.searchsorted(where, j, "right")]
        own = by_cell[np.searchsorted(cell[by_cell], j) : np.searchsorted(cell[by_cell], j, "right")]
        for a in range(0, len(come), side):
            some = come[a : a + side]
            for b in range(0, len(own), side):
                part = own[b : b + side]
                yield some, part, least[part], products(x[some], y[part]), asked[some][:, None] == labels[part][None, :]


def _floors(visits: pa.Table, column: str) -> np.ndarray:
    return np.array([FAR if x is None else x for x in visits[column].to_pylist()], np.int64)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, **index) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``rows`` (vec_id, embedding, label, is_anchor).

    Each component x counts as floor(256 x) and scores are inner products of these. An anchor's positives are its first other rows of the same label, a positive's
    negatives the first rows of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score; higher
    scores come first, then smaller ids, null ids last. Rows with a null label or vector, or a null or non-finite component, take no part, nor do
    those whose squared integer norm reaches 2^62, as their scores don't fit. Vectors of different lengths don't meet; empty ones
    have score 0 with each other. Labels are whole numbers. A repeated row is another row, and a repeated anchor has its rows again. A null vec_id or is_anchor is no anchor.
    Anchors without positives, and positives without negatives, give no rows; nor does an empty table. Other columns are ignored.
    """
    take = positives + 1
    number = lambda x: F.floor(256 * x.cast("double"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(256 * x.cast("double")).cast("double"), 2))
    ok = rows.where(F.col("label").isNotNull() & finite("embedding")).where(square < LIMIT).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: number(x).cast("int")).alias("v"), F.coalesce(F.col("is_anchor") & F.col("vec_id").isNotNull(), F.lit(False)).alias("is_anchor"))
    few = top_k(ok.select("v", "label", "vec_id"), ["v", "label"], [F.col("vec_id").asc_nulls_last()], take)
    classes = few.groupBy("v", "label").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))).alias("ids"))
    classes = Saved(classes.select(F.monotonically_increasing_id().alias("cid"), F.size("v").alias("d"), "v", "label", F.transform("ids", lambda x: x["vec_id"]).alias("ids")), "classes").read()
    anchors = Saved(ok.where("is_anchor").select("vec_id", "v", "label").join(classes.select("cid", "v", "label"), ["v", "label"]).select("vec_id", F.col("cid").alias("aid")), "anchors").read()
    built = Index(classes, **index)
    asked = anchors.select("aid").distinct()
    asks = Saved(built.placed.join(asked, F.col("cid") == F.col("aid"), "left_semi").select(F.col("cid").alias("aid"), "d", "label", "vector"), "asks").read()

    def same_label(rows: pa.Table, visits: pa.Table) -> pa.Table:
        top = Best(take)
        floors = _floors(visits, "floor") if "floor" in visits.column_names else np.full(visits.num_rows, FAR)
        for asks, part, least, scores, same in _meetings(rows, visits):
            r, c = best(scores, same & (scores >= floors[asks][:, None]), take)
            top.add(asks[r], scores[r, c], part[c], least[c])
        ask, score, row, _ = top.found()
        return pa.table({"aid": visits["aid"].take(pa.array(ask)), "score": score, "ids": rows["ids"].take(pa.array(row))})

    def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        return top_k(found.select(*keys, "score", F.explode("ids").alias("id")), keys, [F.desc("score"), F.col("id").asc_nulls_last()], k)

    schema = "aid long, score long, ids array<long>"
    early = Saved(built.visit(asks, same_label, schema, None, FIRST), "early").read()
    floors = ranked(early, ["aid"], take).groupBy("aid").agg(F.when(F.count(F.lit(1)) == take, F.min("score")).alias("floor"))
    late = built.visit(asks.join(floors, "aid", "left"), same_label, schema, "floor", FIRST)
    chosen = ranked(early.unionByName(late), ["aid"], take)
    lists = Saved(chosen.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("rn", "score", "id"))).alias("list")), "positives").read()

    def other_labels(rows: pa.Table, visits: pa.Table) -> pa.Table:
        tops, bottoms = visits["tops"].to_pylist(), visits["bottoms"].to_pylist()
        width = max(map(len, tops), default=0)
        has = np.array([[len(t) > k for k in range(width)] for t in tops], bool).reshape(-1, width)
        high, low = (np.array([[x[k] if k < len(x) else 0 for k in range(width)] for x in lists], np.int64).reshape(-1, width) for lists in (tops, bottoms))
        top = Best(negatives)
        ends = np.where(has, low, NO_ID).min(1, initial=NO_ID), np.where(has, high, FAR).max(1, initial=FAR)
        for asks, part, least, scores, same in _meetings(rows, visits):
            inside = ~same & (scores >= ends[0][asks][:, None]) & (scores <= ends[1][asks][:, None])
            few = np.flatnonzero(inside.any(1))
            asks, scores, inside = asks[few], scores[few], inside[few]
            for k in range(width):
                r, c = best(scores, inside & has[asks, k, None] & (scores <= high[asks, k, None]) & (scores >= low[asks, k, None]), negatives)
                top.add(asks[r] * width + k, scores[r, c], part[c], least[c])
        group, score, row, _ = top.found()
        ask, k = np.divmod(group, max(width, 1))
        return pa.table({"aid": visits["aid"].take(pa.array(ask)), "top": high[ask, k] if width else group, "score": score, "ids": rows["ids"].take(pa.array(row))})

    # the least whole number n with 100 n >= low p, without a product that could overflow
    bottom = F.expr(f"(p - pmod(p, 100L)) div 100 * {low} + (pmod(p, 100L) * {low} + 99) div 100")
    opened = lists.select("aid", F.explode(F.array_distinct(F.transform("list", lambda x: x["score"]))).alias("p")).withColumn("bottom", bottom).where("bottom <= p")
    windowed = lambda w: w.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("p", "bottom"))).alias("w")).select("aid", F.transform("w", lambda x: x["p"]).alias("tops"), F.transform("w", lambda x: x["bottom"]).alias("bottoms"), F.array_min(F.transform("w", lambda x: x["bottom"])).alias("floor"))
    schema = "aid long, top long, score long, ids array<long>"
    early = Saved(built.visit(asks.join(windowed(opened), "aid"), other_labels, schema, None, FIRST), "early").read()
    reached = ranked(early, ["aid", "top"], negatives).groupBy("aid", F.col("top").alias("p")).agg(F.when(F.count(F.lit(1)) == negatives, F.min("score")).alias("reached"))
    raised = opened.join(reached, ["aid", "p"], "left").select("aid", "p", F.greatest("bottom", "reached").alias("bottom"))
    late = built.visit(asks.join(windowed(raised), "aid"), other_labels, schema, "floor", FIRST)
    mined = ranked(early.unionByName(late), ["aid", "top"], negatives).select("aid", F.col("top").alias("positive_score"), F.col("rn").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))

    own = asks.select("aid", "d", "vector").mapInArrow(_own_scores, "aid long, own long")
    at = F.array_position(F.transform("list", lambda x: x["id"].eqNullSafe(F.col("vec_id")) & (x["score"] == F.col("own"))), True) - 1
    others = F.slice(F.filter("list", lambda x, i: i != F.col("at")), 1, positives)
    each = anchors.join(lists.join(own.hint("merge"), "aid").hint("merge"), "aid").withColumn("at", at).select(F.col("vec_id").alias("anchor_id"), "aid", F.explode(others).alias("x")).select("anchor_id", "aid", F.col("x.id").alias("positive_id"), F.col("x.score").alias("positive_score"))
    return each.join(mined.hint("merge"), ["aid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _own_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [int((np.frombuffer(v, np.int32).astype(np.int64) ** 2).sum()) if v else 0 for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("aid"), pa.array(scores, pa.int64())], names=["aid", "own"])
