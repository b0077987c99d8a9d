"""Ranked lexical search over K2-treaps.

The grid has a row for each term and a column for each document; a point is a term's impact in a document. A K2-treap cuts the grid into
quadrants down to single points and keeps, for each quadrant that isn't empty, the greatest impact inside it. It is stored as four bits a node, which
say which quadrants there are, and the difference of each node's impact from its parent's, in as few bytes as a level needs.

A search takes the paths of an item's rows down together: a state is a range of documents with one node for each row of the item, and its bound is the
sum of the nodes' impacts times the terms' weights. States are opened best-first; a range of one document has its exact score. Of equal bounds the
range with lower columns goes first, and columns are in order of doc_id, so ties come out right. A task carries its best scores from
one treap to the next, and a state whose bound can't reach them is left.

Documents are cut into treaps of at most ``COLUMNS`` documents and about ``POINTS`` points where they lie, without a shuffle. Items are searched in
blocks whose distinct terms a task can hold; the grid of a block has the rows of these terms, as no other row is ever asked for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expr import top_k
from weftline.llm.common import Saved, small

#: Documents and points of a treap; terms, with repeats over items, of a block; states opened at once; parts that an item's results are merged in.
COLUMNS, POINTS, BLOCK_TERMS, OPEN, PARTS = 1 << 15, 1 << 20, 1 << 19, 192, 32
# What separates terms, letters that are lower-cased, and the constants of an impact and of a length.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
BASE, SLOPE, SATURATION, UNIT = 100 - 50, 50, 20, 1_000_000_000
_TABLE = bytes(0x20 if c in SEPARATORS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_POPULATION = np.array([bin(m).count("1") for m in range(16)], np.int64)
#: Of a node's quadrants q, how many come before q.
_BEFORE = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int64)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Treap:
    """Points (row, column, impact > 0) with distinct (row, column); columns are documents, in the order in which ties are broken."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = np.zeros(len(rows), np.int64)
        for b in range(self.height):
            code |= ((columns.astype(np.int64) >> b & 1) << 2 * b) | ((rows.astype(np.int64) >> b & 1) << 2 * b + 1)
        order = np.argsort(code)
        code, value = code[order], impacts[order].astype(np.int64)
        masks, values = [], [value]
        for _ in range(self.height):
            parent, quadrant = code >> 2, code & 3
            first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1]))) if len(parent) else np.zeros(0, np.int64)
            masks.append(np.bitwise_or.reduceat(1 << quadrant, first) if len(first) else np.zeros(0, np.int64))
            value = np.maximum.reduceat(value, first) if len(first) else value
            values.append(value)
            code = parent[first]
        self._lay(masks[::-1], values[::-1])

    def _lay(self, masks: list[np.ndarray], values: list[np.ndarray]) -> None:
        """Levels from the root on, one after the other; a node's children follow each other on the next level."""
        mask = np.concatenate([*masks, np.zeros(len(values[-1]), np.int64)]).astype(np.uint8)
        count = _POPULATION[mask]
        self.inner = sum(map(len, masks))
        self.first = np.append(1 + np.cumsum(count) - count, 0)  # node 0 is the root, so the children of all nodes are numbered from 1 on
        self.mask = np.append(mask, 0).astype(np.uint8)  # behind the last node stands an empty one
        self.value = np.append(np.concatenate(values), 0)
        self.empty = len(mask)

    def dump(self) -> tuple[int, bytes, list[bytes]]:
        """Height, the inner nodes' masks in four bits each, and by level the differences from the parents (root: the value itself)."""
        m = self.mask[: self.inner]
        padded = np.append(m, np.zeros(len(m) % 2, np.uint8))
        count = _POPULATION[m]
        parents = np.repeat(np.arange(self.inner), count)
        less = np.concatenate((self.value[:1], self.value[parents] - self.value[1 : 1 + len(parents)])) if self.empty else np.zeros(0, np.int64)
        out, start, size = [], 0, min(1, self.empty)
        for _ in range(self.height + 1):
            level = less[start : start + size]
            width = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if int(level.max(initial=0)) <= np.iinfo(t).max)
            out.append(bytes([np.dtype(width).itemsize]) + level.astype(width).tobytes())
            start, size = start + size, int(count[start : start + size].sum())
        return self.height, (padded[0::2] | padded[1::2] << 4).tobytes(), out

    @classmethod
    def load(cls, height: int, masks: bytes, levels: list[bytes]) -> Treap:
        self = cls.__new__(cls)
        self.height = height
        packed = np.frombuffer(masks, np.uint8)
        less = [np.frombuffer(x[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[x[0]]).astype(np.int64) for x in levels]
        inner = sum(map(len, less[:-1]))
        mask = np.stack((packed & 15, packed >> 4), 1).ravel()[:inner]
        values, parts, start = [less[0]], [], 0
        for k in range(height):
            part = mask[start : start + len(less[k])].astype(np.int64)
            parts.append(part)
            start += len(part)
            values.append(np.repeat(values[-1], _POPULATION[part]) - less[k + 1])
        self._lay(parts, values)
        return self

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int = 0, opened: int = OPEN) -> list[tuple[int, int]]:
        """(score, column) of the k best columns by the weighted sum of the rows' impacts, those over 0 and not under ``floor``; of equal ones the first columns."""
        inside = rows < 1 << self.height
        rows, weights = rows[inside], weights[inside]
        if not self.empty or not len(rows) or k < 1:
            return []
        nodes = np.zeros((1, len(rows)), np.int64)
        level, start = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int(weights.sum()) * int(self.value[0])])
        found_s, found_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = max(floor, 1)
        while len(bound):
            if len(bound) > opened:
                now = np.argpartition(-bound, opened)
                now, rest = now[:opened], now[opened:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            up = self.height - 1 - level[now]
            below = (rows[None, :] >> up[:, None] & 1) * 2
            children, bounds, starts = [], [], []
            for side in (0, 1):
                q = below + side
                at = nodes[now]
                m = self.mask[at]
                there = (m >> q & 1).astype(bool)
                child = np.where(there, self.first[at] + _BEFORE[m, q], self.empty)
                children.append(child)
                bounds.append(self.value[child] @ weights)
                starts.append(start[now] + (side << up))
            child, b, s, deep = np.concatenate(children), np.concatenate(bounds), np.concatenate(starts), np.tile(level[now] + 1, 2)
            leaf = deep == self.height
            scored = leaf & (b >= floor)
            if scored.any():
                found_s, found_c = np.concatenate((found_s, b[scored])), np.concatenate((found_c, s[scored]))
                if len(found_s) >= k:
                    order = np.lexsort((found_c, -found_s))[:k]
                    found_s, found_c = found_s[order], found_c[order]
                    floor = max(floor, int(found_s[-1]))
            more = ~leaf & (b >= floor)  # an equal bound may hide an equal score in an earlier column
            left = rest[bound[rest] >= floor]
            nodes, level = np.concatenate((nodes[left], child[more])), np.concatenate((level[left], deep[more]))
            start, bound = np.concatenate((start[left], s[more])), np.concatenate((bound[left], b[more]))
        order = np.lexsort((found_c, -found_s))[:k]
        return list(zip(found_s[order].tolist(), found_c[order].tolist(), strict=True))


def counted(documents: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the text, with repeats), and the given terms in it by number with their counts."""
    shared = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in small(batches):
            n, ids, tfs, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                held = Counter(filter(number.__contains__, words))
                n.append(len(words))
                ids += [number[t] for t in held]
                tfs += held.values()
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "ids", "tfs"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<long>")


def build(counts: DataFrame, n_docs: int, n_terms: int, columns: int = COLUMNS, points: int = POINTS) -> DataFrame:
    """One row per treap: doc_ids in order of columns, height, masks and levels. ``counts``: counted(); the sizes of the whole collection."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = docs = 0

        def flush() -> pa.RecordBatch:
            doc_id, none, n, lengths, ids, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc_id, none))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # (50 n N) div L in Python's whole numbers where 64 bits might not do
            fits = SLOPE * int(n.max(initial=0)) * n_docs < 1 << 62
            share = (SLOPE * n * n_docs) // max(n_terms, 1) if fits else np.array([SLOPE * int(x) * n_docs // n_terms for x in n], np.int64)
            m = np.repeat(BASE + share, lengths)
            impact = (UNIT * tfs) // (1000 * tfs + SATURATION * m)
            some = impact > 0
            treap = Treap(ids[some], np.repeat(place, lengths)[some], impact[some])
            height, masks, levels = treap.dump()
            ids_in_order = pa.array(doc_id[order], mask=none[order])
            return pa.RecordBatch.from_arrays([pa.array([ids_in_order.to_pylist()], pa.list_(pa.int64())), pa.array([height], pa.int32()), pa.array([masks], pa.binary()), pa.array([levels], pa.list_(pa.binary()))], names=["doc_ids", "height", "masks", "levels"])

        for batch in batches:
            for part in small([batch], 1024):
                ids, tfs = part.column("ids"), part.column("tfs")
                doc_id = part.column("doc_id")
                held.append((doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False), part.column("n").to_numpy(), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), tfs.flatten().to_numpy()))
                size, docs = size + len(held[-1][4]), docs + part.num_rows
                if size >= points or docs + 1024 > columns:
                    yield flush()
                    held, size, docs = [], 0, 0
        if docs:
            yield flush()

    # documents without any of the terms are in no item's results
    return counts.where(F.size("ids") > 0).mapInArrow(grow, "doc_ids array<long>, height int, masks binary, levels array<binary>")


def search(treaps: DataFrame, items: list[tuple[int, list[int], list[int]]], k: int) -> DataFrame:
    """key, doc_id, score: of each task's treaps the k best documents of each item (key, numbers of its terms, their weights)."""
    shared = treaps.sparkSession.sparkContext.broadcast(items)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(key, np.array(rows, np.int64), np.array(weights, np.int64)) for key, rows, weights in shared.value]
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                treap = Treap.load(row["height"], row["masks"], row["levels"])
                ids = row["doc_ids"]
                for key, rows, weights in wanted:
                    have = best.get(key, [])
                    found = treap.search(rows, weights, k, have[-1][0] if len(have) == k else 0)
                    if found:
                        have = have + [(score, ids[c]) for score, c in found]
                        best[key] = sorted(have, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out = [(key, doc_id, score) for key, have in best.items() for score, doc_id in have]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["key", "doc_id", "score"])

    return treaps.mapInArrow(seek, "key long, doc_id long, score long")


def _item_terms(items: DataFrame) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            terms = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("key"), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "key", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("key"), "text")
    return rows.mapInArrow(split, "item_id long, key long, terms array<binary>")


def rank(documents: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, columns: int = COLUMNS, points: int = POINTS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of all ``documents`` (doc_id, text) for each row of ``items`` (item_id, text), scores over 0.

    Higher scores come first, then smaller doc_ids, null ids last. Null and empty texts have no terms. Repeated documents are documents of their own, and
    repeated items are ranked once for each row. Without documents or items there are no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    asked = Saved(_item_terms(items), "items").read()
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    of_all = None
    results = []
    for b in range(blocks):
        part = asked.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)).select("key", "terms").collect()
        terms = sorted({t for r in part for t in r.terms})
        number = {bytes(t): i for i, t in enumerate(terms)}
        counts = Saved(counted(documents, [bytes(t) for t in terms]), "counts")
        if of_all is None:
            sizes = counts.read().agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            of_all = (sizes[0], sizes[1])
        df = dict(counts.read().select(F.explode("ids").alias("id")).groupBy("id").count().collect())
        weights = {t: weight(of_all[0], df[i]) for t, i in number.items() if i in df}
        ready = [(r.key, [number[bytes(t)] for t in r.terms if bytes(t) in weights], [weights[bytes(t)] for t in r.terms if bytes(t) in weights]) for r in part]
        treaps = Saved(build(counts.read(), *of_all, columns, points), "treaps")
        results.append(Saved(search(treaps.read(), [x for x in ready if x[1]], k).withColumn("part", F.spark_partition_id() % PARTS), "found").read())
        counts.drop()
        treaps.drop()
    order: list[Column] = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    few = top_k(found, ["key", "part"], order, k).drop("rn")
    best = top_k(few, ["key"], order, k)
    return best.join(asked.select("key", "item_id"), "key").select("item_id", F.col("rn").cast("int").alias("rank"), "doc_id", "score")
