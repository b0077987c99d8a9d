"""Boosted regression trees over quantile bins, fitted by barrier tasks.

Values are binned once, by quantiles that Spark finds in one pass; a bin takes one byte. Each task holds the binned rows of its partition, and the tasks of one barrier
stage grow the same trees together: a task counts rows and gradients by (node, feature, bin), all tasks exchange these counts, and each finds the same splits.
What is exchanged is bounded by nodes x features x bins and doesn't grow with the rows. Gradients of the absolute loss are signs, so counts are whole numbers and trees don't depend on
how rows are dealt out. A lost executor costs a rerun of the stage. Up to ROWS_PER_TASK rows fit one task, which exchanges nothing, and each model is a task of its own; beyond that
an exchange takes about a second, as Spark's tasks look for its end once a second, and a round needs some ten of them.

A tree is grown leaf by leaf: splits of different nodes don't depend on each other, so a level's nodes are all evaluated at once, and afterwards the splits of
greatest gain are taken from the root on until there are enough leaves. A leaf's value is the exact median of its residuals. Several models (masks of
features) are grown side by side over the same bins.
"""

from __future__ import annotations

import base64
import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.written import written

MISSING, ROWS_PER_TASK, FEW = 255, 250_000, 64
#: Added to a category's rows when categories are put in order of their mean gradient.
SMOOTH = 10
NODES = "model string, round int, node int, feature string, threshold double, categories array<string>, missing_left boolean, left int, right int, value double, gain double, n long, best_round int"


@dataclass(frozen=True)
class Params:
    """rounds at most; step of each; leaves and depth of a tree; least rows of a leaf; share of rows and of features a tree sees; rounds without a better
    validation error after which a model stops; seed."""

    rounds: int = 300
    step: float = 0.05
    leaves: int = 31
    depth: int = 6
    min_rows: int = 30
    rows: float = 0.8
    features: float = 0.6
    patience: int = 30
    seed: int = 42


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's hash and k alone."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def best_splits(count: np.ndarray, grad: np.ndarray, categorical: np.ndarray, min_rows: int) -> list[tuple | None]:
    """Of each node the split of greatest gain: (gain, feature, bin or left bins, missing_left), or None. count, grad: (nodes, features, 256)."""
    n, g = count.sum(2)[:, :1, None], grad.sum(2)[:, :1, None]  # the same for every feature
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = (g**2 / np.maximum(n, 1))[:, 0, 0]
        options = []
        for missing_left in (False, True):
            left_n, left_g = count[:, :, :MISSING].cumsum(2), grad[:, :, :MISSING].cumsum(2)
            if missing_left:
                left_n, left_g = left_n + count[:, :, MISSING:], left_g + grad[:, :, MISSING:]
            right_n = n - left_n
            fits = (left_n >= min_rows) & (right_n >= min_rows) & ~categorical[None, :, None]
            options.append(np.where(fits, left_g**2 / left_n + (g - left_g) ** 2 / right_n, -1.0))
        gains = np.stack(options, 1)  # node, side, feature, bin
    out: list[tuple | None] = []
    for k in range(len(count)):
        flat = gains[k].argmax()
        side, feature, at = np.unravel_index(flat, gains[k].shape)
        best = (gains[k][side, feature, at] - whole[k], int(feature), int(at), bool(side))
        for f in np.flatnonzero(categorical):
            there = np.flatnonzero(count[k, f, :MISSING])
            order = there[np.argsort(grad[k, f, there] / (count[k, f, there] + SMOOTH), kind="stable")]
            left_n, left_g = count[k, f, order].cumsum(), grad[k, f, order].cumsum()
            rest = n[k, 0, 0] - left_n
            fits = (left_n >= min_rows) & (rest >= min_rows)
            if fits.any():
                scored = np.where(fits, left_g**2 / np.maximum(left_n, 1) + (g[k, 0, 0] - left_g) ** 2 / np.maximum(rest, 1), -1.0)
                at = int(scored.argmax())
                if scored[at] - whole[k] > best[0]:
                    best = (scored[at] - whole[k], int(f), frozenset(order[: at + 1].tolist()), False)
        out.append(best if best[0] > 1e-12 else None)
    return out


class Tree:
    """Nodes in the order in which they came up; split[k] is None for those that weren't or couldn't be split."""

    def __init__(self) -> None:
        self.split: list[tuple | None] = [None]
        self.children: list[tuple[int, int] | None] = [None]
        self.count = [0]

    def add(self, node: int, split: tuple) -> tuple[int, int]:
        self.split[node] = split
        self.children[node] = (len(self.split), len(self.split) + 1)
        self.split += [None, None]
        self.children += [None, None]
        self.count += [0, 0]
        return self.children[node]

    def cut(self, leaves: int) -> tuple[np.ndarray, list[int]]:
        """Keeps the splits of greatest gain from the root on. Returns, of each node, the leaf that its rows now belong to, and the leaves."""
        heap, kept = [(-self.split[0][0], 0)] if self.split[0] else [], set()
        while heap and len(kept) < leaves - 1:
            _, node = heapq.heappop(heap)
            kept.add(node)
            for child in self.children[node]:
                if self.split[child]:
                    heapq.heappush(heap, (-self.split[child][0], child))
        leaf = np.arange(len(self.split))
        for node in range(len(self.split)):  # children come after their parents
            if node not in kept and self.children[node]:
                leaf[list(self.children[node])] = leaf[node]
        for node in range(len(self.split)):
            if node not in kept:
                self.split[node] = self.children[node] = None
        return leaf, [node for node in range(len(self.split)) if node not in kept and leaf[node] == node]


def medians(groups: list[np.ndarray], gather: Callable) -> list[float]:
    """Exact medians of groups whose values lie spread over tasks; each array is a task's sorted part of a group.

    Both middle ranks are closed in on by counts over 256 steps, until few values are left, which are exchanged."""
    ends = gather([(len(x), x[0] if len(x) else np.inf, x[-1] if len(x) else -np.inf) for x in groups])
    total = [sum(e[k][0] for e in ends) for k in range(len(groups))]
    targets = []  # group, rank, low, high, values below low
    for k, n in enumerate(total):
        low, high = min(e[k][1] for e in ends), max(e[k][2] for e in ends)
        targets += [[k, r, low, high, 0, n] for r in sorted({(n - 1) // 2, n // 2}) if n]
    found: dict[tuple[int, int], float] = {}
    while targets:
        wide = [t for t in targets if t[5] > FEW and t[2] < t[3]]
        if wide:
            edges = [np.linspace(t[2], t[3], 257)[1:-1] for t in wide]
            mine = [np.searchsorted(groups[t[0]], e, side="right") for t, e in zip(wide, edges, strict=True)]
            upto = sum(np.array(x, np.int64).reshape(len(wide), 255) for x in gather(np.array(mine)))  # values at most each edge
            for t, e, n in zip(wide, edges, upto, strict=True):
                at = int(np.searchsorted(n, t[1], side="right"))  # the first edge that more than rank values don't pass
                below = int(n[at - 1]) if at else t[4]
                above = int(n[at]) if at < 255 else t[4] + t[5]
                before = t[2], t[3]
                t[2], t[3] = (np.nextafter(e[at - 1], np.inf) if at else t[2]), (e[at] if at < 255 else t[3])
                t[4], t[5] = below, above - below
                if (t[2], t[3]) == before:
                    t[3] = t[2]  # no number lies between
            continue
        parts = []
        for k, _, low, high, _, _ in targets:
            x = groups[k]
            values, n = np.unique(x[np.searchsorted(x, low, side="left") : np.searchsorted(x, high, side="right")], return_counts=True)
            parts.append((values, n))
        for i, gathered in enumerate(zip(*gather(parts), strict=True)):
            values = np.concatenate([v for v, _ in gathered])
            order = np.argsort(values, kind="stable")
            reach = np.cumsum(np.concatenate([n for _, n in gathered])[order])
            found[targets[i][0], targets[i][1]] = float(values[order][np.searchsorted(reach, targets[i][1] - targets[i][4], side="right")])
        targets = []
    return [(found[k, (n - 1) // 2] + found[k, n // 2]) / 2 if n else 0.0 for k, n in enumerate(total)]


def grow(ids: np.ndarray, bins: np.ndarray, target: np.ndarray, valid: np.ndarray, categorical: np.ndarray, masks: dict[str, list[int]], params: Params, gather: Callable) -> dict[str, tuple[float, list, int]]:
    """Of each model its start, its trees as (Tree, leaf values, rows of nodes) and the number of rounds with the least validation error."""
    train = ~valid
    start = medians([np.sort(target[train])], gather)[0]
    names = list(masks)
    predicted = {m: np.full(len(target), start) for m in names}
    trees: dict[str, list] = {m: [] for m in names}
    best = {m: (np.inf, 0) for m in names}
    open_ = set(names)
    for k in range(params.rounds):
        running = [m for m in names if m in open_]
        if not running:
            break
        bag = train & (mixed(ids, params.seed + k) < params.rows)
        state = {}
        for m in running:
            features = np.array(masks[m])
            # the same features in all tasks: drawn by the round and the place in the mask
            take = max(1, round(params.features * len(features)))
            drawn = np.sort(features[np.random.default_rng([params.seed, k]).permutation(len(features))[:take]])
            gradient = np.sign(predicted[m] - target)
            state[m] = (Tree(), np.zeros(len(target), np.int32), drawn, gradient, [0])
        for _ in range(params.depth):
            message = {}
            for m, (_, node, drawn, gradient, level) in state.items():
                if not level:
                    continue
                local = np.full(node.max(initial=0) + 1, -1)
                local[[x for x in level if x < len(local)]] = [i for i, x in enumerate(level) if x < len(local)]
                rows = np.flatnonzero(bag & (local[node] >= 0))
                at, g, size = local[node[rows]] * 256, gradient[rows], len(level) * 256
                count = np.stack([np.bincount(at + bins[rows, f], minlength=size) for f in drawn], 1).reshape(len(level), 256, -1)
                grad = np.stack([np.bincount(at + bins[rows, f], g, size) for f in drawn], 1).reshape(len(level), 256, -1)
                message[m] = count.astype(np.int32), grad.astype(np.int32)
            if not message:
                break
            parts = gather(message)
            for m in message:
                tree, node, drawn, gradient, level = state[m]
                count, grad = (sum(p[m][i].astype(np.int64) for p in parts).transpose(0, 2, 1) for i in (0, 1))
                following = []
                for i, (split, x) in enumerate(zip(best_splits(count, grad.astype(np.float64), categorical[drawn], params.min_rows), level, strict=True)):
                    tree.count[x] = int(count[i, 0].sum())
                    if split is None:
                        continue
                    gain, f, where, missing_left = split
                    feature = int(drawn[f])
                    left, right = tree.add(x, (gain, feature, where, missing_left))
                    goes = goes_left(where, missing_left)
                    here = np.flatnonzero(node == x)
                    node[here] = np.where(goes[bins[here, feature]], left, right)
                    tree.count[left] = int(count[i, f][goes].sum())
                    tree.count[right] = tree.count[x] - tree.count[left]
                    following += [left, right]
                level[:] = following
        groups, leaves = [], {}
        for m, (tree, node, _, _, _) in state.items():
            leaf, ends = tree.cut(params.leaves)
            at = leaf[node]
            leaves[m] = (ends, at)
            rest = target - predicted[m]
            for x in leaves[m][0]:
                groups.append(np.sort(rest[bag & (at == x)]))
        values = iter(medians(groups, gather))
        errors = {}
        for m, (tree, *_) in state.items():
            value = np.zeros(len(tree.split))
            for x in leaves[m][0]:
                value[x] = params.step * next(values)
            predicted[m] += value[leaves[m][1]]
            trees[m].append((tree, value, list(tree.count)))
            errors[m] = float(((predicted[m] - target)[valid] ** 2).sum())
        everyone = gather((errors, int(valid.sum())))
        for m in running:
            error = sum(e[m] for e, _ in everyone)
            if not sum(n for _, n in everyone) or error < best[m][0]:
                best[m] = (error, k + 1)
            elif k + 1 - best[m][1] >= params.patience:
                open_.discard(m)
    return {m: (start, trees[m], best[m][1]) for m in names}


def goes_left(where: int | frozenset, missing_left: bool) -> np.ndarray:
    """For each bin whether it goes left."""
    out = np.zeros(256, bool)
    if isinstance(where, frozenset):
        out[list(where)] = True
    else:
        out[: where + 1] = True
        out[MISSING] = missing_left
    return out


def fit(rows: DataFrame, key: list[str], target: str, numeric: list[str], category: str, masks: dict[str, list[str]], params: Params = Params(), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The nodes of the models, one for each of ``masks`` (names of numeric features; the category is a feature of all), fitted on the rows of split ``train`` and stopped on those of ``valid``.

    Columns NODES: a leaf has a value and no feature; round -1 holds the start value. Null and NaN values go where the gain is greater, as do categories unknown to train.
    Rows with a null target are left out. There are at most 254 categories, by frequency; the others count as missing. Without train rows there are no nodes.
    """
    spark = rows.sparkSession
    known = rows.where(F.col("split").isin("train", "valid") & F.col(target).isNotNull())
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    known = written(known.select(F.xxhash64(*key).alias("id"), (F.col("split") == "valid").alias("valid"), F.col(target).cast("double").alias("y"), F.col(category).cast("string").alias("c"), F.array(*[value(c) for c in numeric]).alias("x")), "binned")
    train = known.where("NOT valid")
    categories = [r.c for r in train.where("c IS NOT NULL").groupBy("c").count().orderBy(F.desc("count"), "c").limit(MISSING - 1).collect()]
    steps = F.array(*[F.lit(k / (MISSING - 1)) for k in range(MISSING)])
    edges_row = train.agg(*[F.percentile_approx(F.col("x")[i], steps, 10_000).alias(f"e{i}") for i in range(len(numeric))]).first()
    edges = [np.unique(np.array(e if e is not None else [0.0], np.float64)) for e in edges_row]
    numbers = {f: i + 1 for i, f in enumerate(numeric)}
    wanted = {m: [0, *[numbers[f] for f in fs]] for m, fs in masks.items()}
    is_category = np.array([True, *[False] * len(numeric)])
    n = known.count()
    tasks = max(1, min(-(-n // rows_per_task), spark.sparkContext.defaultParallelism))

    place = {c: i for i, c in enumerate(categories)}

    def train_on(batches: Iterator[pa.RecordBatch], chosen: dict[str, list[int]], gather: Callable) -> Iterator[pa.RecordBatch]:
        ids, valid, y, bins = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0)], [np.zeros((0, len(numeric) + 1), np.uint8)]
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(numeric))
            part = np.empty((len(x), len(numeric) + 1), np.uint8)
            part[:, 0] = [place.get(c, MISSING) for c in batch.column("c").to_pylist()]
            for i, e in enumerate(edges):
                part[:, i + 1] = np.where(np.isnan(x[:, i]), MISSING, np.minimum(np.searchsorted(e, x[:, i], side="left"), len(e) - 1))
            ids.append(batch.column("id").to_numpy())
            valid.append(batch.column("valid").to_numpy(zero_copy_only=False))
            y.append(batch.column("y").to_numpy())
            bins.append(part)
        return map(_nodes_of, grow(np.concatenate(ids), np.concatenate(bins), np.concatenate(y), np.concatenate(valid), is_category, chosen, params, gather).items())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part of the rows, and all models."""
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()

        def gather(message):
            sent = base64.b64encode(zlib.compress(pickle.dumps(message, protocol=5), 1)).decode("ascii")
            return [pickle.loads(zlib.decompress(base64.b64decode(x))) for x in context.allGather(sent)]

        found = train_on(batches, wanted, gather)
        if context.partitionId() == 0:
            yield from found

    def alone(group: tuple, table: pa.Table) -> pa.Table:
        """All rows, which are few, and one model."""
        name = group[0].as_py()
        return pa.Table.from_batches(train_on(table.to_batches(), {name: wanted[name]}, lambda message: [message]))

    def _nodes_of(model: tuple) -> pa.RecordBatch:
        name, (start, trees, best_round) = model
        out = [(name, -1, 0, None, None, None, None, None, None, start, None, None, best_round)]
        for k, (tree, values, counts) in enumerate(trees):
            reached = [0]
            for node in reached:
                if tree.split[node] is None:
                    out.append((name, k, node, None, None, None, None, None, None, float(values[node]), None, counts[node], best_round))
                    continue
                gain, feature, where, missing_left = tree.split[node]
                left, right = tree.children[node]
                chosen = [categories[b] for b in sorted(where)] if feature == 0 else None
                out.append((name, k, node, category if feature == 0 else numeric[feature - 1], None if feature == 0 else float(edges[feature - 1][min(where, len(edges[feature - 1]) - 1)]), chosen, missing_left, left, right, None, float(gain), counts[node], best_round))
                reached += [left, right]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])

    if train.limit(1).count() == 0:
        return spark.createDataFrame([], NODES)
    if tasks == 1:
        each = known.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in masks], "model string")))
        return written(each.groupBy("model").applyInArrow(alone, NODES), "trees")
    return written(known.repartition(tasks, "id").mapInArrow(together, NODES, barrier=True), "trees")


def predict(rows: DataFrame, nodes: DataFrame, model: str, numeric: list[str], category: str, name: str = "predicted_growth") -> DataFrame:
    """``rows`` with the model's prediction, its trees up to the best round. The nodes, at most rounds x 2 leaves, are broadcast."""
    kept = nodes.where((F.col("model") == model) & (F.col("round") < F.col("best_round"))).orderBy("round", "node").collect()
    start = next((r.value for r in kept if r.round < 0), 0.0)
    trees: dict[int, list] = {}
    for r in kept:
        if r.round >= 0:
            trees.setdefault(r.round, []).append(r)
    numbers = {f: i for i, f in enumerate(numeric)}
    flat = []
    for k in sorted(trees):
        at = {r.node: i for i, r in enumerate(trees[k])}
        flat.append([(-1 if r.feature is None else len(numeric) if r.feature == category else numbers[r.feature], r.threshold or 0.0, frozenset(r.categories or ()), bool(r.missing_left), at.get(r.left, 0), at.get(r.right, 0), r.value or 0.0) for r in trees[k]])
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    names = rows.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(numeric))
            c = np.array(batch.column("_c").to_pylist(), object)
            total = np.full(n, start)
            for tree in shared.value:
                at, active = np.zeros(n, np.int64), True
                while active:
                    active = False
                    for node in np.unique(at).tolist():
                        feature, threshold, chosen, missing_left, left, right, _ = tree[node]
                        if feature < 0:
                            continue
                        active = True
                        here = np.flatnonzero(at == node)
                        if feature == len(numeric):
                            goes = np.array([v in chosen for v in c[here]], bool)
                        else:
                            v = x[here, feature]
                            goes = np.where(np.isnan(v), missing_left, v <= threshold)
                        at[here] = np.where(goes, left, right)
                total += np.array([t[6] for t in tree])[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(total)], names=[*names, name])

    value = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    return rows.withColumns({"_x": F.array(*[value(f) for f in numeric]), "_c": F.col(category).cast("string")}).mapInArrow(work, f"{fields}, {name} double")


def importance(nodes: DataFrame, model: str, features: list[str]) -> DataFrame:
    """feature, split_importance, gain_importance and normalized_gain_importance, over the trees up to the best round; a feature without a split has 0."""
    used = nodes.where((F.col("model") == model) & (F.col("round") < F.col("best_round")) & F.col("feature").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    every = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    rows = every.join(used, "feature", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("split_importance"), F.coalesce("gain", F.lit(0.0)).alias("gain_importance"))
    total = rows.agg(F.sum("gain_importance").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("feature", "split_importance", "gain_importance", F.coalesce(F.try_divide("gain_importance", "total"), F.lit(0.0)).alias("normalized_gain_importance"))
