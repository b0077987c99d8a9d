"""Boosted trees against brute force: stumps, medians, independence of how rows are dealt out, and held-out error."""

import threading

import numpy as np
import pytest

from weftline.operators import boosting


class Exchange:
    """Tasks as threads that exchange messages as barrier tasks do."""

    def __init__(self, n):
        self.n, self.barrier, self.held = n, threading.Barrier(n), [None] * n

    def gather(self, k):
        def send(message):
            self.held[k] = message
            self.barrier.wait()
            out = list(self.held)
            self.barrier.wait()
            return out

        return send


def side_by_side(parts, work):
    exchange, out = Exchange(len(parts)), [None] * len(parts)

    def run(k):
        out[k] = work(parts[k], exchange.gather(k))

    threads = [threading.Thread(target=run, args=(k,)) for k in range(len(parts))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_medians_are_exact():
    rnd = np.random.default_rng(1)
    groups = [rnd.normal(size=5000), np.round(rnd.normal(size=3001), 1), np.zeros(700), np.array([3.0]), np.array([]), np.concatenate((np.zeros(900), [1e-300, 5e9]))]
    owner = [rnd.integers(0, 3, len(g)) for g in groups]
    found = side_by_side([0, 1, 2], lambda k, gather: boosting.medians([np.sort(g[o == k]) for g, o in zip(groups, owner, strict=True)], gather))
    want = [float(np.median(g)) if len(g) else 0.0 for g in groups]
    assert all(np.allclose(f, want, rtol=0, atol=1e-15) for f in found)


def brute_split(bins, g, categorical, min_rows):
    """Every split of one node, tried out."""
    best, n = 0.0, len(g)
    for f in range(bins.shape[1]):
        options = []
        values = np.unique(bins[:, f])
        if categorical[f]:
            order = sorted(v for v in values if v != 255)
            mean = {v: g[bins[:, f] == v].sum() / ((bins[:, f] == v).sum() + boosting.SMOOTH) for v in order}
            order.sort(key=lambda v: mean[v])
            options = [np.isin(bins[:, f], order[: k + 1]) for k in range(len(order))]
        else:
            options = [(bins[:, f] <= v) & (bins[:, f] != 255) | (missing & (bins[:, f] == 255)) for v in values if v != 255 for missing in (False, True)]
        for left in options:
            if min_rows <= left.sum() <= n - min_rows:
                best = max(best, g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / n)
    return best


def test_a_stump_is_the_best_of_all():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        bins = rnd.integers(0, 6, (60, 4)).astype(np.uint8)
        bins[rnd.random((60, 4)) < 0.15] = 255
        g = np.sign(rnd.normal(size=60) + (bins[:, 1] > 2))
        categorical = np.array([True, False, False, False])
        count = np.stack([np.bincount(bins[:, f], minlength=256) for f in range(4)])[None]
        grad = np.stack([np.bincount(bins[:, f], g, 256) for f in range(4)])[None]
        found = boosting.best_splits(count, grad, categorical, 5)[0]
        want = brute_split(bins, g, categorical, 5)
        assert np.isclose(found[0] if found else 0.0, want)
        if found:
            left = boosting.goes_left(found[2], found[3])[bins[:, found[1]]]
            assert np.isclose(g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / 60, found[0])


def shape(models):
    return {m: (start, [([None if s is None else (round(s[0], 9), *s[1:]) for s in t.split], v.tolist(), c) for t, v, c in trees], best) for m, (start, trees, best) in models.items()}


def test_trees_do_not_depend_on_how_rows_are_dealt_out():
    rnd = np.random.default_rng(3)
    n = 1500
    bins = np.concatenate((rnd.integers(0, 4, (n, 1)), rnd.integers(0, 60, (n, 3))), 1).astype(np.uint8)
    y = (bins[:, 1] > 30) * 1.0 + bins[:, 0] * 0.3 + 0.2 * rnd.normal(size=n)
    valid = rnd.random(n) < 0.25
    ids = rnd.integers(-(2**62), 2**62, n)
    params = boosting.Params(rounds=12, leaves=7, depth=4, min_rows=20, patience=5)
    masks = {"all": [0, 1, 2, 3], "noise": [2, 3]}
    fit = lambda rows, gather: shape(boosting.grow(ids[rows], bins[rows], y[rows], valid[rows], np.array([True, False, False, False]), masks, params, gather))
    whole = fit(np.arange(n), lambda m: [m])
    owner = rnd.integers(0, 3, n)
    dealt = side_by_side([np.flatnonzero(owner == k) for k in range(3)], fit)
    assert all(d == whole for d in dealt)
    tree = whole["all"][1][0]
    assert sum(s is not None for s in tree[0]) <= 6
    empty = side_by_side([np.arange(n), np.zeros(0, int)], fit)
    assert empty[0] == whole


@pytest.fixture(scope="module")
def noisy(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        x, kind = rnd.normal(), rnd.choice(["a", "b", "c"])
        z = None if rnd.random() < 0.2 else float(rnd.normal())
        y = (2.0 if x > 0.3 else 0.0) + {"a": 0.0, "b": 1.0, "c": -1.0}[kind] + (1.5 if z is None else 0.0) + 0.1 * rnd.normal()
        rows.append((i, "train" if i % 4 else ("valid" if i % 8 else "test"), kind, float(x), z, float(y)))
    return spark.createDataFrame([*rows, (9001, "train", "a", 0.0, 0.0, None), (9002, "test", None, float("nan"), None, 0.0), (9003, "test", "new", 5.0, 1.0, 0.0)], "id long, split string, kind string, x double, z double, y double").repartition(4)


def test_barrier_tasks_fit_as_one_task_does(spark, noisy):
    params = boosting.Params(rounds=2, step=0.2, leaves=4, min_rows=10)
    one, three = (sorted(map(str, boosting.fit(noisy, ["id"], "y", ["x", "z"], "kind", {"full": ["x", "z"]}, params, rows_per_task=n).collect())) for n in (10**6, 300))
    assert one == three and len(one) > 5


def test_fit_and_predict(spark, noisy):
    params = boosting.Params(rounds=60, step=0.2, leaves=8, min_rows=10, features=1.0)
    nodes = boosting.fit(noisy, ["id"], "y", ["x", "z"], "kind", {"full": ["x", "z"], "kind_only": []}, params)
    found = {m: {r.id: (r.split, r.y, r.p) for r in boosting.predict(noisy, nodes, m, ["x", "z"], "kind", "p").collect()} for m in ("full", "kind_only")}
    error = {m: np.mean([abs(y - p) for s, y, p in rows.values() if s == "test" and y]) for m, rows in found.items()}
    assert error["full"] < 0.25 and error["kind_only"] > 0.7
    assert all(np.isfinite(p) for _, _, p in found["full"].values()) and len(found["full"]) == 1203
    got = {r.feature: r for r in boosting.importance(nodes, "full", ["kind", "x", "z"]).collect()}
    assert all(r.split_importance > 0 for r in got.values()) and np.isclose(sum(r.normalized_gain_importance for r in got.values()), 1)
    assert got["x"].gain_importance > 0
    assert {r.feature for r in boosting.importance(nodes, "kind_only", ["kind", "x"]).where("split_importance > 0").collect()} == {"kind"}
    none = boosting.fit(noisy.where("split = 'test'"), ["id"], "y", ["x", "z"], "kind", {"full": ["x"]}, params)
    assert none.count() == 0 and {r.p for r in boosting.predict(noisy.limit(3), none, "full", ["x", "z"], "kind", "p").collect()} == {0.0}
