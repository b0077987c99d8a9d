import math

import duckdb
import numpy as np
import pytest

from weftline.llm import hard_negatives, registry


def brute(rows, positives=5, negatives=5):
    """rows: (vec_id, vector, label, is_anchor); every row is compared with every anchor, in whole numbers of any size."""
    fine = [(i, tuple(math.floor(256 * x) for x in v), label, a) for i, v, label, a in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine = [r for r in fine if sum(x * x for x in r[1]) < 2**62]
    out, last = [], float("inf")
    key = lambda r: (-r[0], last if r[1] is None else r[1])
    for me, (i, v, label, asked) in enumerate(fine):
        if not asked or i is None:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for k, (j, w, other, _) in enumerate(fine) if k != me and len(w) == len(v)]
        for p, j, _ in sorted((r for r in scored if r[2]), key=key)[:positives]:
            window = sorted((r for r in scored if not r[2] and 80 * p <= 100 * r[0] <= 100 * p), key=key)[:negatives]
            out += [(i, j, n + 1, r[1], p, r[0]) for n, r in enumerate(window)]
    return sorted(out, key=str)


def check(spark, rows, **index):
    df = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], label, a, "clash") for i, v, label, a in rows], "vec_id long, embedding array<double>, label int, is_anchor boolean, aid string").repartition(3)
    got = [(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, **index).collect()]
    assert sorted(got, key=str) == brute(rows)
    return got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.5], 1, True), (1, [1.0, 0.4], 1, None), (2, [0.9, 0.4], 2, False), (3, [0.95, 0.45], 2, False), (None, [0.9, 0.4], 2, True), (4, [0.9, 0.4], None, False), (5, None, 1, True), (6, [nan, 1], 2, False), (7, [inf, 1], 2, False), (8, [None, 1.0], 2, False)]
    rows += [(9, [], 1, True), (10, [], 2, False), (11, [], 1, False), (12, [1.0], 1, True), (13, [1.0], 1, True), (13, [1.0], 1, True), (14, [0.9], 2, False), (15, [0.0, 0.0], 2, False), (16, [-1.0, -0.5], 1, False), (17, [1e9, 1e9], 2, True), (18, [8e6, 0], 2, True), (19, [7.8e6, 1.0], 1, False), (20, [7.9e6, 1.0], 2, False), (22, [1e7, 0], 2, False), (100, [1.0, 0.5], 3, True), (21, [1e30, 1], 1, True)]
    assert len(check(spark, rows)) >= 10
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, is_anchor boolean")
    assert hard_negatives.mine(empty).count() == 0


def test_ties_and_hot_vectors(spark):
    rnd = np.random.default_rng(3)
    grid = rnd.integers(-2, 3, (300, 4)) / 4
    rows = [(i, v.tolist(), int(i % 3), i % 10 == 0) for i, v in enumerate(grid)]
    rows += [(1000 + i, [0.5, 0.5, 0.25, 0.0], int(i % 2), i % 7 == 0) for i in range(150)]  # a third are one vector
    check(spark, rows, per_cell=10, block=20)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_many_cells_certify(spark, spread):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(40, 9))
    rows = [(i, (centres[rnd.integers(40)] + spread * rnd.normal(size=9)).tolist(), int(rnd.integers(4)), i % 50 == 0) for i in range(1500)]
    old, hard_negatives.FIRST = hard_negatives.FIRST, 30
    try:
        check(spark, rows, per_cell=8, block=16)
    finally:
        hard_negatives.FIRST = old


def test_heap_order():
    rnd = np.random.default_rng(5)
    u, v = rnd.integers(0, 5, 7).astype(float), rnd.normal(size=11)
    found = list(hard_negatives.by_bound(u, v))
    assert len(found) == len({(i, j) for _, i, j in found}) == 77
    assert [b for b, _, _ in found] == sorted((a + b for a in u for b in v), reverse=True)
    assert all(abs(u[i] + v[j] - b) < 1e-12 for b, i, j in found)


def test_visits_and_what_is_held_stay_small(spark, monkeypatch):
    """An anchor is dealt once to a codeword of the first half, not to each of its cells; a batch of visits and what a task holds are bounded."""
    counts = []

    class Seen(hard_negatives.Saved):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name == "visits":
                counts.append(self.read().groupBy("aid").count().selectExpr("max(count) AS n").first().n)

    monkeypatch.setattr(hard_negatives, "Saved", Seen)
    monkeypatch.setattr(hard_negatives, "WRITTEN", 7)
    monkeypatch.setattr(hard_negatives, "FIRST", 30)
    monkeypatch.setattr(hard_negatives, "PRODUCT", 16)
    rnd = np.random.default_rng(7)
    rows = [(i, rnd.normal(size=8).tolist(), int(rnd.integers(4)), i % 20 == 0) for i in range(1200)]
    check(spark, rows, per_cell=8, block=64)  # 150 cells of 13 x 13 codewords; nearly all are visited
    assert len(counts) == 4 and max(n or 0 for n in counts) <= 13

    top, want = hard_negatives.Best(3), {}
    monkeypatch.setattr(hard_negatives, "HELD", 100)
    top.room = 100
    for _ in range(50):
        group, score, row = rnd.integers(0, 5, 40), rnd.integers(0, 9, 40), rnd.integers(0, 1 << 40, 40)
        top.add(group, score, row, row)
        assert sum(len(p[0]) for p in top.parts) <= 100
        for g, x, r in zip(group, score, row, strict=True):
            want.setdefault(g, []).append((-x, r))
    assert [(g, -x, r) for g, x, r, _ in zip(*top.found(), strict=True)] == [(g, *x) for g in sorted(want) for x in sorted(want[g])[:3]]


def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(registry.HARD_NEGATIVES_SQL)
    columns = want.columns
    got = registry.op12_hard_negatives(spark, folder).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
