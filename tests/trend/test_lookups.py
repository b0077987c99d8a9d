"""As-of lookups, running totals, last points and exact quantiles against plain Python."""

import random

import pytest

from weftline.functions.asof import as_of, last_points, running_totals
from weftline.functions.quantiles import exact_quantiles
from weftline.operators import reco


@pytest.mark.parametrize("block", [None, 5])
def test_as_of_and_totals(spark, block):
    rnd = random.Random(1)
    right = {(k, t): rnd.randrange(9) for k in "abc" for t in rnd.sample(range(40), 15)} | {("hot", t): t % 5 for t in range(0, 400, 2)}
    left = [(k, rnd.randrange(-3, 45), i) for i, k in enumerate("abcd" * 10)] + [("hot", t, 1000 + t) for t in range(0, 420, 7)] + [(None, 3, 5000), ("a", None, 5001), ("a", 9, 5002), ("a", 9, 5002)]
    known = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()] + [(None, 1, 7)], "k string, t long, v long")
    asked = spark.createDataFrame(left, "k string, t long, id long")

    def last(k, t):
        times = [x for kk, x in right if kk == k and t is not None and x <= t]
        return right[k, max(times)] if times else None

    got = [(r.k, r.t, r.id, r.v) for r in as_of(asked, known, ["k"], "t", ["v"], block).collect()]
    assert sorted(got, key=str) == sorted(((k, t, i, last(k, t)) for k, t, i in left), key=str)
    totals = {(r.k, r.t): r.v for r in running_totals(known.where("k IS NOT NULL"), ["k"], "t", ["v"], block).collect()}
    assert totals == {(k, t): sum(v for (kk, x), v in right.items() if kk == k and x <= t) for k, t in right}


def test_last_points_of_interleaved_marks(spark):
    rnd = random.Random(2)
    points = [(k, t, f"{k}{t}") for k in "ab" for t in rnd.sample(range(60), 25)]
    marks = [("a", 10), ("a", 12), ("a", 55), ("b", 0), ("b", 59), ("b", 59), ("c", 4)]
    want = set()
    for k, m in marks:
        want |= set(sorted((t, p) for kk, t, p in points if kk == k and t <= m)[-4:])
    found = last_points(spark.createDataFrame(points, "k string, t long, p string"), spark.createDataFrame(marks, "k string, t long"), ["k"], "t", 4)
    assert sorted((r.t, r.p) for r in found.collect()) == sorted(want)


def test_exact_quantiles_of_hot_values(spark):
    import numpy as np

    rnd = random.Random(3)
    rows = [("x", rnd.gauss(0, 1)) for _ in range(1001)] + [("x", 0.25)] * 2000 + [("y", float(i)) for i in range(7)] + [("y", None), ("z", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    names = {"p01": 0.01, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    got = {r.g: [r[n] for n in names] for r in exact_quantiles(df, ["g"], "v", names).collect()}
    for g in "xyz":
        values = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(got[g], [np.quantile(values, q) for q in names.values()])
    assert exact_quantiles(df.where("g = 'none'"), ["g"], "v", names).count() == 0


def test_history_and_popularity_at_interleaved_cutoffs(spark):
    rnd = random.Random(4)
    tx = [(rnd.choice("uvw"), rnd.choice("abcde"), rnd.randrange(1, 21)) for _ in range(300)]
    cutoffs = [("valid", c, c + 1) for c in (4, 5, 9)] + [("test", c, c + 1) for c in (12, 13, 20)]
    weekly = spark.createDataFrame(tx, "customer_id string, article_id string, week_id long")
    windows = spark.createDataFrame(cutoffs, "split string, cutoff_week long, label_week long")
    users = spark.createDataFrame([(*w, u) for i, w in enumerate(cutoffs) for u in "uvx" if (i + ord(u)) % 3], "split string, cutoff_week long, label_week long, customer_id string")
    want = {}
    for r in users.collect():
        for c, a, w in tx:
            if c == r.customer_id and w <= r.cutoff_week:
                last, n = want.get((r.cutoff_week, c, a), (0, 0))
                want[r.cutoff_week, c, a] = (max(last, w), n + 1)
    assert {(r.cutoff_week, r.customer_id, r.article_id): (r.last_week, r.n) for r in reco.history(weekly, users).collect()} == want
    for recent in (None, 3):
        counts = {}
        for _, c, _ in cutoffs:
            for _, a, w in tx:
                if w <= c and (recent is None or w > c - recent):
                    counts[c, a] = counts.get((c, a), 0) + 1
        assert {(r.cutoff_week, r.article_id): r.n for r in reco.popularity(weekly, windows, recent).collect()} == counts


def test_all_vectors_rank_a_users_candidates_at_once(spark):
    rnd = random.Random(5)
    rows = [("valid", 1, 2, u, f"{i:02d}", rnd.randrange(4) / 4, rnd.randrange(4) / 4) for u in "uvw" for i in range(rnd.randrange(3, 30))]
    vectors = [(k, [k / 4, 1 - k / 4]) for k in range(5)]
    df = spark.createDataFrame(rows, "split string, cutoff_week long, label_week long, customer_id string, article_id string, a double, b double").repartition(3)
    found = reco.rank_vectors(df, spark.createDataFrame(vectors, "k int, w array<double>"), ("a", "b"), "k", 6)
    want = set()
    for k, (x, y) in vectors:
        for u in "uvw":
            best = sorted((-round(a * x + b * y, 9), i) for *_, c, i, a, b in rows if c == u)[:6]
            want |= {(k, u, i, n + 1) for n, (_, i) in enumerate(best)}
    assert {(r.k, r.customer_id, r.article_id, r.rank) for r in found.collect()} == want
