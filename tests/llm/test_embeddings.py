import math
from itertools import combinations

import numpy as np

from help_components import brute_components
from weftline.llm import embeddings
from weftline.llm.common import table


def brute(rows, threshold=0.95):
    """rows: (vec_id, list or None). n_links and component by position."""
    pairs = []
    for length in {len(v) for _, v in rows if v}:
        fine = [i for i, (_, v) in enumerate(rows) if v and len(v) == length and all(x is not None and math.isfinite(x) for x in v) and any(v)]
        x = embeddings.unit(np.array([rows[i][1] for i in fine], float)) if fine else np.zeros((0, 1))
        hits = x @ x.T >= threshold
        pairs += [(fine[a], fine[b]) for a, b in combinations(range(len(fine)), 2) if hits[a, b]]
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    root = brute_components(pairs, range(len(rows)))
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root[i]] = min(v, least.get(root[i], v))
    return [(v, links[i], least.get(root[i])) for i, (v, _) in enumerate(rows)]


def check(spark, rows, **more):
    df = spark.createDataFrame([(v, e if e is None else [None if x is None else float(x) for x in e], "x", 1) for v, e in rows], "vec_id long, embedding array<float>, cell string, m int").repartition(3)
    got = sorted(embeddings.near_duplicates(df, **more).collect(), key=str)
    want = sorted(brute(rows), key=str)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0, 0, 0]), (2, [2.0, 0.1, 0, 0]), (3, None), (4, [0.0] * 4), (5, [nan, 1, 1, 1]), (6, [inf, 1, 1, 1]), (7, [None, 1.0, 1, 1]), (8, [1.0, 0, 0, 0]), (8, [1.0, 0, 0, 0]), (9, []), (10, [1.0, 2.0]), (None, [0, 0, 1.0, 0]), (12, [0.0, 1, 0, 0])]
    check(spark, rows)
    check(spark, [(None, None), (2, [])])
    check(spark, [(1, [1.0, 0]), (2, [2.0, 0]), (3, [1.0, 0, 0]), (4, [3.0, 0, 0]), (5, [0, 1.0, 0]), (6, [1e-30, 0])])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).count() == 0


def test_crowded_cells_and_chains(spark):
    rnd = np.random.default_rng(7)
    base = rnd.normal(size=(900, 64))
    crowd = base[0] + 0.1 * rnd.normal(size=(260, 64))
    pairs = base[100:300] + 0.2 * rnd.normal(size=(200, 64))
    chain = [np.eye(64)[0] * math.cos(0.3 * k) + np.eye(64)[1] * math.sin(0.3 * k) for k in range(12)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate((base, crowd, pairs, np.array(chain))))]
    check(spark, rows, block=50)


def test_recall_on_given_vectors(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {v: n for v, n, _ in brute(rows)}
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert all(got[v] <= n for v, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())
