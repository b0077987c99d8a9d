import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from help_components import brute_components
from weftline.llm import golay, simhash
from weftline.llm.components import connected_components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_of_neighbours_meet():
    rnd = np.random.default_rng(3)
    words = rnd.integers(0, 1 << 23, 3000)
    index, distance = golay.decode(words)
    assert distance.max() <= 3
    assert (golay.decode(np.arange(1 << 12) << 11)[1] <= 3).all()

    def sets(x):
        row, key = golay.keys(x)
        out = [set() for _ in x]
        for r, k in zip(row, key, strict=True):
            out[r].add(int(k))
        return out

    mine = sets(words)
    assert {len(s) for s in mine} <= {1, 6}
    for bit in range(23):
        assert all(a & b for a, b in zip(mine, sets(words ^ (1 << bit)), strict=True))


def test_fingerprints(odd_texts):
    for text in odd_texts:
        assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def test_components(spark):
    rnd = random.Random(2)
    for n, edges in ((1, []), (60, 35), (40, 90)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(edges)] if edges else []
        chain = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (5, 5)] if edges else []
        df = spark.createDataFrame(pairs + chain, "u long, v long")
        nodes = {x for p in pairs + chain if p[0] != p[1] for x in p}
        want = {x: c for x, c in brute_components(pairs + chain, nodes | {5, 7}).items() if x in nodes}
        assert {r.node: r.component for r in connected_components(df).collect()} == want


def test_links_find_all_neighbours_also_in_large_groups(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:4]:  # groups of many fingerprints around one
        for _ in range(120):
            fps.add(base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    for base in list(fps)[:60]:
        fps.add(base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.u, r.v) for r in simhash.links(df).collect()}
    want = {(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in got)
    assert brute_components(got, signed) == brute_components(want, signed)


def test_near_duplicates(spark, odd_documents, no_documents):
    found = simhash.near_duplicates(odd_documents).select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id").collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    assert len(found) == odd_documents.count()
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    ids = [d for d in texts if d is not None]
    want = brute_components([(a, b) for a, b in combinations(ids, 2) if (fps[a] ^ fps[b]).bit_count() <= 2], ids)
    for r in found:
        assert r.h == f"{fps[r.doc_id]:016x}"
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(no_documents).count() == 0


def near_copies(rnd, words, base, n):
    """Texts of 120 words, each with up to two words changed."""
    for _ in range(n):
        text = list(base)
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        yield text


def test_similar_texts_link(spark):
    """No link of Jaccard 0.8 is lost and none is made up, also in groups larger than FULL with a passage in common."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    common = rnd.choices(words, k=30)
    texts = [rnd.choices(words, k=120) for _ in range(40)] + [common + rnd.choices(words, k=90) for _ in range(60)]
    for base, n in ((texts[0], 90), (texts[50], 60), (texts[70], 5), (texts[71], 1)):
        texts += near_copies(rnd, words, base, n)
    texts += [["a"], ["b"], [], [], texts[3], texts[3][:100]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, 0.8).collect()}
    sets = [set(zip(*(t[k:] for k in range(5)), strict=False)) or {tuple(t)} for t in texts]
    fps = [simhash.fingerprint(" ".join(t), 5) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 2]
    assert len(near) > 1000
    assert got == brute_components(near, range(len(texts)))


def test_links_where_every_shingle_is_crowded(spark):
    """Pairs at 0.8 are found though over FULL other sets, which are far from both, share each of their hashes."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(100):
        text = rnd.sample(words, 20)
        texts += [text, [*text[:18], *rnd.sample(sorted(set(words) - set(text)), 2)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 1, 0.8).collect()}
    sets = [set(t) for t in texts]
    fps = [simhash.fingerprint(" ".join(t), 1) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 2]
    assert 100 <= len(near) < 400
    assert got == brute_components(near, range(len(texts)))


def test_similarity_of_odd_documents(spark, odd_documents, no_documents):
    assert simhash.near_duplicates(odd_documents, 5, 0.8).count() == odd_documents.count()
    assert simhash.near_duplicates(no_documents, 5, 0.8).count() == 0


def test_similar_table_rows(spark):
    """On the given documents: all pairs at 0.8 that an inverted index finds lie in one component."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows, 5, 0.8).collect()}
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in rows.collect()}
    holders = {}
    for d, s in sets.items():
        for h in sorted(s)[: len(s) // 5 + 1]:
            holders.setdefault(h, []).append(d)
    near = {(a, b) for ds in holders.values() for a, b in combinations(ds, 2)}
    near = {(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near and all(got[a] == got[b] for a, b in near)


def test_one_of_each_by_row(spark):
    base = " ".join(f"w{i}" for i in range(200))
    other = " ".join(f"v{i}" for i in range(200))
    rows = [(1, base, 1), (1, other, 2), (2, base, 3), (2, base, 3), (3, other + " x", 4), (None, base, 5), (7, "alone here", 6), (7, "alone here", 6), (None, None, 7), (8, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int").repartition(3)
    got = sorted((r.h, r.doc_id) for r in simhash.one_of_each(df, 5, 0.8).collect())
    assert got == [(1, 1), (2, 1), (6, 7), (8, 8)]
    assert simhash.one_of_each(df.limit(0), 5, 0.8).count() == 0
