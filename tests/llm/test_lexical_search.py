import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from weftline.llm import lexical_search, registry

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(documents, items, k):
    texts = [(i, words(t)) for i, t in documents]
    n_docs, n_terms = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for doc, held in texts:
            if held:
                tf, m = Counter(held), 50 + 50 * len(held) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(words(text)) if t in tf)
                if score > 0:
                    scored.append((score, doc))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, n + 1, doc, score) for n, (score, doc) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"columns": 1024, "points": 60, "block_terms": 20}])
def test_odd_documents_and_ties(spark, odd_documents, no_documents, limits):
    documents = [(r.doc_id, r.text) for r in odd_documents.collect()] + [(500 + i, "the of and" if i % 3 else "THE Édition x" + str(i % 5)) for i in range(80)]
    items = [(1, "The of\x00and ÉDITION édition don't"), (1, "the"), (2, None), (None, "null id 漢字 emoji🙂"), (3, "nobodyhasthis"), (4, "x2 x3 the"), (5, "word end a b c")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in documents], "doc_id long, text string, key string, n int").repartition(3)
    asked = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, score int").repartition(2)
    got = [tuple(r) for r in lexical_search.rank(df, asked, 20, **limits).collect()]
    assert sorted(got, key=str) == brute(documents, items, 20)
    if not limits:
        assert lexical_search.rank(no_documents, asked).count() == 0
        assert lexical_search.rank(df, asked.limit(0)).count() == 0


def test_treap_against_all_columns():
    rnd = np.random.default_rng(6)
    for rows, columns, n in ((40, 700, 6000), (300, 9, 900), (1, 1, 1), (5, 64, 64)):
        cells = rnd.choice(rows * columns, min(n, rows * columns), replace=False)
        r, c, v = cells // columns, cells % columns, rnd.integers(1, 40, len(cells))
        grid = np.zeros((2 * rows, columns), np.int64)
        grid[r, c] = v
        built = lexical_search.Treap(r, c, v)
        treap = lexical_search.Treap.load(*built.dump())
        assert (treap.mask == built.mask).all() and (treap.value == built.value).all()
        for _ in range(20):
            asked = np.unique(rnd.integers(0, 2 * rows, 8))
            w = rnd.integers(1, 6, len(asked))
            scores = w @ grid[asked]
            want = sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:10]
            for opened in (1, 7, 1000):
                assert treap.search(asked, w, 10, opened=opened) == [(-s, i) for s, i in want]


def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.sql(registry.LEXICAL_SEARCH_SQL)
    got = registry.op11_lexical_search(spark, folder).select(*want.columns).collect()
    assert len(got) == 40 * 50
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
