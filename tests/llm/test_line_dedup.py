import random
import re

from weftline.llm import line_dedup


def brute(docs, min_words):
    """docs: (doc_id, text), distinct. Removed line numbers by doc_id."""
    rows = []
    for d, t in sorted(docs):
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        rows.append((d, [i for i, _ in lines], [x for _, x in lines], [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in lines]))
    seen, out = set(), {d: set() for d, _ in docs}
    for d, numbers, lines, words in rows:
        for p in range(len(lines)):
            head = next((m for m in range(1, len(lines) - p + 1) if sum(words[p : p + m]) >= min_words), None)
            if head is None:
                continue
            n = head
            while True:
                key = tuple(lines[p : p + n])
                if key in seen:  # in an earlier document, or earlier in this one
                    out[d].update(numbers[p : p + n])
                seen.add(key)
                if p + n == len(lines) or sum(words[p + head : p + n + 1]) >= min_words:
                    break
                n += 1
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice("abcdefg") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 9))) for _ in range(14)]
    for min_words in (1, 6, 15):
        docs = []
        for d in range(50):
            lines = [rnd.choice(pool) if rnd.random() < 0.9 else f"own {d} {rnd.random()}" for _ in range(rnd.randint(0, 12))]
            if d % 7 == 3:
                lines = docs[rnd.randrange(d)][1].split("\n")
            if d % 5 == 2:
                lines.insert(rnd.randint(0, len(lines)), " \t")
            docs.append((d, "\n".join(lines)))
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        got = {r.row.doc_id: r for r in line_dedup.dedup_lines(df, min_words).collect()}
        want = brute(docs, min_words)
        assert {d: set(r.removed) for d, r in got.items()} == want
        assert any(want.values())
        for d, t in docs:
            lines = t.split("\n")
            assert got[d].text == "\n".join(x for i, x in enumerate(lines) if i not in want[d]) and got[d].n_lines == len(lines)


def test_runs_that_only_later_copies_share(spark):
    a, b = " ".join(["a"] * 60), " ".join(["b"] * 40)
    df = spark.createDataFrame([(1, a), (2, a + "\n" + b), (3, a + "\n" + b)], "doc_id long, text string")
    got = {r.row.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: a, 2: b, 3: ""}


def test_odd_documents(spark, odd_documents, no_documents):
    found = line_dedup.dedup_lines(odd_documents).collect()
    assert len(found) == odd_documents.count()
    long = [r for r in found if r.row.text and len(r.row.text) > 20_000]
    assert [len(r.text) > 0 for r in sorted(long, key=lambda r: r.row.doc_id)] == [True, False, True]
    assert all(r.text == r.row.text for r in found if r not in long)
    assert {r.row.key for r in found} == {"clash", None}
    assert line_dedup.dedup_lines(no_documents).count() == 0
