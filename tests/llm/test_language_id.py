import math
import zlib
from collections import Counter

from weftline.llm import language_id
from weftline.llm.common import table


def plain_vector(profiles, text):
    """A text's vector letter by letter, without numpy's counting."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return None
    line = [0, *[x for w in words for x in (*map(ord, w), 0)]]
    d, total = profiles.dimensions, [0] * profiles.dimensions
    letters = {p: profiles.letter(p).tolist() for p in set(line)}
    for gram, n in Counter(zip(line, line[1:], line[2:])).items():
        a, b, c = (letters[p] for p in gram)
        for i in range(d):
            total[i] += n * a[(i - 2) % d] * b[(i - 1) % d] * c[i]
    return total


def brute(rows, dimensions):
    profiles, sums = language_id.Profiles(dimensions), {}
    out = zlib.crc32
    vectors = [plain_vector(profiles, t or "") for _, t, _ in rows]
    held = [out(("" if i is None else str(i)).encode()) % 5 == 0 for i, _, _ in rows]
    for v, h, (_, _, lang) in zip(vectors, held, rows, strict=True):
        if v and not h and lang is not None:
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * dimensions), v, strict=True)]
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1e-300
    result = []
    for v, h, (i, _, _) in zip(vectors, held, rows, strict=True):
        if not v or not sums:
            result.append((i, h, "und", 0.0))
            continue
        best = max(sorted(sums), key=lambda lang: round(sum(a * b for a, b in zip(sums[lang], v, strict=True)) / norm(v) / norm(sums[lang]), 12))
        cosine = sum(a * b for a, b in zip(sums[best], v, strict=True)) / norm(v) / norm(sums[best])
        result.append((i, h, best, round(max(0.0, cosine), 9)))
    return result


def test_odd_documents_as_by_hand(odd_documents, no_documents):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_documents.collect()]
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identify(odd_documents, 32).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 32), key=str)
    assert language_id.identify(no_documents).count() == 0


def test_languages_ties_and_blocks(spark):
    texts = {"en": "the thing that they then thought", "xx": "the thing that they then thought", "de": "der die das und nicht schön", "el": "η γλώσσα των ελλήνων", None: "nobody says"}
    rows = [(10 * k + i, f"{t} {i % 3}", lang) for k, (lang, t) in enumerate(texts.items()) for i in range(10)] + [(900, "12 34", "no letters"), (901, None, "de"), (902, "漢字かな", "ja"), (903, "漢字", "ja"), (904, "かな", "ja")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, held_out string").repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identify(df, 64).collect()), key=str)
    assert got == sorted(brute(rows, 64), key=str)
    by = {r[0]: r[2] for r in got}
    assert by[0] == by[10] == "en"  # equal prototypes: the first by name
    assert by[900] == by[901] == "und"
    # one language a pass gives the same
    known = language_id.prototypes(df.where("doc_id < 900"), 64)
    one, all_of = (sorted(map(str, language_id.compare(df.select("doc_id", "text"), known, 64, languages=n).collect())) for n in (1, 2048))
    assert one == all_of
    assert {r.lang_pred for r in language_id.identify(df.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang"), 64).collect()} == {"und"}


def test_accuracy_on_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
