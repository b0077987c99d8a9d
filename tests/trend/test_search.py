"""Searches through trigram postings return what a scan returns, and open fewer files for rare texts."""

import random

from weftline.operators import cases, search


def test_same_rows_as_a_scan(spark, tmp_path):
    rnd = random.Random(1)
    words = ["red", "reddish", "Red%", "r_d", "blue", "navy blue", "éclair", "50% off", "a~b", "re", "", None]
    rows = [(f"{i:04d}", f"{rnd.choice(words)} {i % 7}", rnd.choice(words), rnd.choice(words)) for i in range(400)] + [("x999", "unicorn", "re", "d"), ("y", None, None, None)]
    articles = spark.createDataFrame(rows, "article_id string, prod_name string, product_type_name string, colour_group_name string")
    path = str(tmp_path / "postings")
    search.write_postings(articles, "article_id", list(cases.SEARCHED), path)
    for text in ("red", "RED", " red ", "red%", "r_d", "50%", "a~b", "éclair", "unicorn", "999", "re", "", "nothing like it", "d 3"):
        want = [r.article_id for r in cases.search_articles(articles, text, 50).collect()]
        near = search.narrowed(articles, "article_id", path, text)
        assert [r.article_id for r in cases.search_articles(near, text, 50).collect()] == want, text
        found = search.candidates(spark, path, text)
        assert (found is None) == (len(text.strip()) < 3)
        if found is not None:
            assert set(want) <= {r.id for r in found.collect()}
    few = search.candidates(spark, path, "unicorn")
    assert [r.id for r in few.collect()] == ["x999"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "PushedFilters: [In(gram" in plan


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id string, t string")
    search.write_postings(none, "id", ["t"], str(tmp_path / "none"))
    assert search.narrowed(none, "id", str(tmp_path / "none"), "ab").count() == 0
