"""Steps that read and write no more than they need, with the same results."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from weftline.operators import reco, trend
from weftline.plans import reco as plans
from weftline.sources import tables

WIN = reco.WIN


@pytest.fixture(scope="module")
def half(spark):
    return plans.Reco(spark, SF)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_purchases_are_written_without_price(spark, half):
    assert half.weekly.columns == ["week_id", "customer_id", "article_id"]
    assert rows(half.weekly, *half.weekly.columns) == rows(half.transactions, *half.weekly.columns)


def test_attributes_counted_by_number(spark, half):
    numbers, names = half.numbers, half.names
    columns = ["week_id", "attr_id", "heat_cnt"]
    got = trend.attribute_week_counted(half.weekly, numbers, names)
    want = trend.attribute_week_observed(trend.article_week_sales(half.transactions), trend.article_edges(half.articles))
    assert rows(got, *columns) == rows(want, *columns)
    assert [r.k for r in names.orderBy("attr_id").collect()] == list(range(1, names.count() + 1))


def test_article_without_a_value_keeps_its_attribute(spark):
    columns = ["article_id", *trend.ATTRIBUTES]
    articles = spark.createDataFrame([("1", *["x"] * 10), ("2", None, *["x"] * 9)], ", ".join(f"{c} string" for c in columns))
    names = trend.attribute_names(trend.attribute_nodes(articles))
    weekly = spark.createDataFrame([(3, "1"), (3, "2"), (3, "2")], "week_id long, article_id string")
    found = {r.attr_id: r.heat_cnt for r in trend.attribute_week_counted(weekly, trend.article_numbers(articles, names), names).collect()}
    assert (found[trend.ATTRIBUTES[0]], found[f"{trend.ATTRIBUTES[0]}::x"], found[f"{trend.ATTRIBUTES[1]}::x"]) == (2, 1, 3)


def test_profile_and_pool_by_number(spark, half):
    columns = [*reco.USER, "attr_id", "attr_value", "preference_score", "purchase_count", "last_purchase_week"]
    assert rows(reco.profile_of(half.past, half.numbers, parts=3, names=half.names), *columns) == rows(reco.profile_of(half.past, half.lists), *columns)
    columns = [*WIN, "attr_id", "article_id", "n", "attr_rank"]
    assert rows(reco.attribute_pool_of(half.recent, half.numbers, half.names), *columns) == rows(reco.attribute_pool(half.recent, half.edges), *columns)


def test_popularity_has_a_row_per_article(spark):
    windows = spark.createDataFrame([("valid", 5, 6), ("test", 5, 6), ("test", 9, 10)], "split string, cutoff_week long, label_week long")
    weekly = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("b", 9), ("c", 10)], "article_id string, week_id long")
    counts = reco.article_counts(weekly, windows)
    assert {r.article_id: r.counts for r in counts.collect()} == {"a": [2, 3], "b": [0, 1], "c": [0, 0]}
    assert rows(reco.spread_counts(counts, windows), *WIN, "article_id", "n") == [("test", 5, 6, "a", 2), ("test", 9, 10, "a", 3), ("test", 9, 10, "b", 1), ("valid", 5, 6, "a", 2)]
    assert reco.popularity(weekly, windows.where("false")).count() == 0


def test_seen_candidates_need_no_score(spark):
    half = plans.Reco(spark, SF)
    got = rows(plans.seen_candidates(half), *plans.ITEM, "is_seen")
    assert half.scored == {}
    assert got == rows(half.features().where("is_seen"), *plans.ITEM, "is_seen")


def test_one_score_waits_for_no_other(spark):
    half = plans.Reco(spark, SF)
    got = {c: rows(plans.one_score(half, c).select(*plans.ITEM, F.round(c, 9).alias(c)), *plans.ITEM, c) for c in ("pop_score", "recent_score", "trend_score")}
    assert half.scored == {}
    every = half.features()
    for c, found in got.items():
        assert found == rows(every.select(*plans.ITEM, F.round(c, 9).alias(c)), *plans.ITEM, c)


def test_strategies_are_counted_once(spark):
    half = plans.Reco(spark, SF)
    got = dict(rows(plans.strategy_counts(half), "strategy", "n"))
    assert list(half.by_strategy) == ["enhanced_default"]
    assert got == {s: half.candidates(s).count() for s in reco.STRATEGIES}


def test_purchases_are_joined_by_sort_and_merge(spark):
    plan = tables.raw_transactions(spark, SF).join(tables.first_date(spark, SF))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_names_of_a_mask(spark):
    frames = [spark.createDataFrame([("test", 1, 2, "c", a, s, r) for a, r in items], "split string, cutoff_week long, label_week long, customer_id string, article_id string, source string, source_rank long") for s, items in (("trend", [("x", 3), ("y", 1)]), ("popularity", [("x", 3)]), ("preference_popularity", [("x", 2)]))]
    merged = reco.merge_sources(frames, "s")
    assert rows(merged, "article_id", "candidate_sources", "primary_source", "best_source_rank", "mask") == [("x", "popularity|trend|preference_popularity", "preference_popularity", 2, 69), ("y", "trend", "trend", 1, 4)]
    assert "lambdafunction" not in merged._jdf.queryExecution().optimizedPlan().toString()
