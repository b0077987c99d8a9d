"""Cases (a user's window with its items) and the views of them and of the trends that a front end shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.asof import last_points
from weftline.functions.expr import top_k
from weftline.operators.reco import TOP, USER, join_large

ITEM = [*USER, "article_id"]
# The attribute types of the trend views, in the order in which they are shown.
TREND_TYPES = ("colour_group_name", "product_type_name", "graphical_appearance_name", "garment_group_name")
# Attribute types that explain a case, those of the top-k chart, buckets of growth, and tags of a case.
EXPLAINING = ("graphical_appearance_name", "product_group_name", "colour_group_name")
CHARTED = ("colour_group_name", "product_type_name", "graphical_appearance_name")
BUCKETS = (("<0%", 0.0), ("0-10%", 0.1), ("10-20%", 0.2), ("20-30%", 0.3), ("30-50%", 0.5))
LAST_BUCKET, NO_BUCKET = "50%+", "--"
HIT, MISS, TWELVE = "命中用户", "未命中样本", "Top-12 推荐"
CONFIDENT = 0.2
SCORES = ("pop_score", "sim_score", "trend_score", "recent_score")


def case_id() -> Column:
    return F.concat_ws("_", F.lit("demo"), "split", "cutoff_week", "label_week", F.substring("customer_id", 1, 12)).alias("case_id")


def marked(items: DataFrame, truth: DataFrame) -> DataFrame:
    """Items with is_hit."""
    return join_large(items, truth.select(*ITEM, F.lit(1).alias("is_hit")), ITEM, "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(0)))


def report_cases(items: DataFrame, truth: DataFrame, profile: DataFrame, count: int) -> DataFrame:
    """The ``count`` test cases with all explanations and an explaining profile, of the most hits, then the longest profile, then by customer."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*SCORES, "candidate_sources")])
    stats = marked(items.where("split = 'test'"), truth).groupBy(*USER).agg(F.sum("is_hit").alias("hit_count"), F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("n_whole"))
    counts = profile.where((F.col("split") == "test") & F.col("attr_type").isin(*EXPLAINING)).groupBy(*USER).agg(F.count(F.lit(1)).alias("profile_count"))
    fit = join_large(stats.where("n = n_whole"), counts, USER)
    return fit.orderBy(F.desc("hit_count"), F.desc("profile_count"), "customer_id", "cutoff_week").limit(count).select(*USER, "hit_count", "profile_count")


def demo_cases(items: DataFrame, truth: DataFrame, profile: DataFrame, count: int) -> DataFrame:
    """The ``count`` best test cases that have ranks 1 to 12 once each, distinct articles, finite scores and sources, and a profile."""
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("score", *SCORES)]) & (F.trim("candidate_sources") != "")
    stats = marked(items.where((F.col("split") == "test") & (F.col("rank") <= TOP)), truth).groupBy(*USER).agg(
        F.sum("is_hit").alias("hit_count"), F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("article_id").alias("articles"), F.count_if(finite).alias("whole"), F.avg("trend_score").alias("trend_mean"), F.avg("score").alias("score_mean")
    )
    counts = profile.where("split = 'test'").groupBy(*USER).agg(F.count(F.lit(1)).alias("profile_count"))
    fit = stats.where(f"n = {TOP} AND ranks = {TOP} AND low = 1 AND high = {TOP} AND articles = {TOP} AND whole = {TOP}").join(counts.hint("merge"), USER)
    order = [F.desc("hit_count"), F.desc("profile_count"), F.round("trend_mean", 9).desc(), F.round("score_mean", 9).desc(), "customer_id", "cutoff_week"]
    return fit.orderBy(*order).limit(count).select(*USER, case_id(), "hit_count", "profile_count", "trend_mean", "score_mean")


def of_cases(rows: DataFrame, cases: DataFrame, top: int | None = None) -> DataFrame:
    """Rows of the cases' users and windows, with their case_id; top: ranks up to it. cases: a bounded list, broadcast."""
    found = rows.join(F.broadcast(cases.select(*USER)), USER, "left_semi")
    return (found.where(F.col("rank") <= top) if top else found).select(case_id(), *rows.columns)


def first_preference(profile: DataFrame) -> DataFrame:
    return top_k(profile, USER, [F.round("preference_score", 9).desc(), F.desc("purchase_count"), "attr_type", "attr_value"], 1).select(*USER, "attr_type", "attr_value")


def demo_users(cases: DataFrame, profile: DataFrame, items: DataFrame) -> DataFrame:
    """One summary row per case, with tags as a JSON list."""
    n = of_cases(items, cases).groupBy(*USER).agg(F.count(F.lit(1)).alias("n_items"))
    rows = cases.join(first_preference(of_cases(profile, cases)), USER, "left").join(n, USER, "left")
    tags = F.array_compact(F.array(F.when(F.col("hit_count") > 0, HIT).otherwise(MISS), F.concat("attr_type", F.lit(": "), "attr_value"), F.when(F.col("n_items") > 0, TWELVE)))
    return rows.select("case_id", *USER, "hit_count", F.to_json(tags).alias("primary_tags"), F.concat_ws("=", "attr_type", "attr_value").alias("profile_summary"), F.concat(F.coalesce("n_items", F.lit(0)).cast("string"), F.lit("/"), F.col("hit_count").cast("string")).alias("recommendation_summary"))


def case_payloads(cases: DataFrame, items: DataFrame, truth: DataFrame, profile: DataFrame, edges: DataFrame, representative: DataFrame, top: int = 5) -> DataFrame:
    """One nested row per case: the first preferences, the cutoff week's first trends, and the items with hit, scores and attributes."""
    liked = top_k(of_cases(profile, cases), USER, [F.round("preference_score", 9).desc(), F.desc("purchase_count"), "attr_type", "attr_value"], top)
    liked = liked.groupBy(*USER).agg(F.array_sort(F.collect_list(F.struct("rn", "attr_id", "preference_score", "purchase_count", "last_purchase_week"))).alias("profile"))
    trends = top_k(representative.join(F.broadcast(cases.select(F.col("cutoff_week").alias("week_id")).distinct()), "week_id", "left_semi"), ["week_id"], [F.round("pred_target_growth", 9).desc(), F.desc("heat_t"), "attr_id"], top)
    trends = trends.groupBy(F.col("week_id").alias("cutoff_week")).agg(F.array_sort(F.collect_list(F.struct("rn", "attr_id", "pred_target_growth", "heat_t"))).alias("representative_trends"))
    shown = marked(of_cases(items, cases, TOP), truth)
    named = edges.join(F.broadcast(shown.select("article_id").distinct()), "article_id", "left_semi").groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr_type", "attr_value")))).alias("attributes"))
    shown = shown.join(named, "article_id", "left")
    shown = shown.groupBy(*USER).agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "is_hit", "candidate_sources", F.struct("score", *SCORES).alias("scores"), F.to_json("attributes").alias("attributes")))).alias("recommendations"))
    return cases.select("case_id", *USER, "hit_count").join(liked, USER, "left").join(trends, "cutoff_week", "left").join(shown, USER, "left")


def trend_attributes(view: DataFrame, per_type: int = 50) -> DataFrame:
    """Rank by predicted growth within (week, type), the first ``per_type``."""
    return top_k(view, ["week_id", "attr_type"], [F.round("pred_target_growth", 9).desc(), "attr_id"], per_type, "rank").withColumns({"source_week": F.col("week_id"), "target_week": F.col("week_id") + 1}).drop("week_id")


def latest_week(view: DataFrame, back: int = 0) -> DataFrame:
    """The last test week, or ``back`` weeks before it, as one row."""
    return F.broadcast(view.where("split = 'test'").agg((F.max("week_id") - back).alias("week")))


def at_latest(attributes: DataFrame, view: DataFrame, back: int = 0) -> DataFrame:
    return attributes.join(latest_week(view, back), F.col("source_week") == F.col("week")).drop("week")


def core_trends(attributes: DataFrame, limit: int) -> DataFrame:
    return attributes.where(F.col("attr_type").isin(*TREND_TYPES) & (F.col("rank") <= limit))


def type_place() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in TREND_TYPES]), F.col("attr_type"))


def growth_histogram(core: DataFrame) -> DataFrame:
    g = F.round("pred_target_growth", 9)
    label = F.when(g.isNull(), NO_BUCKET)
    for name, below in BUCKETS:
        label = label.when(g < below, name)
    return core.groupBy(label.otherwise(LAST_BUCKET).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def trend_summary(core: DataFrame, edges: DataFrame) -> DataFrame:
    """Rising and confident attributes, mean growth and the articles that the attributes cover."""
    g = F.round("pred_target_growth", 9)
    covered = edges.join(F.broadcast(core.select("attr_id")), "attr_id", "left_semi").agg(F.countDistinct("article_id").alias("covered_article_count"))
    return core.agg(F.min("target_week").alias("target_week"), F.count_if(g > 0).alias("rising_attribute_count"), F.count_if(g >= CONFIDENT).alias("high_confidence_attribute_count"), F.avg("pred_target_growth").alias("mean_growth")).crossJoin(covered)


def new_high_potential(attributes: DataFrame, view: DataFrame, limit: int, back: int = 0) -> DataFrame:
    """A week's core trends that no earlier week had among its first ``limit``; the first ``limit`` of them by type, then rank. The
    week is the latest one, or ``back`` weeks before it."""
    now = core_trends(at_latest(attributes, view, back), limit)
    before = attributes.where(F.col("rank") <= limit).join(latest_week(view, back), F.col("source_week") < F.col("week")).select("attr_id")
    fresh = now.join(before, "attr_id", "left_anti").withColumn("place", type_place())
    return fresh.orderBy("place", "rank").limit(limit).drop("place")


def heat_series(attributes: DataFrame, heat: DataFrame, predictions: DataFrame, weeks: int = 8) -> DataFrame:
    """The last ``weeks`` heat points at or before each shown week of an attribute, each point once, with its prediction."""
    shown = attributes.select("attr_id", F.col("source_week").alias("week_id")).distinct()
    points = heat.select("attr_id", "attr_type", "attr_value", "week_id", F.col("heat_cnt").alias("heat"))
    known = predictions.select("attr_id", "week_id", F.col("target_growth").alias("actual_target_growth"), "pred_target_growth", "pred_share_t1")
    return last_points(points, shown, ["attr_id"], "week_id", weeks).join(known, ["attr_id", "week_id"], "left")


def heat_before(series: DataFrame, view: DataFrame, back: int, weeks: int = 8) -> DataFrame:
    """The last ``weeks`` points of each attribute at or before the week that lies ``back`` weeks before the latest."""
    marks = series.select("attr_id").distinct().crossJoin(latest_week(view, back)).withColumnRenamed("week", "week_id")
    return last_points(series, marks, ["attr_id"], "week_id", weeks)


def representative(view: DataFrame, top: int = 8) -> DataFrame:
    """The eligible attributes of greatest predicted growth, then heat, of each week."""
    return top_k(view.where("is_trend_eligible_t"), ["week_id"], [F.round("pred_target_growth", 9).desc(), F.desc("heat_t"), "attr_id"], top)


def eligible_top(view: DataFrame, top: int) -> DataFrame:
    """The charted types' eligible attributes of the last test week, the first ``top`` of each."""
    rows = view.where((F.col("split") == "test") & F.col("is_trend_eligible_t") & (F.col("heat_t") >= 20) & (F.col("history_total_heat_t") >= 100) & (F.col("history_active_weeks_t") >= 8) & F.col("attr_type").isin(*CHARTED))
    rows = rows.join(latest_week(view), F.col("week_id") == F.col("week")).drop("week")
    return top_k(rows, ["attr_type"], [F.round("pred_target_growth", 9).desc(), "attr_id"], top)


def curve_examples(view: DataFrame, types: int = 3, weeks: int = 8) -> DataFrame:
    """The latest week's best eligible attribute of a type, of the first few types by growth, with the weeks before."""
    now = view.where("is_trend_eligible_t").join(latest_week(view), F.col("week_id") == F.col("week"))
    best = top_k(now, ["attr_type"], [F.round("pred_target_growth", 9).desc(), "attr_id"], 1).drop("rn")
    few = best.orderBy(F.round("pred_target_growth", 9).desc(), "attr_id").limit(types).select("attr_id", "week")
    return view.join(F.broadcast(few), "attr_id").where((F.col("week_id") <= F.col("week")) & (F.col("week_id") > F.col("week") - weeks)).select("attr_id", "week_id", "heat_t", "pred_share_t1", "pred_target_growth")


def like(text: str, prefix: bool = False) -> str:
    """A LIKE pattern that holds the text as it is; ~ escapes."""
    escaped = text.strip().lower().replace("~", "~~").replace("%", "~%").replace("_", "~_")
    return f"{'' if prefix else '%'}{escaped}%"


def _is_like(column: str, pattern: str) -> Column:
    return F.like(F.lower(F.coalesce(column, F.lit(""))), F.lit(pattern), F.lit("~"))


# The columns that an article is searched by.
SEARCHED = ("article_id", "prod_name", "product_type_name", "colour_group_name")


def search_articles(articles: DataFrame, text: str, limit: int) -> DataFrame:
    """Articles with the text in their id, name, type or colour; ids that begin with it first, then names that do, then by id."""
    hit = reduce(lambda a, b: a | b, [_is_like(c, like(text)) for c in SEARCHED])
    place = F.when(_is_like("article_id", like(text, True)), 0).when(_is_like("prod_name", like(text, True)), 1).otherwise(2)
    return articles.where(hit).orderBy(place, "article_id").limit(limit)


def search_users(users: DataFrame, text: str, tag: str, limit: int) -> DataFrame:
    hit = (_is_like("case_id", like(text)) | _is_like("customer_id", like(text))) & _is_like("primary_tags", like(tag))
    return users.where(hit).orderBy(F.desc("hit_count"), "case_id").limit(limit)


def metrics_long(df: DataFrame, domain: str, name: str, metrics: tuple[str, ...]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric_name"))
    long = df.select(name, "split", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([name, "split"], list(metrics), "metric_name", "metric_value")
    return long.select(F.lit(domain).alias("metric_domain"), F.col(name).alias("model_or_method"), "split", "metric_name", "metric_value", place.alias("place"))


def metrics_summary(trend: DataFrame, reco: DataFrame) -> DataFrame:
    """Metrics of models and methods as rows in the order they are shown in (trend first): a few rows."""
    both = trend.unionByName(reco)
    order = Window.orderBy(F.desc("metric_domain"), "model_or_method", "split", "place")
    return both.withColumn("display_order", F.row_number().over(order)).drop("place")
