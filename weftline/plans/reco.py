"""Queries of the recommendation half: inputs, sources, scores, ranking, evaluation, experiments and checks."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import expr
from weftline.functions.expr import top_k
from weftline.operators import forecast, reco
from weftline.plans.catalog import query
from weftline.plans.reco_sql import ALL_SCORES, RECO, U, W, coverage, evaluation, minmax, ranked, user_metrics
from weftline.plans.sql import half_up
from weftline.plans.trend import Held
from weftline.sources import tables
from weftline.sources.written import Latest, written


ITEM = [*reco.USER, "article_id"]


class Reco(Held):
    """The recommendation half over one folder, with moving-average forecasts as the trend signal.

    Parts that many operators share are written to the shared folder when first used: a query that needs them starts from files with
    known sizes, and its plan stays small.
    """

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        self.by_strategy: dict[str, DataFrame] = {}
        self.scored: dict[str, DataFrame] = {}
        self.ranked: dict[str, DataFrame] = {}
        self.customers = reco.customer_profile(tables.raw_customers(spark, sf_dir))

    def keep(self, df: DataFrame) -> DataFrame:
        return written(df, "reco")

    @cached_property
    def forecast(self) -> DataFrame:
        return self.keep(forecast.moving_average(self.split).where("split <> 'train'"))

    @cached_property
    def windows(self) -> DataFrame:
        """A few rows: a week each of two splits."""
        return self.spark.createDataFrame(reco.windows_of(self.forecast).collect(), "split string, cutoff_week long, label_week long")

    @cached_property
    def users(self) -> DataFrame:
        return self.keep(reco.target_users(self.weekly, self.windows))

    @cached_property
    def truth(self) -> DataFrame:
        return self.keep(reco.labels(self.weekly, self.users))

    @cached_property
    def parts(self) -> int:
        """Tasks of the widest joins: so many that one has the purchases of about 250,000 lines, however many there are."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.weekly.count() // 250_000))

    @cached_property
    def past(self) -> DataFrame:
        return self.keep(reco.with_ranks(reco.history(self.weekly, self.users, self.parts)))

    @property
    def first(self) -> DataFrame:
        """First weeks of what target users bought up to their cutoffs: no other purchase makes a candidate seen."""
        return self.past.select(*ITEM, "first_week")

    @cached_property
    def lists(self) -> DataFrame:
        return self.keep(reco.article_lists(self.edges, self.products))

    @cached_property
    def profile(self) -> DataFrame:
        return self.keep(reco.profile_of(self.past, self.numbers, parts=self.parts, names=self.names))

    @cached_property
    def people(self) -> DataFrame:
        return self.keep(reco.user_facts(self.users, self.profile, self.customers, self.reorder, self.products))

    @cached_property
    def counts(self) -> DataFrame:
        return self.keep(reco.article_counts(self.weekly, self.windows))

    @property
    def popular(self) -> DataFrame:
        """A row for each window and article, spread where it is read: written, it would be as many rows as windows times articles."""
        return reco.spread_counts(self.counts, self.windows)

    @cached_property
    def recent(self) -> DataFrame:
        return self.keep(reco.popularity(self.weekly, self.windows, reco.RECENT))

    @cached_property
    def trends(self) -> DataFrame:
        return self.keep(reco.trends_of(self.forecast, self.lists, self.windows))

    @cached_property
    def products(self) -> DataFrame:
        return self.keep(reco.product_map(self.articles))

    @property
    def reorder(self) -> DataFrame:
        return reco.from_reorder(self.past)

    @cached_property
    def variants(self) -> DataFrame:
        return self.keep(reco.variant_rows(self.reorder, self.popular, self.products, self.windows))

    @cached_property
    def ages(self) -> DataFrame:
        return self.keep(reco.age_pool(self.weekly, self.customers, self.windows))

    @cached_property
    def attributes(self) -> DataFrame:
        return self.keep(reco.attribute_pool_of(self.recent, self.numbers, self.names))

    @cached_property
    def pool(self) -> DataFrame:
        return self.keep(reco.recommendable(self.weekly, self.windows))

    def source(self, name: str, recent: bool = True) -> DataFrame:
        build = {
            "popularity": lambda: reco.from_popularity(self.recent if recent else self.popular, self.users),
            "similarity": lambda: reco.from_similarity(self.profile, self.edges),
            "trend": lambda: reco.from_trend(self.forecast, self.lists, self.windows, self.users),
            "reorder": lambda: self.reorder,
            "product_variant": lambda: reco.from_variants(self.variants),
            "age_popularity": lambda: reco.from_age(self.ages, self.customers, self.users),
            "preference_popularity": lambda: reco.from_preference(self.attributes, self.profile),
        }
        return build[name]()

    def candidates(self, strategy: str = "enhanced_default") -> DataFrame:
        if strategy not in self.by_strategy:
            frames = [self.source(s, recent=strategy not in reco.ALL_WEEKS) for s in (reco.STRATEGIES | reco.ALL_WEEKS)[strategy]]
            self.by_strategy[strategy] = self.keep(reco.merge_sources(frames, strategy))
        return self.by_strategy[strategy]

    def features(self, strategy: str = "enhanced_default") -> DataFrame:
        """A strategy's candidates with is_seen and their scores over these candidates: four, or all ten for the enhanced strategy."""
        if strategy not in self.scored:
            rows, every = self.candidates(strategy), strategy == "enhanced_default"
            if every:
                articles = reco.article_facts(reco.window_articles(rows, self.popular, self.recent, self.trends), self.lists, self.ages, self.attributes)
                scored = reco.all_scores(rows, self.past, articles, self.people, True, parts=self.parts)
            else:  # the first few popular and trending ones of a window and the first few of each attribute: their number doesn't grow with the purchases
                few = self.keep(rows.select(*reco.WIN, "article_id").distinct())
                articles = self.keep(reco.article_facts(reco.window_articles(rows, self.popular, self.recent, self.trends, few), self.lists, few=few))
                scored = reco.few_scores(rows, self.past, articles, reco.user_facts(self.users, self.profile))
            self.scored[strategy] = self.keep_scores(strategy, scored)
        return self.scored[strategy]

    def keep_scores(self, strategy: str, scored: DataFrame) -> DataFrame:
        return self.keep(scored)

    def article_score(self, name: str) -> DataFrame:
        """One score that candidates have by window and article."""
        known, scaled = {"pop_score": (self.popular.withColumnRenamed("n", name), True), "recent_score": (self.recent.withColumnRenamed("n", name), True), "trend_score": (self.trends, False)}[name]
        return reco.window_score(self.candidates(), known, name, scaled)

    @cached_property
    def groups(self) -> DataFrame:
        """Numbers of enhanced candidates by what diagnostics ask of them; a few rows. No score is needed, and candidates that aren't written yet needn't be."""
        found = self.by_strategy.get("enhanced_default")
        if found is None:
            rows = reco.brought([self.source(s) for s in reco.STRATEGIES["enhanced_default"]])
        else:
            place = F.array_position(F.array(*[F.lit(s) for s in reco.SOURCES]), F.col("primary_source")).cast("int") - 1
            rows = found.select(*ITEM, F.col("mask").alias("bits"), (F.col("best_source_rank") * 8 + place).alias("best"))
        return self.keep(reco.candidate_groups(rows, self.past, self.truth))

    def fill(self, ranked: DataFrame, mode: str) -> DataFrame:
        return reco.fill_items(ranked, self.popular if mode == "pop_score" else self.recent, self.first, self.users)

    def items(self, method: str = "enhanced_pop_similarity_trend") -> DataFrame:
        """The ranked items of a method. The enhanced one lets reorder items be seen and fills no one up. Where attribute_similarity has no
        profile or candidates at all, everyone is filled up with recent popular items, which is what it falls back to."""
        if method not in self.ranked:
            mode, rows = reco.FILL.get(method), self.features(reco.STRATEGY[method])
            best = reco.weighted(reco.allowed(rows, reorder_may=mode is None), reco.METHODS[method])
            if mode:
                best = self.keep(best)
                best = reco.with_fill(best, self.fill(best, mode), mode, reco.METHODS[method])
            self.ranked[method] = self.keep(best)
        return self.ranked[method]

    @cached_property
    def every_item(self) -> DataFrame:
        """The items of all methods."""
        return self.keep(reduce(DataFrame.unionByName, [self.items(m).select(F.lit(m).alias("method"), *ITEM, "rank") for m in reco.METHODS]))


class OneSplit(Reco):
    """The half over the windows of one split: half as many users, candidates and items. What doesn't depend on windows is the whole half's."""

    def __init__(self, whole: Reco, split: str):
        super().__init__(whole.spark, whole.sf_dir)
        self.whole, self.only = whole, split

    @cached_property
    def windows(self) -> DataFrame:
        return self.whole.windows.where(F.col("split") == self.only)

    def keep_scores(self, strategy: str, scored: DataFrame) -> DataFrame:
        """Scores of the default strategy serve two methods; others are ranked where they are made."""
        return self.keep(scored) if strategy == "default" else scored


for _n in ("weekly", "edges", "nodes", "hierarchy", "numbers", "names", "heat", "split", "forecast", "parts", "lists", "products"):
    setattr(OneSplit, _n, property(lambda self, n=_n: getattr(self.whole, n)))


#: The half over one folder; its written parts serve all queries of a session until the folder's files change.
shared = Latest(lambda spark, sf_dir: Reco(spark, sf_dir))


def _register(name: str, sql: str | None, build, digits: int = 6) -> None:
    query(name, None if sql is None else RECO + sql)(lambda spark, sf_dir: expr.half_up(build(shared(spark, sf_dir)), digits))


_register("cust_profile", "SELECT customer_id, age, age_bucket, club_member_status, news_frequency FROM cust", lambda t: t.customers)
_register("win_reco_windows", "SELECT * FROM win", lambda t: t.windows)
SPLIT_SUMMARY_SQL = (
    "SELECT 'trend' AS domain, split, min(week_id) AS week_start, max(week_id) AS week_end, count(DISTINCT week_id) AS week_count, count(*) AS row_count, count(DISTINCT attr_id) AS attribute_count, CAST(NULL AS BIGINT) AS user_count FROM split GROUP BY 2 "
    "UNION ALL SELECT 'recommendation', split, min(cutoff_week), max(cutoff_week), count(DISTINCT cutoff_week), count(*), CAST(NULL AS BIGINT), (SELECT count(DISTINCT customer_id) FROM users u WHERE u.split = w.split) FROM win w GROUP BY 2"
)
_register("agg_split_summary", SPLIT_SUMMARY_SQL, lambda t: split_summaries(t))


def split_summaries(t: Reco) -> DataFrame:
    """Weeks, rows, attributes and users of the splits of both domains."""
    weeks = lambda c: [F.min(c).alias("week_start"), F.max(c).alias("week_end"), F.countDistinct(c).alias("week_count"), F.count(F.lit(1)).alias("row_count")]
    none = F.lit(None).cast("long")
    trends = t.split.groupBy("split").agg(*weeks("week_id"), F.countDistinct("attr_id").alias("attribute_count")).select(F.lit("trend").alias("domain"), "*", none.alias("user_count"))
    users = t.users.groupBy("split").agg(F.countDistinct("customer_id").alias("user_count"))
    windows = t.windows.groupBy("split").agg(*weeks("cutoff_week")).join(users, "split", "left")
    return trends.unionByName(windows.select(F.lit("recommendation").alias("domain"), "split", "week_start", "week_end", "week_count", "row_count", none.alias("attribute_count"), F.coalesce("user_count", F.lit(0)).alias("user_count")))


def seen_candidates(t: Reco) -> DataFrame:
    """Candidates that the user's history has; no score is needed to tell."""
    return reco.join_large(t.candidates().select(*ITEM), t.past.select(*ITEM), ITEM, "left_semi", t.parts).withColumn("is_seen", F.lit(True))


def strategy_counts(t: Reco) -> DataFrame:
    """Candidates of each strategy. The widest one has the sources of all and its mask says which brought a candidate, so the others' are those of its candidates that their sources brought."""
    bits = {s: sum(1 << reco.SOURCES.index(x) for x in sources) for s, sources in reco.STRATEGIES.items()}
    found = t.candidates().agg(F.array(*[F.struct(F.lit(s).alias("strategy"), F.count_if(F.col("mask").bitwiseAND(b) > 0).alias("n")) for s, b in bits.items()]).alias("x"))
    return found.select(F.explode("x").alias("x")).select("x.*")


def one_score(t: Reco, name: str) -> DataFrame:
    """A score of the enhanced candidates. One that is known by window and article doesn't wait for the others, unless they are there already."""
    if name in ("pop_score", "recent_score", "trend_score") and "enhanced_default" not in t.scored:
        return t.article_score(name).select(*ITEM, name)
    return t.features().select(*ITEM, name)


_register("in_target_users", "SELECT * FROM users", lambda t: t.users)
_register("in_eval_labels", "SELECT * FROM truth", lambda t: t.truth)
for _n in ("agg_user_profile", "in_user_profile"):
    _register(_n, f"SELECT {U}, attr_id, attr_type, attr_value, round(preference_score, 6) AS preference_score, purchase_count, last_purchase_week FROM profile", lambda t: t.profile)
_register("agg_user_history", "SELECT * FROM hist", lambda t: t.past.select(*ITEM, "last_week", "n"))
_register("agg_popularity_cutoff", "SELECT * FROM pop", lambda t: t.popular)
_register("join_range_cutoff", "SELECT * FROM rpop", lambda t: t.recent)
_register("agg_weekly_popularity", "SELECT * FROM wpop", lambda t: t.weekly.groupBy("week_id", "article_id").agg(F.count(F.lit(1)).alias("n")))
_register("agg_recommendable_pool", "SELECT * FROM pool", lambda t: t.pool)
_register("join_cross_users_topn", f"SELECT {U}, article_id, rn AS source_rank FROM users JOIN poprank USING ({W}) WHERE rn <= 12", lambda t: t.source("popularity", recent=False).drop("source"))
_register("join_concat_axis1_dropna", "SELECT customer_id, a.n AS n_before, b.n AS n_after FROM (SELECT customer_id, count(*) AS n FROM tx WHERE week_id <= 300 GROUP BY 1) a JOIN (SELECT customer_id, count(*) AS n FROM tx WHERE week_id > 300 GROUP BY 1) b USING (customer_id)", lambda t: t.weekly.where("week_id <= 300").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_before")).join(t.weekly.where("week_id > 300").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_after")), "customer_id"))
for _n, _cte, _key in (("ret_recent_popularity", "s_recent", "popularity"), ("ret_similarity", "s_sim", "similarity"), ("ret_trend", "s_trend", "trend"), ("ret_reorder", "s_reorder", "reorder"), ("ret_product_variant", "s_variant", "product_variant"), ("ret_age_popularity", "s_age", "age_popularity"), ("ret_preference_popularity", "s_pref", "preference_popularity")):
    _register(_n, f"SELECT {U}, article_id, source, source_rank FROM {_cte}", lambda t, k=_key: t.source(k).select(*ITEM, "source", "source_rank"))
_register("ret_popularity", f"SELECT {U}, article_id, source, source_rank FROM s_pop", lambda t: t.source("popularity", recent=False).select(*ITEM, "source", "source_rank"))
CAND = f"{W}, strategy, customer_id, article_id, candidate_sources, primary_source, best_source_rank, mask, has_reorder_source"
_register("ret_merge_sources", f"SELECT {CAND} FROM cand", lambda t: t.candidates())
_register(
    "ret_strategies",
    "SELECT 'popularity' AS strategy, count(*) AS n FROM s_recent UNION ALL SELECT 'similarity', count(*) FROM s_sim UNION ALL SELECT 'trend_union', count(*) FROM s_trend UNION ALL SELECT 'default', count(*) FROM cand WHERE mask & 7 > 0 UNION ALL SELECT 'enhanced_default', count(*) FROM cand",
    lambda t: strategy_counts(t),
)
_register("flag_candidate_seen", f"SELECT {U}, article_id, is_seen FROM feat WHERE is_seen", lambda t: seen_candidates(t))
_register("flt_seen", f"SELECT {U}, article_id FROM feat WHERE NOT is_seen", lambda t: reco.without_seen(t.candidates(), t.first).select(*ITEM))
_register("flt_seen_by_source", f"SELECT {U}, article_id FROM feat WHERE NOT is_seen OR has_reorder_source", lambda t: reco.without_seen(t.candidates(), t.first, True).select(*ITEM))
# both policies over flags that are kept with the candidates
_register(
    "flt_cached_seen",
    f"SELECT 'strict' AS policy, {U}, article_id FROM feat WHERE NOT is_seen UNION ALL SELECT 'by_source', {U}, article_id FROM feat WHERE NOT is_seen OR has_reorder_source",
    lambda t: reco.allowed(t.features()).select(F.lit("strict").alias("policy"), *ITEM).unionByName(reco.allowed(t.features(), True).select(F.lit("by_source").alias("policy"), *ITEM)),
)
_register("join_anti_drop_existing", f"SELECT {U}, article_id FROM feat_dflt ANTI JOIN it_pop_similarity_trend USING ({U}, article_id)", lambda t: reco.join_large(t.candidates("default").select(*ITEM), t.items("pop_similarity_trend").select(*ITEM), ITEM, "left_anti"))
_register(
    "dg_seen_filtered",
    f"SELECT split, count(*) AS n_candidates, count(*) FILTER (NOT is_seen OR has_reorder_source) AS n_kept, count(*) FILTER (is_seen AND NOT has_reorder_source) AS n_dropped FROM feat GROUP BY 1",
    lambda t: t.features().groupBy("split").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(~F.col("is_seen") | F.col("has_reorder_source")).alias("n_kept"), F.count_if(F.col("is_seen") & ~F.col("has_reorder_source")).alias("n_dropped")),
)
for _n, _c in (("sc_pop", "pop_score"), ("sc_recent", "recent_score"), ("sc_sim", "sim_score"), ("sc_trend", "trend_score"), ("sc_reorder", "reorder_score"), ("sc_variant", "variant_score"), ("sc_age_pop", "age_pop_score"), ("sc_preference_pop", "preference_pop_score"), ("sc_source_rank", "source_rank_score"), ("sc_source_count", "source_count_score")):
    _register(_n, f"SELECT {U}, article_id, round({_c}, 6) AS {_c} FROM feat", lambda t, c=_c: one_score(t, c))
_register("sc_all_features", f"SELECT {U}, article_id, {ALL_SCORES} FROM feat", lambda t: t.features().select(*ITEM, *reco.SCORES))
_register("sc_article_trend", f"SELECT {W}, article_id, round(v, 6) AS trend_score FROM atrend", lambda t: t.trends)
_register("sc_minmax_group", f"SELECT {W}, article_id, round({minmax('n', 'PARTITION BY ' + W)}, 6) AS score FROM pop", lambda t: reco.minmax_groups(t.popular.withColumnRenamed("n", "score"), "score", reco.WIN))
_register("sc_rank_norm", f"SELECT {U}, article_id, round(greatest(0.0, least(1.0, (12 - source_rank + 1) / 12.0)), 6) AS score FROM s_reorder", lambda t: t.reorder.select(*ITEM, reco.rank_norm(F.col("source_rank"), 12).alias("score")))
_register("rk_weighted_topk", f"SELECT {U}, article_id, {half_up('score')} AS score, rank FROM items", lambda t: t.items().select(*ITEM, "score", "rank"))
_register("md_enhanced", f"SELECT {U}, article_id, {half_up('score')} AS score, rank FROM items", lambda t: t.items().select(*ITEM, "score", "rank"))
for _m in reco.FILL:
    _register(f"md_{_m}", f"SELECT {U}, article_id, {half_up('score')} AS score, rank, is_backfill FROM it_{_m}", lambda t, m=_m: t.items(m).select(*ITEM, "score", "rank", "is_backfill"))
_register("rk_items", f"SELECT {U}, i.article_id, rank, {half_up('score')} AS score, {ALL_SCORES}, candidate_sources FROM items i JOIN feat USING ({U}, article_id)", lambda t: t.items().select(*ITEM, "rank", "score", *reco.SCORES, "candidate_sources"))
_register("rk_pack", f"SELECT {U}, string_agg(article_id, ' ' ORDER BY rank) AS prediction FROM items GROUP BY ALL", lambda t: reco.packed(t.items()))
_register("ev_parse_prediction", f"SELECT {U}, article_id, rank FROM items", lambda t: reco.unpacked(reco.packed(t.items())))
MAIN = "pop_similarity_trend"
FOUR = "round(pop_score, 6) AS pop_score, round(recent_score, 6) AS recent_score, round(sim_score, 6) AS sim_score, round(trend_score, 6) AS trend_score"
_register("rk_backfill", f"SELECT {U}, article_id, rank, {half_up('score')} AS score, {FOUR}, candidate_sources, is_backfill FROM it_{MAIN}", lambda t: t.items(MAIN))
_have = f"SELECT {U}, count(*) FILTER (NOT is_backfill) AS b, count(*) AS a FROM it_{MAIN} GROUP BY ALL"
_register(
    "rk_underfilled",
    f"SELECT {W}, count(*) AS n_users, count(*) FILTER (coalesce(b, 0) < 12) AS n_short_before, count(*) FILTER (coalesce(a, 0) < 12) AS n_short_after FROM users LEFT JOIN ({_have}) USING ({U}) GROUP BY ALL",
    lambda t: reco.join_large(t.users, t.items(MAIN).groupBy(*reco.USER).agg(F.count_if(~F.col("is_backfill")).alias("b"), F.count(F.lit(1)).alias("a")), reco.USER, "left").groupBy(*reco.WIN).agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.coalesce("b", F.lit(0)) < 12).alias("n_short_before"), F.count_if(F.coalesce("a", F.lit(0)) < 12).alias("n_short_after")),
)
_register("join_hash_hit_flag", f"SELECT {U}, i.article_id, rank, CAST(t.article_id IS NOT NULL AS INTEGER) AS is_hit FROM items i LEFT JOIN truth t USING ({U}, article_id)", lambda t: reco.join_large(t.items(), t.truth.withColumn("is_hit", F.lit(1)), ITEM, "left").select(*ITEM, "rank", F.coalesce("is_hit", F.lit(0)).alias("is_hit")))
for _n, _c in (("ev_map", "ap"), ("ev_recall", "recall"), ("ev_hit_rate", "hit"), ("ev_ndcg", "ndcg")):
    _register(_n, f"SELECT {U}, round({_c}, 6) AS {_c} FROM ({user_metrics('items')})", lambda t, c=_c: reco.user_metrics(t.items(), t.users, t.truth).select(*reco.USER, c))
_register("ev_coverage", f"SELECT {W}, round(coverage, 6) AS coverage FROM ({coverage('items')})", lambda t: reco.coverage(t.items(), t.pool))
_register("ev_all", evaluation("items"), lambda t: reco.evaluate(t.items(), t.users, t.truth, t.pool))
STAGES = (("pre_seen", "true"), ("post_seen", "NOT is_seen OR has_reorder_source"))


def by_stage(t: Reco, build) -> DataFrame:
    """A diagnostic of the candidates before and after the source policy's seen filter. build: of their groups and what is kept."""
    kept = {"pre_seen": F.lit(True), "post_seen": ~F.col("is_seen") | (F.col("mask").bitwiseAND(1 << reco.SOURCES.index("reorder")) > 0)}
    return reduce(DataFrame.unionByName, [build(t.groups, kept[stage]).withColumn("stage", F.lit(stage)) for stage, _ in STAGES])


def stages_sql(select: str) -> str:
    """select: a query over c, the candidates of a stage."""
    return " UNION ALL ".join(f"(WITH c AS (SELECT * FROM feat WHERE {rule}) {select.replace('STAGE', stage)})" for stage, rule in STAGES)


RECALL = f"SELECT 'STAGE' AS stage, split, count(*) AS n_labels, count(c.article_id) AS n_found, round(avg(CAST(c.article_id IS NOT NULL AS INTEGER)), 6) AS candidate_recall FROM truth t LEFT JOIN c USING ({U}, article_id) GROUP BY 2"
_register("dg_candidate_recall", stages_sql(RECALL), lambda t: by_stage(t, reco.group_recall))
CREDIT = f"SELECT 'STAGE' AS stage, split, source, round(sum(1.0 / len(string_split(candidate_sources, '|'))), 6) AS credit, count(*) FILTER (source = primary_source) AS n_primary FROM (SELECT *, unnest(string_split(candidate_sources, '|')) AS source FROM c SEMI JOIN truth USING ({U}, article_id)) GROUP BY 2, 3"
PER_USER = "SELECT 'STAGE' AS stage, split, round(n / CAST(m AS DOUBLE), 6) AS per_user FROM (SELECT split, count(*) AS n FROM c GROUP BY 1) JOIN (SELECT split, count(*) AS m FROM users GROUP BY 1) USING (split)"
SHARES = "SELECT 'STAGE' AS stage, split, source, count(*) AS n_rows FROM (SELECT split, unnest(string_split(candidate_sources, '|')) AS source FROM c) GROUP BY 2, 3"


def per_user(t: Reco, groups: DataFrame, kept) -> DataFrame:
    users = t.users.groupBy("split").agg(F.count(F.lit(1)).alias("m"))
    return groups.where((F.col("mask") > 0) & kept).groupBy("split").agg(F.sum("n").alias("n")).join(users, "split").select("split", (F.col("n") / F.col("m")).alias("per_user"))


def source_rows(groups: DataFrame, kept) -> DataFrame:
    return reco.group_sources(groups, kept).groupBy("split", "source").agg(F.sum("n").alias("n_rows"))


def diagnostics(t: Reco) -> DataFrame:
    """All diagnostics of the candidates as one table: stage, split, diagnostic, source (empty where there is none), value."""

    def all_of(groups: DataFrame, kept) -> DataFrame:
        long = lambda df, name, source, value: df.select("split", F.lit(name).alias("diagnostic"), source.alias("source"), F.col(value).cast("double").alias("value"))
        none, credit = F.lit(""), reco.group_credit(groups, kept)
        recall = reco.group_recall(groups, kept)
        parts = [long(recall, n, none, n) for n in ("n_labels", "n_found", "candidate_recall")] + [long(credit, n, F.col("source"), n) for n in ("credit", "n_primary")]
        parts += [long(per_user(t, groups, kept), "per_user", none, "per_user"), long(source_rows(groups, kept), "n_rows", F.col("source"), "n_rows")]
        return reduce(DataFrame.unionByName, parts)

    return by_stage(t, all_of)


_long = lambda sql, names, source: " UNION ALL ".join(f"SELECT stage, split, '{n}' AS diagnostic, {source} AS source, CAST({n} AS DOUBLE) AS value FROM ({stages_sql(sql)})" for n in names)
_register("dg_payload", "SELECT * FROM (" + " UNION ALL ".join((_long(RECALL, ("n_labels", "n_found", "candidate_recall"), "''"), _long(CREDIT, ("credit", "n_primary"), "source"), _long(PER_USER, ("per_user",), "''"), _long(SHARES, ("n_rows",), "source"))) + ")", diagnostics)
_register("dg_source_credit", stages_sql(CREDIT), lambda t: by_stage(t, reco.group_credit))
_register("dg_avg_candidates", stages_sql(PER_USER), lambda t: by_stage(t, lambda groups, kept: per_user(t, groups, kept)))
_register("dg_source_coverage", stages_sql(SHARES), lambda t: by_stage(t, source_rows))

# The weight grid, in the order pop, sim, trend, recent.
GRID = ((0.4, 0.2, 0.3, 0.1), (0.4, 0.3, 0.2, 0.1), (0.3, 0.3, 0.3, 0.1), (0.2, 0.4, 0.3, 0.1), (0.4, 0.1, 0.0, 0.5), (0.3, 0.1, 0.2, 0.4), (0.3, 0.0, 0.2, 0.5), (0.2, 0.1, 0.2, 0.5), (0.2, 0.0, 0.3, 0.5), (0.4, 0.0, 0.1, 0.5), (0.2, 0.2, 0.1, 0.5), (0.3, 0.2, 0.1, 0.4), (0.4, 0.2, 0.0, 0.4), (0.4, 0.1, 0.1, 0.4), (0.3, 0.2, 0.2, 0.3), (0.3, 0.1, 0.3, 0.3), (0.4, 0.1, 0.2, 0.3), (0.4, 0.2, 0.1, 0.3), (0.2, 0.3, 0.2, 0.3), (0.2, 0.2, 0.3, 0.3), (0.3, 0.3, 0.0, 0.4), (0.4, 0.3, 0.0, 0.3), (0.2, 0.3, 0.0, 0.5), (0.2, 0.2, 0.4, 0.2), (0.3, 0.0, 0.4, 0.3))
GRID_SCORES = ("pop_score", "sim_score", "trend_score", "recent_score")


# The enhanced grid in hundredths, in the order of SCORES; the scores that strict ablations drop; a method's name in reports.
ENHANCED_GRID = [tuple(x / 100 for x in row) for row in ((14, 30, 10, 8, 16, 8, 4, 4, 3, 3), (16, 28, 10, 8, 16, 8, 4, 4, 3, 3), (12, 32, 10, 8, 16, 8, 4, 4, 3, 3))]
STRICT = (("without_trend_in_rec", "w/o Trend in Rec", "trend_score"), ("without_similarity", "w/o Similarity", "sim_score"), ("without_recent", "w/o Recent", "recent_score"))
BASELINE_VARIANTS = (("recent_only_baseline", "recent_popularity"), ("pop_similarity_baseline", "pop_similarity"))
#: Variants of the enhanced method: sources and scores that go; whether the seen filter loses its exception.
SOURCE_VARIANTS = (("full_model", (), (), False), ("without_trend_score", (), ("trend_score",), False), ("without_trend_source_score", ("trend",), ("trend_score",), False), ("without_reorder_variant", ("reorder", "product_variant"), ("reorder_score", "variant_score"), False), ("without_customer_segment", ("age_popularity",), ("age_pop_score",), False), ("enhanced_seen_filtered", (), (), True))


def dropped_weights(weights: dict[str, float], gone: tuple[str, ...]) -> dict[str, float]:
    """The weights without some of them, the others brought back to a sum of 1."""
    rest = sum(w for c, w in weights.items() if c not in gone)
    return {c: 0.0 if c in gone else w / rest for c, w in weights.items()}


def vector_metrics(t: Reco, rows: DataFrame, vectors: DataFrame, scores: tuple[str, ...], by: str, mode: str | None, only=lambda df: df) -> DataFrame:
    """Metrics of the items of every weight vector (by, w) in one pass; only: the splits. Candidates are held against the labels before they are ranked, so a user's items of a vector
    stay one row. Who has too few candidates has them all ranked by any vector, so the fill is the same for all."""
    rows, users, truth = only(rows), only(t.users), only(t.truth)
    allowed = reco.allowed(rows, reorder_may=mode is None)
    lists = reco.rank_lists(reco.marked(allowed.select(*ITEM, *scores), truth), vectors, scores, by, ("hit",))
    if mode:
        some = top_k(allowed.select(*ITEM), reco.USER, ["article_id"], reco.TOP, "rank")
        lists = reco.filled_lists(lists, vectors, reco.marked(only(t.fill(some, mode)).select(*ITEM, "rank"), truth), by)
    return reco.evaluate_lists(t.keep(lists), users, truth, only(t.pool), vectors.select(by), by=(by,))


def valid(df: DataFrame) -> DataFrame:
    return df.where("split = 'valid'")


def grid_metrics(t: Reco) -> DataFrame:
    """The 25 weight vectors on the valid windows, with their place by NDCG, then index."""
    if "grid" not in t.ranked:
        vectors = t.spark.createDataFrame([(k, list(w)) for k, w in enumerate(GRID)], "grid_index int, w array<double>")
        found = expr.half_up(vector_metrics(t, t.features("default"), vectors, GRID_SCORES, "grid_index", reco.FILL[MAIN], valid))
        t.ranked["grid"] = t.keep(top_k(found.join(F.broadcast(vectors), "grid_index"), ["split"], [F.desc("ndcg_at_12"), "grid_index"], len(GRID), "place"))
    return t.ranked["grid"]


def variant_metrics(t: Reco, vectors: DataFrame) -> DataFrame:
    """Metrics of the main method by split, for weight vectors (variant_id, w)."""
    return vector_metrics(t, t.features("default"), vectors, GRID_SCORES, "variant_id", reco.FILL[MAIN])


def best_vectors(t: Reco) -> DataFrame:
    """variant_id and w: the best grid vector, and it without a score, the others brought back to a sum of 1."""
    best = grid_metrics(t).where("place = 1").select("w")
    one = [best.select(F.lit("full_model").alias("variant_id"), "w")]
    for variant, _, gone in STRICT:
        k = GRID_SCORES.index(gone)
        left = F.array(*[F.lit(0.0) if i == k else F.col("w")[i] / (1 - F.col("w")[k]) for i in range(len(GRID_SCORES))])
        one.append(best.select(F.lit(variant).alias("variant_id"), left.alias("w")))
    return reduce(DataFrame.unionByName, one)


def best_metrics(t: Reco) -> DataFrame:
    if "best" not in t.ranked:
        t.ranked["best"] = t.keep(expr.half_up(variant_metrics(t, best_vectors(t))))
    return t.ranked["best"]


def method_summary(t: Reco) -> DataFrame:
    if "methods" not in t.ranked:
        t.ranked["methods"] = t.keep(expr.half_up(reco.evaluate(t.every_item, t.users, t.truth, t.pool, by=("method",))))
    return t.ranked["methods"]


def named_ablation(t: Reco) -> DataFrame:
    """The full model, its strict ablations and two baselines side by side."""
    out = [best_metrics(t).withColumn("method", F.lit(MAIN))]
    out += [method_summary(t).where(F.col("method") == m).withColumn("variant_id", F.lit(v)) for v, m in BASELINE_VARIANTS]
    return reduce(DataFrame.unionByName, out).select("variant_id", "method", "split", *METRIC_NAMES)


def trend_buckets(t: Reco) -> DataFrame:
    """The best grid vector of each trend weight, with its metrics on both splits."""
    bucket = top_k(grid_metrics(t).withColumn("trend_weight", F.col("w")[2]), ["trend_weight"], [F.desc("ndcg_at_12"), "grid_index"], 1)
    chosen = bucket.select(F.col("grid_index").cast("string").alias("variant_id"), "w", "trend_weight")
    found = variant_metrics(t, chosen.select("variant_id", "w"))
    return found.join(F.broadcast(chosen.drop("w")), "variant_id").select("trend_weight", F.col("variant_id").cast("int").alias("grid_index"), "split", *METRIC_NAMES)


def source_ablation(t: Reco) -> DataFrame:
    """The enhanced method without some sources or scores, on the valid windows."""
    rows, items, counts = valid(t.features()), [], []
    for variant, sources, scores, strict in SOURCE_VARIANTS:
        left = reco.without_sources(rows, set(sources)) if sources or strict else rows
        best = reco.weighted(reco.allowed(left, reorder_may=not strict), dropped_weights(reco.METHODS["enhanced_pop_similarity_trend"], scores))
        items.append(best.select(F.lit(variant).alias("variant_id"), *ITEM, "rank"))
        counts.append(left.agg(F.lit(variant).alias("variant_id"), F.count(F.lit(1)).alias("candidate_rows")))
    found = reco.evaluate(t.keep(reduce(DataFrame.unionByName, items)), valid(t.users), valid(t.truth), valid(t.pool), by=("variant_id",))
    return found.join(F.broadcast(reduce(DataFrame.unionByName, counts)), "variant_id").select("variant_id", "candidate_rows", *METRIC_NAMES)


def flattened(t: Reco) -> DataFrame:
    """Grid, methods, named ablation and trend buckets as rows of one report: section, place, method, split, weights, metrics."""
    weights = [F.round(F.col("w")[k], 6).alias(f"{c}_weight") for k, c in enumerate(GRID_SCORES)]
    none = [F.lit(None).cast("double").alias(f"{c}_weight") for c in GRID_SCORES]
    grid = grid_metrics(t).select(F.lit("search_results").alias("section"), F.col("place").cast("int").alias("place"), F.lit(MAIN).alias("method"), "split", *weights, *METRIC_NAMES)
    place = lambda order, names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(order)).cast("int").alias("place")
    methods = method_summary(t).select(F.lit("ablation").alias("section"), place("method", sorted(reco.METHODS)), "method", "split", *none, *METRIC_NAMES)
    names = ["full_model", *[v for v, _, _ in STRICT], *[v for v, _ in BASELINE_VARIANTS]]
    own = F.broadcast(best_vectors(t))
    named = named_ablation(t).join(own, "variant_id", "left").select(F.lit("named_ablation").alias("section"), place("variant_id", names), F.col("variant_id").alias("method"), "split", *weights, *METRIC_NAMES)
    return grid.unionByName(methods).unionByName(named)


METRIC_NAMES = (*reco.METRICS, "user_count", "missing_users")
_metrics = ", ".join(METRIC_NAMES)
_values = ", ".join(f"({k}, [{', '.join(map(str, w))}])" for k, w in enumerate(GRID))


def _vector_items(vectors: str, by: str, features: str, scores: tuple[str, ...], fill: bool) -> str:
    """Items of every vector (by, w)."""
    total = " + ".join(f"{c} * w[{k + 1}]" for k, c in enumerate(scores))
    rule = "NOT is_seen" if fill else "NOT is_seen OR has_reorder_source"
    more = f" UNION ALL SELECT {by}, {U}, article_id, rank FROM fl_{MAIN} CROSS JOIN {vectors}" if fill else ""
    return f"SELECT {by}, {U}, article_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by}, {U} ORDER BY round(score, 9) DESC, article_id) AS rank FROM (SELECT {by}, {U}, article_id, {total} AS score FROM {features} CROSS JOIN {vectors} WHERE {rule})) WHERE rank <= 12{more}"


_strict = " UNION ALL ".join(f"SELECT '{v}' AS variant_id, list_transform(w, lambda x, i: CASE WHEN i = {GRID_SCORES.index(c) + 1} THEN 0.0 ELSE x / (1 - w[{GRID_SCORES.index(c) + 1}]) END) AS w FROM best" for v, _, c in STRICT)
EXPERIMENT = RECO + f""", gridv AS (SELECT CAST(k AS INTEGER) AS grid_index, CAST(v AS DOUBLE[]) AS w FROM (VALUES {_values}) g(k, v)),
griditems AS ({_vector_items("gridv", "grid_index", "(SELECT * FROM feat_dflt WHERE split = 'valid')", GRID_SCORES, True)}),
gridm AS (SELECT *, row_number() OVER (ORDER BY ndcg_at_12 DESC, grid_index) AS place FROM ({evaluation("(SELECT * FROM griditems WHERE split = 'valid')", "grid_index")}) JOIN gridv USING (grid_index) WHERE split = 'valid'),
best AS (SELECT w FROM gridm WHERE place = 1),
bestv AS (SELECT 'full_model' AS variant_id, w FROM best UNION ALL {_strict}),
bestitems AS ({_vector_items("bestv", "variant_id", "feat_dflt", GRID_SCORES, True)}),
bestm AS ({evaluation("bestitems", "variant_id")}),
bucketv AS (SELECT CAST(grid_index AS VARCHAR) AS variant_id, w, w[3] AS trend_weight FROM gridm QUALIFY row_number() OVER (PARTITION BY w[3] ORDER BY ndcg_at_12 DESC, grid_index) = 1),
bucketitems AS ({_vector_items("bucketv", "variant_id", "feat_dflt", GRID_SCORES, True)}),
methodm AS ({evaluation("everyitem", "method")}),
namedm AS (SELECT variant_id, '{MAIN}' AS method, split, {_metrics} FROM bestm {" ".join(f"UNION ALL SELECT '{v}', method, split, {_metrics} FROM methodm WHERE method = '{m}'" for v, m in BASELINE_VARIANTS)}),
envec AS (SELECT CAST(k AS INTEGER) AS grid_index, CAST(v AS DOUBLE[]) AS w FROM (VALUES {", ".join(f"({k}, [{', '.join(map(str, w))}])" for k, w in enumerate(ENHANCED_GRID))}) g(k, v)),
enitems AS ({_vector_items("envec", "grid_index", "(SELECT * FROM feat WHERE split = 'valid')", reco.SCORES, False)})
"""


def _source_sql() -> str:
    """Items of the enhanced method's variants on the valid windows."""
    pu = f"PARTITION BY {U}"
    parts, counts = [], []
    for variant, sources, scores, strict in SOURCE_VARIANTS:
        rows = "(SELECT * FROM feat WHERE split = 'valid')"
        if sources or strict:
            left = f"list_filter(string_split(candidate_sources, '|'), lambda x: NOT list_contains([{', '.join(repr(x) for x in sources)}]::VARCHAR[], x))"
            rows = f"(SELECT * EXCLUDE (l, a, b), list_contains(l, 'reorder') AS has_reorder_source, {minmax('a', pu)} AS source_rank_score, {minmax('b', pu)} AS source_count_score FROM (SELECT * EXCLUDE (has_reorder_source, source_rank_score, source_count_score), 1.0 / best_source_rank AS a, CAST(len(l) AS DOUBLE) AS b FROM (SELECT *, {left} AS l FROM feat WHERE split = 'valid') WHERE len(l) > 0))"
        total = " + ".join(f"{c} * {w}" for c, w in dropped_weights(reco.METHODS["enhanced_pop_similarity_trend"], scores).items())
        rule = "NOT is_seen" if strict else "NOT is_seen OR has_reorder_source"
        parts.append(f"SELECT '{variant}' AS variant_id, {U}, article_id, rank FROM (SELECT *, row_number() OVER ({pu} ORDER BY round(score, 9) DESC, article_id) AS rank FROM (SELECT *, {total} AS score FROM {rows} WHERE {rule})) WHERE rank <= 12")
        counts.append(f"SELECT '{variant}' AS variant_id, count(*) AS candidate_rows FROM {rows}")
    return f"SELECT variant_id, candidate_rows, {_metrics} FROM ({evaluation('(' + ' UNION ALL '.join(parts) + ')', 'variant_id')}) JOIN ({' UNION ALL '.join(counts)}) USING (variant_id) WHERE split = 'valid'"


def _experiment(name: str, sql: str, build) -> None:
    query(name, EXPERIMENT + sql)(lambda spark, sf_dir: expr.half_up(build(shared(spark, sf_dir))))


_experiment("ex_weight_grid", f"SELECT grid_index, place, {_metrics} FROM gridm", lambda t: grid_metrics(t).select("grid_index", "place", *METRIC_NAMES))
_experiment(
    "ex_enhanced_grid",
    f"SELECT grid_index, row_number() OVER (ORDER BY map_at_12 DESC, ndcg_at_12 DESC, grid_index) AS place, {_metrics} FROM ({evaluation('enitems', 'grid_index')}) WHERE split = 'valid'",
    lambda t: top_k(expr.half_up(vector_metrics(t, t.features(), t.spark.createDataFrame([(k, list(w)) for k, w in enumerate(ENHANCED_GRID)], "grid_index int, w array<double>"), reco.SCORES, "grid_index", None, valid)), ["split"], [F.desc("map_at_12"), F.desc("ndcg_at_12"), "grid_index"], 9, "place").select("grid_index", "place", *METRIC_NAMES),
)
_experiment("ex_strict_ablation", f"SELECT variant_id, split, {_metrics} FROM bestm WHERE variant_id <> 'full_model'", lambda t: best_metrics(t).where("variant_id <> 'full_model'").select("variant_id", "split", *METRIC_NAMES))
_experiment("ex_named_ablation", "SELECT * FROM namedm", named_ablation)
_experiment("ex_trend_buckets", f"SELECT trend_weight, CAST(variant_id AS INTEGER) AS grid_index, split, {_metrics} FROM ({evaluation('bucketitems', 'variant_id')}) JOIN bucketv USING (variant_id)", trend_buckets)
_experiment("ex_method_summary", f"SELECT method, split, {_metrics} FROM methodm", method_summary)
_experiment("ex_source_ablation", _source_sql(), source_ablation)
_none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}_weight" for c in GRID_SCORES)
_own = ", ".join(f"round(w[{k + 1}], 6) AS {c}_weight" for k, c in enumerate(GRID_SCORES))
_places = lambda names: "CAST(list_position([" + ", ".join(f"'{x}'" for x in names) + "], "
FLATTENED_SQL = f"SELECT 'search_results' AS section, CAST(place AS INTEGER) AS place, '{MAIN}' AS method, split, {_own}, {_metrics} FROM gridm UNION ALL SELECT 'ablation', {_places(sorted(reco.METHODS))}method) AS INTEGER), method, split, {_none}, {_metrics} FROM methodm UNION ALL SELECT 'named_ablation', {_places(['full_model', *[v for v, _, _ in STRICT], *[v for v, _ in BASELINE_VARIANTS]])}variant_id) AS INTEGER), variant_id, split, {_own}, {_metrics} FROM namedm LEFT JOIN bestv USING (variant_id)"
_experiment("ex_flatten", FLATTENED_SQL, flattened)
_gone = ("reorder", "trend")
_left = f"list_filter(string_split(candidate_sources, '|'), lambda x: x NOT IN {_gone})"
_register(
    "ex_drop_sources",
    f"SELECT {U}, article_id, array_to_string(l, '|') AS candidate_sources, l[1] AS primary_source, list_contains(l, 'reorder') AS has_reorder_source, round({minmax('a', 'PARTITION BY ' + U)}, 6) AS source_rank_score, round({minmax('b', 'PARTITION BY ' + U)}, 6) AS source_count_score FROM (SELECT *, 1.0 / best_source_rank AS a, CAST(len(l) AS DOUBLE) AS b FROM (SELECT *, {_left} AS l FROM cand) WHERE len(l) > 0)",
    lambda t: reco.without_sources(t.candidates(), set(_gone)).select(*ITEM, "candidate_sources", "primary_source", "has_reorder_source", "source_rank_score", "source_count_score"),
)
_register("pr_articles", "SELECT article_id, prod_name, product_group_name, colour_group_name FROM art", lambda t: t.articles.select("article_id", "prod_name", "product_group_name", "colour_group_name").dropDuplicates(["article_id"]))
_register("pr_article_attrs", "SELECT article_id, attr_type, attr_value FROM edges", lambda t: t.edges.select("article_id", "attr_type", "attr_value").dropDuplicates())
_register("pr_related_articles", "SELECT article_id, prod_name FROM edges JOIN art USING (article_id) WHERE attr_id = 'colour_group_name::red' ORDER BY article_id LIMIT 20", lambda t: t.edges.where("attr_id = 'colour_group_name::red'").join(t.articles.select("article_id", "prod_name"), "article_id").orderBy("article_id").limit(20).select("article_id", "prod_name"))
_register("dq_score_bounds", "SELECT count(*) FILTER (" + " OR ".join(f"{c} NOT BETWEEN 0 AND 1" for c in reco.SCORES) + ") AS n_violations FROM feat", lambda t: t.features().agg(F.count_if(reduce(lambda a, b: a | b, [~F.col(c).between(0, 1) for c in reco.SCORES])).alias("n_violations")))
_register("dq_windows", "SELECT count(DISTINCT split) AS n_splits, count(*) FILTER (label_week <> cutoff_week + 1) AS n_violations FROM win", lambda t: t.windows.agg(F.countDistinct("split").alias("n_splits"), F.count_if(F.col("label_week") != F.col("cutoff_week") + 1).alias("n_violations")))
_register("dq_top12_ranks", f"SELECT count(*) FILTER (low <> 1 OR high <> n OR d <> n) AS n_violations FROM (SELECT {U}, min(rank) AS low, max(rank) AS high, count(*) AS n, count(DISTINCT article_id) AS d FROM items GROUP BY ALL)", lambda t: t.items().groupBy(*reco.USER).agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n"), F.countDistinct("article_id").alias("d")).agg(F.count_if((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("d") != F.col("n"))).alias("n_violations")))
