"""Queries of the trend half: sources, catalogue, graph, panel, labels, features, forecasts and their metrics."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.expr import average_rank, rounded, top_k
from weftline.functions.quantiles import exact_quantiles
from weftline.operators import boosting, forecast, graph, trend
from weftline.plans.catalog import query
from weftline.plans.sql import TREND, rounds
from weftline.sources import tables
from weftline.sources.written import Latest, written


class Trend:
    """The trend half over one folder; every part is a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = tables.raw_transactions(spark, sf_dir)
        self.articles = tables.raw_articles(spark, sf_dir)

    def hold(self, df: DataFrame) -> DataFrame:
        return df

    @cached_property
    def weekly(self) -> DataFrame:
        return self.hold(trend.with_week_id(self.raw, tables.first_date(self.spark, self.sf_dir)))

    @cached_property
    def sales(self) -> DataFrame:
        return trend.article_week_sales(self.weekly)

    @cached_property
    def edges(self) -> DataFrame:
        return self.hold(trend.article_edges(self.articles))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.hold(trend.attribute_nodes(self.articles))

    @cached_property
    def hierarchy(self) -> DataFrame:
        return self.hold(trend.hierarchy_edges(self.articles))

    @cached_property
    def degree(self) -> DataFrame:
        return trend.degrees(self.nodes, self.hierarchy)

    @cached_property
    def heat(self) -> DataFrame:
        return self.hold(trend.heat_panel(self.sales, self.edges, self.nodes, self.weekly.select("week_id").distinct()))

    @cached_property
    def target(self) -> DataFrame:
        return trend.next_week_target(self.heat)

    @cached_property
    def samples(self) -> DataFrame:
        return trend.trend_samples(self.heat, self.target, self.degree)

    @cached_property
    def split(self) -> DataFrame:
        return self.hold(trend.split_by_time(self.samples, last=trend.last_labelled_week(self.weekly)))

    def predictions(self) -> DataFrame:
        return forecast.baselines(self.split)

    def base(self) -> DataFrame:
        return trend.rank_percent(self.samples).select("week_id", "attr_id", "heat_t", "share_t", "growth_lag_1", "rank_pct")


def _register(name: str, sql: str | None, build, digits: int = 6) -> None:
    query(name, None if sql is None else TREND + sql)(lambda spark, sf_dir: rounded(build(Trend(spark, sf_dir)), digits))


TX = "CAST(t_dat AS VARCHAR) AS t_dat, week_id, customer_id, article_id, round(price, 6) AS price, sales_channel_id"
HEAT = "week_id, attr_id, attr_type, attr_value, heat_cnt, type_total_heat, " + rounds("heat_share", "log_heat") + ", rank_in_type"
PRED = "week_id, attr_id, attr_type, attr_value, model_name, split, " + rounds("share_t", "pred_share_t1", "target_growth", "pred_target_growth") + ", target_rank_in_type_t1"
DOUBLES = {"share_t", "log_heat_t", *(f"share_lag_{k}" for k in (1, 2, 3, 4)), "growth_lag_1", "growth_lag_2", "acc_lag_1", "heat_ma_4", "share_ma_4", "share_std_4", "share_max_4", "share_min_4", "target_growth", "target_log_heat_t1"}
SAMPLE = ", ".join(f"round({c}, 6) AS {c}" if c in DOUBLES else c for c in trend.SAMPLE_COLUMNS)
METRIC = rounds(*forecast.METRICS)

_register("tx_date_range", "SELECT CAST(min(t_dat) AS VARCHAR) AS min_date, CAST(max(t_dat) AS VARCHAR) AS max_date, count(*) AS n_rows FROM raw", lambda t: trend.date_range(t.raw).select(F.col("min_date").cast("string"), F.col("max_date").cast("string"), "n_rows"))
_register("tx_week_id", f"SELECT {TX} FROM tx", lambda t: t.weekly.withColumn("t_dat", F.col("t_dat").cast("string")))
_register("src_parquet_projected", "SELECT week_id, customer_id, article_id FROM tx", lambda t: t.weekly.select("week_id", "customer_id", "article_id"))
_register("cat_clean_articles", "SELECT * FROM art", lambda t: t.articles)
_register("cat_clean_articles_mvp", "SELECT article_id, product_code, prod_name, product_group_name, product_type_name, garment_group_name, colour_group_name, graphical_appearance_name FROM art", lambda t: t.articles.select("article_id", "product_code", "prod_name", *tables.CORE_TYPES))
_register("cat_product_map", "SELECT article_id, product_code FROM art WHERE trim(product_code) <> ''", lambda t: t.articles.where("trim(product_code) <> ''").select("article_id", "product_code"))
_register("graph_article_nodes", "SELECT article_id, 'article_' || article_id AS article_node_id, product_code, prod_name FROM art", lambda t: trend.article_nodes(t.articles))
_register("graph_attr_nodes", "SELECT * FROM nodes", lambda t: t.nodes)
_register("graph_article_attr_edges", "SELECT * FROM edges", lambda t: t.edges)
_register("graph_hierarchy_edges", "SELECT * FROM hier", lambda t: t.hierarchy)
_register("graph_degree", "SELECT * FROM degree", lambda t: t.degree)
_register("agg_article_week_sales", "SELECT week_id, article_id, sales_cnt, sales_user_cnt, round(sales_amount, 4) AS sales_amount FROM sales", lambda t: t.sales, 4)
_register("agg_attr_week_heat_obs", "SELECT * FROM observed", lambda t: trend.attribute_week_observed(t.sales, t.edges))
_register("panel_attr_week_heat", f"SELECT {HEAT} FROM heat", lambda t: t.heat)
_register("join_inner_sales_edges", "SELECT week_id, article_id, attr_id, sales_cnt FROM sales JOIN edges USING (article_id)", lambda t: t.sales.join(t.edges, "article_id").select("week_id", "article_id", "attr_id", "sales_cnt"))
_register("join_cross_week_attr", "SELECT week_id, attr_id FROM (SELECT DISTINCT week_id FROM sales) CROSS JOIN nodes", lambda t: t.sales.select("week_id").distinct().crossJoin(t.nodes.select("attr_id")))
_register("join_left_zero_fill", "SELECT week_id, attr_id, heat_cnt FROM filled", lambda t: t.heat.select("week_id", "attr_id", "heat_cnt"))
_register("join_shifted_self", "SELECT a.week_id, a.attr_id, a.heat_cnt AS heat_t, b.heat_cnt AS heat_t1 FROM heat a JOIN heat b ON a.attr_id = b.attr_id AND b.week_id = a.week_id + 1", lambda t: t.target.select("week_id", "attr_id", "heat_t", "heat_t1"))
_register(
    "join_outer_keyset_diff",
    "SELECT CAST(count(*) FILTER (b.attr_id IS NULL) AS BIGINT) AS only_heat, CAST(count(*) FILTER (a.attr_id IS NULL) AS BIGINT) AS only_target FROM heat a FULL JOIN target b ON a.week_id = b.week_id AND a.attr_id = b.attr_id",
    lambda t: t.heat.select("week_id", "attr_id", F.lit(1).alias("a")).join(t.target.select("week_id", "attr_id", F.lit(1).alias("b")), ["week_id", "attr_id"], "full").agg(F.count_if(F.col("b").isNull()).alias("only_heat"), F.count_if(F.col("a").isNull()).alias("only_target")),
)
_register("join_left_indicator_missing", "SELECT week_id, attr_id FROM heat ANTI JOIN target USING (week_id, attr_id)", lambda t: t.heat.join(t.target, ["week_id", "attr_id"], "left_anti").select("week_id", "attr_id"))
_register(
    "join_1to1_validated",
    "SELECT model_name, count(*) AS n_rows, CAST(sum(CAST(abs(p.share_t - s.share_t) > 1e-12 OR abs(p.target_growth - s.target_growth) > 1e-12 AS INTEGER)) AS BIGINT) AS n_differences FROM pred p JOIN samples s USING (week_id, attr_id) GROUP BY 1",
    lambda t: t.predictions().join(t.samples.select("week_id", "attr_id", F.col("share_t").alias("s"), F.col("target_growth").alias("g")), ["week_id", "attr_id"]).groupBy("model_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.abs(F.col("share_t") - F.col("s")) > 1e-12) | (F.abs(F.col("target_growth") - F.col("g")) > 1e-12)).alias("n_differences")),
)
_register("lbl_next_week_target", "SELECT week_id, attr_id, attr_type, attr_value, heat_t, heat_t1, " + rounds("share_t", "share_t1") + ", rank_in_type_t, " + rounds("target_log_heat_t1", "target_growth") + ", target_rank_in_type_t1 FROM target", lambda t: t.target)


def _features(name: str, columns: list[str]) -> None:
    chosen = ["week_id", "attr_id", *columns]
    lag = lambda c: c.startswith("heat_lag")  # noqa: E731  null at the start: returned as doubles
    _register(name, "SELECT " + ", ".join(f"round({c}, 6) AS {c}" if c in DOUBLES else f"CAST({c} AS DOUBLE) AS {c}" if lag(c) else c for c in chosen) + " FROM feats", lambda t: trend.heat_features(t.heat).select(*[F.col(c).cast("double").alias(c) if lag(c) else c for c in chosen]))


_features("feat_lags", [f"{c}_lag_{k}" for c in ("heat", "share") for k in (1, 2, 3, 4)])
_features("feat_growth_acc", ["growth_lag_1", "growth_lag_2", "acc_lag_1"])
_features("feat_rolling4", ["heat_ma_4", "share_ma_4", "share_std_4", "share_max_4", "share_min_4"])
_features("feat_history_cum", ["history_total_heat_t", "history_active_weeks_t", "is_trend_eligible_t"])
_features("feat_calendar", ["week_index", "week_mod_52"])
_register("feat_trend_samples", f"SELECT {SAMPLE} FROM samples", lambda t: t.samples)
_register("split_time", f"SELECT split, {SAMPLE} FROM split", lambda t: t.split)
_register("flt_split", f"SELECT split, {SAMPLE} FROM split WHERE split IN ('valid', 'test')", lambda t: t.split.where(F.col("split").isin("valid", "test")))
for _name in ("last_week", "previous_growth", "moving_average"):
    _register(f"fc_{_name}", f"SELECT {PRED} FROM pred WHERE model_name = '{_name}'", lambda t, f=getattr(forecast, _name): f(t.split))
_register("fc_normalize_share", "SELECT model_name, split, week_id, attr_id, round(pred_share_t1, 6) AS pred_share_t1 FROM pred", lambda t: t.predictions().select("model_name", "split", "week_id", "attr_id", "pred_share_t1"))
GROUP = "model_name, split, week_id, attr_type"
_register("te_mae_rmse", f"SELECT {GROUP}, {rounds('mae', 'rmse')} FROM groups", lambda t: forecast.group_metrics(t.predictions()).select("model_name", *forecast.KEYS, "mae", "rmse"))
_register("te_spearman", f"SELECT {GROUP}, {rounds('spearman')} FROM groups", lambda t: forecast.group_metrics(t.predictions()).select("model_name", *forecast.KEYS, "spearman"))
_pr = [f"{m}_at_{k}" for k in (5, 10, 20) for m in ("precision", "recall")]
_register("te_precision_recall_k", f"SELECT {GROUP}, {rounds(*_pr)} FROM groups", lambda t: forecast.group_metrics(t.predictions()).select("model_name", *forecast.KEYS, *_pr))
_nd = [f"ndcg_at_{k}" for k in (5, 10, 20)]
_register("te_ndcg_k", f"SELECT {GROUP}, {rounds(*_nd)} FROM groups", lambda t: forecast.group_metrics(t.predictions()).select("model_name", *forecast.KEYS, *_nd))
_means = ", ".join(f"round(avg({m}), 6) AS {m}" for m in forecast.METRICS)
_register("te_overall", f"SELECT model_name, split, count(*) AS n_groups, {_means} FROM groups WHERE split <> 'train' GROUP BY 1, 2", lambda t: forecast.overall_metrics(forecast.group_metrics(t.predictions())))
_register("te_by_attr_type", f"SELECT model_name, split, attr_type, count(*) AS n_groups, {_means} FROM groups WHERE split <> 'train' GROUP BY 1, 2, 3", lambda t: forecast.overall_metrics(forecast.group_metrics(t.predictions()), ("model_name", "split", "attr_type")))
_by_type = f"SELECT model_name, split, attr_type, {_means} FROM groups WHERE split <> 'train' GROUP BY 1, 2, 3"
_overall = f"SELECT model_name, split, 'all' AS attr_type, {_means} FROM groups WHERE split <> 'train' GROUP BY 1, 2"


def flattened(t: Trend) -> DataFrame:
    """Metrics as rows: overall (attr_type all) and by attribute type."""
    groups = forecast.group_metrics(t.predictions())
    overall = forecast.overall_metrics(groups).withColumn("attr_type", F.lit("all"))
    by_type = forecast.overall_metrics(groups, ("model_name", "split", "attr_type"))
    rows = overall.unionByName(by_type).drop("n_groups")
    return forecast.metrics_long(rows, ["model_name", "split", "attr_type"]).where("value IS NOT NULL")


_register(
    "te_flatten",
    f"SELECT model_name, split, attr_type, metric, value FROM (UNPIVOT ({_overall} UNION ALL {_by_type}) ON {', '.join(forecast.METRICS)} INTO NAME metric VALUE value)",
    flattened,
)
_register("fc_run_select", "SELECT model_name, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(spearman), 6) AS spearman, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse FROM groups WHERE split = 'valid' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", lambda t: rounded(forecast.overall_metrics(forecast.group_metrics(t.predictions()))).where("split = 'valid'").select("model_name", "ndcg_at_10", "spearman", "mae", "rmse").orderBy(F.desc("ndcg_at_10"), "model_name").limit(1))
_register("rank_average", "SELECT week_id, attr_id, round(rank() OVER (PARTITION BY week_id, attr_type ORDER BY heat_cnt) + (count(*) OVER (PARTITION BY week_id, attr_type, heat_cnt) - 1) / 2.0, 6) AS avg_rank FROM heat", lambda t: t.heat.select("week_id", "attr_id", average_rank(F.col("heat_cnt"), ["week_id", "attr_type"]).alias("avg_rank")))
_register("rank_row_number", "SELECT week_id, attr_id, rank_in_type FROM heat", lambda t: t.heat.select("week_id", "attr_id", "rank_in_type"))
_register("topk_per_group", "SELECT week_id, attr_type, attr_id, rank_in_type FROM heat WHERE rank_in_type <= 3", lambda t: t.heat.where("rank_in_type <= 3").select("week_id", "attr_type", "attr_id", "rank_in_type"))
_register("topk_global", "SELECT article_id, CAST(sum(sales_cnt) AS BIGINT) AS n FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", lambda t: t.sales.groupBy("article_id").agg(F.sum("sales_cnt").alias("n")).orderBy(F.desc("n"), "article_id").limit(12))
_register("setop_union_all", "SELECT parent_attr_id AS attr_id FROM hier UNION ALL SELECT child_attr_id FROM hier", lambda t: t.hierarchy.select(F.col("parent_attr_id").alias("attr_id")).unionByName(t.hierarchy.select(F.col("child_attr_id").alias("attr_id"))))
_register("setop_distinct", "SELECT product_code, min(article_id) AS article_id FROM art GROUP BY 1", lambda t: top_k(t.articles, ["product_code"], ["article_id"], 1).select("product_code", "article_id"))
_register("setop_difference", "SELECT article_id FROM art EXCEPT SELECT article_id FROM tx", lambda t: t.articles.select("article_id").join(t.weekly.select("article_id"), "article_id", "left_anti").distinct())
_register("setop_intersect_count", "SELECT week_id, attr_type, CAST(sum(CAST(rank_in_type_t <= 5 AND target_rank_in_type_t1 <= 5 AS INTEGER)) AS BIGINT) AS n_common FROM target GROUP BY 1, 2", lambda t: t.target.groupBy("week_id", "attr_type").agg(F.count_if((F.col("rank_in_type_t") <= 5) & (F.col("target_rank_in_type_t1") <= 5)).alias("n_common")))
_register("agg_target_distribution", "SELECT split, count(*) AS n, round(min(target_growth), 6) AS low, round(max(target_growth), 6) AS high, round(avg(target_growth), 6) AS mean, round(stddev_pop(target_growth), 6) AS std, " + ", ".join(f"round(quantile_cont(target_growth, {q}), 6) AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + ", count(*) FILTER (abs(target_growth) > 2) AS n_large FROM split GROUP BY 1", lambda t: _distribution(written(t.split.select("split", "target_growth"), "targets"), "target_growth"))
_register("agg_residual_distribution", "SELECT split, count(*) AS n, round(min(e), 6) AS low, round(max(e), 6) AS high, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, " + ", ".join(f"round(quantile_cont(e, {q}), 6) AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + ", count(*) FILTER (abs(e) > 2) AS n_large, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM (SELECT split, target_growth - pred_target_growth AS e FROM pred WHERE model_name = 'moving_average') GROUP BY 1", lambda t: _residuals(t))
_register("agg_zero_share_rows", "SELECT split, count(*) AS n_rows, count(*) FILTER (share_t = 0) AS n_zero FROM split GROUP BY 1", lambda t: t.split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("share_t") == 0).alias("n_zero")))


QUANTILES = {f"p{int(q * 100):02d}": q for q in (0.01, 0.05, 0.5, 0.95, 0.99)}


def _distribution(df: DataFrame, c: str, *more) -> DataFrame:
    figures = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count_if(F.abs(c) > 2).alias("n_large"), *more)
    return figures.join(exact_quantiles(df, ["split"], c, QUANTILES), "split")


def _residuals(t: Trend) -> DataFrame:
    rows = forecast.moving_average(t.split).withColumn("e", F.col("target_growth") - F.col("pred_target_growth"))
    return _distribution(written(rows.select("split", "e"), "residuals"), "e", F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))


_register("agg_graph_summary", "SELECT 'nodes' AS part, level AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'hierarchy', relation_type, count(*) FROM hier GROUP BY 2 UNION ALL SELECT 'edges', attr_type, count(*) FROM edges GROUP BY 2", lambda t: t.nodes.groupBy(F.lit("nodes").alias("part"), F.col("level").alias("kind")).agg(F.count(F.lit(1)).alias("n")).union(t.hierarchy.groupBy(F.lit("hierarchy"), "relation_type").count()).union(t.edges.groupBy(F.lit("edges"), "attr_type").count()))
_register("agg_artifact_shape", "SELECT 'transactions' AS artifact, count(*) AS n_rows, 6 AS n_columns FROM tx UNION ALL SELECT 'articles', count(*), 13 FROM art UNION ALL SELECT 'heat', count(*), 9 FROM heat UNION ALL SELECT 'samples', count(*), 37 FROM samples", lambda t: _shapes({"transactions": t.weekly, "articles": t.articles, "heat": t.heat, "samples": t.samples}))


def _shapes(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


_register("kg_rank_pct", f"SELECT week_id, attr_id, {rounds('rank_pct')} FROM kbase", lambda t: t.base().select("week_id", "attr_id", "rank_pct"))
for _side, _target, _other in (("parent", "child_attr_id", "parent_attr_id"), ("child", "parent_attr_id", "child_attr_id")):
    _register(
        "kg_neighbor_wavg" if _side == "parent" else "kg_neighbor_wavg_children",
        f"SELECT week_id, {_target} AS attr_id, " + ", ".join(f"round(sum({c} * edge_weight) / sum(edge_weight), 6) AS {_side}_{n}" for c, n in (("heat_t", "heat"), ("share_t", "share"), ("growth_lag_1", "growth"), ("rank_pct", "rank_pct"))) + f" FROM kbase JOIN hier ON attr_id = {_other} GROUP BY 1, 2",
        lambda t, s=_side: trend.neighbour_means(t.base(), t.hierarchy, s),
    )
_register("kg_sibling_links", "SELECT * FROM sib", lambda t: trend.sibling_links(t.hierarchy))
_SIBLINGS = rounds("sibling_share", "sibling_growth", "sibling_rank_pct", "sibling_max_share", "sibling_share_gap", "sibling_growth_gap")
_register(
    "kg_sibling_features",
    f"SELECT week_id, attr_id, sibling_count, {_SIBLINGS} FROM sibs",
    lambda t: graph.sibling_features(t.base(), t.hierarchy),
)
_register(
    "kg_structure",
    "SELECT attr_id, parent_weight, child_weight, round(ln(1 + parent_weight), 6) AS log_parent_weight, round(ln(1 + child_weight), 6) AS log_child_weight, CAST(parent_weight > 0 AS INTEGER) AS has_parent, "
    "CAST(child_weight > 0 AS INTEGER) AS has_child, CAST(parent_weight = 0 AS INTEGER) AS is_root, CAST(child_weight = 0 AS INTEGER) AS is_leaf FROM structure",
    lambda t: trend.hierarchy_structure(t.nodes, t.hierarchy),
)
_GAPS = [f"kg_self_{side}_{gap}" for side in ("parent", "child") for gap in ("share_gap_t", "growth_gap_lag_1")]
_WHOLE = {"kg_sibling_count", "kg_has_sibling", "kg_has_parent", "kg_has_child", "kg_is_root_attr", "kg_is_leaf_attr"}
CONTEXT = ", ".join(c if c in _WHOLE else f"round({c}, 6) AS {c}" for c in graph.FEATURES)
_register(
    "kg_gap",
    f"SELECT week_id, attr_id, {rounds(*_GAPS)} FROM context",
    lambda t: graph.graph_context(t.samples, t.nodes, t.hierarchy).select("week_id", "attr_id", *_GAPS),
)
_register(
    "kg_context_features",
    f"SELECT week_id, attr_id, {CONTEXT} FROM context",
    lambda t: graph.graph_context(t.samples, t.nodes, t.hierarchy),
)
_register(
    "kg_enhanced_samples",
    f"SELECT split, {SAMPLE}, {CONTEXT} FROM split LEFT JOIN context USING (week_id, attr_id)",
    lambda t: t.split.join(graph.graph_context(t.samples, t.nodes, t.hierarchy), ["week_id", "attr_id"], "left").select("split", *trend.SAMPLE_COLUMNS, *graph.FEATURES),
)
#: The attribute whose neighbourhood is shown.
ATTRIBUTE = "index_name::I1"
_near = f"FROM hier WHERE parent_attr_id = '{ATTRIBUTE}' OR child_attr_id = '{ATTRIBUTE}'"
_register(
    "app_attr_neighborhood",
    f"SELECT 'edge' AS kind, parent_attr_id, child_attr_id, relation_type, NULL AS attr_id, NULL AS attr_type {_near} UNION ALL SELECT 'node', NULL, NULL, NULL, attr_id, attr_type FROM (SELECT parent_attr_id AS attr_id, parent_attr_type AS attr_type {_near} UNION SELECT child_attr_id, child_attr_type {_near})",
    lambda t: trend.neighbourhood(t.hierarchy, ATTRIBUTE),
)
_register("pres_hierarchy_labeled", "SELECT h.*, p.attr_value AS parent_value, c.attr_value AS child_value FROM hier h JOIN nodes p ON p.attr_id = parent_attr_id JOIN nodes c ON c.attr_id = child_attr_id", lambda t: t.hierarchy.join(t.nodes.select(F.col("attr_id").alias("parent_attr_id"), F.col("attr_value").alias("parent_value")), "parent_attr_id").join(t.nodes.select(F.col("attr_id").alias("child_attr_id"), F.col("attr_value").alias("child_value")), "child_attr_id"))


class Held(Trend):
    """Purchases, attributes, panel and samples are written when first used: all after the panel is as small as weeks times attributes, and lazy frames would derive it from the
    lines again at every use. Of purchases only what the recommendation half and the panel read is written: customer, article and date; weeks are counted when it is read, as the first
    date is known only then. An article's edges are ten times its row, so they are derived from it at each use."""

    def hold(self, df: DataFrame) -> DataFrame:
        return written(df, "trend")

    @cached_property
    def weekly(self) -> DataFrame:
        """Purchases with week_id, without price and channel."""
        rows = self.hold(self.raw.select("t_dat", "customer_id", "article_id"))
        first = F.lit(rows.agg(F.min("t_dat")).first()[0]).cast("date")
        return rows.select(F.floor(F.datediff("t_dat", first) / 7).cast("long").alias("week_id"), "customer_id", "article_id")

    @property
    def transactions(self) -> DataFrame:
        """Purchases with all columns, from the tables."""
        return trend.with_week_id(self.raw, tables.first_date(self.spark, self.sf_dir))

    @cached_property
    def sales(self) -> DataFrame:
        return trend.article_week_sales(self.transactions)

    @cached_property
    def edges(self) -> DataFrame:
        return trend.article_edges(self.articles)

    @cached_property
    def names(self) -> DataFrame:
        return self.hold(trend.attribute_names(self.nodes))

    @cached_property
    def numbers(self) -> DataFrame:
        return self.hold(trend.article_numbers(self.articles, self.names))

    @cached_property
    def heat(self) -> DataFrame:
        return self.hold(trend.heat_panel(None, None, self.nodes, self.weekly.select("week_id").distinct(), trend.attribute_week_counted(self.weekly, self.numbers, self.names)))


class Fitted:
    """Models over one folder, fitted when first asked for; the written nodes and predictions serve all queries that show them."""

    def __init__(self, t: Trend):
        self.t = t
        self.features = forecast.numeric_features(t.split)

    @cached_property
    def split(self) -> DataFrame:
        return self.t.split

    @cached_property
    def nodes(self) -> DataFrame:
        return forecast.fit_boosted_trees(self.split, {forecast.BOOSTED: self.features})

    @cached_property
    def predictions(self) -> DataFrame:
        return written(forecast.boosted_predictions(self.split, self.nodes, forecast.BOOSTED, self.features), "predictions")

    def importance(self) -> DataFrame:
        return boosting.importance(self.nodes, forecast.BOOSTED, ["attr_type", *self.features])

    @cached_property
    def enhanced(self) -> DataFrame:
        context = graph.graph_context(self.t.samples, self.t.nodes, self.t.hierarchy)
        return written(self.t.split.join(context, ["week_id", "attr_id"], "left"), "enhanced")

    @cached_property
    def masks(self) -> dict[str, list[str]]:
        return graph.ablation_masks(self.features, forecast.GRAPH_FEATURES)

    @cached_property
    def ablation_nodes(self) -> DataFrame:
        """The five variants are grown side by side over the same bins."""
        return forecast.fit_boosted_trees(self.enhanced, self.masks)

    @cached_property
    def ablation_predictions(self) -> DataFrame:
        every = [forecast.boosted_predictions(self.enhanced, self.ablation_nodes, m, features) for m, features in self.masks.items()]
        return written(reduce(DataFrame.unionByName, every), "ablation")

    def ablation_summary(self) -> DataFrame:
        """Metrics of each variant and split with its number of features (the type included) and its best round."""
        counts = self.t.spark.createDataFrame([(m, 1 + len(f)) for m, f in self.masks.items()], "model_name string, feature_count int")
        rounds_ = self.ablation_nodes.groupBy(F.col("model").alias("model_name")).agg(F.max("best_round").alias("best_round"))
        metrics = forecast.overall_metrics(forecast.group_metrics(self.ablation_predictions))
        return metrics.join(F.broadcast(counts.join(rounds_, "model_name")), "model_name").select("model_name", "split", "feature_count", "best_round", "mae", "rmse", "ndcg_at_10", "spearman", "precision_at_10", "recall_at_10")


_fitted = Latest(lambda spark, sf_dir: Fitted(Held(spark, sf_dir)))


def _model(name: str, build) -> None:
    query(name)(lambda spark, sf_dir: rounded(build(_fitted(spark, sf_dir))))


_model("fc_gbt", lambda f: f.predictions)
_model("fc_predict_frame", lambda f: f.predictions.select(*forecast.PREDICTION_COLUMNS))
_model("fc_feature_importance", lambda f: f.importance())
_model("pr_feature_top_n", lambda f: f.importance().orderBy(F.desc("normalized_gain_importance"), "feature").limit(15))
_model("fc_ablation_masks", lambda f: f.ablation_predictions)
_model("fc_ablation_summary", lambda f: f.ablation_summary())
