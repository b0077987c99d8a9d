"""Queries of the quality checks, and of the windowed views over predictions and heat."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import audit, cases, checks, graph
from weftline.plans.catalog import query
from weftline.plans.trend import _register
from weftline.sources import tables
from weftline.sources.written import shared_folder

_register("dq_not_null", "SELECT * FROM (UNPIVOT (SELECT count(*) FILTER (t_dat IS NULL) AS t_dat, count(*) FILTER (customer_id IS NULL) AS customer_id, count(*) FILTER (price IS NULL) AS price FROM tx) ON t_dat, customer_id, price INTO NAME column_name VALUE n_violations)", lambda t: checks.not_null(t.weekly, ["t_dat", "customer_id", "price"]))
_register("dq_not_blank", "SELECT * FROM (UNPIVOT (SELECT count(*) FILTER (coalesce(trim(article_id), '') = '') AS article_id, count(*) FILTER (coalesce(trim(prod_name), '') = '') AS prod_name FROM art) ON article_id, prod_name INTO NAME column_name VALUE n_violations)", lambda t: checks.not_blank(t.articles, ["article_id", "prod_name"]))
_register("dq_unique_key", "SELECT count(*) AS n_violations FROM (SELECT week_id, attr_id FROM heat GROUP BY 1, 2 HAVING count(*) > 1)", lambda t: checks.unique_key(t.heat, ["week_id", "attr_id"]))
_register("dq_non_negative", "SELECT count(*) FILTER (heat_cnt < 0) AS n_violations FROM heat", lambda t: checks.failing(t.heat, F.col("heat_cnt") < 0))
_register("dq_positive", "SELECT count(*) FILTER (sales_cnt <= 0) AS n_violations FROM sales", lambda t: checks.failing(t.sales, F.col("sales_cnt") <= 0))
_register("dq_finite", "SELECT count(*) FILTER (NOT isfinite(share_t) OR NOT isfinite(target_growth)) AS n_violations FROM target", lambda t: checks.failing(t.target, checks.not_finite(["share_t", "target_growth"])))
_register("dq_functional_dep", "SELECT count(*) AS n_violations FROM (SELECT attr_id FROM edges GROUP BY 1 HAVING count(DISTINCT (attr_type, attr_value)) > 1)", lambda t: checks.functional_dependency(t.edges, "attr_id", ["attr_type", "attr_value"]))
_register("dq_metadata_match", "SELECT count(*) AS n_violations FROM edges e JOIN nodes n USING (attr_id) WHERE e.attr_type <> n.attr_type OR e.attr_value <> n.attr_value", lambda t: t.edges.alias("e").join(t.nodes.alias("n"), "attr_id").where("e.attr_type <> n.attr_type OR e.attr_value <> n.attr_value").agg(F.count(F.lit(1)).alias("n_violations")))
_register("dq_heat_formulas", "SELECT count(*) FILTER (abs(heat_share * type_total_heat - heat_cnt) > 1e-6) AS n_violations FROM heat", lambda t: checks.heat_formulas(t.heat))
_register("dq_share_distribution", "SELECT count(*) AS n_violations FROM (SELECT 1 FROM pred GROUP BY model_name, split, week_id, attr_type HAVING min(pred_share_t1) < 0 OR (abs(sum(pred_share_t1) - 1) > 1e-6 AND max(pred_share_t1) > 0))", lambda t: checks.share_sums(t.predictions()))


# The checks below run over the tables as built and over damaged copies: what the twins count is the damage.
_STATES = ("as_built", "damaged")


def both_states(rules: list[str], violations: Callable, built: tuple, damaged: tuple) -> DataFrame:
    """state, rule, n_violations of a check over two sets of tables."""
    found = [audit.report(violations(*frames), rules).select(F.lit(state).alias("state"), "rule", "n_violations") for state, frames in zip(_STATES, (built, damaged), strict=True)]
    return found[0].unionByName(found[1])


def both_states_sql(rules: list[str], built: dict[str, str], damaged: dict[str, str]) -> str:
    """built and damaged: selects of one number for rules that aren't 0 by construction."""
    number = lambda counts, rule: f"CAST(({counts[rule]}) AS BIGINT)" if rule in counts else "CAST(0 AS BIGINT)"
    return " UNION ALL ".join(f"SELECT '{state}' AS state, '{rule}' AS rule, {number(counts, rule)} AS n_violations" for state, counts in zip(_STATES, (built, damaged), strict=True) for rule in rules)


_at = lambda table, k: f"SELECT count(*) FROM {table} WHERE week_id % 50 = {k}"


def week(k: int) -> Column:
    """The weeks that a damage hits."""
    return F.col("week_id") % 50 == k


def damaged_targets(target: DataFrame) -> DataFrame:
    """Growth is off in some weeks, some weeks lack, some come twice."""
    off = target.withColumn("target_growth", F.col("target_growth") + F.when(week(7), 1.0).otherwise(0.0)).where(~week(8))
    return off.unionByName(off.where(week(9)))


_register(
    "dq_target_formulas",
    both_states_sql(
        audit.TARGET_RULES,
        {
            "growth": "SELECT count(*) FROM target WHERE abs(ln((share_t1 + 1e-6) / (share_t + 1e-6)) - target_growth) > 1e-9",
            "log_heat": "SELECT count(*) FROM target WHERE abs(ln(1 + heat_t1) - target_log_heat_t1) > 1e-9",
            "not_finite": "SELECT count(*) FROM target WHERE NOT (isfinite(share_t) AND isfinite(share_t1) AND isfinite(target_growth))",
        },
        {"growth": _at("target", 7), "changed": _at("target", 7), "missing": _at("target", 8), "repeated": _at("target", 9)},
    ),
    lambda t: both_states(audit.TARGET_RULES, audit.target_violations, (t.target, t.target), (damaged_targets(t.target), t.target)),
)


def damaged_split(split: DataFrame) -> DataFrame:
    """Some weeks have other values, some lack, some are in no split."""
    return split.where(~week(8)).withColumns({"attr_value": F.when(week(7), F.lit("?")).otherwise(F.col("attr_value")), "split": F.when(week(9), F.lit("other")).otherwise(F.col("split"))})


_register(
    "dq_split_cover",
    both_states_sql(
        audit.SPLIT_RULES,
        {"missing": "SELECT count(*) FROM samples ANTI JOIN split USING (week_id, attr_id)", "extra": "SELECT count(*) FROM split ANTI JOIN samples USING (week_id, attr_id)"},
        {"changed": _at("split", 7), "missing": _at("split", 8), "unknown_split": _at("split", 9)},
    ),
    lambda t: both_states(audit.SPLIT_RULES, audit.split_violations, (t.split, t.samples), (damaged_split(t.split), t.samples)),
)


def damaged_predictions(predictions: DataFrame) -> DataFrame:
    """Some weeks carry another share than the sample, some lack, some have no finite share."""
    return predictions.where(~week(8)).withColumns({"share_t": F.col("share_t") + F.when(week(7), 1.0).otherwise(0.0), "pred_share_t1": F.when(week(9), F.lit(float("nan"))).otherwise(F.col("pred_share_t1"))})


_register(
    "dq_prediction_align",
    both_states_sql(
        audit.PREDICTION_RULES,
        {"no_sample": "SELECT count(*) FROM pred ANTI JOIN split USING (split, week_id, attr_id)", "not_finite": "SELECT count(*) FROM pred WHERE NOT (isfinite(pred_share_t1) AND isfinite(pred_target_growth))"},
        {"changed": _at("pred", 7), "no_prediction": _at("pred", 8), "not_finite": _at("pred", 9)},
    ),
    lambda t: both_states(audit.PREDICTION_RULES, audit.prediction_violations, (t.predictions(), t.split), (damaged_predictions(t.predictions()), t.split)),
)


def damaged_panel(heat: DataFrame) -> DataFrame:
    """One attribute type lacks in all weeks, and some weeks hold an unknown attribute."""
    rest = heat.where("attr_type <> 'index_name'")
    return rest.unionByName(rest.where(week(7) & (F.col("rank_in_type") == 1)).withColumn("attr_id", F.concat(F.lit("unknown::"), F.col("attr_id"))))


_register(
    "dq_panel_complete",
    both_states_sql(
        audit.PANEL_RULES,
        {"missing": "SELECT (SELECT count(DISTINCT week_id) FROM sales) * (SELECT count(*) FROM nodes) - (SELECT count(*) FROM heat)"},
        {"missing": "SELECT (SELECT count(DISTINCT week_id) FROM sales) * (SELECT count(*) FROM nodes WHERE attr_type = 'index_name')", "extra": "SELECT count(*) FROM heat WHERE week_id % 50 = 7 AND rank_in_type = 1 AND attr_type <> 'index_name'"},
    ),
    lambda t: both_states(audit.PANEL_RULES, audit.panel_violations, (t.heat, t.sales, t.nodes), (damaged_panel(t.heat), t.sales, t.nodes)),
)
_register(
    "dq_ref_integrity",
    both_states_sql(
        audit.REFERENCE_RULES,
        {"sale_without_edge": "SELECT count(DISTINCT article_id) FROM sales ANTI JOIN edges USING (article_id)", "edge_without_node": "SELECT count(DISTINCT attr_id) FROM edges ANTI JOIN nodes USING (attr_id)"},
        {
            "sale_without_edge": "SELECT count(DISTINCT article_id) FROM sales WHERE article_id LIKE '%7'",
            "edge_without_node": "SELECT count(DISTINCT attr_id) FROM edges WHERE attr_type = 'index_name' AND article_id NOT LIKE '%7'",
            "edge_without_article": "SELECT count(DISTINCT article_id) FROM edges WHERE article_id LIKE '%8'",
            "parent_without_node": "SELECT count(DISTINCT parent_attr_id) FROM hier WHERE parent_attr_type = 'index_name'",
            "child_without_node": "SELECT count(DISTINCT child_attr_id) FROM hier WHERE child_attr_type = 'index_name'",
        },
    ),
    lambda t: both_states(
        audit.REFERENCE_RULES,
        audit.reference_violations,
        (t.sales, t.edges, t.nodes, t.articles, t.hierarchy),
        (t.sales, t.edges.where("article_id NOT LIKE '%7'"), t.nodes.where("attr_type <> 'index_name'"), t.articles.where("article_id NOT LIKE '%8'"), t.hierarchy),
    ),
)


def absent_types(view: DataFrame) -> DataFrame:
    """Types of the trend views that no row has."""
    every = view.sparkSession.createDataFrame([(x,) for x in cases.TREND_TYPES], "attr_type string")
    return audit.unmatched(every, view, ["attr_type"], "absent_type")


_four = ", ".join(f"'{x}'" for x in cases.TREND_TYPES)
_register(
    "dq_core_types_present",
    both_states_sql(
        ["absent_type"],
        {"absent_type": f"SELECT 4 - count(DISTINCT attr_type) FROM pred WHERE split <> 'train' AND attr_type IN ({_four})"},
        {"absent_type": f"SELECT 4 - count(DISTINCT attr_type) FROM pred WHERE split <> 'train' AND attr_type IN ({_four}) AND attr_type NOT LIKE '%e_name'"},
    ),
    lambda t: both_states(["absent_type"], absent_types, (t.predictions().where("split <> 'train'"),), (t.predictions().where("split <> 'train' AND attr_type NOT LIKE '%e_name'"),)),
)


def checked_target(t) -> DataFrame:
    """The damaged targets, written with their violations counted in the same pass."""
    rules = {"growth": F.abs(F.col("target_growth") - F.log((F.col("share_t1") + 1e-6) / (F.col("share_t") + 1e-6))) > audit.TOLERANCE, "rank": F.col("rank_in_type_t") <= 0}
    path = f"{shared_folder(t.spark)}/checked-{uuid.uuid4().hex}"
    found = audit.write_checked(damaged_targets(t.target), path, rules, ["week_id", "attr_id"], strict=False)
    n = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    return t.spark.createDataFrame([(rule, k) for rule, k, _ in found], "rule string, n_violations long").crossJoin(n)


_register(
    "dq_checked_write",
    ", n AS (SELECT (SELECT count(*) FROM target WHERE week_id % 50 <> 8) + (SELECT count(*) FROM target WHERE week_id % 50 = 9) AS n_rows) "
    + " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS n_violations, CAST(n_rows AS BIGINT) AS n_rows FROM n" for rule, sql in (("growth", _at("target", 7)), ("rank", "SELECT 0"), ("repeated", f"SELECT 2 * ({_at('target', 9)})"))),
    checked_target,
)


def aligned(t) -> DataFrame:
    """Samples before and after they are given graph features, stored by ranges: the keys that differ, over the table as built and over a damaged one."""
    folder, key, values = f"{shared_folder(t.spark)}/aligned-{uuid.uuid4().hex}", ["week_id", "attr_id"], ["split", "target_growth", "target_log_heat_t1", "target_rank_in_type_t1"]
    rich = t.split.join(graph.graph_context(t.samples, t.nodes, t.hierarchy), key, "left").select(*key, *values)
    audit.store_ranges(t.split.select(*key, *values), key, f"{folder}/before")
    audit.store_ranges(rich, key, f"{folder}/as_built")
    kept = t.spark.read.parquet(f"{folder}/as_built").drop("_range")
    damaged = kept.where(~(week(8) & (F.col("attr_id") < "d"))).withColumn("target_growth", F.when(week(7) & (F.col("attr_id") < "d"), 0.0).otherwise(F.col("target_growth")))
    audit.store_ranges(damaged, key, f"{folder}/damaged")
    found = [audit.different_keys(t.spark, f"{folder}/before", f"{folder}/{state}", key, values).select(F.lit(state).alias("state"), "rule", F.get_json_object("key", "$.week_id").cast("long").alias("week_id"), F.get_json_object("key", "$.attr_id").alias("attr_id")) for state in _STATES]
    return found[0].unionByName(found[1])


_register(
    "dq_alignment",
    "SELECT 'damaged' AS state, 'missing' AS rule, week_id, attr_id FROM split WHERE week_id % 50 = 8 AND attr_id < 'd' UNION ALL SELECT 'damaged', 'changed', week_id, attr_id FROM split WHERE week_id % 50 = 7 AND attr_id < 'd' AND abs(target_growth) > 1e-9",
    aligned,
)


@query("prof_row_counts", "SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer")
def prof_row_counts(spark, sf_dir):
    out = None
    for name in ("orders", "lineitem", "part", "customer"):
        one = tables.read(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out
