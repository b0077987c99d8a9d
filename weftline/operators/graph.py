"""Graph features of samples: means over parents, children and siblings in the same week, and structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.expr import top_k
from weftline.operators.trend import hierarchy_structure, neighbour_means, rank_percent

KEYS = ["week_id", "attr_id"]
# The graph features, in three groups and in order.
HIERARCHY_CONTEXT = (
    "kg_parent_heat_t_wavg",
    "kg_parent_share_t_wavg",
    "kg_parent_growth_lag_1_wavg",
    "kg_parent_rank_pct_t_wavg",
    "kg_child_heat_t_wavg",
    "kg_child_share_t_wavg",
    "kg_child_growth_lag_1_wavg",
    "kg_child_rank_pct_t_wavg",
    "kg_self_parent_share_gap_t",
    "kg_self_parent_growth_gap_lag_1",
    "kg_self_child_share_gap_t",
    "kg_self_child_growth_gap_lag_1",
)
SIBLING_COMPETITION = (
    "kg_sibling_count",
    "kg_sibling_share_t_wavg",
    "kg_sibling_share_t_max",
    "kg_sibling_growth_lag_1_wavg",
    "kg_sibling_rank_pct_t_wavg",
    "kg_self_vs_sibling_share_gap_t",
    "kg_self_vs_sibling_growth_gap_lag_1",
    "kg_has_sibling",
)
LIGHT_STRUCTURE = (
    "kg_parent_edge_weight_sum",
    "kg_child_edge_weight_sum",
    "kg_parent_edge_weight_log",
    "kg_child_edge_weight_log",
    "kg_has_parent",
    "kg_has_child",
    "kg_is_root_attr",
    "kg_is_leaf_attr",
)
FEATURES = (*HIERARCHY_CONTEXT, *SIBLING_COMPETITION, *LIGHT_STRUCTURE)


def _sibling_counts(base: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Distinct siblings that have a row in the same week. Children with the same parents are one group, and groups that share a parent
    are linked once; so a crowd under one parent is one group, and only the groups' sizes by week are added."""
    parents = hierarchy.groupBy(F.col("child_attr_id").alias("attr_id")).agg(F.sort_array(F.collect_set("parent_attr_id")).alias("parents"))
    groups = parents.groupBy("parents").agg(F.min("attr_id").alias("group"))
    member = parents.join(groups, "parents").select("attr_id", "group")
    under = groups.select("group", F.explode("parents").alias("parent"))
    linked = under.join(under.withColumnRenamed("group", "other"), "parent").select("group", "other").distinct()
    there = base.select("week_id", "attr_id").join(member, "attr_id")
    sizes = there.groupBy("week_id", F.col("group").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    near = linked.join(sizes, "other").groupBy("week_id", "group").agg(F.sum("n").alias("n"))
    return there.join(near, ["week_id", "group"]).select("week_id", "attr_id", (F.col("n") - 1).alias("sibling_count"))


def sibling_features(base: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Figures of an attribute's siblings, the other children of its parents: means of share, growth and rank, weighted by the products of edge weights summed over shared
    parents, the greatest share, the number of siblings and the gaps between own and mean figures.

    No pair of siblings is built. Each parent sums its children's weights and weighted figures once a week, and a child takes its own part off;
    the greatest share comes from the two greatest of each parent. Rows without siblings in the week are left out.
    """
    edges = hierarchy.select(F.col("parent_attr_id").alias("parent"), F.col("child_attr_id").alias("attr_id"), F.col("edge_weight").cast("double").alias("w"))
    children = edges.join(base.select(*KEYS, "share_t", "growth_lag_1", "rank_pct"), "attr_id")
    figures = {"s": "share_t", "g": "growth_lag_1", "r": "rank_pct"}
    sums = children.groupBy("week_id", "parent").agg(F.sum("w").alias("w_all"), *[F.sum(F.col("w") * F.col(c)).alias(f"{k}_all") for k, c in figures.items()])
    two = top_k(children.select("week_id", "parent", "attr_id", "share_t"), ["week_id", "parent"], [F.desc("share_t"), "attr_id"], 2)
    first = F.max(F.when(F.col("rn") == 1, F.struct("attr_id", "share_t")))
    tops = two.groupBy("week_id", "parent").agg(first.alias("top"), F.max(F.when(F.col("rn") == 2, F.col("share_t"))).alias("next"))
    joined = children.join(sums.join(tops, ["week_id", "parent"]), ["week_id", "parent"])
    rest = lambda whole, own: F.sum(F.col("w") * (F.col(whole) - own))
    other = F.when(F.col("top.attr_id") == F.col("attr_id"), F.col("next")).otherwise(F.col("top.share_t"))
    figured = joined.groupBy(*KEYS).agg(
        rest("w_all", F.col("w")).alias("weight"),
        *[rest(f"{k}_all", F.col("w") * F.col(c)).alias(k) for k, c in figures.items()],
        F.max(other).alias("sibling_max_share"),
        F.first("share_t").alias("own_s"),
        F.first("growth_lag_1").alias("own_g"),
    )
    mean = lambda k: F.col(k) / F.col("weight")
    counted = figured.join(_sibling_counts(base, hierarchy).where("sibling_count > 0"), KEYS)
    return counted.select(
        *KEYS,
        "sibling_count",
        mean("s").alias("sibling_share"),
        mean("g").alias("sibling_growth"),
        mean("r").alias("sibling_rank_pct"),
        "sibling_max_share",
        (F.col("own_s") - mean("s")).alias("sibling_share_gap"),
        (F.col("own_g") - mean("g")).alias("sibling_growth_gap"),
    )


def graph_context(samples: DataFrame, nodes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """week_id, attr_id and the 28 graph features of every sample; what has no such neighbour is 0."""
    base = rank_percent(samples).select(*KEYS, "heat_t", "share_t", "growth_lag_1", "rank_pct")
    parts = [neighbour_means(base, hierarchy, "parent"), neighbour_means(base, hierarchy, "child"), sibling_features(base, hierarchy)]
    wide = reduce(lambda a, b: a.join(b, KEYS, "left"), parts, base).join(hierarchy_structure(nodes, hierarchy), "attr_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gap = lambda own, other: zero(F.col(own) - F.col(other))
    values: dict[str, Column] = {}
    for side in ("parent", "child"):
        values |= {f"kg_{side}_{long}_wavg": zero(F.col(f"{side}_{short}")) for short, long in (("heat", "heat_t"), ("share", "share_t"), ("growth", "growth_lag_1"), ("rank_pct", "rank_pct_t"))}
        values |= {f"kg_self_{side}_share_gap_t": gap("share_t", f"{side}_share"), f"kg_self_{side}_growth_gap_lag_1": gap("growth_lag_1", f"{side}_growth")}
        values |= {f"kg_{side}_edge_weight_sum": zero(F.col(f"{side}_weight").cast("double")), f"kg_{side}_edge_weight_log": zero(F.col(f"log_{side}_weight")), f"kg_has_{side}": whole(F.col(f"has_{side}"))}
    values |= {
        "kg_sibling_count": whole(F.col("sibling_count")),
        "kg_sibling_share_t_wavg": zero(F.col("sibling_share")),
        "kg_sibling_share_t_max": zero(F.col("sibling_max_share")),
        "kg_sibling_growth_lag_1_wavg": zero(F.col("sibling_growth")),
        "kg_sibling_rank_pct_t_wavg": zero(F.col("sibling_rank_pct")),
        "kg_self_vs_sibling_share_gap_t": zero(F.col("sibling_share_gap")),
        "kg_self_vs_sibling_growth_gap_lag_1": zero(F.col("sibling_growth_gap")),
        "kg_has_sibling": F.col("sibling_count").isNotNull().cast("long"),
        "kg_is_root_attr": whole(F.col("is_root")),
        "kg_is_leaf_attr": whole(F.col("is_leaf")),
    }
    return wide.select(*KEYS, *[values[name].alias(name) for name in FEATURES])


def ablation_masks(numeric: list[str], coarse: set[str]) -> dict[str, list[str]]:
    """The numeric features of each of the five variants; the attribute's type is a feature of all of them."""
    full = [*numeric, *FEATURES]
    return {
        "no_graph": [f for f in numeric if f not in coarse],
        "current_coarse_graph": list(numeric),
        "full_enhanced": full,
        "wo_hierarchy_context": [f for f in full if f not in HIERARCHY_CONTEXT],
        "wo_sibling_competition": [f for f in full if f not in SIBLING_COMPETITION],
    }
