"""Report tables: the columns of each, in order, and the order of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_METRICS = ("mae", "rmse", "spearman", "ndcg_at_10", "precision_at_10", "recall_at_10")
_RANKED = ("map_at_12", "recall_at_12", "hit_rate_at_12", "ndcg_at_12", "coverage")
# The report tables, their columns and what they are sorted by.
COLUMNS = {
    "data_artifact_summary": ("section", "artifact", "row_count", "column_count"),
    "time_split_summary": ("domain", "split", "week_start", "week_end", "week_count", "row_count", "attribute_count", "user_count"),
    "attribute_graph_summary": ("entity_type", "attr_type", "relation_type", "count"),
    "trend_model_metrics": ("model_name", "split", *_METRICS),
    "trend_metrics_by_attr_type": ("model_name", "split", "attr_type", *_METRICS),
    "recommendation_method_metrics": ("method", "split", *_RANKED, "user_count", "missing_recommendation_user_count"),
    "recommendation_experiment_summary": ("section", "rank", "method", "split", "pop_score", "sim_score", "trend_score", "recent_score", *_RANKED),
}
SORT = {
    "data_artifact_summary": ("section", "artifact"),
    "time_split_summary": ("domain", "split", "week_start"),
    "attribute_graph_summary": ("entity_type", "attr_type", "relation_type"),
    "trend_model_metrics": ("model_name", "split"),
    "trend_metrics_by_attr_type": ("model_name", "split", "attr_type"),
    "recommendation_method_metrics": ("method", "split"),
    "recommendation_experiment_summary": ("section", "rank", "split", "method"),
}


def report_table(rows: DataFrame, name: str) -> DataFrame:
    """The table's columns with row_order; a report has a few rows, so one window numbers them. Missing columns are an error."""
    order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in SORT[name]])
    return rows.select(*COLUMNS[name]).withColumn("row_order", F.row_number().over(order))


def artifact_summary(artifacts: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """section, artifact, row_count and column_count of each table."""
    out = None
    for (section, name), df in artifacts.items():
        one = df.agg(F.lit(section).alias("section"), F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"))
        out = one if out is None else out.unionByName(one)
    return out


def graph_summary(nodes: DataFrame, edges: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Nodes by type, article edges by type and kind, hierarchy edges by types and relation."""
    none = F.lit("")
    count = F.count(F.lit(1)).alias("count")
    a = nodes.groupBy(F.lit("attribute_node").alias("entity_type"), "attr_type", none.alias("relation_type")).agg(count)
    b = edges.groupBy(F.lit("article_attribute_edge").alias("entity_type"), "attr_type", F.col("edge_type").alias("relation_type")).agg(count)
    c = hierarchy.groupBy(F.lit("attribute_hierarchy_edge").alias("entity_type"), F.concat_ws("->", "parent_attr_type", "child_attr_type").alias("attr_type"), "relation_type").agg(count)
    return a.unionByName(b).unionByName(c)
