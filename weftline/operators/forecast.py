"""Baseline and boosted-tree forecasts of next week's share and growth, and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.expr import EPSILON, average_rank, log_growth
from weftline.operators import boosting

#: Growths that agree to so many digits tie: the last bits depend on the order of a sum.
TIE_DIGITS = 9
KEYS = ["split", "week_id", "attr_type"]
# The columns of a prediction, in order.
PREDICTION_COLUMNS = "week_id attr_id attr_type attr_value model_name split share_t pred_share_t1 target_growth pred_target_growth target_rank_in_type_t1".split()


def implied_share(growth: Column, epsilon: float = EPSILON) -> Column:
    """The share that a growth implies, not below 0."""
    return F.greatest(F.exp(growth) * (F.col("share_t") + epsilon) - epsilon, F.lit(0.0))


def _normalised(rows: DataFrame, epsilon: float) -> DataFrame:
    """rows: samples with model_name, pred_target_growth (null: what the predicted share gives) and raw, a share that is normalised by type."""
    total = F.sum("raw").over(Window.partitionBy("model_name", *KEYS))
    rows = rows.withColumn("pred_share_t1", F.coalesce(F.try_divide(F.col("raw"), total), F.lit(0.0)))
    rows = rows.withColumn("pred_target_growth", F.coalesce("pred_target_growth", log_growth(F.col("pred_share_t1"), F.col("share_t"), epsilon)))
    return rows.select(*PREDICTION_COLUMNS)


def baselines(split: DataFrame, models: tuple[str, ...] = ("last_week", "previous_growth", "moving_average"), epsilon: float = EPSILON) -> DataFrame:
    """Predictions of the baseline models, from one pass over the samples: each becomes a row for each model. last_week keeps the share, the
    others take the growth of the last week, or the mean of two."""
    growth = {"last_week": F.lit(None).cast("double"), "previous_growth": F.col("growth_lag_1"), "moving_average": (F.col("growth_lag_1") + F.col("growth_lag_2")) / 2}
    share = {m: F.greatest(F.col("share_t"), F.lit(0.0)) if m == "last_week" else implied_share(growth[m], epsilon) for m in models}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), growth[m].alias("pred_target_growth"), share[m].alias("raw")) for m in models]))
    needed = [c for c in PREDICTION_COLUMNS if c in split.columns]
    return _normalised(split.withColumn("_each", each).select(*needed, "_each.*"), epsilon)


def last_week(split: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    return baselines(split, ("last_week",), epsilon)


def previous_growth(split: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    return baselines(split, ("previous_growth",), epsilon)


def moving_average(split: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    return baselines(split, ("moving_average",), epsilon)


# What is no feature of a sample, and the coarse graph features.
NOT_FEATURES = {"split", "week_id", "attr_id", "attr_type", "attr_value", "target_growth", "target_log_heat_t1", "target_rank_in_type_t1"}
GRAPH_FEATURES = {"article_count", "is_core_attr", "parent_count", "child_count", "degree"}
BOOSTED = "boosted_trees"


def numeric_features(split: DataFrame) -> list[str]:
    return [c for c, kind in split.dtypes if c not in NOT_FEATURES and kind in ("bigint", "int", "double", "boolean")]


def fit_boosted_trees(split: DataFrame, masks: dict[str, list[str]], params: boosting.Params = boosting.Params()) -> DataFrame:
    """Nodes of a model for each mask of numeric features; the attribute's type is a categorical feature of all."""
    numeric = list(dict.fromkeys(f for fs in masks.values() for f in fs))
    return boosting.fit(split, ["week_id", "attr_id"], "target_growth", numeric, "attr_type", masks, params)


def boosted_predictions(split: DataFrame, nodes: DataFrame, model: str, features: list[str]) -> DataFrame:
    rows = boosting.predict(split, nodes, model, features, "attr_type", "predicted_growth")
    return _normalised(rows.withColumns({"model_name": F.lit(model), "pred_target_growth": F.col("predicted_growth"), "raw": implied_share(F.col("predicted_growth"))}), EPSILON)


def ranked(predictions: DataFrame) -> DataFrame:
    w = Window.partitionBy("model_name", *KEYS)
    return predictions.withColumns(
        {
            "pred_rank": F.row_number().over(w.orderBy(F.round("pred_target_growth", TIE_DIGITS).desc(), "attr_id")),
            "true_rank": F.row_number().over(w.orderBy(F.round("target_growth", TIE_DIGITS).desc(), "attr_id")),
            "n": F.count(F.lit(1)).over(w),
            "gain": F.col("target_growth") - F.min("target_growth").over(w),
        }
    )


def group_metrics(predictions: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """mae, rmse, spearman, precision, recall and ndcg at k of every (model, split, week, type)."""
    group = ["model_name", *KEYS]
    error = F.col("pred_target_growth") - F.col("target_growth")
    rows = ranked(predictions).withColumns({"a": average_rank(F.round("pred_target_growth", TIE_DIGITS), group), "b": average_rank(F.round("target_growth", TIE_DIGITS), group)})
    w = Window.partitionBy(*group)
    rows = rows.withColumns({"a": F.col("a") - F.avg("a").over(w), "b": F.col("b") - F.avg("b").over(w)})
    gain = lambda rank, k: F.sum(F.when(F.col(rank) <= k, F.col("gain") / F.log2(F.col(rank) + 1)).otherwise(0.0))
    out = [F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))).alias("spearman")]
    for k in ks:
        hit = F.count_if((F.col("pred_rank") <= k) & (F.col("true_rank") <= k)) / F.least(F.lit(k), F.max("n"))
        out += [hit.alias(f"precision_at_{k}"), hit.alias(f"recall_at_{k}"), F.try_divide(gain("pred_rank", k), gain("true_rank", k)).alias(f"ndcg_at_{k}")]
    return rows.groupBy(*group).agg(*out)


METRICS = ["mae", "rmse", "spearman", *[f"{m}_at_{k}" for k in (5, 10, 20) for m in ("precision", "recall", "ndcg")]]


def overall_metrics(groups: DataFrame, by: tuple[str, ...] = ("model_name", "split")) -> DataFrame:
    """Means of the groups' metrics; groups without one are passed over."""
    return groups.where("split <> 'train'").groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), *[F.avg(m).alias(m) for m in METRICS])


def metrics_long(metrics: DataFrame, ids: list[str]) -> DataFrame:
    return metrics.unpivot(ids, METRICS, "metric", "value")
