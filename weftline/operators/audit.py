"""Checks that name what is wrong: violations by rule and key, reports, writes that are checked in their own pass, and digests by range.

A violation is a row (rule, key), key being a JSON object; frames of them can be united. An empty frame means that the check passes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9


class CheckFailed(ValueError):
    """A strict check found violations; the report is its argument."""


def key_of(names: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(n) for n in names])).alias("key")


def broken(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """A row for each rule that a row of ``df`` breaks, in one pass. A condition that is null isn't broken."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
    return df.select(F.explode(found).alias("rule"), key_of(key))


def repeated(df: DataFrame, key: list[str], rule: str = "repeated") -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").select(F.lit(rule).alias("rule"), key_of(key))


def unmatched(df: DataFrame, other: DataFrame, key: list[str], rule: str) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` doesn't have."""
    return df.select(*key).distinct().join(other.select(*key).distinct(), key, "left_anti").select(F.lit(rule).alias("rule"), key_of(key))


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def report(violations: DataFrame, rules: list[str], samples: int = 3) -> DataFrame:
    """rule, n_violations and the first keys as samples, for all rules, broken or not."""
    spark = violations.sparkSession
    every = spark.createDataFrame([(r,) for r in rules], "rule string")
    counts = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    few = violations.withColumn("p", F.row_number().over(Window.partitionBy("rule").orderBy("key"))).where(F.col("p") <= samples)
    shown = few.groupBy("rule").agg(F.sort_array(F.collect_list("key")).alias("samples"))
    return every.join(counts, "rule", "left").join(shown, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n_violations"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def require(violations: DataFrame) -> None:
    """Strict mode: raises with the first violations, if there are any."""
    first = violations.orderBy("rule", "key").limit(5).collect()
    if first:
        raise CheckFailed([(r.rule, r.key) for r in first])


# contents


def differs(a: Column, b: Column, kind: str) -> Column:
    """Null-safe; doubles differ beyond the tolerance, NaN equals NaN."""
    if kind in ("double", "float"):
        both_nan = F.coalesce(F.isnan(a) & F.isnan(b), F.lit(False))
        return ~(a.eqNullSafe(b) | both_nan | F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False)))
    return ~a.eqNullSafe(b)


def compared(got: DataFrame, want: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison by key: missing, extra and changed rows; either side's keys are single."""
    kinds = dict(want.dtypes)
    a = got.select(*key, F.struct(*values).alias("_a"))
    b = want.select(*key, F.struct(*values).alias("_b"))
    both = a.join(b, key, "full")
    changed = reduce(lambda x, y: x | y, [differs(F.col("_a")[c], F.col("_b")[c], kinds[c]) for c in values])
    return broken(both, {"missing": F.col("_a").isNull(), "extra": F.col("_b").isNull(), "changed": F.col("_a").isNotNull() & F.col("_b").isNotNull() & changed}, key)


def not_finite(*columns: str) -> Column:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return reduce(lambda a, b: a | b, [bad(c) for c in columns])


TARGET_RULES = ["not_finite", "negative", "rank", "share_above_one", "growth", "log_heat", "repeated", "missing", "extra", "changed"]


def target_violations(target: DataFrame, derived: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Labels against their formulas and, row by row, against ``derived``, the labels made from the heat panel anew."""
    key = ["week_id", "attr_id"]
    growth = F.log((F.col("share_t1") + epsilon) / (F.col("share_t") + epsilon))
    rules = {
        "not_finite": not_finite("share_t", "share_t1", "target_growth", "target_log_heat_t1"),
        "negative": (F.col("heat_t") < 0) | (F.col("heat_t1") < 0) | (F.col("share_t") < 0) | (F.col("share_t1") < 0) | (F.col("target_log_heat_t1") < 0),
        "rank": (F.col("rank_in_type_t") <= 0) | (F.col("target_rank_in_type_t1") <= 0),
        "share_above_one": (F.col("share_t") > 1 + TOLERANCE) | (F.col("share_t1") > 1 + TOLERANCE),
        "growth": F.abs(F.col("target_growth") - growth) > TOLERANCE,
        "log_heat": F.abs(F.col("target_log_heat_t1") - F.log1p("heat_t1")) > TOLERANCE,
    }
    values = [c for c in derived.columns if c not in key]
    return united([broken(target, rules, key), repeated(target, key), compared(target, derived, key, values)])


SPLIT_RULES = ["unknown_split", "order", "repeated", "missing", "extra", "changed"]


def split_violations(split: DataFrame, samples: DataFrame) -> DataFrame:
    """The splits hold every sample once and unchanged, and weeks go from train over valid to test without overlap."""
    key = ["week_id", "attr_id"]
    place = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).when(F.col("split") == "test", 2)
    weeks = split.select("week_id", place.alias("place")).distinct().where("place IS NOT NULL")
    # in order of weeks, no week may come in an earlier split than one before it, nor in two
    before = F.max("place").over(Window.orderBy("week_id").rangeBetween(Window.unboundedPreceding, 0))  # a row for each week and split
    order = broken(weeks.withColumn("before", before), {"order": F.col("before") > F.col("place")}, ["week_id", "place"])
    values = [c for c in samples.columns if c not in key]
    return united([broken(split, {"unknown_split": place.isNull()}, [*key, "split"]), order, repeated(split, key), compared(split, samples, key, values)])


PREDICTION_RULES = ["not_finite", "repeated", "no_sample", "no_prediction", "changed"]


def prediction_violations(predictions: DataFrame, split: DataFrame) -> DataFrame:
    """Every model predicts every sample of every split once, with the sample's own values and finite figures."""
    key = ["split", "week_id", "attr_id"]
    own = ["attr_type", "attr_value", "share_t", "target_growth", "target_rank_in_type_t1"]
    kinds = dict(split.dtypes)
    models = predictions.select("model_name").distinct()
    wanted = split.select(*key, F.struct(*own).alias("_b")).crossJoin(F.broadcast(models))  # a row for each prediction there should be
    both = predictions.select("model_name", *key, F.struct(*own).alias("_a")).join(wanted, ["model_name", *key], "full")
    changed = reduce(lambda a, b: a | b, [differs(F.col("_a")[c], F.col("_b")[c], kinds[c]) for c in own])
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    rules = {"no_sample": F.col("_b").isNull(), "no_prediction": F.col("_a").isNull(), "changed": met & changed}
    finite = broken(predictions, {"not_finite": not_finite("pred_share_t1", "pred_target_growth")}, ["model_name", *key])
    return united([finite, repeated(predictions, ["model_name", *key]), broken(both, rules, ["model_name", *key])])


PANEL_RULES = ["repeated", "missing", "extra"]


def panel_violations(heat: DataFrame, weeks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The panel has each week with each attribute once. weeks and nodes come from outside, so what lacks in all weeks is found too."""
    key = ["week_id", "attr_id"]
    grid = weeks.select("week_id").distinct().crossJoin(nodes.select("attr_id").distinct())  # the panel's own size
    return united([repeated(heat, key), unmatched(grid, heat, key, "missing"), unmatched(heat, grid, key, "extra")])


REFERENCE_RULES = ["sale_without_edge", "edge_without_node", "edge_without_article", "parent_without_node", "child_without_node"]


def reference_violations(sales: DataFrame, edges: DataFrame, nodes: DataFrame, articles: DataFrame, hierarchy: DataFrame) -> DataFrame:
    of = lambda column: hierarchy.select(F.col(column).alias("attr_id"))
    return united(
        [
            unmatched(sales, edges, ["article_id"], "sale_without_edge"),
            unmatched(edges, nodes, ["attr_id"], "edge_without_node"),
            unmatched(edges, articles, ["article_id"], "edge_without_article"),
            unmatched(of("parent_attr_id"), nodes, ["attr_id"], "parent_without_node"),
            unmatched(of("child_attr_id"), nodes, ["attr_id"], "child_without_node"),
        ]
    )


# checked writes


def _move(spark, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.exists(path(target)):
        raise FileExistsError(target)
    if not system.rename(path(source), path(target)):
        raise OSError(f"could not move {source} to {target}")


def _drop(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], key: list[str], unique: bool = True, strict: bool = True, samples: int = 3) -> list[tuple[str, int, list[str]]]:
    """Writes ``df`` as Parquet and counts, in the same pass, the rows that break each rule; returns (rule, n_violations, sample keys).

    With ``unique``, rows of a key that comes more than once break the rule ``repeated``; that takes one shuffle by key. The counts and samples are metrics that are
    observed while rows pass by: a sample is the key of least hash under one of ``samples`` salts, so a task holds a few keys. In strict mode a table with violations isn't published: it is
    written beside the path and deleted, and CheckFailed is raised with the report. The path must not exist.
    """
    spark = df.sparkSession
    checked, columns = df, df.columns
    all_rules = dict(rules)
    if unique:
        checked = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
        all_rules["repeated"] = F.col("_n") > 1
    names, metrics = list(all_rules), []
    shown = key_of(key)
    for i, bad in enumerate(all_rules.values()):
        metrics.append(F.count_if(bad).alias(f"n{i}"))
        metrics += [F.min_by(F.when(bad, shown), F.when(bad, F.xxhash64(shown, F.lit(s)))).alias(f"s{i}_{s}") for s in range(samples)]
    seen = Observation()
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    checked.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).select(*columns).write.parquet(staged)
    got = seen.get
    found = [(name, int(got.get(f"n{i}") or 0), sorted({got[f"s{i}_{s}"] for s in range(samples) if got.get(f"s{i}_{s}") is not None})) for i, name in enumerate(names)]
    if strict and any(n for _, n, _ in found):
        _drop(spark, staged)
        raise CheckFailed([x for x in found if x[1]])
    _move(spark, staged, path)
    return found


# digests by range


def store_ranges(df: DataFrame, key: list[str], path: str, bits: int = 6) -> None:
    """Writes ``df`` in 2^bits folders by ranges of the key's hash, so that a range can be read by itself."""
    placed = df.withColumn("_range", F.shiftrightunsigned(F.xxhash64(*key), 64 - bits).cast("int"))
    placed.repartition("_range").write.partitionBy("_range").parquet(path)


def digests(stored: DataFrame, key: list[str], values: list[str], bits: int = 6) -> DataFrame:
    """A tree of digests: level, node, n, digest. Level ``bits`` has the ranges, level 0 the root; a node sums its two children's.
    Sums of row hashes don't depend on the order of rows; 128-bit sums of two hashes make a chance agreement negligible."""
    row = lambda seed: F.xxhash64(F.lit(seed), *key, *values).cast("decimal(38,0)")
    leaves = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(row(1)).alias("a"), F.sum(row(2)).alias("b"))
    nodes = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda up: F.struct((F.lit(bits) - up).alias("level"), F.call_function("shiftright", F.col("_range"), up).alias("node"))))
    return leaves.select(nodes.alias("x"), "n", "a", "b").groupBy("x.level", "x.node").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def different_ranges(before: DataFrame, after: DataFrame, bits: int = 6) -> list[int]:
    """Goes down the two digest trees from the root, into nodes that differ. At most 2^bits numbers come to the driver."""
    differing = before.alias("x").join(after.alias("y"), ["level", "node"], "full").where("NOT (x.n <=> y.n AND x.a <=> y.a AND x.b <=> y.b)").select("level", "node")
    open_ = {0}
    by_level: dict[int, set[int]] = {}
    for r in differing.collect():
        by_level.setdefault(r.level, set()).add(r.node)
    for level in range(bits + 1):
        open_ = {n for n in by_level.get(level, set()) if level == 0 or n >> 1 in open_}
    return sorted(open_)


def different_keys(spark, before: str, after: str, key: list[str], values: list[str], bits: int = 6) -> DataFrame:
    """Violations (missing, extra, changed) between two folders of store_ranges(); only ranges whose digests differ are read and compared."""
    a, b = spark.read.parquet(before), spark.read.parquet(after)
    ranges = different_ranges(digests(a, key, values, bits), digests(b, key, values, bits), bits)
    inside = F.col("_range").isin(ranges) if ranges else F.lit(False)
    return compared(b.where(inside), a.where(inside), key, values)
