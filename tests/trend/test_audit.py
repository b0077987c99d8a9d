"""A planted violation of every rule is found, and nothing else is."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import audit, trend


def found(violations):
    return sorted((r.rule, r.key) for r in violations.collect())


def rules_of(violations):
    return sorted({r.rule for r in violations.collect()})


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(w, a, "c", a, h) for w, hs in enumerate(([3, 1], [2, 2], [4, 0])) for a, h in zip("xy", hs, strict=True)]
    df = spark.createDataFrame(rows, "week_id long, attr_id string, attr_type string, attr_value string, heat_cnt long")
    total = F.sum("heat_cnt").over(Window.partitionBy("week_id"))
    rank = F.row_number().over(Window.partitionBy("week_id").orderBy(F.desc("heat_cnt"), "attr_id")).cast("long")
    return df.withColumns({"type_total_heat": total, "heat_share": F.col("heat_cnt") / total, "log_heat": F.log1p("heat_cnt"), "rank_in_type": rank})


def test_targets(spark, panel):
    derived = trend.next_week_target(panel)
    assert found(audit.target_violations(derived, derived)) == []
    at = lambda week, attr: (F.col("week_id") == week) & (F.col("attr_id") == attr)
    change = lambda c, v, when=at(0, "x"): derived.withColumn(c, F.when(when, F.lit(v)).otherwise(F.col(c)))
    for planted, rule in ((change("target_growth", 5.0), "growth"), (change("target_log_heat_t1", 9.0), "log_heat"), (change("heat_t", -1), "negative"), (change("rank_in_type_t", 0), "rank"), (change("share_t", 1.5), "share_above_one"), (change("target_growth", math.nan), "not_finite"), (change("attr_value", "z"), "changed")):
        assert rule in rules_of(audit.target_violations(planted, derived)) and ("changed", '{"week_id":0,"attr_id":"x"}') in found(audit.target_violations(planted, derived))
    assert found(audit.target_violations(derived.where(~at(1, "y")), derived)) == [("missing", '{"week_id":1,"attr_id":"y"}')]
    assert found(audit.target_violations(derived, derived.where(~at(1, "y")))) == [("extra", '{"week_id":1,"attr_id":"y"}')]
    assert "repeated" in rules_of(audit.target_violations(derived.union(derived.where(at(0, "x"))), derived))


def test_splits(spark):
    samples = spark.createDataFrame([(w, a, w / 10) for w in range(8) for a in "xy"], "week_id long, attr_id string, share_t double")
    split = trend.split_by_time(samples, 2, 2)
    assert found(audit.split_violations(split, samples)) == []
    swapped = split.withColumn("attr_id", F.when((F.col("week_id") == 3) & (F.col("attr_id") == "x"), F.lit("z")).otherwise(F.col("attr_id")))
    assert found(audit.split_violations(swapped, samples)) == [("extra", '{"week_id":3,"attr_id":"z"}'), ("missing", '{"week_id":3,"attr_id":"x"}')]
    late = split.withColumn("split", F.when(F.col("week_id") == 7, F.lit("train")).otherwise(F.col("split")))
    assert rules_of(audit.split_violations(late, samples)) == ["order"]
    both = split.withColumn("split", F.when((F.col("week_id") == 5) & (F.col("attr_id") == "x"), F.lit("test")).otherwise(F.col("split")))
    assert rules_of(audit.split_violations(both, samples)) == ["order"]
    odd = split.withColumn("split", F.when(F.col("week_id") == 0, F.lit("other")).otherwise(F.col("split")))
    assert rules_of(audit.split_violations(odd, samples)) == ["unknown_split"]
    assert rules_of(audit.split_violations(split.withColumn("share_t", F.col("share_t") + 1), samples)) == ["changed"]
    assert "repeated" in rules_of(audit.split_violations(split.union(split), samples))


def test_predictions(spark):
    split = spark.createDataFrame([("valid", 1, a, "c", a, 0.5, 0.1, 1) for a in "xy"], "split string, week_id long, attr_id string, attr_type string, attr_value string, share_t double, target_growth double, target_rank_in_type_t1 long")
    predictions = split.crossJoin(spark.createDataFrame([("m",), ("n",)], "model_name string")).withColumns({"pred_share_t1": F.lit(0.5), "pred_target_growth": F.lit(0.0)})
    assert found(audit.prediction_violations(predictions, split)) == []
    mine = (F.col("model_name") == "m") & (F.col("attr_id") == "x")
    change = lambda c, v: predictions.withColumn(c, F.when(mine, F.lit(v)).otherwise(F.col(c)))
    assert rules_of(audit.prediction_violations(change("share_t", 0.75), split)) == ["changed"]
    assert rules_of(audit.prediction_violations(change("pred_share_t1", math.inf), split)) == ["not_finite"]
    assert rules_of(audit.prediction_violations(change("pred_target_growth", None), split)) == ["not_finite"]
    assert found(audit.prediction_violations(predictions.where(~mine), split)) == [("no_prediction", '{"model_name":"m","split":"valid","week_id":1,"attr_id":"x"}')]
    assert rules_of(audit.prediction_violations(change("split", "test"), split)) == ["no_prediction", "no_sample"]
    assert "repeated" in rules_of(audit.prediction_violations(predictions.union(predictions), split))


def test_panel_and_references(spark, panel):
    weeks, nodes = panel.select("week_id").distinct(), spark.createDataFrame([("x",), ("y",)], "attr_id string")
    assert found(audit.panel_violations(panel, weeks, nodes)) == []
    more = nodes.union(spark.createDataFrame([("z",)], "attr_id string"))
    assert found(audit.panel_violations(panel, weeks, more)) == [("missing", f'{{"week_id":{w},"attr_id":"z"}}') for w in range(3)]
    assert found(audit.panel_violations(panel, weeks.where("week_id < 2"), nodes)) == [("extra", f'{{"week_id":2,"attr_id":"{a}"}}') for a in "xy"]
    assert rules_of(audit.panel_violations(panel.union(panel), weeks, nodes)) == ["repeated"]
    frame = lambda names, *rows: spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names.split()))
    sales, edges, articles = frame("article_id", ("1",)), frame("article_id attr_id", ("1", "x")), frame("article_id", ("1",))
    hierarchy = frame("parent_attr_id child_attr_id", ("x", "y"))
    assert found(audit.reference_violations(sales, edges, nodes, articles, hierarchy)) == []
    planted = audit.reference_violations(frame("article_id", ("1",), ("2",)), frame("article_id attr_id", ("1", "x"), ("3", "q")), nodes, articles, frame("parent_attr_id child_attr_id", ("p", "y"), ("x", "c")))
    assert rules_of(planted) == sorted(audit.REFERENCE_RULES)
    table = {r.rule: (r.n_violations, r.samples) for r in audit.report(planted, [*audit.REFERENCE_RULES, "none"]).collect()}
    assert table["none"] == (0, []) and table["sale_without_edge"] == (1, ['{"article_id":"2"}'])
    with pytest.raises(audit.CheckFailed, match="sale_without_edge"):
        audit.require(planted)
    audit.require(planted.where("rule = 'none'"))


def test_writes_are_checked_in_their_own_pass(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)] + [(7, -1.0), (8, None)], "k long, v double").repartition(3)
    rules = {"negative": F.col("v") < 0, "null": F.col("v").isNull()}
    with pytest.raises(audit.CheckFailed, match="negative"):
        audit.write_checked(df, str(tmp_path / "strict"), rules, ["k"])
    assert not list(tmp_path.iterdir())  # nothing is published, and nothing left
    table = {rule: (n, keys) for rule, n, keys in audit.write_checked(df, str(tmp_path / "loose"), rules, ["k"], strict=False)}
    assert table["negative"] == (1, ['{"k":7}']) and table["null"] == (1, ['{"k":8}']) and table["repeated"][0] == 4 and set(table["repeated"][1]) <= {'{"k":7}', '{"k":8}'}
    back = spark.read.parquet(str(tmp_path / "loose"))
    assert back.count() == 52 and back.columns == ["k", "v"]
    assert [n for _, n, _ in audit.write_checked(df.where("v >= 0").dropDuplicates(["k"]), str(tmp_path / "fine"), rules, ["k"])] == [0, 0, 0]
    with pytest.raises(FileExistsError):
        audit.write_checked(df.where("v >= 0").dropDuplicates(["k"]), str(tmp_path / "fine"), rules, ["k"])
    assert [n for _, n, _ in audit.write_checked(df.limit(0), str(tmp_path / "none"), rules, ["k"])] == [0, 0, 0]


def test_digests_name_what_differs(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(500)], "k long, v string")
    audit.store_ranges(df, ["k"], str(tmp_path / "a"))
    planted = df.where("k <> 17").withColumn("v", F.when(F.col("k") == 300, F.lit("other")).otherwise(F.col("v"))).union(spark.createDataFrame([(999, "new")], "k long, v string"))
    audit.store_ranges(planted.orderBy(F.desc("k")), ["k"], str(tmp_path / "b"))
    a, b = (audit.digests(spark.read.parquet(str(tmp_path / x)), ["k"], ["v"]) for x in "ab")
    assert audit.different_ranges(a, a) == [] and 1 <= len(audit.different_ranges(a, b)) <= 3
    got = audit.different_keys(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["k"], ["v"])
    assert found(got) == [("changed", '{"k":300}'), ("extra", '{"k":999}'), ("missing", '{"k":17}')]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan  # only their ranges are read
    same = audit.different_keys(spark, str(tmp_path / "a"), str(tmp_path / "a"), ["k"], ["v"])
    assert found(same) == []
