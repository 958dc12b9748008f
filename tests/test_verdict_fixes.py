"""Rows with NULL labels stay, configuration errors are told at once, many groups take the one ordered path."""
import pytest
from pyspark.sql import functions as F

from riskweave.functions import expr as X
from riskweave.operators import checks, decisions as D, ml as M, sampling as S, shap as SH
from riskweave.operators.ordered import count_below, running_totals


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "SK_ID_CURR long, TARGET int")


def test_null_labels_are_a_class(labelled):
    n = labelled.count()
    split = S.stratified_split(labelled)
    assert split.count() == n
    got = {(r[0], r[1]): r[2] for r in split.groupBy("TARGET", "split").count().collect()}
    assert got[(None, "test")] == 2 and got[(None, "train")] == 8 and got[(0, "test")] == 8 and got[(1, "test")] == 10
    three = S.three_way_split(labelled)
    assert three.count() == n and {r[0] for r in three.where("TARGET is null").select("split").distinct().collect()} == {"fit", "calib", "test"}
    folds = S.stratified_folds(labelled, 5)
    assert folds.count() == n and {r[1] for r in folds.where("TARGET is null").groupBy("fold").count().collect()} == {2}
    assert S.stratified_sample(labelled, 50).groupBy("TARGET").count().where("TARGET is null").first()[1] == 5


def test_split_moves_no_rows(labelled):
    plan = S.stratified_split(labelled.withColumn("payload", F.lit("x")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError, match="not a class"):
        S.stratified_split(spark.range(2000).selectExpr("id SK_ID_CURR", "id TARGET"))


def test_running_totals_of_many_groups(spark):
    df = spark.range(4000).selectExpr("if(id % 251 = 250, null, id % 251) g", "cast(id as double) k", "1 m")
    got = running_totals(df, "k", ["m"], ["g"], n_buckets=7).groupBy("g").agg(F.max("cum_m").alias("n"), F.count("*").alias("c")).collect()
    assert len(got) == 251 and all(r["n"] == r["c"] for r in got)


def test_count_below_is_a_tree_in_codegen(spark):
    edges = [0.5, 1.0, 1.0, 2.0, 7.5]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 0.7, 1.0, 2.0, 3.0, 7.5, 8.0, float("nan"))], "x double")
    out = df.select("x", count_below(F.col("x"), edges).alias("b"), count_below(F.col("x"), edges, True).alias("c"))
    for x, b, c in out.collect():
        assert x != x or (b, c) == (sum(e < x for e in edges), sum(e <= x for e in edges))
    assert "lambda" not in out._jdf.queryExecution().toString()


def test_sweep_refuses_bad_scores(spark):
    for bad in (1.7, -3.0, float("nan"), None):
        with pytest.raises(ValueError):
            D.threshold_sweep(spark.createDataFrame([(0, 0.5), (1, bad)], "y_true int, y_proba double"))


def test_model_config_lists_all_violations():
    checks.validate_model_config({"model": {"type": "gbt"}, "split": {"test_size": 0.2, "random_state": 1}})
    for cfg in ({}, {"model": "x"}, {"model": {}, "business": {"profit_if_good": "abc"}}, {"model": {}, "random_state": "q"}, "x"):
        with pytest.raises(ValueError):
            checks.validate_model_config(cfg)
    with pytest.raises(ValueError) as e:
        checks.validate_model_config({"split": {"test_size": 2}, "scenarios": [{"threshold": "a"}, 3], "thresholds": {"step": 0}})
    assert all(w in str(e.value) for w in ("model is missing", "test_size", "entry 2", "loss_given_default", "step"))


def test_feature_group_rules(spark):
    df = spark.createDataFrame([("AMT_X",), ("Z",)], "f string")
    assert [r[0] for r in df.select(X.feature_group("f", [("money", "^AMT")])).collect()] == ["money", "other"]
    for bad in (["x"], [("a", "[")], [("a", "")]):
        with pytest.raises(ValueError):
            X.feature_group("f", bad)


def test_fold_medians_leave_the_held_fold_out(spark, monkeypatch):
    rows = [(i, i % 2, float(i % 2) + (100.0 if i % 4 < 2 else 0.0), i // 2 % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, X double, fold int")
    seen, real = [], M.fit_medians
    monkeypatch.setattr(M, "fit_medians", lambda d, c, **k: seen.append({r[0] for r in d.select("SK_ID_CURR").collect()}) or real(d, c, **k))
    out = M.tune(df, ["X"], [], folds=df, n_trials=1, n_folds=2, max_estimators=30, space={"num_leaves": (4, 4, "int")}).first()
    assert [s & {i for i, *_, f in rows if f == k} for k, s in enumerate(seen)] == [set(), set()]
    assert out["n_estimators"] < 30 and M.tuned_params(spark.createDataFrame([out]))["n_estimators"] == M.MIN_FINAL_TREES
    assert "reg_alpha" not in out.asDict()


def test_training_partitions_do_not_depend_on_rows(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert M.for_training(spark.range(10).repartition(8)).rdd.getNumPartitions() == n
    assert M.for_training(spark.range(5000).repartition(2)).rdd.getNumPartitions() == n


def test_linear_shap(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "_id long, _x array<double>")
    got = {(r[0], r[1]): r[2] for r in SH.linear_shap(rows, [2.0, 5.0], ["a", "b"]).collect()}
    assert got == {(1, "a"): -2.0, (2, "a"): 2.0, (1, "b"): 0.0, (2, "b"): 0.0}
