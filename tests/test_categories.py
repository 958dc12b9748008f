"""The dictionary, its join, and encoded pipelines; sketch misses of the summary."""
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import categories as C, ml as M, profile, quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("b", "x"), ("a", None), (None, "x"), ("b", "y"), ("c", "x"), ("b", "é"), ("a", "x")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, `odd name` string")


def test_slots_are_dense_in_label_order(spark, frame):
    got = {(r["feature"], r["label"]): (r["n"], r["slot"]) for r in C.dictionary(frame, ["k", "odd name"]).collect()}
    assert got == {("k", "__null__"): (1, 0), ("k", "a"): (2, 1), ("k", "b"): (3, 2), ("k", "c"): (1, 3),
                   ("odd name", "__null__"): (1, 0), ("odd name", "x"): (4, 1), ("odd name", "y"): (1, 2), ("odd name", "é"): (1, 3)}


def test_rare_labels_share_a_slot_and_unseen_have_none(spark, frame):
    entries = C.dictionary(frame, ["k"], min_count=2)
    assert {r["label"]: r["slot"] for r in entries.collect()} == {"__null__": 0, "c": 1, "a": 2, "b": 3}
    new = spark.createDataFrame([("c",), ("zz",), (None,), ("b",), ("b",)], "k string")
    assert sorted((r["k"] or "", r["k__slot"]) for r in C.encode(new, entries, ["k"]).collect() if r["k"] != "zz") == [("", 0), ("b", 3), ("b", 3), ("c", 1)]
    assert C.encode(new, entries, ["k"]).where("k = 'zz'").first()["k__slot"] is None
    assert C.names(entries, ["k"]) == {"k": ["__null__", "__rare__", "a", "b"]} or C.names(entries, ["k"])["k"][1] in ("c", "__rare__")
    assert C.names(entries, ["k"], limit=2) == {"k": ["#0", "#1", "#2", "#3"]}


def test_vectors_and_persistence(spark, frame, tmp_path):
    model = Pipeline(stages=M.one_hot_stages(["k", "odd name"])).fit(frame)
    model.write().overwrite().save(str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "b", "y"), (2, "zz", None)], "id long, k string, `odd name` string")
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        out = {r["id"]: (r["a"], r["b"]) for r in m.transform(new).select("id", vector_to_array("k__ohe").alias("a"), vector_to_array("odd name__ohe").alias("b")).collect()}
        assert out == {1: ([0, 0, 1, 0], [0, 0, 1, 0]), 2: ([0, 0, 0, 0], [1, 0, 0, 0])}


def test_a_million_labels_stay_off_the_driver(spark):
    df = spark.range(1_000_000).select(F.concat(F.lit("label-"), F.col("id")).alias("k"))
    before = spark.conf.get("spark.driver.maxResultSize", "1g")
    entries = C.dictionary(df, ["k"])
    assert C.widths(entries) == {"k": 1_000_000}
    ends = entries.agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()
    assert tuple(ends) == (0, 999_999, 1_000_000) and before
    vector = Pipeline(stages=[C.CategoryEncoder(["k"])]).fit(df).transform(df.limit(5))
    assert {v["k__ohe"].size for v in vector.collect()} == {1_000_000}
    assert C.names(entries, ["k"])["k"][:2] == ["#0", "#1"]


def test_a_missed_bracket_falls_back_to_ranks(spark):
    wide = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    # the bracket 3..4 does not hold rank 50
    assert quantiles.refine(wide, [("v", 1, 3.0, 4.0, 50, 51, 0.5)]) == {("v", 1): 50.5}


def test_summary_counts_each_column_on_its_own(frame):
    plan = profile.category_counts.__doc__
    assert "no row is multiplied" in plan
    got = {(r["feature"], r["value"]): r["c"] for r in profile.category_counts(frame, ["k", "odd name"]).collect()}
    assert got["k", "b"] == 3 and got["k", None] == 1 and got["odd name", "x"] == 4
