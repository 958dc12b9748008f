"""The classifiers on held-out rows, their defined edge cases, and the pipeline against brute force."""
import random

import pytest

import corpus_pipeline
from riskweave.llm import quality, registry, toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def _labelled(spark, seed=1, n=900):
    """Documents of which some hold words of a marked family (toxic) or shout and repeat (low quality)."""
    r, rows, labels = random.Random(seed), [], []
    vocabulary = ["".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(600)]
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        toxic, good = int(r.random() < 0.25), int(r.random() < 0.7)
        for _ in range(3 * toxic):
            words[r.randrange(len(words))] = "zqx" + r.choice(["vor", "vin", "val", "vek", "vum"])
        text = " ".join(words if good else [w.upper() + "!!" for w in words[:9]] * 6 + words)
        rows.append((i, text))
        labels.append((i, good, toxic))
    rows += [(n, None), (n + 1, ""), (None, "words"), (n + 2, rows[0][1]), (n + 2, rows[0][1])]
    labels += [(None, 1, 1), (n, None, None), (n + 1, 1, 0), (n + 9, 0, 1), (0, labels[0][1], labels[0][2])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), labels


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy(spark, name):
    docs, labels, known = _labelled(spark)
    module, column = (toxicity, 2) if name == "toxic" else (quality, 1)
    got = (module.toxicity if name == "toxic" else module.quality)(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    from zlib import crc32
    truth = {d: y for d, *ys in known for y in [ys[column - 1]] if d is not None and y is not None}
    every, left = (5, 0) if name == "toxic" else (4, 2)
    held = [(r["score"], truth[r["row"]["doc_id"]]) for r in got
            if r["row"]["doc_id"] in truth and crc32(str(r["row"]["doc_id"]).encode()) % every == left]
    right = sum((s >= (0.5 if name == "toxic" else 0.7)) == y for s, y in held) / len(held)
    assert len(held) > 100 and right > 0.93


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "words"), (2, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in quality.quality(docs, labels).collect()] == [0.5] * 3
    assert toxicity.keep_clean(docs, labels).count() == 3
    assert toxicity.toxicity(docs.limit(0), labels).count() == quality.quality(docs.limit(0), labels).count() == 0


def test_scores_do_not_read_other_columns(spark):
    docs, labels, _ = _labelled(spark, n=150)
    from pyspark.sql import functions as F
    a = {(r["row"]["doc_id"], r["row"]["text"]): r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s"))
    b = {(r["row"]["doc_id"], r["row"]["text"]): r["score"] for r in toxicity.toxicity(other, labels).collect()}
    assert a == b


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, its decisions taken again by brute force."""
    docs, steps = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        steps[name] = docs, (docs := spark.read.parquet(str(tmp_path / name)))
    texts = {n: ([(r["doc_id"], r["text"]) for r in a.collect()], b) for n, (a, b) in steps.items()}
    before, after = texts["near_duplicates"]
    assert after.columns == columns
    assert {r["doc_id"] for r in after.collect()} == {d for d, _, c in brute.near_duplicates(before, 5) if d == c}
    before, after = texts["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, n, h, _ in brute.contamination(before, items) if not (h and 20 * h >= n)}
    assert after.columns == columns and {r["doc_id"] for r in after.collect()} == clean
    before, after = texts["mixing"]
    assert after.columns == columns and {r["doc_id"] for r in after.collect()} <= {d for d, _ in before}
    before, after = texts["token_output"]
    assert after.count() == len(before) and texts["toxicity"][1].columns == columns


def test_registry_is_complete():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES) and "pipeline" in corpus_pipeline.QUERIES
