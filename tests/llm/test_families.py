"""Families of chained texts: links are found over posting lists, in whatever blocks the family is cut."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskweave.llm import near_dedup
from tests.llm import brute


def chain(n, step=4, length=60, seed=6, gaps=()):
    """n different texts; each shares four fifths of its shingles with the next one only, but for those before a gap."""
    r = np.random.default_rng(seed)
    words = [w.hex() for w in (r.bytes(4) for _ in range(n * step + length + step * 20 * len(gaps)))]
    at, texts = 0, []
    for i in range(n):
        texts.append(" ".join(words[at:at + length]))
        at += step * (20 if i + 1 in gaps else 1)
    return texts


def test_chain_in_small_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    rows = [(7 * i % 211, t) for i, t in enumerate(chain(150, gaps=(40, 95)))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute.near_duplicates(rows, 4))


def test_chain_of_twenty_thousand(spark):
    rows = pd.DataFrame({"doc_id": np.arange(20_000), "text": chain(20_000, gaps=(12_345,))})
    got = near_dedup.near_duplicates(spark.createDataFrame(rows), 4)
    found = {(r["component_id"], r["n"]) for r in got.groupBy("component_id").agg(F.count("*").alias("n")).collect()}
    assert found == {(0, 12_345), (12_345, 20_000 - 12_345)}


def test_blocks_that_share_no_list_do_not_meet(spark):
    """A class goes to the blocks of its own lists' members: two a neighbour at most, whatever the family's size."""
    postings = spark.createDataFrame([(c, t) for c in range(400) for t in (c, c + 1)], "cid long, token long")
    classes = postings.select("cid").distinct().withColumn("side", (F.col("cid") % 40).cast("int"))
    met = {r["cid"]: r["n"] for r in near_dedup._meetings(postings, classes).groupBy("cid").agg(F.count("*").alias("n")).collect()}
    assert len(met) == 400 and max(met.values()) == 3
