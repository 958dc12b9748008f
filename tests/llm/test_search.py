"""op11: vectors found against brute force, the tree, and vectors that take no part."""
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, leaf int, x string"


def exact(rows, k, every):
    """{query: [(score, vec_id)]} over usable rows, one vector an id."""
    held = {}
    for i, v in rows:
        if i is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        v = [float(np.float32(c)) for c in v]
        held[i] = min(held.get(i, v), v)
    size = max(sorted({len(v) for v in held.values()}), key=lambda n: sum(len(v) == n for v in held.values()))
    held = {i: v for i, v in held.items() if len(v) == size}
    return {q: sorted(((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in held.items() if i != q))[:k]
            for q in held if q % every == 0}


def rows(n, d, seed=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    out = [(i, [c + r.gauss(0, 0.4) for c in r.choice(centres)]) for i in range(n)]
    out += [(n + i, list(out[7][1])) for i in range(40)]                      # equal vectors
    out += [(n + 100, None), (n + 101, []), (n + 102, [0.0] * d), (n + 103, [float("nan")] * d), (n + 104, [float("inf")] + [1.0] * (d - 1)),
            (n + 105, [None] + [1.0] * (d - 1)), (n + 106, [1.0] * (d + 1)), (None, [1.0] * d), out[20], out[20], (40, [9.0] * d)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "x", 1, "y") for i, v in data], SCHEMA).repartition(3)


def test_every_leaf_visited_equals_brute_force(spark):
    data = rows(300, 6)
    got = ann.search(frame(spark, data), F.col("vec_id") % 20 == 0, k=7, recall=1.0, leaf_rows=10, bin_rows=15, part_queries=3).collect()
    want = exact(data, 7, 20)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    for q, near in want.items():
        assert [x[0] for x in found[q]] == list(range(1, 8))
        for (_, _, score), (negative, _) in zip(found[q], near, strict=True):
            assert score == pytest.approx(-negative, rel=1e-12)
        assert sum(i in {n for _, n in near} for _, i, _ in found[q]) == 7


def test_recall_of_a_narrow_search(spark):
    data = rows(3000, 8)
    got = ann.search(frame(spark, data), F.col("vec_id") % 20 == 0, k=10, recall=0.95, leaf_rows=40).toPandas()
    want = exact(data, 10, 20)
    hits = sum(len(set(g["vec_id"]) & {i for _, i in want[q]}) for q, g in got.groupby("query_id"))
    assert hits >= 0.9 * 10 * len(want)
    again = ann.search(frame(spark, data), F.col("vec_id") % 20 == 0, k=10, recall=0.95, leaf_rows=40).toPandas()
    order = ["query_id", "rank"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), again.sort_values(order, ignore_index=True))


def test_fewer_candidates_than_asked_and_none(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.0]), (2, [-1.0, -1.0])])
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, -3.0)]
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(few, F.col("vec_id") == 77).count() == 0
    assert ann.search(frame(spark, [(0, [0.0]), (1, None)]), F.col("vec_id") == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_tree_order_and_visits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    tree = ann.grow(x, 20, branch=4)
    leaf = tree.leaf_of(x)
    assert set(leaf) <= set(tree.leaves) and np.bincount(leaf).max() <= 60
    order = list(tree.visit(x[0]))
    assert sorted(order) == sorted(tree.leaves)                               # every leaf once
    assert leaf[0] in order[:5]
    assert len(ann.grow(np.ones((50, 3)), 10).leaves) == 1                    # equal vectors cannot be split


def test_calibration_widens_until_recall():
    tree = ann.Tree(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([-1, 0, 0, 0]))
    truth = pd.DataFrame({"query": [0] * 4, "leaf": [1, 1, 2, 3]})
    near_one = np.array([[1.0]])                                              # leaves in the order 1, 2, 3 by distance
    assert ann.calibrate(truth, tree, near_one, 0.5)[0] == 1
    assert ann.calibrate(truth, tree, near_one, 0.75)[0] == 2
    assert ann.calibrate(truth, tree, near_one, 1.0) == (3, 1.0)


def test_large_leaves_take_several_bins():
    bins = ann._bins({1: 5, 2: 40, 3: 4, 4: 4, 5: 4}, [1, 2, 3, 4, 5], 10)
    assert bins[2][1] == 4 and bins[1][1] == 1 and bins[3] == bins[4]
    used = [b for first, n in bins.values() for b in range(first, first + n)]
    assert len(set(used) & set(range(bins[2][0], bins[2][0] + 4))) == 4 and used.count(bins[2][0]) == 1
