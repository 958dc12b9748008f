"""ROC corners against exact geometry, and the next row across partitions."""
import math
from fractions import Fraction

import numpy as np
import pytest

from riskweave.operators import evaluate as EV
from riskweave.operators.ordered import running_totals


def _corners(y, p):
    """(score, positives, negatives) of the points that do not lie between their neighbours on a line."""
    grid = sorted(set(p.tolist()), reverse=True)
    at = [(math.inf, 0, 0)] + [(s, int(((p >= s) & (y == 1)).sum()), int(((p >= s) & (y == 0)).sum())) for s in grid]
    keep = [at[0]]
    for before, here, after in zip(at, at[1:], at[2:]):
        if (here[1] - before[1]) * (after[2] - here[2]) != (here[2] - before[2]) * (after[1] - here[1]):
            keep.append(here)
    return keep + at[-1:]


@pytest.mark.parametrize("buckets", [1, 7, 64])
@pytest.mark.parametrize("levels", [3, 40, 5000])
def test_corners_equal_geometry(spark, buckets, levels):
    rng = np.random.default_rng(levels)
    p = np.round(rng.random(800) * levels) / levels
    y = (rng.random(800) < p * 0.6).astype(int)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y_true int, y_proba double")
    got = sorted((tuple(r) for r in EV.roc_corners(df, n_buckets=buckets).collect()), reverse=True)
    pos, neg = int(y.sum()), int((1 - y).sum())
    want = [(s, n / neg, t / pos) for s, t, n in _corners(y, p)]
    assert got == want
    full = sorted(tuple(r) for r in EV.roc_curve(df, n_buckets=buckets).collect())
    assert set(got) <= set(full)

    def area(points):
        points = sorted((Fraction(round(x * neg), neg), Fraction(round(t * pos), pos)) for _, x, t in points)
        return sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(points, points[1:]))

    assert area(got) == area(full)
    if levels == 5000:
        assert len(got) < 0.8 * len(full)


def test_corners_of_one_class_ties_and_nothing(spark):
    def rows(data):
        df = spark.createDataFrame(data, "y_true int, y_proba double")
        return sorted((tuple(r) for r in EV.roc_corners(df, n_buckets=3).collect()), reverse=True)

    assert rows([]) == [(math.inf, 0.0, 0.0)]
    assert rows([(1, 0.5), (0, 0.5), (None, 0.7), (1, None)]) == [(math.inf, 0.0, 0.0), (0.5, 1.0, 1.0)]
    assert rows([(1, 0.1), (1, 0.2), (1, 0.3)]) == [(math.inf, 0.0, 0.0), (0.1, None, 1.0)]
    assert rows([(1, 0.9), (2, 0.5), (0, 0.2)]) == [(math.inf, 0.0, 0.0), (0.9, 0.0, 1.0), (0.2, 1.0, 1.0)]


def test_next_row_of_each_group(spark):
    rng = np.random.default_rng(5)
    g = np.where(rng.random(600) < 0.5, 0, rng.integers(1, 4, 600))
    k = rng.permutation(600)
    rows = [(None if a == 3 else int(a), None if b == 17 else float(b), int(b) % 11, int(b)) for a, b in zip(g, k)]
    df = spark.createDataFrame(rows, "g long, k double, m long, id long")
    out = running_totals(df, "k", ["m"], ["g"], tie_breakers=["id"], n_buckets=16, ahead=["id", "m"]).toPandas()
    for key, part in out.assign(g=out["g"].fillna(-1)).groupby("g"):
        part = part.sort_values("k", na_position="first")
        ids = part["id"].tolist()
        assert [None if x is None else x["id"] for x in part["next"]] == [*ids[1:], None], key
