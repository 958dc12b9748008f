"""Distributed running totals and exact quantiles against brute force, incl. a hot key."""
import numpy as np
import pytest

from riskweave.operators.ordered import exact_quantiles, running_totals


def test_running_totals_matches_cumsum_with_hot_group(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 5, n))      # group 0 holds ~60% of rows
    k = rng.permutation(n).astype(float)
    m = rng.integers(0, 5, n)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, k, m)], "g long, k double, m long")
    out = running_totals(df, "k", ["m"], ["g"], n_buckets=16).toPandas()
    for grp, part in out.groupby("g"):
        part = part.sort_values("k")
        assert (part["cum_m"].to_numpy() == np.cumsum(part["m"].to_numpy())).all(), grp


@pytest.mark.parametrize("probs", [[0.05, 0.5, 0.95], [0.2, 0.4, 0.6, 0.8], [0.0, 1.0]])
def test_exact_quantiles_match_numpy(spark, probs):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=500), np.full(400, 2.5), rng.integers(0, 9, 100).astype(float)])
    grp = np.array([0] * 600 + [1] * 400)
    rows = [(int(a), float(b)) for a, b in zip(grp, vals)] + [(0, None), (2, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    out = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "v", probs, ["g"], n_buckets=8).collect()}
    assert set(out) == {0, 1}                         # an all-NULL group produces no row
    for key in (0, 1):
        expect = np.quantile(vals[grp == key], probs)
        assert np.allclose(out[key], expect, rtol=0, atol=1e-12)


def test_quantiles_of_whole_columns(spark):
    from riskweave.operators.quantiles import column_quantiles, quantile_edges
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=3000), rng.integers(0, 5, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if i % 3 else None, None) for i, (a, b) in enumerate(zip(x, y))], "`a b` double, y double, z double")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    got = column_quantiles(df, ["a b", "y", "z"], probs)
    assert np.allclose(got["a b"], np.quantile(x, probs)) and got["z"] is None
    assert np.allclose(got["y"], np.quantile(y[np.arange(3000) % 3 != 0], probs))
    assert quantile_edges(df.limit(1), "y", [0.5]) is None and column_quantiles(df, [], probs) == {}


def test_bins_plan_no_nested_loop(spark):
    from riskweave.operators import segments
    df = spark.createDataFrame([(float(i),) for i in range(50)], "a double")
    plan = segments.quantile_bin(df, "a", 3, ["x", "y", "z"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
