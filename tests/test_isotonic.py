"""J7 against a sequential fit: many distinct scores in small blocks, long chains of violators, and ranges joined instead of broadcast."""
import numpy as np
import pandas as pd
import pytest

from riskweave.operators.isotonic import IsotonicCalibrator, fit_isotonic


def sequential(scores, labels):
    """Fitted value at each distinct score, by pooling one after the other."""
    x, at = np.unique(scores, return_inverse=True)
    out = []
    for s, n in zip(np.bincount(at, labels), np.bincount(at), strict=True):
        out.append([s, n, 1])
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            s, n, k = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + n, out[-1][2] + k]
    return x, np.repeat([s / n for s, n, _ in out], [k for _, _, k in out])


def frame(spark, scores, labels):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(scores)), "y_proba": scores, "TARGET": labels})).repartition(5)


@pytest.mark.parametrize("shared", [500_000, 0])
def test_many_distinct_scores_equal_the_sequential_fit(spark, shared):
    rng = np.random.default_rng(8)
    scores = rng.random(130_000)
    scores[:20_000] = np.round(scores[:20_000], 3)                     # ties
    labels = (rng.random(len(scores)) < 0.2 + 0.6 * scores ** 2).astype(int)
    assert len(np.unique(scores)) > 100_000
    model = fit_isotonic(frame(spark, scores, labels), block_rows=4_000)
    new = np.concatenate([rng.random(3000), scores[:3000], [-1.0, 2.0]])
    got = model.transform(frame(spark, new, np.zeros(len(new), int)), shared=shared, bucket_pools=7, salts=3).orderBy("id").toPandas()
    assert np.allclose(got["y_proba_calibrated"], np.interp(new, *sequential(scores, labels)), atol=1e-12)


@pytest.mark.parametrize("kind", ["falling", "rising", "saw"])
def test_chains_longer_than_a_block(spark, kind):
    n = 600
    scores, x = np.arange(n) / n, np.arange(n)
    share = {"falling": 1 - x / n, "rising": x / n, "saw": ((x % 40) / 40 + x / n) / 2}[kind]
    reps = 20
    s = np.repeat(scores, reps)
    y = (np.tile(np.arange(reps), n) < np.repeat(np.round(share * reps), reps)).astype(int)
    model = fit_isotonic(frame(spark, s, y), block_rows=16)
    pools = model.pools.toPandas().sort_values("lo")
    wx, wy = sequential(s, y)
    assert np.allclose(np.interp(wx, pools[["lo", "hi"]].to_numpy().reshape(-1), np.repeat(pools["positives"] / pools["n"], 2)), wy)
    assert (np.diff(pools["positives"] / pools["n"]) > 0).all()


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.2, 1), (2, 0.4, 0), (3, None, 1), (4, 0.6, None), (5, 0.9, 1)], "id long, y_proba double, TARGET int")
    model = fit_isotonic(df)
    again = IsotonicCalibrator.load(spark, model.save(str(tmp_path / "m")))
    for m in (model, again):
        got = {r["id"]: r["y_proba_calibrated"] for r in m.transform(df).collect()}
        assert got == {1: 0.5, 2: 0.5, 3: None, 4: pytest.approx(0.7), 5: 1.0}
    for shared in (10, 0):
        assert [r["c"] for r in model.transform(df.where("id = 3"), out_col="c", shared=shared).collect()] == [None]
        assert model.transform(df.limit(0), shared=shared).count() == 0
    none = fit_isotonic(df.limit(0))
    assert {r["y_proba_calibrated"] for r in none.transform(df).collect()} == {None}
