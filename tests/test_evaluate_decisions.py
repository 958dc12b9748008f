"""Metrics and decision economics against brute force and the reference's published arithmetic."""
import math

import numpy as np
import pytest

from riskweave.operators import checks, decisions as D, evaluate as EV


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(11)
    n = 400
    y = (rng.random(n) < 0.2).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)      # rounded: many ties
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "application_id long, y_true int, y_proba double")
    return df, y, p


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def brute_ap(y, p):
    order = np.unique(p)[::-1]
    P = y.sum()
    ap = 0.0
    for s in order:
        sel = p >= s
        tp, fp = (y[sel] == 1).sum(), (y[sel] == 0).sum()
        ap += ((y[p == s] == 1).sum() / P) * tp / (tp + fp)
    return ap


def test_ranking_metrics_match_brute_force(spark, scores):
    df, y, p = scores
    m = EV.classification_metrics(df, n_buckets=8).collect()[0]
    assert m["auc_roc"] == pytest.approx(round(brute_auc(y, p), 6), abs=1e-6)
    assert m["average_precision"] == pytest.approx(round(brute_ap(y, p), 6), abs=1e-6)
    assert m["brier_score"] == pytest.approx(round(float(np.mean((p - y) ** 2)), 6), abs=1e-6)
    q = np.clip(p, EV.LOG_LOSS_EPS, 1 - EV.LOG_LOSS_EPS)
    assert m["log_loss"] == pytest.approx(round(float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))), 6),
                                          abs=1e-6)
    assert EV.auc_roc(df, n_buckets=4).collect()[0]["auc_roc"] == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_ks_and_roc(spark, scores):
    df, y, p = scores
    ks = EV.ks_statistic(df, n_buckets=4).collect()[0]["ks_statistic"]
    grid = np.unique(p)
    cdf_b = np.array([(p[y == 1] <= s).mean() for s in grid])
    cdf_g = np.array([(p[y == 0] <= s).mean() for s in grid])
    assert ks == pytest.approx(round(float(np.max(np.abs(cdf_b - cdf_g))), 4))
    roc = EV.roc_curve(df, n_buckets=4).toPandas().sort_values("threshold", ascending=False)
    assert len(roc) == len(grid) + 1 and math.isinf(roc["threshold"].iloc[0])
    x, t = roc["fpr"].to_numpy(), roc["tpr"].to_numpy()
    assert float(np.sum((x[1:] - x[:-1]) * (t[1:] + t[:-1]) / 2)) == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_ks_one_class_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y_true int, y_proba double")
    assert EV.ks_statistic(df).collect()[0]["ks_statistic"] is None


def test_sweep_has_18_thresholds_and_matches_loop(spark, scores):
    df, y, p = scores
    ts = D.sweep_thresholds(0.05, 0.95, 0.05)
    assert len(ts) == 18 and ts[-1] == 0.9
    out = {r["threshold"]: r for r in D.threshold_sweep(df).collect()}
    for t in ts:
        a = p < t
        good, bad = ((y == 0) & a).sum(), ((y == 1) & a).sum()
        r = out[t]
        assert r["approval_rate"] == pytest.approx(round(a.mean(), 6))
        assert r["default_rate_among_approved"] == pytest.approx(round(y[a].mean(), 6) if a.any() else 0.0)
        assert r["expected_value"] == pytest.approx(round(good * 0.2 - bad * 1.0, 6))


def test_scenarios_agree_with_sweep(spark, scores):
    df, _, _ = scores
    sweep = {r["threshold"]: r for r in D.threshold_sweep(df).collect()}
    for r in D.scenario_results(df).collect():
        if r["profit_if_good"] == 0.2:
            s = sweep[r["threshold"]]
            assert (r["approval_rate"], r["net_value"]) == (s["approval_rate"], s["expected_value"])
    best = D.best_scenario(D.scenario_results(df)).collect()[0]
    assert best["best_scenario"] in {"Base", "Conservative", "Aggressive"}


def test_confusion_golden_arithmetic(spark):
    # published confusion row at t = 0.2: tn 20213, fp 36325, fn 405, tp 4560
    rows = [(0, 0.1)] * 3 + [(0, 0.5)] * 5 + [(1, 0.1)] * 1 + [(1, 0.9)] * 2
    df = spark.createDataFrame(rows, "y_true int, y_proba double")
    c = EV.confusion_matrix(df, 0.2).collect()[0]
    assert (c["true_negative"], c["false_positive"], c["false_negative"], c["true_positive"]) == (3, 5, 1, 2)
    assert round(4560 / (4560 + 36325), 6) == 0.111532 and round(4560 / (4560 + 405), 6) == 0.918429
    f1 = EV.f1_score(EV.confusion_matrix(df, 0.2)).collect()[0]["f1"]
    assert f1 == pytest.approx(round(2 * (2 / 7) * (2 / 3) / ((2 / 7) + (2 / 3)), 6))


def test_calibration_bins_display_rule():
    # published rows: "(3.999999999999989e-05, 0.0986]" midpoint 0.0493, "(0.0986, 0.195]" midpoint 0.1468
    disp = EV._display_edges([0.0010412, 0.09860004, 0.19499996])
    assert disp[0] == 3.999999999999989e-05 and disp[1:] == [0.0986, 0.195]
    assert round((disp[0] + disp[1]) / 2, 4) == 0.0493 and round((disp[1] + disp[2]) / 2, 4) == 0.1468
    e = EV.cut_edges(0.0, 1.0, 10)
    assert e[0] == pytest.approx(-0.001) and e[-1] == 1.0 and len(e) == 11


def test_calibration_bins_keep_empty(spark):
    rows = [(0, 0.0), (1, 1.0), (0, 0.05)]
    df = spark.createDataFrame(rows, "y_true int, y_proba double")
    out = EV.calibration_bins(df, n_bins=10).orderBy("bin").collect()
    assert len(out) == 10 and sum(r["n"] for r in out) == 3
    assert out[5]["n"] == 0 and out[5]["actual_default_rate"] is None


def test_validation_errors(spark):
    bad = spark.createDataFrame([(0, 1.2), (1, 0.5)], "y_true int, y_proba double")
    with pytest.raises(ValueError):
        checks.validate_scores(bad, "y_proba", "y_true")
    with pytest.raises(ValueError):
        checks.validate_sweep(0.5, 0.2, 0.1)
    with pytest.raises(ValueError):
        checks.validate_sweep(0.1, 0.9, 0)
    with pytest.raises(ValueError):
        checks.validate_scenarios([])
    assert checks.validate_scenarios([{"threshold": 0.1, "profit_if_good": 1, "loss_given_default": 1}])[0][
        "name"] == "scenario_1"
    with pytest.raises(ValueError):
        checks.validate_model_config({"split": {"test_size": 1.2}})
    checks.validate_model_config({"split": {"test_size": 0.2}, "model": {"type": "gbt"}})
    tgt = spark.createDataFrame([(0,), (2,), (None,)], "TARGET int")
    with pytest.raises(ValueError, match="binary"):
        checks.validate_binary(tgt, "TARGET")
