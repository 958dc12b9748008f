"""Spark ML layer: parameter mapping, fallback, end-to-end smoke, calibration, SHAP additivity."""
import logging

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import evaluate as EV, ml as M, shap as SH


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        f2 = int(rng.integers(0, 3))
        f1 = float(rng.normal()) if i % 7 else None
        y = int((f1 or 0) + 0.8 * f2 + rng.normal(scale=0.5) > 1.0)
        rows.append((i, y, f1, f2, ["a", "b", None][i % 3]))
    return spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, feat1 double, feat2 int, cat string")


def test_param_mapping_drops_unknown(caplog):
    mapped, dropped = M.map_params("gbt", {"n_estimators": 10, "num_leaves": 63, "reg_alpha": 1.0})
    assert mapped == {"maxIter": 10, "maxDepth": 6} and dropped == ["reg_alpha"]
    mapped, dropped = M.map_params("logreg", {"max_iter": 50, "num_leaves": 3})
    assert mapped == {"maxIter": 50} and dropped == ["num_leaves"]
    with pytest.raises(ValueError):
        M.map_params("nonsense", {})


def test_train_score_end_to_end(spark, frame):
    num, cat = M.feature_lists(frame)
    assert (num, cat) == (["feat1", "feat2"], ["cat"])
    model, eff, names = M.train_classifier(frame, num, cat, "gbt",
                                           {"n_estimators": 5, "num_leaves": 7, "class_weight": "balanced"})
    assert eff == "gbt" and names[:2] == ["feat1", "feat2"] and "cat___null__" in names
    scored = M.score(model, frame)
    preds = M.predictions_table(scored, "r", "c").collect()
    assert len(preds) == 60 and all(0 <= r["y_proba"] <= 1 for r in preds)
    assert {r["risk_band"] for r in preds} <= {"Low", "Medium", "High"}
    m = EV.classification_metrics(scored, "TARGET", "y_proba").collect()[0]
    assert m["auc_roc"] > 0.5


def test_boosted_failure_falls_back_to_logistic(spark, frame, caplog, monkeypatch):
    num, cat = M.feature_lists(frame)
    real = M.make_classifier

    def broken(model_type, *a, **k):
        if model_type in ("gbt", "lightgbm"):
            raise RuntimeError("booster unavailable")
        return real(model_type, *a, **k)
    monkeypatch.setattr(M, "make_classifier", broken)
    with caplog.at_level(logging.WARNING):
        model, eff, _ = M.train_classifier(frame, num, cat, "gbt", {"n_estimators": 5, "max_iter": 50})
    assert eff == "logreg"
    assert any("falling back" in r.message for r in caplog.records)


def test_isotonic_and_reliability(spark, frame):
    num, cat = M.feature_lists(frame)
    model, _, _ = M.train_classifier(frame, num, cat, "logreg", {"max_iter": 50})
    scored = M.score(model, frame)
    iso = M.fit_isotonic(scored, "y_proba", "TARGET")
    cal = M.calibrate(iso, scored, "y_proba", "y_cal")
    rel = EV.reliability_curve(cal, {"raw": "y_proba", "calibrated": "y_cal"}, "TARGET").collect()
    assert {r["method"] for r in rel} == {"raw", "calibrated"}
    assert all(0 <= r["mean_predicted"] <= 1 and 0 <= r["fraction_positive"] <= 1 for r in rel)
    # isotonic is monotone in the raw score
    pdf = cal.select("y_proba", "y_cal").toPandas().sort_values("y_proba")
    assert (np.diff(pdf["y_cal"].to_numpy()) >= -1e-12).all()


def test_shap_values_add_up_to_margin(spark, frame):
    num, cat = M.feature_lists(frame)
    model, _, names = M.train_classifier(frame, num, cat, "gbt", {"n_estimators": 6, "num_leaves": 8})
    trees, w = SH.tree_table(model)
    base = SH.expected_margin(trees, w)
    sv = SH.shap_values(model, frame, names).groupBy("SK_ID_CURR").agg(F.sum("shap").alias("s"))
    raw = model.transform(frame).select("SK_ID_CURR", vector_to_array("rawPrediction")[1].alias("m"))
    j = sv.join(raw, "SK_ID_CURR").toPandas()
    assert len(j) == 60
    assert np.allclose(j["s"] + base, j["m"], atol=1e-9)
    imp = SH.shap_importance(model, frame, names).collect()
    assert [r["rank"] for r in imp] == list(range(1, len(imp) + 1))


def test_tune_finds_signal(spark, frame):
    num, cat = M.feature_lists(frame)
    space = {"num_leaves": (4, 8, "int"), "learning_rate": (0.05, 0.3, "log"), "min_child_samples": (1, 5, "int")}
    row = M.tune(frame, num, cat, n_trials=2, n_folds=2, max_estimators=5, space=space).collect()[0]
    assert row["n_trials"] == 2 and row["best_cv_auc"] > 0.6
    assert set(space) <= set(row.asDict())
