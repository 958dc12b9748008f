"""Job smoke: the reference's flows write their contract tables (small driver tables)."""
import os
import tempfile

from pyspark.sql import functions as F

from riskweave.plans import catalog, jobs
from riskweave.sources import adapters as A
from riskweave.sources.io import SourceSpec, SourcesConfig, load_model, read_table, write_contract
from tests.conftest import SMOKE


SMALL_BOOSTER = {"n_estimators": 10, "learning_rate": 0.1, "num_leaves": 15, "class_weight": "balanced", "random_state": 42}


def test_flows_write_contracts(spark):
    out = tempfile.mkdtemp(prefix="rw-jobs-")
    app = catalog.enriched_applications(spark, SMOKE)
    w = jobs.ingest_validate(app, out)
    assert set(w) == {"data_shape", "missingness", "dtypes", "target_stats"}
    d = jobs.make_dashboard_tables(app, out, "r1", "2026-01-01T00:00:00+00:00")
    kpi = spark.read.option("header", True).csv(d["kpi_overview"]).collect()[0]
    assert kpi["run_id"] == "r1" and int(kpi["n_cols"]) == len(app.columns)
    ml = A.ml_frame(spark, SMOKE)
    b = jobs.train_simulate(ml, out, "logreg", {"max_iter": 20}, "baseline")
    assert os.path.exists(b["feature_importance_shap"]) and "metrics_compare" not in b
    t = jobs.train_simulate(ml, "file://" + out, params=SMALL_BOOSTER)
    t = {k: v.removeprefix("file://") for k, v in t.items()}
    assert spark.read.option("header", True).csv(t["metrics_compare"]).count() >= 2
    for k in ("metrics_champion", "confusion_matrix", "calibration_bins", "predictions", "decision_simulation"):
        assert os.path.exists(t[k]), k
    preds = spark.read.option("header", True).option("inferSchema", True).csv(t["predictions"])
    assert preds.count() == ml.count()
    assert load_model(os.path.join(out, "model_champion")) is not None
    s = jobs.simulate_scenarios(preds, out)
    assert spark.read.option("header", True).csv(s).count() == 3


def test_load_sources_skips_disabled_and_missing(spark):
    d = tempfile.mkdtemp(prefix="rw-src-")
    base = os.path.join(d, "app.parquet")
    write_contract(A.application(spark, SMOKE), base)
    write_contract(A.pos_cash_balance(spark, SMOKE), os.path.join(d, "pos.parquet"))
    cfg = SourcesConfig(base, {"pos_cash_balance": SourceSpec(os.path.join(d, "pos.parquet")),
                               "bureau": SourceSpec(os.path.join(d, "nope.parquet")),
                               "credit_card_balance": SourceSpec(os.path.join(d, "pos.parquet"), enabled=False)})
    b, srcs = jobs.load_sources(spark, cfg) if hasattr(jobs, "load_sources") else (None, None)
    assert set(srcs) == {"pos_cash_balance"}
    out = jobs.build_features(spark, cfg, os.path.join(d, "enriched.parquet"))
    e = read_table(spark, out)
    assert e.count() == b.count() and "POS_N_MONTHS" in e.columns and "BUREAU_N_CREDITS" not in e.columns
