"""End-to-end jobs (the reference's CLI flows) composed from the operators.

Each job reads its inputs lazily, builds the whole plan, and writes every
contract table with :func:`write_contract`. Report-sized tables are
coalesced to one file; per-applicant tables keep their partitioning.
Typical use on a cluster::

    spark-submit --conf spark.checkpoint.dir=hdfs:///shared/ckpt job.py
"""
from __future__ import annotations

import logging
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import checks, decisions as D, evaluate as EV, ml as M, profile, rollup, sampling as S
from riskweave.operators import segments, shap as SH
from riskweave.session import ensure_checkpoint_dir, reliable_checkpoint
from riskweave.sources.io import (SourcesConfig, load_sources, model_run_row, new_run_stamp, path_exists, read_table,
                                  run_stamp, save_model, write_contract)

LOG = logging.getLogger(__name__)

DASHBOARD_REQUIRED = ["AMT_INCOME_TOTAL", "DAYS_BIRTH", "AMT_CREDIT", "CODE_GENDER", "TARGET"]


def _out(out_dir: str, name: str) -> str:
    return os.path.join(out_dir, name)


def ingest_validate(df: DataFrame, out_dir: str, target: str = "TARGET", fmt: str = "csv") -> dict[str, str]:
    """Validate the target, then write data_shape, missingness, dtypes and target_stats."""
    checks.require_columns(df, [target])
    checks.validate_binary(df, target)
    outs = {
        "data_shape": profile.data_shape(df),
        "missingness": profile.missingness(df),
        "dtypes": profile.column_types(df),
        "target_stats": profile.target_stats(df, target),
    }
    return {k: write_contract(v, _out(out_dir, k), fmt, report_sized=True) for k, v in outs.items()}


def build_features(spark: SparkSession, cfg: SourcesConfig, out_path: str, fmt: str = "parquet") -> str:
    """Roll every enabled source up to one row per applicant and join onto the base table."""
    base, sources = load_sources(spark, cfg)
    enriched = rollup.enrich_applications(base, sources, cfg.id_col)
    return write_contract(enriched, out_path, fmt)


def make_dashboard_tables(df: DataFrame, out_dir: str, run_id: str | None = None, created_at: str | None = None,
                          fmt: str = "csv") -> dict[str, str]:
    """KPI overview, missingness by feature, population segments, feature summary, correlations."""
    checks.require_columns(df, DASHBOARD_REQUIRED, "application table")
    checks.validate_binary(df, "TARGET")
    if run_id is None or created_at is None:
        run_id, created_at = new_run_stamp()
    outs = {
        "kpi_overview": profile.kpi_overview(df, run_id, created_at),
        "missingness_by_feature": profile.missingness_by_feature(df),
        "population_segments": segments.population_segments(df),
        "feature_summary": profile.feature_summary(df),
        "correlation_top": profile.correlation_top_sorted(df),
    }
    return {k: write_contract(v, _out(out_dir, k), fmt, report_sized=True) for k, v in outs.items()}


def train_simulate(df: DataFrame, out_dir: str, model_type: str = "gbt", params: dict | None = None,
                   label: str = "champion", target: str = "TARGET", id_col: str = "SK_ID_CURR",
                   test_size: float = 0.2, seed: int = 42, business_threshold: float = 0.2,
                   sweep: tuple[float, float, float] = D.DEFAULT_SWEEP, profit_if_good: float = 0.2,
                   loss_given_default: float = 1.0, shap_rows: int | None = None,
                   config: dict | None = None, fmt: str = "csv") -> dict[str, str]:
    """Train, evaluate on a stratified test split, explain, score everything, sweep thresholds.

    Every test row is explained; shap_rows limits that to a sample. A champion run ends with the comparison
    to the baseline's metrics, if there are any.
    """
    spark = df.sparkSession
    checks.validate_model_config(config if config is not None else {
        "model": {"type": model_type, "params": params or {}}, "split": {"test_size": test_size, "random_state": seed},
        "business": {"profit_if_good": profit_if_good, "loss_given_default": loss_given_default},
        "thresholds": dict(zip(("start", "stop", "step"), sweep))})
    checks.require_columns(df, [target, id_col])
    checks.validate_binary(df, target)
    t0 = time.time()
    split = reliable_checkpoint(S.stratified_split(df, target, id_col, test_size, seed))
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    num, cat = M.feature_lists(df, target, id_col)
    model, effective, names = M.train_classifier(train, num, cat, model_type, params, target)
    test_scored = reliable_checkpoint(M.score(model, test).select(id_col, target, "y_proba"))
    checks.validate_scores(test_scored, "y_proba")
    written: dict[str, str] = {}
    metrics = EV.classification_metrics(test_scored, target, "y_proba")
    written[f"metrics_{label}"] = write_contract(metrics, _out(out_dir, f"metrics_{label}"), fmt, True)
    written["confusion_matrix"] = write_contract(
        EV.confusion_matrix(test_scored, business_threshold, target, "y_proba"), _out(out_dir, "confusion_matrix"),
        fmt, True)
    written["calibration_bins"] = write_contract(
        EV.calibration_bins(test_scored, target, "y_proba"), _out(out_dir, "calibration_bins"), fmt, True)
    explained = test if shap_rows is None else S.sample_rows(test, shap_rows, id_col, seed)
    written["feature_importance_shap"] = _explained(model, explained, names, id_col, _out(out_dir, "feature_importance_shap"), fmt)
    save_model(model, _out(out_dir, f"model_{label}"))
    run_id, created_at = new_run_stamp()
    scored_all = reliable_checkpoint(M.score(model, df).select(id_col, target, "y_proba"))
    written["predictions"] = write_contract(
        M.predictions_table(scored_all, run_id, created_at, id_col, target), _out(out_dir, "predictions"), fmt)
    written["decision_simulation"] = write_contract(
        D.threshold_sweep(scored_all, target, "y_proba", *sweep, profit_if_good, loss_given_default),
        _out(out_dir, "decision_simulation"), fmt, True)
    m = {k: v for k, v in metrics.collect()[0].asDict().items()}
    written["runs"] = _out(out_dir, "model_runs")
    model_run_row(spark, run_id=run_id, created_at=created_at, label=label, model_type=effective,
                  numeric_features=num, categorical_features=cat, metrics=m,
                  train_seconds=time.time() - t0).write.mode("append").parquet(written["runs"])
    if label == "champion" and (compared := compare_metrics(spark, out_dir, fmt)):
        written["metrics_compare"] = compared
    return written


def _explained(model, rows: DataFrame, names: list[str], id_col: str, path: str, fmt: str) -> str:
    """Mean |SHAP| by feature; split importances under the same names if it cannot be worked out for this model."""
    try:
        return write_contract(SH.shap_importance(model, rows, names, id_col), path, fmt, True)
    except Exception as exc:  # noqa: BLE001 - a failed job is no reason for another table
        if M.failed_job(exc):
            raise
        LOG.warning("Shapley values failed (%s); writing split importances", exc)
        split = M.split_importance(model, names)
        return write_contract(split.withColumnRenamed("importance", "mean_abs_shap"), path, fmt, True)


def compare_metrics(spark: SparkSession, out_dir: str, fmt: str = "csv",
                    baseline: str = "Baseline (no class weight)",
                    champion: str = "Champion (class_weight=balanced)") -> str | None:
    """metrics_compare from the two labelled metric tables; skipped if either is missing."""
    paths = {baseline: _out(out_dir, "metrics_baseline"), champion: _out(out_dir, "metrics_champion")}
    if not all(path_exists(spark, p) for p in paths.values()):
        return None
    names = ("auc_roc", "average_precision", "brier_score", "log_loss")
    tables = {k: read_table(spark, p, fmt=fmt).select(*[F.col(n).cast("double").alias(n) for n in names]) for k, p in paths.items()}
    cmp = EV.metrics_compare(tables)
    return write_contract(cmp, _out(out_dir, "metrics_compare"), fmt, True)


def calibrate(df: DataFrame, out_dir: str, params: dict | None = None, target: str = "TARGET",
              id_col: str = "SK_ID_CURR", seed: int = 42, fmt: str = "csv") -> dict[str, str]:
    """Fit on the inner split, isotonic-calibrate on the held-out slice, report on the outer test split."""
    parts = reliable_checkpoint(S.three_way_split(df, target, id_col, 0.2, 0.25, seed))
    fit = parts.where(F.col("split") == "fit").drop("split")
    num, cat = M.feature_lists(df, target, id_col)
    model, _, _ = M.train_classifier(fit, num, cat, "gbt", params, target)
    calib = M.score(model, parts.where(F.col("split") == "calib").drop("split"))
    test = M.score(model, parts.where(F.col("split") == "test").drop("split"))
    iso = M.fit_isotonic(calib, "y_proba", target)
    cal = reliable_checkpoint(M.calibrate(iso, test, "y_proba", "y_proba_calibrated")
                              .select(id_col, target, "y_proba", "y_proba_calibrated"))
    out = {
        "calibration_metrics": EV.calibration_report(cal, "y_proba", "y_proba_calibrated", target),
        "calibration_curve": EV.reliability_curve(cal, {"raw": "y_proba", "calibrated": "y_proba_calibrated"},
                                                  target).drop("bin"),
    }
    iso.save(_out(out_dir, "model_calibrator"))
    return {k: write_contract(v, _out(out_dir, k), fmt, True) for k, v in out.items()}


def tune(df: DataFrame, out_dir: str, n_trials: int = 24, n_folds: int = 2, sample_size: int | None = 70000,
         max_estimators: int = 600, target: str = "TARGET", id_col: str = "SK_ID_CURR", seed: int = 42,
         fmt: str = "csv") -> str:
    """Random-search tuning on a stratified sample of the training split; one summary row."""
    split = S.stratified_split(df, target, id_col, 0.2, seed)
    train = split.where(F.col("split") == "train").drop("split")
    if sample_size:
        train = S.stratified_sample(train, sample_size, target, id_col, seed)
    num, cat = M.feature_lists(df, target, id_col)
    res = M.tune(train, num, cat, None, n_trials, n_folds, max_estimators, target, seed, id_col)
    return write_contract(res, _out(out_dir, "tuning_results"), fmt, True)


def simulate_scenarios(predictions: DataFrame, out_dir: str, scenarios: list[dict] | None = None,
                       fmt: str = "csv") -> str:
    """What-if table from an existing predictions table (y_true, y_proba)."""
    checks.require_columns(predictions, ["y_true", "y_proba"], "predictions")
    checks.validate_scores(predictions, "y_proba", "y_true")
    res = D.scenario_results(predictions, scenarios).drop("scenario_order")
    return write_contract(res, _out(out_dir, "scenario_results"), fmt, True)


__all__ = ["ingest_validate", "build_features", "make_dashboard_tables", "train_simulate", "compare_metrics",
           "calibrate", "tune", "simulate_scenarios", "read_table", "run_stamp", "ensure_checkpoint_dir"]
