"""Roll-up operators on hand-built frames with known answers (reference test style)."""
import math

import pytest

from riskweave.operators import rollup


def rows(df, key="SK_ID_CURR"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_bureau_with_balance(spark):
    bureau = spark.createDataFrame(
        [(1, 10, "Active", 100.0, 1000.0, 5, 0.0, -100), (1, 11, "Closed", 0.0, 500.0, 0, 0.0, -200),
         (2, 20, None, None, 300.0, None, None, -50)],
        "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, AMT_CREDIT_SUM_DEBT double, "
        "AMT_CREDIT_SUM double, CREDIT_DAY_OVERDUE int, AMT_CREDIT_SUM_OVERDUE double, DAYS_CREDIT int")
    bb = spark.createDataFrame([(10, 0, "1"), (10, -1, "C"), (11, 0, "0")],
                               "SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string")
    out = rows(rollup.agg_bureau(bureau, bb))
    a = out[1]
    assert a["BUREAU_N_CREDITS"] == 2 and a["BUREAU_N_ACTIVE"] == 1
    assert a["BUREAU_ACTIVE_RATIO"] == 0.5
    assert a["BUREAU_DEBT_SUM"] == 100.0 and a["BUREAU_DEBT_MEAN"] == 50.0
    assert a["BUREAU_OVERDUE_MAX"] == 5 and a["BUREAU_DAYS_CREDIT_MEAN"] == -150.0
    assert a["BUREAU_BB_DPD_MONTHS_SUM"] == 1
    b = out[2]
    # all-missing group: sums are 0, means and max missing (pandas semantics)
    assert b["BUREAU_DEBT_SUM"] == 0 and b["BUREAU_DEBT_MEAN"] is None and b["BUREAU_OVERDUE_MAX"] is None
    assert b["BUREAU_N_ACTIVE"] == 0 and b["BUREAU_BB_DPD_MONTHS_SUM"] == 0


def test_bureau_minimal_schema_has_no_balance_column(spark):
    bureau = spark.createDataFrame([(1, "Active")], "SK_ID_CURR long, CREDIT_ACTIVE string")
    out = rollup.agg_bureau(bureau, None)
    assert "BUREAU_BB_DPD_MONTHS_SUM" not in out.columns
    assert out.collect()[0]["BUREAU_ACTIVE_RATIO"] == 1.0


def test_previous_apps(spark):
    prev = spark.createDataFrame([(1, "Approved", 100.0, 50.0, -10), (1, "Refused", 0.0, 40.0, -20),
                                  (2, None, 10.0, 5.0, -1)],
                                 "SK_ID_CURR long, NAME_CONTRACT_STATUS string, AMT_APPLICATION double, "
                                 "AMT_CREDIT double, DAYS_DECISION int")
    out = rows(rollup.agg_previous_apps(prev))
    a = out[1]
    assert a["PREV_N_APPS"] == 2 and a["PREV_APPROVED_RATIO"] == 0.5 and a["PREV_REFUSED_RATIO"] == 0.5
    assert a["PREV_AMT_CREDIT_MEAN"] == 45.0
    assert a["PREV_CREDIT_TO_APP_RATIO"] == pytest.approx(0.5)   # 50/100; 40/0 is missing
    assert a["PREV_DAYS_DECISION_MEAN"] == -15.0
    assert out[2]["PREV_APPROVED_RATIO"] == 0.0                 # NULL status counts in the denominator


def test_installments(spark):
    inst = spark.createDataFrame([(1, -10, -5, 100.0, 90.0), (1, -10, -12, 100.0, 110.0)],
                                 "SK_ID_CURR long, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, "
                                 "AMT_INSTALMENT double, AMT_PAYMENT double")
    a = rollup.agg_installments(inst).collect()[0]
    assert a["INST_N_INSTALMENTS"] == 2 and a["INST_LATE_RATE"] == 0.5
    assert a["INST_DPD_MEAN"] == 2.5 and a["INST_DPD_MAX"] == 5
    assert a["INST_SHORTFALL_MEAN"] == pytest.approx(0.05)


def test_installments_missing_payment_day_is_on_time(spark):
    inst = spark.createDataFrame([(1, -10, None, 0.0, 5.0)],
                                 "SK_ID_CURR long, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, "
                                 "AMT_INSTALMENT double, AMT_PAYMENT double")
    a = rollup.agg_installments(inst).collect()[0]
    assert a["INST_LATE_RATE"] == 0.0 and a["INST_DPD_MEAN"] is None and a["INST_SHORTFALL_MEAN"] is None


def test_pos_and_card(spark):
    pos = spark.createDataFrame([(1, 0), (1, 3), (1, 0)], "SK_ID_CURR long, SK_DPD int")
    p = rollup.agg_pos(pos).collect()[0]
    assert (p["POS_N_MONTHS"], p["POS_DPD_MEAN"], p["POS_DPD_MAX"], p["POS_N_LATE_MONTHS"]) == (3, 1.0, 3, 1)
    cc = spark.createDataFrame([(1, 50.0, 100.0, 0), (1, 100.0, 100.0, 2)],
                               "SK_ID_CURR long, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL double, SK_DPD int")
    c = rollup.agg_credit_card(cc).collect()[0]
    assert (c["CC_N_MONTHS"], c["CC_BALANCE_MEAN"], c["CC_UTILIZATION_MEAN"], c["CC_DPD_MEAN"]) == (2, 75.0, 0.75, 1.0)


def test_enrich_fills_counts_only(spark):
    app = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "SK_ID_CURR long, TARGET int")
    agg = spark.createDataFrame([(1, 2, 0.5), (2, 1, 1.0)],
                                "SK_ID_CURR long, BUREAU_N_CREDITS long, BUREAU_ACTIVE_RATIO double")
    out = rows(rollup.enrich(app, {"bureau": agg}))
    assert len(out) == 3
    assert out[3]["BUREAU_N_CREDITS"] == 0 and out[3]["BUREAU_ACTIVE_RATIO"] is None


def test_enrich_skip_empty_source(spark):
    app = spark.createDataFrame([(1, 0)], "SK_ID_CURR long, TARGET int")
    empty = spark.createDataFrame([], "SK_ID_CURR long, SK_DPD int")
    out = rollup.enrich_applications(app, {"pos_cash_balance": empty}, skip_empty=True)
    assert out.columns == ["SK_ID_CURR", "TARGET"]
    fixed = rollup.enrich_applications(app, {"pos_cash_balance": empty})
    assert fixed.collect()[0]["POS_N_MONTHS"] == 0


def test_missing_id_raises(spark):
    df = spark.createDataFrame([(1,)], "X long")
    for fn in (rollup.agg_previous_apps, rollup.agg_installments, rollup.agg_pos, rollup.agg_credit_card):
        with pytest.raises(ValueError):
            fn(df)
    with pytest.raises(ValueError):
        rollup.agg_bureau(df)
    with pytest.raises(ValueError):
        rollup.enrich(df, {})


def test_hot_applicant_rollup_is_exact(spark):
    # one applicant owns a third of all instalment rows; partial aggregation keeps the result exact
    rows = [(1, -10, -10 + (i % 4), 100.0, 90.0) for i in range(3000)]
    rows += [(2 + i % 50, -10, -12, 100.0, 100.0) for i in range(6000)]
    inst = spark.createDataFrame(rows, "SK_ID_CURR long, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, "
                                       "AMT_INSTALMENT double, AMT_PAYMENT double").repartition(8)
    out = {r["SK_ID_CURR"]: r for r in rollup.agg_installments(inst).collect()}
    hot = out[1]
    assert hot["INST_N_INSTALMENTS"] == 3000 and hot["INST_LATE_RATE"] == 0.75
    assert hot["INST_DPD_MEAN"] == 1.5 and hot["INST_DPD_MAX"] == 3
    assert hot["INST_SHORTFALL_MEAN"] == pytest.approx(0.1)
    assert len(out) == 51 and all(out[k]["INST_N_INSTALMENTS"] == 120 for k in range(2, 52))


def test_require_and_split_columns(spark):
    from riskweave.operators import checks, profile
    df = spark.createDataFrame([(1, 2.0, "a", True)], "id long, x double, s string, b boolean")
    checks.require_columns(df, ["id", "x"])
    with pytest.raises(ValueError, match="missing"):
        checks.require_columns(df, ["id", "nope"])
    # booleans are categorical, as in the pandas pipeline
    assert profile.split_columns(df, drop=["id"]) == (["x"], ["s", "b"])
