"""Histories in buckets by applicant are rolled up and joined where they lie."""
from riskweave.operators import rollup
from riskweave.sources import adapters as A
from riskweave.sources.bucketed import BY_APPLICANT, store_histories
from tests.conftest import SMOKE
from tests.oracle_runner import digest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_roll_ups_of_bucketed_histories_move_nothing(spark, tmp_path):
    tables = {"application": A.application(spark, SMOKE)} | A.lending_sources(spark, SMOKE)
    stored = store_histories(spark, tables, "bucket_test_", buckets=3, folder=str(tmp_path))
    try:
        for name, roll in (("previous_application", rollup.agg_previous_apps), ("installments_payments", rollup.agg_installments),
                           ("pos_cash_balance", rollup.agg_pos), ("credit_card_balance", rollup.agg_credit_card)):
            assert "Exchange" in plan(roll(tables[name])) and "Exchange" not in plan(roll(stored[name])), name
        histories = {n: d for n, d in stored.items() if n != "application"}
        direct = {n: d for n, d in histories.items() if n in BY_APPLICANT}
        enriched = rollup.enrich_applications(stored["application"], direct)
        assert "hashpartitioning" not in plan(enriched)                        # small sides may still be broadcast
        got = rollup.enrich_applications(stored["application"], histories)
        want = rollup.enrich_applications(tables["application"], {n: d for n, d in tables.items() if n != "application"})
        assert got.columns == want.columns
        assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(want.columns, [tuple(r) for r in want.collect()])[0]
    finally:
        for name in BY_APPLICANT:
            spark.sql(f"DROP TABLE IF EXISTS bucket_test_{name}")
