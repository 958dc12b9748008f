"""Independent DuckDB SQL for every D-checked query in the catalog.

The adapter CTEs restate the driver-table reshaping in SQL so each oracle
is self-contained over the pre-registered parquet views. Conventions:
doubles are rounded to 6 decimals on both sides, DuckDB HUGEINT sums and
BIGINT day differences are cast back to Spark's types.
"""
from __future__ import annotations

DAYS = "CAST(date_diff('day', DATE '2001-12-31', CAST({c} AS DATE)) AS INTEGER)"

ADAPTERS = {
    "application": """
SELECT c_custkey AS SK_ID_CURR,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET,
       CAST(1000 + (c_custkey * 7919) % 90001 AS DOUBLE) AS AMT_INCOME_TOTAL,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(5000 + (c_custkey * 104729) % 500009 AS DOUBLE) END AS AMT_CREDIT,
       -(6570 + (c_custkey * 7919) % 20000) AS DAYS_BIRTH,
       NULLIF(c_mktsegment, 'BUILDING') AS CODE_GENDER,
       c_nationkey AS REGION_CODE,
       1 AS FLAG_MOBIL
FROM customer""",
    "bureau": f"""
SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
       CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE NULL END AS CREDIT_ACTIVE,
       CASE o_orderstatus WHEN 'O' THEN o_totalprice WHEN 'F' THEN 0e0 ELSE NULL END AS AMT_CREDIT_SUM_DEBT,
       o_totalprice AS AMT_CREDIT_SUM,
       o_orderkey % 7 AS CREDIT_DAY_OVERDUE,
       CASE WHEN o_orderkey % 7 > 4 THEN o_totalprice * 1e-1 ELSE 0e0 END AS AMT_CREDIT_SUM_OVERDUE,
       {DAYS.format(c='o_orderdate')} AS DAYS_CREDIT
FROM orders""",
    "bureau_balance": """
SELECT l_orderkey AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE,
       CASE WHEN l_linestatus = 'F' THEN 'C' ELSE CAST(l_linenumber % 6 AS VARCHAR) END AS STATUS
FROM lineitem""",
    "previous_application": f"""
SELECT o_custkey AS SK_ID_CURR,
       CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'P' THEN 'Refused' ELSE NULL END AS NAME_CONTRACT_STATUS,
       CASE WHEN o_orderkey % 10 = 0 THEN 0e0 ELSE o_totalprice END AS AMT_APPLICATION,
       CASE o_orderstatus WHEN 'P' THEN 0e0 ELSE o_totalprice * 9e-1 END AS AMT_CREDIT,
       {DAYS.format(c='o_orderdate')} AS DAYS_DECISION
FROM orders""",
    "installments_payments": f"""
SELECT o_custkey AS SK_ID_CURR,
       {DAYS.format(c='o_orderdate')} AS DAYS_INSTALMENT,
       CASE WHEN l_linenumber = 5 THEN NULL ELSE {DAYS.format(c='l_shipdate')} END AS DAYS_ENTRY_PAYMENT,
       CASE WHEN l_partkey % 13 = 0 THEN 0e0 ELSE l_extendedprice END AS AMT_INSTALMENT,
       l_extendedprice * (1e0 - l_discount) AS AMT_PAYMENT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pos_cash_balance": """
SELECT user_id AS SK_ID_CURR,
       CASE WHEN event_type = 'error' THEN CAST(floor(value) AS INTEGER) WHEN event_type = 'signup' THEN NULL ELSE 0 END AS SK_DPD
FROM events""",
    "credit_card_balance": """
SELECT user_id AS SK_ID_CURR, value AS AMT_BALANCE,
       CASE WHEN event_type = 'signup' THEN 0e0 ELSE 1e2 END AS AMT_CREDIT_LIMIT_ACTUAL,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS SK_DPD
FROM events""",
    "predictions": """
SELECT c_custkey AS application_id,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y_true,
       round(7.5e-1 * (CASE WHEN c_custkey % 8 = 0 THEN (c_custkey % 97) / 97e0 ELSE ((c_custkey * 7919) % 999983) / 999983e0 END) + CASE WHEN c_acctbal < 0 THEN 2.4e-1 ELSE 0e0 END, 6) AS y_proba
FROM customer""",
    "predictions_baseline": """
SELECT c_custkey AS application_id,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y_true,
       round(9e-1 * (((c_custkey * 104729) % 1013) / 1013e0) + CASE WHEN c_acctbal < 0 THEN 6e-2 ELSE 0e0 END, 6) AS y_proba
FROM customer""",
    "scored_pair": """
SELECT a.*, b.y_proba AS y_proba_alt FROM predictions a JOIN predictions_baseline b USING (application_id)""",
}

AGGS = {
    "agg_bureau_balance": """
SELECT SK_ID_BUREAU, count(*) AS BB_MONTHS,
       CAST(sum(CASE WHEN STATUS IN ('1','2','3','4','5') THEN 1 ELSE 0 END) AS BIGINT) AS BB_DPD_MONTHS
FROM bureau_balance WHERE SK_ID_BUREAU IS NOT NULL GROUP BY SK_ID_BUREAU""",
    "bureau_with_balance": """
SELECT b.*, bb.BB_MONTHS, bb.BB_DPD_MONTHS FROM bureau b LEFT JOIN agg_bureau_balance bb USING (SK_ID_BUREAU)""",
    "agg_bureau": """
SELECT SK_ID_CURR,
       count(*) AS BUREAU_N_CREDITS,
       CAST(sum(CASE WHEN CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END) AS BIGINT) AS BUREAU_N_ACTIVE,
       CAST(sum(CASE WHEN CREDIT_ACTIVE = 'Active' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS BUREAU_ACTIVE_RATIO,
       coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS BUREAU_DEBT_SUM,
       avg(AMT_CREDIT_SUM_DEBT) AS BUREAU_DEBT_MEAN,
       coalesce(sum(AMT_CREDIT_SUM), 0) AS BUREAU_CREDIT_SUM,
       avg(AMT_CREDIT_SUM) AS BUREAU_CREDIT_MEAN,
       max(CREDIT_DAY_OVERDUE) AS BUREAU_OVERDUE_MAX,
       coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0) AS BUREAU_AMT_OVERDUE_SUM,
       avg(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MEAN,
       CAST(coalesce(sum(BB_DPD_MONTHS), 0) AS BIGINT) AS BUREAU_BB_DPD_MONTHS_SUM
FROM bureau_with_balance WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""",
    "agg_previous_apps": """
SELECT SK_ID_CURR,
       count(*) AS PREV_N_APPS,
       avg(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END) AS PREV_APPROVED_RATIO,
       avg(CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END) AS PREV_REFUSED_RATIO,
       avg(AMT_APPLICATION) AS PREV_AMT_APPLICATION_MEAN,
       avg(AMT_CREDIT) AS PREV_AMT_CREDIT_MEAN,
       avg(AMT_CREDIT / NULLIF(AMT_APPLICATION, 0)) AS PREV_CREDIT_TO_APP_RATIO,
       avg(DAYS_DECISION) AS PREV_DAYS_DECISION_MEAN
FROM previous_application WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""",
    "agg_installments": """
SELECT SK_ID_CURR,
       count(*) AS INST_N_INSTALMENTS,
       avg(CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN 1 ELSE 0 END) AS INST_LATE_RATE,
       avg(CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0 ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END) AS INST_DPD_MEAN,
       max(CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0 ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END) AS INST_DPD_MAX,
       avg(CASE WHEN 1e0 - AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0) < 0 THEN 0e0
                ELSE 1e0 - AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0) END) AS INST_SHORTFALL_MEAN
FROM installments_payments WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""",
    "agg_pos": """
SELECT SK_ID_CURR,
       count(*) AS POS_N_MONTHS,
       avg(SK_DPD) AS POS_DPD_MEAN,
       max(SK_DPD) AS POS_DPD_MAX,
       CAST(count(*) FILTER (WHERE SK_DPD > 0) AS BIGINT) AS POS_N_LATE_MONTHS
FROM pos_cash_balance WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""",
    "agg_credit_card": """
SELECT SK_ID_CURR,
       count(*) AS CC_N_MONTHS,
       avg(AMT_BALANCE) AS CC_BALANCE_MEAN,
       avg(AMT_BALANCE / NULLIF(AMT_CREDIT_LIMIT_ACTUAL, 0)) AS CC_UTILIZATION_MEAN,
       avg(SK_DPD) AS CC_DPD_MEAN
FROM credit_card_balance WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR""",
}

ENRICHED = """
SELECT a.*,
       coalesce(b.BUREAU_N_CREDITS, 0) AS BUREAU_N_CREDITS, coalesce(b.BUREAU_N_ACTIVE, 0) AS BUREAU_N_ACTIVE,
       b.BUREAU_ACTIVE_RATIO, b.BUREAU_DEBT_SUM, b.BUREAU_DEBT_MEAN, b.BUREAU_CREDIT_SUM, b.BUREAU_CREDIT_MEAN,
       b.BUREAU_OVERDUE_MAX, b.BUREAU_AMT_OVERDUE_SUM, b.BUREAU_DAYS_CREDIT_MEAN,
       coalesce(b.BUREAU_BB_DPD_MONTHS_SUM, 0) AS BUREAU_BB_DPD_MONTHS_SUM,
       coalesce(p.PREV_N_APPS, 0) AS PREV_N_APPS, p.PREV_APPROVED_RATIO, p.PREV_REFUSED_RATIO,
       p.PREV_AMT_APPLICATION_MEAN, p.PREV_AMT_CREDIT_MEAN, p.PREV_CREDIT_TO_APP_RATIO, p.PREV_DAYS_DECISION_MEAN,
       coalesce(i.INST_N_INSTALMENTS, 0) AS INST_N_INSTALMENTS, i.INST_LATE_RATE, i.INST_DPD_MEAN, i.INST_DPD_MAX,
       i.INST_SHORTFALL_MEAN,
       coalesce(s.POS_N_MONTHS, 0) AS POS_N_MONTHS, s.POS_DPD_MEAN, s.POS_DPD_MAX,
       coalesce(s.POS_N_LATE_MONTHS, 0) AS POS_N_LATE_MONTHS,
       coalesce(c.CC_N_MONTHS, 0) AS CC_N_MONTHS, c.CC_BALANCE_MEAN, c.CC_UTILIZATION_MEAN, c.CC_DPD_MEAN
FROM application a
LEFT JOIN agg_bureau b USING (SK_ID_CURR)
LEFT JOIN agg_previous_apps p USING (SK_ID_CURR)
LEFT JOIN agg_installments i USING (SK_ID_CURR)
LEFT JOIN agg_pos s USING (SK_ID_CURR)
LEFT JOIN agg_credit_card c USING (SK_ID_CURR)"""

# dependency order of the named CTEs
_CTE_ORDER = (list(ADAPTERS) + ["agg_bureau_balance", "bureau_with_balance", "agg_bureau",
              "agg_previous_apps", "agg_installments", "agg_pos", "agg_credit_card", "enriched"])
_CTE_TEXT = {**ADAPTERS, **AGGS, "enriched": ENRICHED}


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs (and everything they depend on)."""
    needed = set()
    deps = {
        "bureau_with_balance": ["bureau", "agg_bureau_balance"],
        "agg_bureau_balance": ["bureau_balance"],
        "agg_bureau": ["bureau_with_balance"],
        "agg_previous_apps": ["previous_application"],
        "agg_installments": ["installments_payments"],
        "agg_pos": ["pos_cash_balance"],
        "agg_credit_card": ["credit_card_balance"],
        "scored_pair": ["predictions", "predictions_baseline"],
        "enriched": ["application", "agg_bureau", "agg_previous_apps", "agg_installments",
                     "agg_pos", "agg_credit_card"],
    }

    def visit(n):
        if n in needed:
            return
        needed.add(n)
        for d in deps.get(n, []):
            visit(d)
    for n in names:
        visit(n)
    parts = [f"{n} AS ({_CTE_TEXT[n]}\n)" for n in _CTE_ORDER if n in needed]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def round_all(select_list: list[str]) -> str:
    return ", ".join(select_list)


# Spark type names of the enriched application table (schema metadata the
# Spark side reads from df.schema; restated here for the SQL oracle).
ENRICHED_TYPES = {
    "SK_ID_CURR": "bigint", "TARGET": "int", "AMT_INCOME_TOTAL": "double", "AMT_CREDIT": "double",
    "DAYS_BIRTH": "bigint", "CODE_GENDER": "string", "REGION_CODE": "int", "FLAG_MOBIL": "int",
    "BUREAU_N_CREDITS": "bigint", "BUREAU_N_ACTIVE": "bigint", "BUREAU_ACTIVE_RATIO": "double",
    "BUREAU_DEBT_SUM": "double", "BUREAU_DEBT_MEAN": "double", "BUREAU_CREDIT_SUM": "double",
    "BUREAU_CREDIT_MEAN": "double", "BUREAU_OVERDUE_MAX": "bigint", "BUREAU_AMT_OVERDUE_SUM": "double",
    "BUREAU_DAYS_CREDIT_MEAN": "double", "BUREAU_BB_DPD_MONTHS_SUM": "bigint", "PREV_N_APPS": "bigint",
    "PREV_APPROVED_RATIO": "double", "PREV_REFUSED_RATIO": "double", "PREV_AMT_APPLICATION_MEAN": "double",
    "PREV_AMT_CREDIT_MEAN": "double", "PREV_CREDIT_TO_APP_RATIO": "double", "PREV_DAYS_DECISION_MEAN": "double",
    "INST_N_INSTALMENTS": "bigint", "INST_LATE_RATE": "double", "INST_DPD_MEAN": "double", "INST_DPD_MAX": "int",
    "INST_SHORTFALL_MEAN": "double", "POS_N_MONTHS": "bigint", "POS_DPD_MEAN": "double", "POS_DPD_MAX": "int",
    "POS_N_LATE_MONTHS": "bigint", "CC_N_MONTHS": "bigint", "CC_BALANCE_MEAN": "double",
    "CC_UTILIZATION_MEAN": "double", "CC_DPD_MEAN": "double",
}
ENRICHED_COLS = list(ENRICHED_TYPES)
ENRICHED_NUMERIC = [c for c, t in ENRICHED_TYPES.items() if t != "string"]
ENRICHED_CATEGORICAL = [c for c, t in ENRICHED_TYPES.items() if t == "string"]

FEATURE_GROUP_SQL = """CASE
  WHEN regexp_matches({c}, '^AMT_') THEN 'amount'
  WHEN regexp_matches({c}, '^DAYS_') THEN 'days'
  WHEN regexp_matches({c}, '^NAME_') THEN 'name'
  WHEN regexp_matches({c}, '^CODE_') THEN 'code'
  WHEN regexp_matches({c}, '^FLAG_') THEN 'flag'
  WHEN regexp_matches({c}, '^CNT_') THEN 'count'
  WHEN regexp_matches({c}, '^REG_') THEN 'region'
  WHEN regexp_matches({c}, '^EXT_SOURCE') THEN 'ext_source'
  WHEN regexp_matches({c}, 'BUREAU') THEN 'bureau'
  WHEN regexp_matches({c}, 'DOCUMENT') THEN 'document'
  ELSE 'other' END"""


def dtype_case(col: str, types: dict[str, str] = ENRICHED_TYPES) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in types.items())
    return f"CASE {col} {whens} END"


def missing_union(table: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {i} AS pos, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS r FROM {table}"
        for i, c in enumerate(cols))


def unpivot_numeric(table: str, cols: list[str], keep: list[str] | None = None) -> str:
    keep = keep or []
    casts = ", ".join(keep + [f"CAST({c} AS DOUBLE) AS {c}" for c in cols])
    return (f"(SELECT * FROM (SELECT {casts} FROM {table}) UNPIVOT INCLUDE NULLS "
            f"(value FOR feature IN ({', '.join(cols)})))")


def unpivot_categorical(table: str, cols: list[str]) -> str:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
    return (f"(SELECT * FROM (SELECT {casts} FROM {table}) UNPIVOT INCLUDE NULLS "
            f"(value FOR feature IN ({', '.join(cols)})))")
