"""Query catalog: every SURVEY §2 operator wired to the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB
SQL over the same parquet views). Each query reads whole tables through
the adapters, so its work grows with the data. Doubles are rounded to 6
decimals on both sides (summation order differs across partitions).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskweave.operators import rollup
from riskweave.plans.oracle_sql import with_ctes
from riskweave.sources import adapters as A
from riskweave.sources.io import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def snap_rounds(sql: str) -> str:
    """Rewrite every ``round(x, d)`` into exact-decimal rounding after a 9-decimal snap
    (the Spark side's :func:`rround`), so both engines resolve float noise the same way."""
    out, i, low = [], 0, sql          # lower-case round( only: upper-case ROUND( is left as written
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 5, None
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma is None:
            out.append(sql[i:k + 1])
            i = k + 1
            continue
        inner = snap_rounds(sql[j + 6:comma])
        digits = sql[comma + 1:k].strip()
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST(({inner}) AS DECIMAL(38,9)), {digits}) AS DOUBLE)")
        i = k + 1


def register(name: str, sql: str | None = None, round_digits: int | None = 6):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df, round_digits) if round_digits is not None else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = snap_rounds(sql)
        return run
    return deco


def rounded(body: str, doubles: list[str], digits: int = 6) -> str:
    """Wrap an oracle body so its double columns are rounded like the Spark side."""
    if not doubles:
        return body
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) _q"


def double_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


# ---------------------------------------------------------------- roll-ups
_BUREAU_DBL = ["BUREAU_ACTIVE_RATIO", "BUREAU_DEBT_SUM", "BUREAU_DEBT_MEAN", "BUREAU_CREDIT_SUM",
               "BUREAU_CREDIT_MEAN", "BUREAU_AMT_OVERDUE_SUM", "BUREAU_DAYS_CREDIT_MEAN"]
_PREV_DBL = ["PREV_APPROVED_RATIO", "PREV_REFUSED_RATIO", "PREV_AMT_APPLICATION_MEAN", "PREV_AMT_CREDIT_MEAN",
             "PREV_CREDIT_TO_APP_RATIO", "PREV_DAYS_DECISION_MEAN"]
_INST_DBL = ["INST_LATE_RATE", "INST_DPD_MEAN", "INST_SHORTFALL_MEAN"]
_POS_DBL = ["POS_DPD_MEAN"]
_CC_DBL = ["CC_BALANCE_MEAN", "CC_UTILIZATION_MEAN", "CC_DPD_MEAN"]
_APP_DBL = ["AMT_INCOME_TOTAL", "AMT_CREDIT"]


@register("agg_bureau_balance", rounded(with_ctes("SELECT * FROM agg_bureau_balance", "agg_bureau_balance"), []))
def q_agg_bureau_balance(spark, sf):
    return rollup.agg_bureau_balance(A.bureau_balance(spark, sf))


@register("bureau_with_balance", rounded(with_ctes("SELECT * FROM bureau_with_balance", "bureau_with_balance"),
                                         ["AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_OVERDUE"]))
def q_bureau_with_balance(spark, sf):
    return rollup.bureau_with_balance(A.bureau(spark, sf), A.bureau_balance(spark, sf))


@register("agg_bureau", rounded(with_ctes("SELECT * FROM agg_bureau", "agg_bureau"), _BUREAU_DBL))
def q_agg_bureau(spark, sf):
    return rollup.agg_bureau(A.bureau(spark, sf), A.bureau_balance(spark, sf))


@register("agg_previous_apps", rounded(with_ctes("SELECT * FROM agg_previous_apps", "agg_previous_apps"), _PREV_DBL))
def q_agg_previous_apps(spark, sf):
    return rollup.agg_previous_apps(A.previous_application(spark, sf))


@register("agg_installments", rounded(with_ctes("SELECT * FROM agg_installments", "agg_installments"), _INST_DBL))
def q_agg_installments(spark, sf):
    return rollup.agg_installments(A.installments_payments(spark, sf))


@register("agg_pos", rounded(with_ctes("SELECT * FROM agg_pos", "agg_pos"), _POS_DBL))
def q_agg_pos(spark, sf):
    return rollup.agg_pos(A.pos_cash_balance(spark, sf))


@register("agg_credit_card", rounded(with_ctes("SELECT * FROM agg_credit_card", "agg_credit_card"), _CC_DBL))
def q_agg_credit_card(spark, sf):
    return rollup.agg_credit_card(A.credit_card_balance(spark, sf))


ENRICHED_DBL = _APP_DBL + _BUREAU_DBL + _PREV_DBL + _INST_DBL + _POS_DBL + _CC_DBL


def enriched_applications(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.enrich_applications(A.application(spark, sf), A.lending_sources(spark, sf))


@register("enrich_from_csv", rounded(with_ctes("SELECT * FROM enriched", "enriched"), ENRICHED_DBL))
def q_enrich_from_csv(spark, sf):
    """The flagship from CSV files without schemas: the applications and six histories are written as CSV, typed from their values and enriched."""
    from riskweave.session import reliable_checkpoint, scratch_folder
    from riskweave.sources.io import SourceSpec, SourcesConfig, load_sources
    with scratch_folder(spark, "csv") as folder:
        tables = {"base": A.application(spark, sf)} | A.lending_sources(spark, sf)
        for name, df in tables.items():
            df.write.option("header", True).csv(f"{folder}/{name}.csv")
        cfg = SourcesConfig(f"{folder}/base.csv", {n: SourceSpec(f"{folder}/{n}.csv") for n in tables if n != "base"})
        base, sources = load_sources(spark, cfg)
        return reliable_checkpoint(rollup.enrich_applications(base, sources))


@register("enrich_applications", rounded(with_ctes("SELECT * FROM enriched", "enriched"), ENRICHED_DBL))
def q_enrich_applications(spark, sf):
    """Flagship: 31 relational features joined onto every applicant."""
    return enriched_applications(spark, sf)


# ---------------------------------------------------------------- validation & profiling (B, E7–E10)
from pyspark.sql import functions as F  # noqa: E402

from riskweave.functions import expr as X  # noqa: E402
from riskweave.operators import checks, profile, segments  # noqa: E402
from riskweave.plans import oracle_sql as O  # noqa: E402

RUN_ID, CREATED_AT = "20260101_000000", "2026-01-01T00:00:00+00:00"


@register("invalid_target_values", with_ctes(
    "SELECT DISTINCT REGION_CODE AS invalid_value FROM enriched "
    "WHERE REGION_CODE IS NOT NULL AND REGION_CODE <> 0 AND REGION_CODE <> 1", "enriched"))
def q_invalid_target_values(spark, sf):
    """B2 on a column of region codes, most of which are no target."""
    return checks.invalid_binary_values(enriched_applications(spark, sf), "REGION_CODE")


@register("invalid_scores", with_ctes(
    "SELECT * FROM (SELECT application_id, y_true, CASE WHEN application_id % 50 = 0 THEN NULL ELSE y_proba * 1.25e0 END AS y_proba "
    "FROM predictions) WHERE y_proba IS NULL OR y_proba < 0 OR y_proba > 1", "predictions"))
def q_invalid_scores(spark, sf):
    """B7 on scores stretched beyond 1, some missing."""
    stretched = F.when(F.col("application_id") % 50 != 0, F.col("y_proba") * 1.25)
    return checks.invalid_scores(A.predictions(spark, sf).withColumn("y_proba", stretched), "y_proba", "y_true")


@register("data_shape", with_ctes(f"SELECT count(*) AS rows, {len(O.ENRICHED_COLS)} AS columns FROM enriched",
                                  "enriched"))
def q_data_shape(spark, sf):
    return profile.data_shape(enriched_applications(spark, sf))


@register("missingness", with_ctes(
    f"SELECT \"column\", round(r, 6) AS missing_ratio FROM ({O.missing_union('enriched', O.ENRICHED_COLS)})",
    "enriched"))
def q_missingness(spark, sf):
    return profile.missingness(enriched_applications(spark, sf))


@register("column_types", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS n_present FROM enriched" for c, t in O.ENRICHED_TYPES.items()), "enriched"))
def q_column_types(spark, sf):
    return profile.column_types(enriched_applications(spark, sf))


@register("target_stats", with_ctes(
    "SELECT TARGET AS target_value, count(*) AS count, "
    "round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM enriched) * 100, 4) AS pct "
    "FROM enriched WHERE TARGET IS NOT NULL GROUP BY TARGET", "enriched"))
def q_target_stats(spark, sf):
    return profile.target_stats(enriched_applications(spark, sf))


@register("kpi_overview", with_ctes(f"""
SELECT '{RUN_ID}' AS run_id, '{CREATED_AT}' AS created_at,
       (SELECT count(*) FROM enriched) AS n_rows, {len(O.ENRICHED_COLS)} AS n_cols,
       round((SELECT CAST(sum(TARGET) AS DOUBLE) / count(*) FROM enriched), 6) AS default_rate,
       round(avg(r), 6) AS avg_missing_rate,
       round(CAST(count(*) FILTER (WHERE r > 0.4) AS DOUBLE) / count(*) * 100, 4) AS pct_columns_missing_gt_40
FROM ({O.missing_union('enriched', O.ENRICHED_COLS)})""", "enriched"))
def q_kpi_overview(spark, sf):
    return profile.kpi_overview(enriched_applications(spark, sf), RUN_ID, CREATED_AT)


@register("missingness_by_feature", with_ctes(f"""
SELECT "column" AS feature, round(r, 6) AS missing_rate, {O.dtype_case('"column"')} AS dtype,
       {O.FEATURE_GROUP_SQL.format(c='"column"')} AS feature_group
FROM ({O.missing_union('enriched', O.ENRICHED_COLS)})""", "enriched"))
def q_missingness_by_feature(spark, sf):
    return profile.missingness_by_feature(enriched_applications(spark, sf))


_SUMMARY_NUM_SQL = f"""
SELECT feature, {O.dtype_case('feature')} AS dtype, count(value) AS n,
       round(CAST(count(*) - count(value) AS DOUBLE) / count(*), 6) AS missing_rate,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.95), 6) AS p95,
       CAST(NULL AS VARCHAR) AS top1, CAST(NULL AS DOUBLE) AS top1_rate,
       CAST(NULL AS VARCHAR) AS top2, CAST(NULL AS DOUBLE) AS top2_rate,
       {O.FEATURE_GROUP_SQL.format(c='feature')} AS feature_group
FROM {O.unpivot_numeric('enriched', O.ENRICHED_NUMERIC)} GROUP BY feature"""

_SUMMARY_CAT_SQL = f"""
SELECT b.feature, {O.dtype_case('b.feature')} AS dtype, b.n,
       round(CAST(b.rows_ - b.n AS DOUBLE) / b.rows_, 6) AS missing_rate,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS p05,
       CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p95,
       t1.value AS top1, round(CAST(t1.c AS DOUBLE) / b.n * 100, 4) AS top1_rate,
       t2.value AS top2, round(CAST(t2.c AS DOUBLE) / b.n * 100, 4) AS top2_rate,
       {O.FEATURE_GROUP_SQL.format(c='b.feature')} AS feature_group
FROM (SELECT feature, count(value) AS n, count(*) AS rows_ FROM lng GROUP BY feature) b
LEFT JOIN ranked t1 ON t1.feature = b.feature AND t1.rk = 1
LEFT JOIN ranked t2 ON t2.feature = b.feature AND t2.rk = 2"""

_SUMMARY_CAT_CTES = f""", lng AS (SELECT * FROM {O.unpivot_categorical('enriched', O.ENRICHED_CATEGORICAL)}),
vc AS (SELECT feature, value, count(*) AS c FROM lng WHERE value IS NOT NULL GROUP BY feature, value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY c DESC, value) AS rk FROM vc)
"""


def _cat_sql() -> str:
    base = with_ctes("SELECT 1", "enriched")
    ctes = base[: base.rindex("\nSELECT 1")]
    return ctes + _SUMMARY_CAT_CTES + _SUMMARY_CAT_SQL


@register("feature_summary_numeric", with_ctes(_SUMMARY_NUM_SQL, "enriched"))
def q_feature_summary_numeric(spark, sf):
    return profile.feature_summary_numeric(enriched_applications(spark, sf))


@register("feature_summary_categorical", _cat_sql())
def q_feature_summary_categorical(spark, sf):
    return profile.feature_summary_categorical(enriched_applications(spark, sf))


@register("feature_summary", _cat_sql() + "\nUNION ALL\n" + _SUMMARY_NUM_SQL)
def q_feature_summary(spark, sf):
    return profile.feature_summary(enriched_applications(spark, sf))


_CORR_NUM = [c for c in O.ENRICHED_NUMERIC if c != "TARGET"]


_CORR_BODY = f"""
SELECT feature, round(r, 6) AS corr_with_target FROM (
  SELECT feature, CASE WHEN min(value) = max(value) OR min(y) = max(y) THEN NULL
                       ELSE covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y)) END AS r
  FROM (SELECT * FROM {O.unpivot_numeric('enriched', _CORR_NUM, ['CAST(TARGET AS DOUBLE) AS y'])})
  WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY feature) WHERE r IS NOT NULL AND NOT isnan(r)"""


@register("correlation_top", with_ctes(_CORR_BODY, "enriched"))
def q_correlation_top(spark, sf):
    return profile.correlation_top(enriched_applications(spark, sf))


# ---------------------------------------------------------------- segments
def _qbin_sql(table: str, col: str, n: int, labels: list[str], where: str = "") -> str:
    probs = ", ".join(str(i / n) for i in range(1, n))
    arr = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE {arr}[1 + len(list_filter("
            f"(SELECT quantile_cont({col}, [{probs}]) FROM {table} {where}), lambda e: {col} > e))] END")


_AGE_SQL = "round(-DAYS_BIRTH / 365.25e0, 1)"
_AGE_BAND_SQL = ("CASE WHEN a >= 0 AND a < 25 THEN '<25' WHEN a >= 25 AND a < 35 THEN '25-35' "
                 "WHEN a >= 35 AND a < 45 THEN '35-45' WHEN a >= 45 AND a < 55 THEN '45-55' "
                 "WHEN a >= 55 AND a < 65 THEN '55-65' WHEN a >= 65 AND a < 120 THEN '65+' END")
_Q5 = [f"q{i}" for i in range(1, 6)]


def _seg_sql(name: str, label_sql: str, table: str = "enriched") -> str:
    return (f"SELECT '{name}' AS segment_name, v AS segment_value, count(*) AS n, "
            f"round(avg(TARGET), 6) AS default_rate FROM (SELECT {label_sql} AS v, TARGET FROM {table}) "
            f"WHERE v IS NOT NULL GROUP BY v")


_SEG_INCOME = _seg_sql("income_band", _qbin_sql("enriched", "AMT_INCOME_TOTAL", 5, _Q5))
_SEG_AGE = _seg_sql("age_band", _AGE_BAND_SQL.replace("a ", f"({_AGE_SQL}) ").replace("a >=", f"({_AGE_SQL}) >="))
_SEG_CREDIT = _seg_sql("credit_amount_band", _qbin_sql("enriched", "AMT_CREDIT", 5, _Q5))
_SEG_GENDER = _seg_sql("gender", "CODE_GENDER")
_SEG_ALL = "\nUNION ALL\n".join([_SEG_INCOME, _SEG_AGE, _SEG_CREDIT, _SEG_GENDER])


@register("quantile_bin", with_ctes(
    f"SELECT SK_ID_CURR, AMT_CREDIT, {_qbin_sql('application', 'AMT_CREDIT', 5, _Q5)} AS AMT_CREDIT_bin "
    f"FROM application", "application"))
def q_quantile_bin(spark, sf):
    app = A.application(spark, sf).select("SK_ID_CURR", "AMT_CREDIT")
    return segments.quantile_bin(app, "AMT_CREDIT", 5)


@register("risk_band", with_ctes(
    f"SELECT *, {_qbin_sql('predictions', 'y_proba', 3, ['Low', 'Medium', 'High'])} AS risk_band FROM predictions",
    "predictions"))
def q_risk_band(spark, sf):
    return segments.risk_band(A.predictions(spark, sf), "y_proba")


@register("segments_quantile", with_ctes(_SEG_INCOME, "enriched"))
def q_segments_quantile(spark, sf):
    return segments.segments_by_quantile(enriched_applications(spark, sf), "AMT_INCOME_TOTAL", "income_band", 5)


@register("segments_age_band", with_ctes(_SEG_AGE, "enriched"))
def q_segments_age_band(spark, sf):
    return segments.segments_by_band(enriched_applications(spark, sf))


@register("segments_category", with_ctes(_SEG_GENDER, "enriched"))
def q_segments_category(spark, sf):
    return segments.segments_by_category(enriched_applications(spark, sf), "CODE_GENDER", "gender")


@register("population_segments", with_ctes(_SEG_ALL, "enriched"))
def q_population_segments(spark, sf):
    return segments.population_segments(enriched_applications(spark, sf))


@register("segment_extremes", with_ctes(f"""
SELECT segment_name,
       sum(default_rate * n) / CAST(sum(n) AS DOUBLE) AS weighted_default_rate,
       min(segment_value) FILTER (WHERE default_rate = mx) AS riskiest_value, max(mx) AS riskiest_rate,
       min(segment_value) FILTER (WHERE default_rate = mn) AS safest_value, max(mn) AS safest_rate,
       max(mx) - max(mn) AS spread
FROM (SELECT *, max(default_rate) OVER (PARTITION BY segment_name) AS mx,
             min(default_rate) OVER (PARTITION BY segment_name) AS mn FROM ({_SEG_ALL}))
GROUP BY segment_name""", "enriched"))
def q_segment_extremes(spark, sf):
    return segments.segment_extremes(segments.population_segments(enriched_applications(spark, sf)))


# ---------------------------------------------------------------- scalar expressions
@register("safe_div", with_ctes(
    "SELECT SK_ID_CURR, AMT_CREDIT / NULLIF(AMT_APPLICATION, 0) AS credit_to_app FROM previous_application",
    "previous_application"))
def q_safe_div(spark, sf):
    p = A.previous_application(spark, sf)
    return p.select("SK_ID_CURR", X.safe_div("AMT_CREDIT", "AMT_APPLICATION").alias("credit_to_app"))


@register("payment_lateness", with_ctes("""
SELECT SK_ID_CURR, dpd, CASE WHEN dpd > 0 THEN 1 ELSE 0 END AS is_late FROM (
  SELECT SK_ID_CURR, CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0
                          ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END AS dpd FROM installments_payments)""",
    "installments_payments"))
def q_payment_lateness(spark, sf):
    i = A.installments_payments(spark, sf)
    dpd = X.days_past_due("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")
    return i.select("SK_ID_CURR", dpd.alias("dpd"), X.is_late(dpd).alias("is_late"))


@register("payment_shortfall", with_ctes("""
SELECT SK_ID_CURR, CASE WHEN 1e0 - AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0) < 0 THEN 0e0
                        ELSE 1e0 - AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0) END AS shortfall
FROM installments_payments""", "installments_payments"))
def q_payment_shortfall(spark, sf):
    i = A.installments_payments(spark, sf)
    return i.select("SK_ID_CURR", X.payment_shortfall("AMT_PAYMENT", "AMT_INSTALMENT").alias("shortfall"))


@register("utilization", with_ctes(
    "SELECT SK_ID_CURR, AMT_BALANCE / NULLIF(AMT_CREDIT_LIMIT_ACTUAL, 0) AS utilization FROM credit_card_balance",
    "credit_card_balance"))
def q_utilization(spark, sf):
    c = A.credit_card_balance(spark, sf)
    return c.select("SK_ID_CURR", X.utilization("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL").alias("utilization"))


@register("age_years", with_ctes(f"SELECT SK_ID_CURR, {_AGE_SQL} AS age_years FROM application", "application"))
def q_age_years(spark, sf):
    return A.application(spark, sf).select("SK_ID_CURR", X.age_years("DAYS_BIRTH").alias("age_years"))


@register("age_band", with_ctes(
    f"SELECT SK_ID_CURR, {_AGE_BAND_SQL} AS age_band FROM (SELECT SK_ID_CURR, {_AGE_SQL} AS a FROM application)",
    "application"))
def q_age_band(spark, sf):
    return A.application(spark, sf).select("SK_ID_CURR", X.age_band(X.age_years("DAYS_BIRTH")).alias("age_band"))


_NAMES_SQL = f"(SELECT \"column\" AS feature, round(r, 6) AS missing_ratio FROM ({O.missing_union('enriched', O.ENRICHED_COLS)}))"


def _feature_names(spark, sf):
    return profile.missingness(enriched_applications(spark, sf)).select(F.col("column").alias("feature"), "missing_ratio")


@register("feature_group", with_ctes(
    f"SELECT feature, missing_ratio, {O.FEATURE_GROUP_SQL.format(c='feature')} AS feature_group FROM {_NAMES_SQL}", "enriched"))
def q_feature_group(spark, sf):
    return _feature_names(spark, sf).select("feature", "missing_ratio", X.feature_group("feature").alias("feature_group"))


_IMP_SQL = """CASE
  WHEN contains(upper(feature), 'EXT_SOURCE') THEN 'External Bureau'
  WHEN starts_with(upper(feature), 'AMT') THEN 'Loan Amounts'
  WHEN starts_with(upper(feature), 'DAYS') THEN 'Temporal / Age'
  WHEN contains(upper(feature), 'NAME_') OR contains(upper(feature), 'CODE_') OR contains(upper(feature), 'GENDER')
    OR contains(upper(feature), 'EDUCATION') OR contains(upper(feature), 'OCCUPATION')
    OR contains(upper(feature), 'FAMILY') OR contains(upper(feature), 'HOUSING')
    OR contains(upper(feature), 'ORGANIZATION') OR contains(upper(feature), 'TYPE') THEN 'Demographics'
  WHEN contains(upper(feature), 'REGION') OR contains(upper(feature), 'CITY')
    OR contains(upper(feature), 'RATING') THEN 'Geography'
  WHEN contains(upper(feature), 'FLAG_') OR contains(upper(feature), 'OWN_') OR contains(upper(feature), 'REG_')
    OR contains(upper(feature), 'LIVE_') THEN 'Flags'
  ELSE 'Other' END"""


@register("importance_group", with_ctes(f"SELECT feature, missing_ratio, {_IMP_SQL} AS importance_group FROM {_NAMES_SQL}",
                                        "enriched"))
def q_importance_group(spark, sf):
    return _feature_names(spark, sf).select("feature", "missing_ratio", X.importance_group("feature").alias("importance_group"))


@register("missing_severity", with_ctes(f"""
SELECT "column" AS feature, round(r, 6) AS missing_rate,
       CASE WHEN round(r, 6) > 0.5 THEN 'high' WHEN round(r, 6) > 0.2 THEN 'medium' ELSE 'low' END AS severity
FROM ({O.missing_union('enriched', O.ENRICHED_COLS)})""", "enriched"))
def q_missing_severity(spark, sf):
    m = profile.missingness(enriched_applications(spark, sf))
    return m.select(F.col("column").alias("feature"), F.col("missing_ratio").alias("missing_rate"),
                    X.missing_severity("missing_ratio").alias("severity"))


@register("clean_feature_name", with_ctes(f"""
SELECT pref AS encoded_name, missing_ratio, regexp_replace(pref, '^(num__|cat__)', '') AS feature FROM (
  SELECT missing_ratio, CASE WHEN {O.dtype_case('feature')} = 'string' THEN 'cat__' ELSE 'num__' END || feature AS pref
  FROM {_NAMES_SQL})""", "enriched"))
def q_clean_feature_name(spark, sf):
    df = enriched_applications(spark, sf)
    kinds = {f.name: ("num__" if profile.is_numeric(f.dataType) else "cat__") for f in df.schema.fields}
    kind_map = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    names = _feature_names(spark, sf).select(F.concat(kind_map[F.col("feature")], F.col("feature")).alias("encoded_name"), "missing_ratio")
    return names.select("encoded_name", "missing_ratio", X.clean_feature_name("encoded_name").alias("feature"))


@register("corr_direction", with_ctes(
    "SELECT feature, corr_with_target, CASE WHEN corr_with_target > 0 THEN 'raises risk' ELSE 'lowers risk' END "
    f"AS direction FROM ({_CORR_BODY})", "enriched"))
def q_corr_direction(spark, sf):
    c = profile.correlation_top(enriched_applications(spark, sf))
    return c.select("feature", "corr_with_target", X.corr_direction("corr_with_target").alias("direction"))


@register("decisions", with_ctes(
    "SELECT application_id, y_proba, y_proba < 0.2 AS approved, y_proba >= 0.2 AS predicted_default FROM predictions",
    "predictions"))
def q_decisions(spark, sf):
    p = A.predictions(spark, sf)
    return p.select("application_id", "y_proba", X.approve("y_proba", 0.2).alias("approved"),
                    X.predicted_default("y_proba", 0.2).alias("predicted_default"))


# ---------------------------------------------------------------- decisions
from riskweave.operators import decisions as D  # noqa: E402
from riskweave.operators import evaluate as EV  # noqa: E402


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# written out, not taken from the code under test
_SWEEP_VALUES = ("(0.05e0), (0.1e0), (0.15e0), (0.2e0), (0.25e0), (0.3e0), (0.35e0), (0.4e0), (0.45e0), (0.5e0), (0.55e0), (0.6e0), "
                 "(0.65e0), (0.7e0), (0.75e0), (0.8e0), (0.85e0), (0.9e0)")
_SCEN_VALUES = "(0, 'Base', 0.2e0, 0.2e0, 1e0), (1, 'Conservative', 0.1e0, 0.2e0, 1e0), (2, 'Aggressive', 0.3e0, 0.25e0, 1e0)"

_COUNTS_AT = """SELECT t.threshold, count(*) AS n,
       count(*) FILTER (WHERE y_proba < t.threshold) AS approved,
       count(*) FILTER (WHERE y_proba < t.threshold AND y_true = 0) AS good,
       count(*) FILTER (WHERE y_proba < t.threshold AND y_true = 1) AS bad
FROM {params} AS t(threshold), predictions GROUP BY t.threshold"""

_SWEEP_BODY = f"""
SELECT threshold,
       round(CASE WHEN n > 0 THEN CAST(approved AS DOUBLE) / n ELSE 0e0 END, 6) AS approval_rate,
       round(CASE WHEN approved > 0 THEN CAST(bad AS DOUBLE) / approved ELSE 0e0 END, 6) AS default_rate_among_approved,
       round(good * 0.2e0, 6) AS expected_profit,
       round(bad * 1e0, 6) AS expected_loss,
       round(good * 0.2e0 - bad * 1e0, 6) AS expected_value
FROM ({_COUNTS_AT.format(params=f"(VALUES {_SWEEP_VALUES})")})"""

_SCEN_BODY = f"""
SELECT s.scenario_order, s.scenario_name, s.threshold, s.profit_if_good, s.loss_given_default,
       round(CASE WHEN n > 0 THEN CAST(approved AS DOUBLE) / n ELSE 0e0 END, 6) AS approval_rate,
       round(CASE WHEN approved > 0 THEN CAST(bad AS DOUBLE) / approved ELSE 0e0 END, 6) AS default_rate,
       round(good * s.profit_if_good, 6) AS expected_profit,
       round(bad * s.loss_given_default, 6) AS expected_loss,
       round(good * s.profit_if_good - bad * s.loss_given_default, 6) AS net_value
FROM (VALUES {_SCEN_VALUES}) AS s(scenario_order, scenario_name, threshold, profit_if_good, loss_given_default)
JOIN ({_COUNTS_AT.format(params=f"(SELECT DISTINCT threshold FROM (VALUES {_SCEN_VALUES}) "
                                 "AS v(o, nm, threshold, pg, lg))")}) c USING (threshold)"""


def _sweep(spark, sf):
    return D.threshold_sweep(A.predictions(spark, sf))


def _scenarios(spark, sf):
    return D.scenario_results(A.predictions(spark, sf))


@register("threshold_sweep", with_ctes(_SWEEP_BODY, "predictions"))
def q_threshold_sweep(spark, sf):
    return _sweep(spark, sf)


@register("scenario_results", with_ctes(_SCEN_BODY, "predictions"))
def q_scenario_results(spark, sf):
    return _scenarios(spark, sf)


@register("optimal_threshold", with_ctes(
    f"SELECT * FROM ({_SWEEP_BODY}) ORDER BY expected_value DESC, threshold ASC LIMIT 1", "predictions"))
def q_optimal_threshold(spark, sf):
    return D.optimal_threshold(_sweep(spark, sf))


@register("value_vs_optimal", with_ctes(
    f"SELECT *, expected_value - max(expected_value) OVER () AS delta_vs_optimal FROM ({_SWEEP_BODY})", "predictions"))
def q_value_vs_optimal(spark, sf):
    return D.value_vs_optimal(_sweep(spark, sf))


@register("portfolio_projection", with_ctes(
    f"SELECT threshold, 100e0 AS scale, expected_profit * 100e0 AS projected_profit, "
    f"expected_loss * 100e0 AS projected_loss, expected_value * 100e0 AS projected_value FROM ({_SWEEP_BODY})",
    "predictions"))
def q_portfolio_projection(spark, sf):
    return D.portfolio_projection(_sweep(spark, sf), 100.0)


@register("best_scenario", with_ctes(f"""
SELECT (SELECT scenario_name FROM s ORDER BY net_value DESC, scenario_order LIMIT 1) AS best_scenario,
       (SELECT net_value FROM s ORDER BY net_value DESC, scenario_order LIMIT 1) AS best_net_value,
       (SELECT default_rate FROM s ORDER BY net_value DESC, scenario_order LIMIT 1) AS best_default_rate,
       (SELECT max(net_value) FROM s WHERE scenario_name = 'Conservative') AS reference_net_value
FROM (SELECT 1) _one, LATERAL (SELECT 1) _l""".replace("FROM s ", f"FROM ({_SCEN_BODY}) s "), "predictions"))
def q_best_scenario(spark, sf):
    return D.best_scenario(_scenarios(spark, sf))


# ---------------------------------------------------------------- evaluation (G, H, E16, E17)
_SC = """(SELECT y_proba AS score, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg
          FROM {t} WHERE y_proba IS NOT NULL AND y_true IS NOT NULL GROUP BY y_proba)"""


def _asc(t: str = "predictions") -> str:
    return (f"(SELECT *, sum(pos) OVER (ORDER BY score) AS cp, sum(neg) OVER (ORDER BY score) AS cn, "
            f"sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM {_SC.format(t=t)})")


def _desc(t: str = "predictions") -> str:
    return (f"(SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn, "
            f"sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM {_SC.format(t=t)})")


_EPS = "2.220446049250313e-16"
_Q = f"least(greatest(y_proba, {_EPS}), 1e0 - {_EPS})"


def _metrics_sql(t: str) -> str:
    return f"""SELECT
  (SELECT round(sum(pos * (cn - neg / 2e0)) / (max(P) * max(N)), 6) FROM {_asc(t)}) AS auc_roc,
  (SELECT round(sum(pos * cp / (cp + cn)) / max(P), 6) FROM {_desc(t)}) AS average_precision,
  (SELECT round(avg(pow(y_proba - y_true, 2)), 6) FROM {t}) AS brier_score,
  (SELECT round(avg(-(y_true * ln({_Q}) + (1 - y_true) * ln(1e0 - {_Q}))), 6) FROM {t}) AS log_loss"""


_AUC_SQL = f"SELECT sum(pos * (cn - neg / 2e0)) / (max(P) * max(N)) AS auc_roc FROM {_asc()}"


@register("ks_statistic", with_ctes(
    f"SELECT round(max(abs(cp / P - cn / N)), 4) AS ks_statistic FROM {_asc()}", "predictions"))
def q_ks_statistic(spark, sf):
    return EV.ks_statistic(A.predictions(spark, sf))


@register("roc_curve", with_ctes(
    f"SELECT 'inf'::DOUBLE AS threshold, 0e0 AS fpr, 0e0 AS tpr UNION ALL "
    f"SELECT score AS threshold, cn / N AS fpr, cp / P AS tpr FROM {_desc()}", "predictions"))
def q_roc_curve(spark, sf):
    return EV.roc_curve(A.predictions(spark, sf))


@register("roc_corners", with_ctes(
    f"SELECT 'inf'::DOUBLE AS threshold, 0e0 AS fpr, 0e0 AS tpr UNION ALL "
    f"SELECT score AS threshold, cn / N AS fpr, cp / P AS tpr FROM ("
    f"SELECT *, lead(pos) OVER (ORDER BY score DESC) AS pos1, lead(neg) OVER (ORDER BY score DESC) AS neg1 FROM {_desc()}) "
    f"WHERE pos1 IS NULL OR pos::HUGEINT * neg1::HUGEINT <> neg::HUGEINT * pos1::HUGEINT", "predictions"))
def q_roc_corners(spark, sf):
    return EV.roc_corners(A.predictions(spark, sf))


@register("auc_roc", with_ctes(_AUC_SQL, "predictions"))
def q_auc_roc(spark, sf):
    return EV.auc_roc(A.predictions(spark, sf))


@register("gini", with_ctes(f"SELECT round(2 * auc_roc - 1, 3) AS gini FROM ({_AUC_SQL})", "predictions"))
def q_gini(spark, sf):
    return EV.gini(EV.auc_roc(A.predictions(spark, sf)))


@register("average_precision", with_ctes(
    f"SELECT sum(pos * cp / (cp + cn)) / max(P) AS average_precision FROM {_desc()}", "predictions"))
def q_average_precision(spark, sf):
    return EV.average_precision(A.predictions(spark, sf))


@register("brier_score", with_ctes("SELECT avg(pow(y_proba - y_true, 2)) AS brier_score FROM predictions",
                                   "predictions"))
def q_brier_score(spark, sf):
    return EV.brier_score(A.predictions(spark, sf))


@register("log_loss", with_ctes(
    f"SELECT avg(-(y_true * ln({_Q}) + (1 - y_true) * ln(1e0 - {_Q}))) AS log_loss FROM predictions", "predictions"))
def q_log_loss(spark, sf):
    return EV.log_loss(A.predictions(spark, sf))


@register("classification_metrics", with_ctes(_metrics_sql("predictions"), "predictions"))
def q_classification_metrics(spark, sf):
    return EV.classification_metrics(A.predictions(spark, sf))


_COMPARE_SQL = (f"SELECT 'Baseline' AS model, * FROM ({_metrics_sql('predictions_baseline')}) UNION ALL "
                f"SELECT 'Champion' AS model, * FROM ({_metrics_sql('predictions')})")


def _compare(spark, sf):
    return EV.metrics_compare({"Baseline": EV.classification_metrics(A.predictions_baseline(spark, sf)),
                               "Champion": EV.classification_metrics(A.predictions(spark, sf))})


@register("metrics_compare", with_ctes(_COMPARE_SQL, "predictions", "predictions_baseline"))
def q_metrics_compare(spark, sf):
    return _compare(spark, sf)


_CONF_SQL = """
SELECT 0.2e0 AS threshold, tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive,
       round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END, 6) AS recall
FROM (SELECT count(*) FILTER (WHERE y_proba < 0.2 AND y_true = 0) AS tn,
             count(*) FILTER (WHERE y_proba >= 0.2 AND y_true = 0) AS fp,
             count(*) FILTER (WHERE y_proba < 0.2 AND y_true = 1) AS fn,
             count(*) FILTER (WHERE y_proba >= 0.2 AND y_true = 1) AS tp FROM predictions)"""


@register("confusion_matrix", with_ctes(_CONF_SQL, "predictions"))
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(A.predictions(spark, sf), 0.2)


@register("f1_score", with_ctes(
    f"SELECT threshold, precision, recall, round(CASE WHEN precision + recall > 0 THEN "
    f"2 * precision * recall / (precision + recall) ELSE 0e0 END, 6) AS f1 FROM ({_CONF_SQL})", "predictions"))
def q_f1_score(spark, sf):
    return EV.f1_score(EV.confusion_matrix(A.predictions(spark, sf), 0.2))


def _rf(x: str) -> str:
    # three significant digits below 1, three decimals above (precision inference assumed to stop at 3)
    return (f"(CASE WHEN {x} = 0 THEN {x} WHEN abs({x}) < 1 THEN "
            f"ROUND({x}, CAST(-floor(log10(abs({x}))) - 1 + 3 AS INTEGER)) ELSE ROUND({x}, 3) END)")


_CALIB_SQL = f"""
WITH mm AS (SELECT min(y_proba) AS lo, max(y_proba) AS hi FROM predictions),
e AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 1e-3 ELSE i * ((hi - lo) / 10e0) + lo END AS edge,
             CASE WHEN i = 10 THEN hi ELSE i * ((hi - lo) / 10e0) + lo END AS raw_edge
      FROM mm, range(0, 11) r(i)),
d AS (SELECT i, CASE WHEN i = 0 THEN {_rf('edge')} - 1e-3 ELSE {_rf('raw_edge')} END AS disp FROM e),
bins AS (SELECT a.i + 1 AS bin, '(' || CAST(a.disp AS VARCHAR) || ', ' || CAST(b.disp AS VARCHAR) || ']' AS prob_bin,
                round((a.disp + b.disp) / 2, 4) AS predicted_midpoint
         FROM d a JOIN d b ON b.i = a.i + 1),
inner_edges AS (SELECT list(raw_edge ORDER BY i) AS q FROM e WHERE i BETWEEN 1 AND 9),
scored AS (SELECT 1 + len(list_filter(q, lambda x: y_proba > x)) AS bin, y_true FROM predictions, inner_edges
           WHERE y_proba IS NOT NULL),
agg AS (SELECT bin, count(*) AS n, avg(y_true) AS actual_default_rate FROM scored GROUP BY bin)
SELECT bins.bin, prob_bin, predicted_midpoint, coalesce(n, 0) AS n, actual_default_rate
FROM bins LEFT JOIN agg USING (bin)"""


@register("calibration_bins", with_ctes(_CALIB_SQL.replace("WITH mm AS", "SELECT * FROM (WITH mm AS", 1) + ")",
                                        "predictions"))
def q_calibration_bins(spark, sf):
    return EV.calibration_bins(A.predictions(spark, sf))


def _rel_sql(method: str, col: str) -> str:
    probs = ", ".join(str(i / 10) for i in range(1, 10))
    return (f"SELECT '{method}' AS method, bin, round(avg(p), 6) AS mean_predicted, "
            f"round(avg(CAST(y_true AS DOUBLE)), 6) AS fraction_positive FROM ("
            f"SELECT {col} AS p, y_true, 1 + len(list_filter((SELECT quantile_cont({col}, [{probs}]) FROM scored_pair), "
            f"lambda e: {col} > e)) AS bin FROM scored_pair WHERE {col} IS NOT NULL) GROUP BY bin")


@register("reliability_curve", with_ctes(_rel_sql("champion", "y_proba") + " UNION ALL " +
                                         _rel_sql("baseline", "y_proba_alt"), "scored_pair"))
def q_reliability_curve(spark, sf):
    return EV.reliability_curve(A.scored_pair(spark, sf), {"champion": "y_proba", "baseline": "y_proba_alt"})


_QR = f"least(greatest(y_proba, {_EPS}), 1e0 - {_EPS})"
_QA = f"least(greatest(y_proba_alt, {_EPS}), 1e0 - {_EPS})"


@register("calibration_report", with_ctes(f"""
SELECT *, round(raw_brier - calibrated_brier, 6) AS brier_improvement FROM (SELECT
  (SELECT round(sum(pos * (cn - neg / 2e0)) / (max(P) * max(N)), 6) FROM
     {_asc('(SELECT y_true, y_proba_alt AS y_proba FROM scored_pair)')}) AS auc_roc,
  round(avg(pow(y_proba - y_true, 2)), 6) AS raw_brier,
  round(avg(pow(y_proba_alt - y_true, 2)), 6) AS calibrated_brier,
  round(avg(-(y_true * ln({_QR}) + (1 - y_true) * ln(1e0 - {_QR}))), 6) AS raw_log_loss,
  round(avg(-(y_true * ln({_QA}) + (1 - y_true) * ln(1e0 - {_QA}))), 6) AS calibrated_log_loss
FROM scored_pair)""", "scored_pair"))
def q_calibration_report(spark, sf):
    return EV.calibration_report(A.scored_pair(spark, sf), "y_proba", "y_proba_alt")


@register("headline_metrics", with_ctes(f"""
SELECT (SELECT round(CAST(sum(TARGET) AS DOUBLE) / count(*), 6) FROM enriched) AS default_rate,
       c.auc_roc AS champion_auc, round(c.auc_roc - b.auc_roc, 6) AS auc_delta_vs_baseline,
       round(2 * c.auc_roc - 1, 3) AS gini,
       (SELECT round(max(abs(cp / P - cn / N)), 4) FROM {_asc()}) AS ks_statistic
FROM ({_metrics_sql('predictions')}) c, ({_metrics_sql('predictions_baseline')}) b""",
    "enriched", "predictions", "predictions_baseline"))
def q_headline_metrics(spark, sf):
    kpi = profile.kpi_overview(enriched_applications(spark, sf), RUN_ID, CREATED_AT)
    return EV.headline_metrics(kpi, _compare(spark, sf), EV.ks_statistic(A.predictions(spark, sf)),
                               "Champion", "Baseline")


_IMP_BODY = f"SELECT feature, abs(corr_with_target) AS importance FROM ({_CORR_BODY})"


def _corr_importance(spark, sf):
    c = profile.correlation_top(enriched_applications(spark, sf))
    return c.select("feature", F.abs("corr_with_target").alias("importance"))


@register("importance_rank", with_ctes(
    f"SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM ({_IMP_BODY})",
    "enriched"))
def q_importance_rank(spark, sf):
    return EV.importance_rank(_corr_importance(spark, sf))


@register("top_missing_features", with_ctes(f"""
SELECT "column" AS feature, round(r, 6) AS missing_rate FROM ({O.missing_union('enriched', O.ENRICHED_COLS)})
WHERE round(r, 6) > 0 ORDER BY round(r, 6) DESC, "column" LIMIT 25""", "enriched"))
def q_top_missing_features(spark, sf):
    m = profile.missingness(enriched_applications(spark, sf)).select(
        F.col("column").alias("feature"), F.col("missing_ratio").alias("missing_rate"))
    return EV.top_features(m, "missing_rate", 25, where=F.col("missing_rate") > 0)


@register("importance_by_group", with_ctes(f"""
SELECT {_IMP_SQL} AS "group", sum(importance) AS importance FROM (
  SELECT * FROM ({_IMP_BODY}) ORDER BY importance DESC, feature LIMIT 20) GROUP BY 1""", "enriched"))
def q_importance_by_group(spark, sf):
    return EV.importance_by_group(_corr_importance(spark, sf), 20)


@register("score_histogram", with_ctes("""
SELECT y_true, bin, bin / 50e0 AS bin_lo, (bin + 1) / 50e0 AS bin_hi, count(*) AS n FROM (
  SELECT y_true, CAST(least(floor(y_proba * 50), 49) AS INTEGER) AS bin FROM predictions WHERE y_proba IS NOT NULL)
GROUP BY y_true, bin""", "predictions"))
def q_score_histogram(spark, sf):
    return EV.score_histogram(A.predictions(spark, sf))


# ---------------------------------------------------------------- sampling
from riskweave.operators import sampling as S  # noqa: E402


def _h(seed) -> str:
    return f"CAST(('0x' || substr(md5(CAST(SK_ID_CURR AS VARCHAR) || '|' || '{seed}'), 1, 15)) AS BIGINT)"


def _rank_sql(table: str, seed) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {_h(seed)}, SK_ID_CURR) AS rk, "
            f"count(*) OVER (PARTITION BY TARGET) AS nc FROM {table}")


def _app_cols() -> str:
    return "SK_ID_CURR, TARGET, AMT_INCOME_TOTAL, AMT_CREDIT, DAYS_BIRTH, CODE_GENDER, REGION_CODE, FLAG_MOBIL"


@register("stratified_split", with_ctes(
    f"SELECT {_app_cols()}, CASE WHEN rk <= ceil(0.2 * nc) THEN 'test' ELSE 'train' END AS split "
    f"FROM ({_rank_sql('application', 42)})", "application"))
def q_stratified_split(spark, sf):
    return S.stratified_split(A.application(spark, sf), "TARGET", "SK_ID_CURR", 0.2, 42)


@register("three_way_split", with_ctes(f"""
SELECT {_app_cols()}, CASE WHEN rk2 <= ceil(0.25 * nc2) THEN 'calib' ELSE 'fit' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {_h('42-inner')}, SK_ID_CURR) AS rk2,
         count(*) OVER (PARTITION BY TARGET) AS nc2
  FROM (SELECT {_app_cols()} FROM ({_rank_sql('application', '42-outer')}) WHERE rk > ceil(0.2 * nc)))
UNION ALL
SELECT {_app_cols()}, 'test' AS split FROM ({_rank_sql('application', '42-outer')}) WHERE rk <= ceil(0.2 * nc)""",
    "application"))
def q_three_way_split(spark, sf):
    return S.three_way_split(A.application(spark, sf), "TARGET", "SK_ID_CURR", 0.2, 0.25, 42)


@register("stratified_sample", with_ctes(
    f"SELECT {_app_cols()} FROM ({_rank_sql('application', 42)}) "
    f"WHERE rk <= ceil(nc * 500e0 / (SELECT count(*) FROM application))", "application"))
def q_stratified_sample(spark, sf):
    return S.stratified_sample(A.application(spark, sf), 500, "TARGET", "SK_ID_CURR", 42)


@register("stratified_folds", with_ctes(
    f"SELECT {_app_cols()}, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM ({_rank_sql('application', 42)})",
    "application"))
def q_stratified_folds(spark, sf):
    return S.stratified_folds(A.application(spark, sf), 5, "TARGET", "SK_ID_CURR", 42)


_BY_GENDER = (f"SELECT *, row_number() OVER (PARTITION BY CODE_GENDER ORDER BY {_h(7)}, SK_ID_CURR) AS rk, "
              "count(*) OVER (PARTITION BY CODE_GENDER) AS nc FROM application")


@register("stratified_split_null_label", with_ctes(
    f"SELECT {_app_cols()}, CASE WHEN rk <= ceil(0.3 * nc) THEN 'test' ELSE 'train' END AS split FROM ({_BY_GENDER})", "application"))
def q_stratified_split_null_label(spark, sf):
    """I1 on a label with NULLs: they are a class of their own."""
    return S.stratified_split(A.application(spark, sf), "CODE_GENDER", "SK_ID_CURR", 0.3, 7)


@register("stratified_folds_null_label", with_ctes(
    f"SELECT {_app_cols()}, CAST((rk - 1) % 4 AS INTEGER) AS fold FROM ({_BY_GENDER})", "application"))
def q_stratified_folds_null_label(spark, sf):
    """I4 on a label with NULLs."""
    return S.stratified_folds(A.application(spark, sf), 4, "CODE_GENDER", "SK_ID_CURR", 7)


@register("sample_rows", with_ctes(
    f"SELECT {_app_cols()} FROM application ORDER BY {_h(42)}, SK_ID_CURR LIMIT 200", "application"))
def q_sample_rows(spark, sf):
    return S.sample_rows(A.application(spark, sf), 200, "SK_ID_CURR", 42)


# ---------------------------------------------------------------- contract tables (K1–K3)
def _decisions(spark, sf):
    return segments.decision_table(A.predictions(spark, sf), A.application(spark, sf), 0.2)


_DECISION_SQL = f"""
SELECT p.application_id, p.y_true, p.y_proba,
       {_qbin_sql('predictions', 'p.y_proba', 3, ['Low', 'Medium', 'High'])} AS risk_band,
       {_AGE_BAND_SQL.replace('a ', f'({_AGE_SQL}) ').replace('a >=', f'({_AGE_SQL}) >=')} AS age_band,
       a.CODE_GENDER AS gender,
       CASE WHEN p.y_proba < 0.2 THEN 'approve' ELSE 'decline' END AS decision, 0.2e0 AS threshold_used
FROM predictions p LEFT JOIN application a ON a.SK_ID_CURR = p.application_id"""


@register("decision_table", with_ctes(_DECISION_SQL.replace("(SELECT quantile_cont(p.y_proba", "(SELECT quantile_cont(y_proba"),
                                      "predictions", "application"))
def q_decision_table(spark, sf):
    return _decisions(spark, sf)


def _kpi_sql(col: str) -> str:
    return (f"SELECT '{col}' AS segment_name, {col} AS segment_value, count(*) AS n, "
            f"avg(CASE WHEN decision = 'approve' THEN 1 ELSE 0 END) AS approval_rate, avg(y_proba) AS avg_pd, "
            f"avg(CASE WHEN decision = 'approve' THEN y_proba END) AS estimated_bad_rate, "
            f"avg(y_true) AS observed_default_rate FROM d WHERE {col} IS NOT NULL GROUP BY {col}")


_D_FIXED = _DECISION_SQL.replace("(SELECT quantile_cont(p.y_proba", "(SELECT quantile_cont(y_proba")


@register("segment_kpis", with_ctes(
    f"SELECT * FROM (WITH d AS ({_D_FIXED}) " + " UNION ALL ".join(
        _kpi_sql(c) for c in ("risk_band", "age_band", "gender")) + ")", "predictions", "application"))
def q_segment_kpis(spark, sf):
    return segments.segment_kpis(_decisions(spark, sf))


@register("fairness_report", with_ctes(f"""
SELECT * FROM (WITH d AS ({_D_FIXED}),
g AS (SELECT gender AS group_value, count(*) AS n,
             avg(CASE WHEN decision = 'approve' THEN 1 ELSE 0 END) AS approval_rate,
             CAST(sum(CASE WHEN y_true = 1 AND decision = 'decline' THEN 1 ELSE 0 END) AS DOUBLE)
               / NULLIF(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END), 0) AS tpr
      FROM d WHERE gender IS NOT NULL GROUP BY gender),
o AS (SELECT avg(CASE WHEN decision = 'approve' THEN 1 ELSE 0 END) AS ar,
             CAST(sum(CASE WHEN y_true = 1 AND decision = 'decline' THEN 1 ELSE 0 END) AS DOUBLE)
               / NULLIF(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END), 0) AS tp
      FROM d WHERE gender IS NOT NULL)
SELECT 'gender' AS group_name, group_value, n, approval_rate, tpr, approval_rate - ar AS approval_rate_gap,
       tpr - tp AS tpr_gap FROM g, o)""", "predictions", "application"))
def q_fairness_report(spark, sf):
    return segments.fairness_report(_decisions(spark, sf), "gender")


@register("run_stamp", with_ctes(
    f"SELECT '{RUN_ID}' AS run_id, '{CREATED_AT}' AS created_at, * FROM predictions", "predictions"))
def q_run_stamp(spark, sf):
    from riskweave.sources.io import run_stamp
    return run_stamp(A.predictions(spark, sf), RUN_ID, CREATED_AT)


# ---------------------------------------------------------------- Spark ML
from riskweave.operators import ml as M  # noqa: E402

def _ml_frame(spark, sf):
    # text-shape features scan every document: materialise them once for the multi-pass ML jobs
    from riskweave.session import reliable_checkpoint
    return reliable_checkpoint(A.ml_frame(spark, sf))


def _ml_split(spark, sf):
    """The enriched applications, four fifths of each class for training."""
    from riskweave.session import reliable_checkpoint
    return reliable_checkpoint(S.stratified_split(enriched_applications(spark, sf), "TARGET", "SK_ID_CURR", 0.2, 42))


def _fit(spark, sf, model_type="gbt", params=None):
    split = _ml_split(spark, sf)
    train = split.where(F.col("split") == "train").drop("split")
    num, cat = M.feature_lists(train)
    model, eff, names = M.train_classifier(train, num, cat, model_type, params)
    return split, model, eff, names


@register("impute_median", with_ctes(f"""
SELECT feature, quantile_cont(value, 0.5) AS median FROM (
  SELECT * FROM (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in O.ENRICHED_NUMERIC if c not in ('TARGET', 'SK_ID_CURR'))}
                 FROM ({_rank_sql('enriched', 42)}) WHERE rk > ceil(0.2 * nc))
  UNPIVOT (value FOR feature IN ({', '.join(c for c in O.ENRICHED_NUMERIC if c not in ('TARGET', 'SK_ID_CURR'))})))
GROUP BY feature""", "enriched"))
def q_impute_median(spark, sf):
    split = S.stratified_split(enriched_applications(spark, sf), "TARGET", "SK_ID_CURR", 0.2, 42)
    train = split.where(F.col("split") == "train")
    num, _ = M.feature_lists(train.drop("split"))
    return M.fit_medians(train, num)


@register("class_weights", with_ctes(
    "SELECT TARGET, CAST((SELECT count(*) FROM enriched WHERE TARGET IS NOT NULL) AS DOUBLE) / "
    "((SELECT count(DISTINCT TARGET) FROM enriched) * count(*)) AS weight FROM enriched "
    "WHERE TARGET IS NOT NULL GROUP BY TARGET", "enriched"))
def q_class_weights(spark, sf):
    return M.class_weights(enriched_applications(spark, sf), "TARGET")


@register("one_hot", """
SELECT l.doc_id AS SK_ID_CURR, dense_rank() OVER (ORDER BY coalesce(lang, '__null__')) - 1 AS NAME_LANG_slot, 1e0 AS NAME_LANG_sum,
       dense_rank() OVER (ORDER BY coalesce(source, '__null__')) - 1 AS NAME_SOURCE_slot, 1e0 AS NAME_SOURCE_sum
FROM labels l JOIN documents d USING (doc_id)""", round_digits=None)
def q_one_hot(spark, sf):
    """Where the one of each encoded vector stands, and the vector's sum."""
    from pyspark.ml import Pipeline
    df = _ml_frame(spark, sf)
    _, cat = M.feature_lists(df)
    out = Pipeline(stages=M.one_hot_stages(cat)).fit(df).transform(df).select(
        "SK_ID_CURR", *[vector_to_array_col(f"{c}__ohe") for c in cat])
    return out.select("SK_ID_CURR", *[e for c in cat for e in (
        (F.array_position(f"{c}_onehot", F.lit(1.0)) - 1).alias(f"{c}_slot"),
        F.aggregate(f"{c}_onehot", F.lit(0.0), lambda a, x: a + x).alias(f"{c}_sum"))])


@register("category_dictionary", """
SELECT feature, label, n, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY shown) - 1 AS INTEGER) AS slot FROM (
  SELECT *, CASE WHEN n < 12 AND label <> '__null__' THEN '__rare__' ELSE label END AS shown FROM (
    SELECT 'p_name' AS feature, p_name AS label, count(*) AS n FROM part GROUP BY 2 UNION ALL
    SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 UNION ALL
    SELECT 'p_size', coalesce(CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END, '__null__'), count(*) FROM part GROUP BY 2))""", round_digits=None)
def q_category_dictionary(spark, sf):
    """The dictionary of three part columns, labels under twelve rows together."""
    from riskweave.operators import categories
    from riskweave.sources.io import table_path
    part = spark.read.parquet(table_path(sf, "part")).withColumn("p_size", F.when(F.col("p_size") % 10 != 0, F.col("p_size")))
    return categories.dictionary(part, ["p_name", "p_type", "p_size"], min_count=12)


def vector_to_array_col(c: str):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(c).alias(c.replace("__ohe", "_onehot"))


def _metrics_row(spark, sf, model_type):
    split, model, eff, _ = _fit(spark, sf, model_type)
    test = split.where(F.col("split") == "test").drop("split")
    scored = M.score(model, test)
    m = EV.classification_metrics(scored, "TARGET", "y_proba")
    return m.select(F.lit(eff).alias("model_type"), "*")


@register("train_gbt_metrics")
def q_train_gbt_metrics(spark, sf):
    return _metrics_row(spark, sf, "gbt")


@register("train_logreg_metrics")
def q_train_logreg_metrics(spark, sf):
    return _metrics_row(spark, sf, "logreg")


# a published scorecard: intercept, then (coefficient, value where missing) per column
_CARD = (-2.0, {"AMT_INCOME_TOTAL": (2e-5, 40000.0), "BUREAU_N_CREDITS": (0.05, 0.0), "BUREAU_ACTIVE_RATIO": (1.5, 0.5),
                "INST_LATE_RATE": (0.8, 0.3)})
_CARD_SQL = """(SELECT SK_ID_CURR, TARGET, 1e0 / (1e0 + exp(-(-2e0 + 2e-5 * coalesce(AMT_INCOME_TOTAL, 4e4) + 0.05e0 * coalesce(BUREAU_N_CREDITS, 0e0)
  + 1.5e0 * coalesce(BUREAU_ACTIVE_RATIO, 0.5e0) + 0.8e0 * coalesce(INST_LATE_RATE, 0.3e0)))) AS y_proba FROM enriched)"""


@register("predictions", with_ctes(f"""
SELECT '{RUN_ID}' AS run_id, '{CREATED_AT}' AS created_at, SK_ID_CURR AS application_id, TARGET AS y_true, round(y_proba, 6) AS y_proba,
       CASE WHEN y_proba <= q[1] THEN 'Low' WHEN y_proba <= q[2] THEN 'Medium' ELSE 'High' END AS risk_band
FROM {_CARD_SQL}, (SELECT quantile_cont(y_proba, [1e0 / 3, 2e0 / 3]) AS q FROM {_CARD_SQL})""", "enriched"), round_digits=None)
def q_predictions(spark, sf):
    """The predictions contract over scorecard probabilities of all applicants."""
    return M.predictions_table(M.score_linear(enriched_applications(spark, sf), *_CARD), RUN_ID, CREATED_AT)


# scores of the three-way split's calibration rows pooled by the max-min formula: prefix sums give every range's mean
_CALIBRATED_SQL = f"""
SELECT application_id, y_true, y_proba, ROUND(CASE WHEN hi2 IS NULL OR lo1 = hi2 THEN coalesce(v1, v2)
       WHEN lo1 IS NULL THEN v2 ELSE v1 + (v2 - v1) * (y_proba - lo1) / (hi2 - lo1) END, 6) AS y_proba_calibrated FROM (
  WITH inner_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {_h('42-outer').replace('SK_ID_CURR', 'application_id')}, application_id) AS rk,
      count(*) OVER (PARTITION BY y_true) AS nc FROM predictions) WHERE rk > ceil(0.2 * nc)),
  calib AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {_h('42-inner').replace('SK_ID_CURR', 'application_id')}, application_id) AS rk2,
      count(*) OVER (PARTITION BY y_true) AS nc2 FROM inner_rows) WHERE rk2 <= ceil(0.25 * nc2)),
  k AS (SELECT y_proba AS s, sum(sum(y_true)) OVER w AS y, sum(count(*)) OVER w AS n, row_number() OVER w AS i FROM calib
        GROUP BY y_proba WINDOW w AS (ORDER BY y_proba)),
  r AS (SELECT a.i AS lo, b.i AS hi, (b.y - coalesce(z.y, 0)) / (b.n - coalesce(z.n, 0)) AS v
        FROM k a JOIN k b ON b.i >= a.i LEFT JOIN k z ON z.i = a.i - 1),
  least_above AS (SELECT lo, hi, min(v) OVER (PARTITION BY lo ORDER BY hi DESC) AS v FROM r),
  fit AS (SELECT s, v FROM k JOIN (SELECT hi AS i, max(v) AS v FROM least_above GROUP BY hi) USING (i))
  SELECT p.*, a.s AS lo1, a.v AS v1, b.s AS hi2, b.v AS v2
  FROM predictions p ASOF LEFT JOIN fit a ON p.y_proba >= a.s ASOF LEFT JOIN fit b ON p.y_proba <= b.s)"""


@register("calibrated_predictions", with_ctes(_CALIBRATED_SQL, "predictions"), round_digits=None)
def q_calibrated_predictions(spark, sf):
    """Isotonic on the calibration rows of the three-way split, applied to all applicants, interpolated between pools."""
    scored = A.predictions(spark, sf)
    parts = S.three_way_split(scored, "y_true", "application_id", 0.2, 0.25, 42)
    model = M.fit_isotonic(parts.where("split = 'calib'"), "y_proba", "y_true")
    out = M.calibrate(model, scored)
    return out.select("application_id", "y_true", "y_proba", F.round("y_proba_calibrated", 6).alias("y_proba_calibrated"))


@register("train_calibrate_score")
def q_train_calibrate_score(spark, sf):
    """Twelve leaf-wise trees fitted on one part of the enriched applications, calibrated on another, all applicants scored and banded."""
    parts = S.three_way_split(enriched_applications(spark, sf), "TARGET", "SK_ID_CURR", 0.2, 0.25, 42)
    from riskweave.session import reliable_checkpoint
    parts = reliable_checkpoint(parts)
    fit = parts.where("split = 'fit'").drop("split")
    num, cat = M.feature_lists(fit)
    model, _, _ = M.train_classifier(fit, num, cat, "lightgbm", M.DEFAULT_GBT_PARAMS | {"n_estimators": 12, "num_leaves": 15})
    scored = reliable_checkpoint(M.score(model, parts).select("SK_ID_CURR", "TARGET", "split", "y_proba"))
    cal = M.calibrate(M.fit_isotonic(scored.where("split = 'calib'")), scored)
    return M.predictions_table(cal.select("SK_ID_CURR", "TARGET", F.col("y_proba_calibrated").alias("y_proba")), RUN_ID, CREATED_AT)


@register("tuning_results")
def q_tuning_results(spark, sf):
    """The whole model-guided search for the leaf-wise booster over all training rows: 24 trials on two folds, up to 600 trees each, no limit of time."""
    split = _ml_split(spark, sf)
    train = split.where(F.col("split") == "train").drop("split")
    num, cat = M.feature_lists(train)
    return M.tune(train, num, cat, timeout_s=None)


@register("train_booster_metrics")
def q_train_booster_metrics(spark, sf):
    """Held-out metrics of twelve leaf-wise trees with L1 and L2 terms over the enriched applications."""
    split, model, eff, _ = _fit(spark, sf, "lightgbm", M.DEFAULT_GBT_PARAMS | {"n_estimators": 12, "num_leaves": 15, "reg_alpha": 0.1, "reg_lambda": 1.0})
    scored = M.score(model, split.where(F.col("split") == "test").drop("split"))
    return EV.classification_metrics(scored, "TARGET", "y_proba").select(F.lit(eff).alias("model_type"), "*")


# J5 on small integers: three features (one with NULLs), two trees of three leaves, checked value by value
_BOOST = {"num_leaves": 3, "learning_rate": 0.1, "reg_alpha": 0.5, "reg_lambda": 1.0, "min_child_samples": 5}
_BOOST_X = ("REGION_CODE", "AGE_DECADE", "GENDER_CODE")


def _boost_rows(spark, sf):
    app = A.application(spark, sf)
    gender = F.when(F.col("CODE_GENDER") == "AUTOMOBILE", 0).when(F.col("CODE_GENDER") == "FURNITURE", 1).when(F.col("CODE_GENDER") == "HOUSEHOLD", 2) \
        .when(F.col("CODE_GENDER") == "MACHINERY", 3)
    x = (F.col("REGION_CODE"), F.floor(-F.col("DAYS_BIRTH") / 3650), gender)
    return app.select(F.array(*[c.cast("double") for c in x]).alias("_x"), F.col("TARGET").cast("double").alias("y"), F.lit(1.0).alias("w"))


def _split_ctes(name: str, rows: str) -> str:
    """Best split of the rows (x0, x1, x2, g, h) of one leaf, as ``name`` (no row if none helps); helper tables are prefixed."""
    score = "(pow(sign({g}) * greatest(abs({g}) - 0.5e0, 0e0), 2) / ({h} + 1e0))"
    gain = " + ".join([score.format(g="gl", h="hl"), score.format(g="(gt - gl)", h="(ht - hl)")]) + " - " + score.format(g="gt", h="ht")
    unpivoted = " UNION ALL ".join(f"SELECT {i} AS f, x{i} AS v, g, h FROM {rows}" for i in range(3))
    return f"""
{name}_l AS ({unpivoted}),
{name}_t AS (SELECT f, sum(g) AS gt, sum(h) AS ht, count(*) AS nt, coalesce(sum(g) FILTER (v IS NULL), 0e0) AS g0,
  coalesce(sum(h) FILTER (v IS NULL), 0e0) AS h0, count(*) FILTER (v IS NULL) AS n0 FROM {name}_l GROUP BY f),
{name}_c AS (SELECT f, v, sum(sum(g)) OVER w AS gc, sum(sum(h)) OVER w AS hc, sum(count(*)) OVER w AS nc FROM {name}_l WHERE v IS NOT NULL
  GROUP BY f, v WINDOW w AS (PARTITION BY f ORDER BY v)),
{name}_s AS (SELECT f, v, side, n0, gt, ht, nt, gc + side * g0 AS gl, hc + side * h0 AS hl, nc + side * n0 AS nl
  FROM {name}_c JOIN {name}_t USING (f), (VALUES (1), (0)) AS sides(side)),
{name} AS (SELECT *, CASE WHEN n0 > 0 THEN side = 1 ELSE hl >= ht - hl END AS null_left FROM (
  SELECT *, ROUND({gain}, 9) AS gain FROM {name}_s WHERE nl >= 5 AND nt - nl >= 5 AND hl >= 1e-3 AND ht - hl >= 1e-3) WHERE gain > 0
  ORDER BY gain DESC, f, v, side DESC LIMIT 1)"""


def _boost_sql() -> str:
    value = "-0.1e0 * sign({g}) * greatest(abs({g}) - 0.5e0, 0e0) / ({h} + 1e0)"
    left = "CASE WHEN (CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END) IS NULL THEN null_left ELSE (CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END) <= v END"
    ctes = ["""r0 AS (SELECT SK_ID_CURR AS id, TARGET AS y, CAST(REGION_CODE AS DOUBLE) AS x0, floor(-DAYS_BIRTH / 3650e0) AS x1,
  CASE CODE_GENDER WHEN 'AUTOMOBILE' THEN 0e0 WHEN 'FURNITURE' THEN 1e0 WHEN 'HOUSEHOLD' THEN 2e0 WHEN 'MACHINERY' THEN 3e0 END AS x2,
  ln(avg(TARGET) OVER () / (1e0 - avg(TARGET) OVER ())) AS m FROM application)"""]
    for t in (1, 2):
        ctes.append(f"""g{t} AS (SELECT *, 1e0 / (1e0 + exp(-m)) - y AS g, 1e0 / (1e0 + exp(-m)) * (1e0 - 1e0 / (1e0 + exp(-m))) AS h FROM r{t - 1})""")
        ctes.append(_split_ctes(f"a{t}", f"g{t}"))
        ctes.append(f"b{t} AS (SELECT g{t}.*, CASE WHEN {left} THEN 1 ELSE 2 END AS node FROM g{t}, a{t})")
        ctes += [_split_ctes(f"c{t}{k}", f"(SELECT * FROM b{t} WHERE node = {k})") for k in (1, 2)]
        ctes.append(f"d{t} AS (SELECT 1 AS cut_leaf, f, v, null_left, gain FROM c{t}1 UNION ALL SELECT 2, f, v, null_left, gain FROM c{t}2 ORDER BY gain DESC, cut_leaf LIMIT 1)")
        ctes.append(f"e{t} AS (SELECT b{t}.* REPLACE (CASE WHEN node = cut_leaf THEN CASE WHEN {left} THEN 3 ELSE 4 END ELSE node END AS node) FROM b{t} LEFT JOIN d{t} ON true)")
        ctes.append(f"l{t} AS (SELECT node, count(*) AS n_rows, {value.format(g='sum(g)', h='sum(h)')} AS leaf_value FROM e{t} GROUP BY node)")
        ctes.append(f"r{t} AS (SELECT id, y, x0, x1, x2, m + leaf_value AS m FROM e{t} JOIN l{t} USING (node))")
    return f"SELECT * FROM (WITH {', '.join(ctes)} SELECT 1 AS tree, * REPLACE (ROUND(leaf_value, 6) AS leaf_value) FROM l1 UNION ALL SELECT 2, * REPLACE (ROUND(leaf_value, 6) AS leaf_value) FROM l2)"


@register("booster_leaves", with_ctes(_boost_sql(), "application"), round_digits=None)
def q_booster_leaves(spark, sf):
    """Every leaf of two trees grown on three small integer features: its number, rows and value."""
    from riskweave.operators import boost
    booster = boost.Growing(_boost_rows(spark, sf), _BOOST, len(_BOOST_X)).add(2)
    rows = [(i, node, int(t.cover[node]), round(t.value[node], 6)) for i, t in enumerate(booster.trees, 1) for node in range(len(t.left)) if t.left[node] < 0]
    return spark.createDataFrame(rows, "tree int, node int, n_rows long, leaf_value double")


# a fixed tree: income <= 40000 ? (credits <= 8 ? 0.5 : -0.25) : 1, with covers 100 = 40 (30 + 10) + 60
def _fixed_tree() -> dict:
    import numpy as np
    return {"left": np.array([1, 3, -1, -1, -1]), "right": np.array([2, 4, -1, -1, -1]), "feat": np.array([0, 1, -1, -1, -1]),
            "thr": np.array([40000.0, 8.0, 0, 0, 0]), "cats": [None] * 5, "value": np.array([0, 0, 1.0, 0.5, -0.25]),
            "cover": np.array([100.0, 40.0, 60.0, 30.0, 10.0]), "root": 0}


def _tree_values(spark, sf):
    from riskweave.operators import shap as SH
    rows = enriched_applications(spark, sf).select(
        F.col("SK_ID_CURR").alias("_id"), F.array(F.col("AMT_INCOME_TOTAL"), F.col("BUREAU_N_CREDITS").cast("double")).alias("_x"))
    return SH.explain(rows, [_fixed_tree()], [1.0], ["AMT_INCOME_TOTAL", "BUREAU_N_CREDITS"])


# f(both), f(income only), f(credits only), f(neither): unknown features go by the covers
_SHAP_SQL = """(SELECT SK_ID_CURR, 0.5e0 * (b - c) + 0.5e0 * (i - 0.725e0) AS s0, 0.5e0 * (b - i) + 0.5e0 * (c - 0.725e0) AS s1 FROM (
  SELECT SK_ID_CURR, CASE WHEN AMT_INCOME_TOTAL <= 4e4 THEN CASE WHEN BUREAU_N_CREDITS <= 8 THEN 0.5e0 ELSE -0.25e0 END ELSE 1e0 END AS b,
         CASE WHEN AMT_INCOME_TOTAL <= 4e4 THEN 0.3125e0 ELSE 1e0 END AS i,
         0.4e0 * CASE WHEN BUREAU_N_CREDITS <= 8 THEN 0.5e0 ELSE -0.25e0 END + 0.6e0 AS c FROM enriched))"""


@register("shap_values", with_ctes(f"""
SELECT SK_ID_CURR, 'AMT_INCOME_TOTAL' AS feature, round(s0, 6) AS shap FROM {_SHAP_SQL} UNION ALL
SELECT SK_ID_CURR, 'BUREAU_N_CREDITS' AS feature, round(s1, 6) AS shap FROM {_SHAP_SQL}""", "enriched"))
def q_shap_values(spark, sf):
    """Values of a fixed two-level tree for all applicants."""
    return _tree_values(spark, sf).withColumnRenamed("_id", "SK_ID_CURR")


@register("shap_importance", with_ctes(f"""
SELECT feature, round(v, 6) AS mean_abs_shap, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank FROM (
SELECT 'AMT_INCOME_TOTAL' AS feature, avg(abs(s0)) AS v FROM {_SHAP_SQL} UNION ALL
SELECT 'BUREAU_N_CREDITS', avg(abs(s1)) FROM {_SHAP_SQL})""", "enriched"))
def q_shap_importance(spark, sf):
    from riskweave.operators import shap as SH
    return SH.importance(_tree_values(spark, sf))


@register("split_importance")
def q_split_importance(spark, sf):
    """Split gains of a booster with default parameters, and its mean |SHAP| over every test row."""
    from riskweave.operators import shap as SH
    split, model, _, names = _fit(spark, sf)
    test = split.where(F.col("split") == "test").drop("split")
    shap = SH.shap_importance(model, test, names).select("feature", "mean_abs_shap", F.col("rank").alias("shap_rank"))
    return M.split_importance(model, names).join(shap, "feature")


# ---------------------------------------------------------------- sources (A2, B5 companions)
@register("load_sources", """
SELECT 'base' AS source, count(*) AS n_rows, 5 AS n_cols FROM customer UNION ALL
SELECT 'orders', count(*), 6 FROM orders UNION ALL
SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL
SELECT 'events', count(*), 6 FROM events""")
def q_load_sources(spark, sf):
    """A2: enabled+present sources are loaded, disabled and missing ones skipped; one row per source."""
    import os
    from functools import reduce

    from pyspark.sql import DataFrame as _DF

    from riskweave.sources.io import SourceSpec, SourcesConfig, load_sources, table_path
    cfg = SourcesConfig(table_path(sf, "customer"), {
        "orders": SourceSpec(table_path(sf, "orders")),
        "lineitem": SourceSpec(table_path(sf, "lineitem")),
        "events": SourceSpec(table_path(sf, "events")),
        "not_there": SourceSpec(os.path.join(sf, "no_such_table.parquet")),
        "switched_off": SourceSpec(table_path(sf, "part"), enabled=False),
    }, id_col="c_custkey")
    base, srcs = load_sources(spark, cfg)
    parts = [base.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("base").alias("source"), "n_rows",
                                                                F.lit(len(base.columns)).alias("n_cols"))]
    parts += [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("source"), "n_rows",
                                                              F.lit(len(d.columns)).alias("n_cols"))
              for n, d in srcs.items()]
    return reduce(_DF.unionByName, parts)


# ---------------------------------------------------------------- final oracle rounding
def _final_round(sql: str, doubles: list[str], digits: int = 6) -> str:
    """Apply the Spark side's contract rounding to every double output column of an oracle."""
    if not doubles:
        return sql
    rep = ", ".join(
        f'CASE WHEN isinf("{c}") OR isnan("{c}") THEN "{c}" '
        f'ELSE CAST(ROUND(CAST("{c}" AS DECIMAL(38,9)), {digits}) AS DOUBLE) END AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _final"


def _finalize_oracles() -> None:
    from riskweave.plans.oracle_doubles import DOUBLE_COLUMNS
    for name in list(ORACLE):
        ORACLE[name] = _final_round(ORACLE[name], DOUBLE_COLUMNS.get(name, []))


_finalize_oracles()
