"""Roll one-to-many credit histories up to one row per applicant.

Each aggregator is one ``groupBy(id).agg(...)``: partial (map-side)
aggregation collapses hot ids before the shuffle, so an applicant owning a
third of all rows costs one row per map task, not a third of the data in
one reducer. Aggregate *before* joining (no 1:N fan-out), and only the
columns a feature needs are read (Catalyst prunes the Parquet scan).

Schema tolerance: every output column exists only if its inputs exist;
this is decided at plan-build time from ``df.columns``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import expr as X

ID = "SK_ID_CURR"
BUREAU_ID = "SK_ID_BUREAU"

# Column prefixes whose join misses mean "zero events" and are filled with 0.
COUNT_PREFIXES = ("BUREAU_N", "BUREAU_BB", "PREV_N", "INST_N", "POS_N", "CC_N")


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _require_id(df: DataFrame, what: str, id_col: str) -> None:
    if id_col not in df.columns:
        raise ValueError(f"{what}: no id column {id_col}; columns are {', '.join(df.columns)}")


def _sum0(c: Column) -> Column:
    """pandas sum: all-missing group -> 0 (SQL SUM gives NULL)."""
    return F.coalesce(F.sum(c), F.lit(0))


def _rows() -> Column:
    return F.count(F.lit(1))


def _keyed(df: DataFrame, id_col: str) -> DataFrame:
    # pandas groupby drops missing keys
    return df.where(F.col(id_col).isNotNull())


def agg_bureau_balance(bb: DataFrame, bureau_id: str = BUREAU_ID) -> DataFrame:
    """Per credit, BB_MONTHS (rows) and BB_DPD_MONTHS (past-due status months)."""
    _require_id(bb, "bureau_balance", bureau_id)
    aggs = [_rows().alias("BB_MONTHS")]
    if "STATUS" not in bb.columns:
        return _keyed(bb, bureau_id).groupBy(bureau_id).agg(*aggs)
    aggs.append(F.sum(X.past_due_flag("STATUS")).alias("BB_DPD_MONTHS"))
    return _keyed(bb, bureau_id).groupBy(bureau_id).agg(*aggs)


def bureau_with_balance(bureau: DataFrame, bb: DataFrame | None, bureau_id: str = BUREAU_ID,
                        skip_empty: bool = False) -> DataFrame:
    """Credits left-joined to their monthly-status aggregate (credit id is unique after E1).

    ``skip_empty`` reproduces the pandas rule "an empty status table adds no
    column" at the price of a probe job; by default the output schema is
    fixed and an empty table simply yields BB_DPD_MONTHS = NULL.
    """
    if bb is None or bureau_id not in bureau.columns or "STATUS" not in bb.columns:
        return bureau
    if skip_empty and bb.where(F.col(bureau_id).isNotNull()).isEmpty():   # LIMIT 1 probe
        return bureau
    return bureau.join(agg_bureau_balance(bb, bureau_id), bureau_id, "left")


def agg_bureau(bureau: DataFrame, bb: DataFrame | None = None, id_col: str = ID,
               bureau_id: str = BUREAU_ID) -> DataFrame:
    """Prior-credit summary per applicant (optionally with the E1 fold)."""
    _require_id(bureau, "bureau", id_col)
    df = bureau_with_balance(bureau, bb, bureau_id)
    aggs: list[Column] = [_rows().alias("BUREAU_N_CREDITS")]
    if _has(df, "CREDIT_ACTIVE"):
        active = F.coalesce(F.col("CREDIT_ACTIVE").cast("string") == "Active", F.lit(False)).cast("int")
        aggs.append(F.sum(active).alias("BUREAU_N_ACTIVE"))
    for col, name in (("AMT_CREDIT_SUM_DEBT", "BUREAU_DEBT"), ("AMT_CREDIT_SUM", "BUREAU_CREDIT")):
        if _has(df, col):
            aggs += [_sum0(F.col(col)).alias(f"{name}_SUM"), F.avg(col).alias(f"{name}_MEAN")]
    if _has(df, "CREDIT_DAY_OVERDUE"):
        aggs.append(F.max("CREDIT_DAY_OVERDUE").alias("BUREAU_OVERDUE_MAX"))
    if _has(df, "AMT_CREDIT_SUM_OVERDUE"):
        aggs.append(_sum0(F.col("AMT_CREDIT_SUM_OVERDUE")).alias("BUREAU_AMT_OVERDUE_SUM"))
    if _has(df, "DAYS_CREDIT"):
        aggs.append(F.avg("DAYS_CREDIT").alias("BUREAU_DAYS_CREDIT_MEAN"))
    if _has(df, "BB_DPD_MONTHS"):
        aggs.append(_sum0(F.col("BB_DPD_MONTHS")).alias("BUREAU_BB_DPD_MONTHS_SUM"))
    out = _keyed(df, id_col).groupBy(id_col).agg(*aggs)
    order = ["BUREAU_N_CREDITS", "BUREAU_N_ACTIVE", "BUREAU_ACTIVE_RATIO", "BUREAU_DEBT_SUM",
             "BUREAU_DEBT_MEAN", "BUREAU_CREDIT_SUM", "BUREAU_CREDIT_MEAN", "BUREAU_OVERDUE_MAX",
             "BUREAU_AMT_OVERDUE_SUM", "BUREAU_DAYS_CREDIT_MEAN", "BUREAU_BB_DPD_MONTHS_SUM"]
    if "BUREAU_N_ACTIVE" in out.columns:
        out = out.withColumn("BUREAU_ACTIVE_RATIO", X.safe_div("BUREAU_N_ACTIVE", "BUREAU_N_CREDITS"))
    return out.select(id_col, *[c for c in order if c in out.columns])


def agg_previous_apps(prev: DataFrame, id_col: str = ID) -> DataFrame:
    """Prior applications; ratios are means of row ratios, NULL status counts as 'other'."""
    _require_id(prev, "previous_application", id_col)
    aggs: list[Column] = [_rows().alias("PREV_N_APPS")]
    if _has(prev, "NAME_CONTRACT_STATUS"):
        s = F.col("NAME_CONTRACT_STATUS").cast("string")
        aggs += [F.avg(F.coalesce(s == "Approved", F.lit(False)).cast("int")).alias("PREV_APPROVED_RATIO"),
                 F.avg(F.coalesce(s == "Refused", F.lit(False)).cast("int")).alias("PREV_REFUSED_RATIO")]
    if _has(prev, "AMT_APPLICATION"):
        aggs.append(F.avg("AMT_APPLICATION").alias("PREV_AMT_APPLICATION_MEAN"))
    if _has(prev, "AMT_CREDIT"):
        aggs.append(F.avg("AMT_CREDIT").alias("PREV_AMT_CREDIT_MEAN"))
    if _has(prev, "AMT_CREDIT", "AMT_APPLICATION"):
        aggs.append(F.avg(X.safe_div("AMT_CREDIT", "AMT_APPLICATION")).alias("PREV_CREDIT_TO_APP_RATIO"))
    if _has(prev, "DAYS_DECISION"):
        aggs.append(F.avg("DAYS_DECISION").alias("PREV_DAYS_DECISION_MEAN"))
    return _keyed(prev, id_col).groupBy(id_col).agg(*aggs)


def agg_installments(inst: DataFrame, id_col: str = ID) -> DataFrame:
    """Lateness (rate over all rows, DPD over non-missing) and payment shortfall."""
    _require_id(inst, "installments_payments", id_col)
    aggs: list[Column] = [_rows().alias("INST_N_INSTALMENTS")]
    if _has(inst, "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT"):
        dpd = X.days_past_due("DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT")
        aggs += [F.avg(X.is_late(dpd)).alias("INST_LATE_RATE"),
                 F.avg(dpd).alias("INST_DPD_MEAN"),
                 F.max(dpd).alias("INST_DPD_MAX")]
    if _has(inst, "AMT_PAYMENT", "AMT_INSTALMENT"):
        aggs.append(F.avg(X.payment_shortfall("AMT_PAYMENT", "AMT_INSTALMENT")).alias("INST_SHORTFALL_MEAN"))
    return _keyed(inst, id_col).groupBy(id_col).agg(*aggs)


def agg_pos(pos: DataFrame, id_col: str = ID) -> DataFrame:
    """E5: POS/cash monthly balance: months, DPD mean/max, late months."""
    _require_id(pos, "POS_CASH_balance", id_col)
    aggs: list[Column] = [_rows().alias("POS_N_MONTHS")]
    if _has(pos, "SK_DPD"):
        aggs += [F.avg("SK_DPD").alias("POS_DPD_MEAN"), F.max("SK_DPD").alias("POS_DPD_MAX"),
                 F.sum(F.coalesce(F.col("SK_DPD") > 0, F.lit(False)).cast("long")).alias("POS_N_LATE_MONTHS")]
    return _keyed(pos, id_col).groupBy(id_col).agg(*aggs)


def agg_credit_card(cc: DataFrame, id_col: str = ID) -> DataFrame:
    """Card balance, utilisation (mean of row ratios), DPD."""
    _require_id(cc, "credit_card_balance", id_col)
    aggs: list[Column] = [_rows().alias("CC_N_MONTHS")]
    if _has(cc, "AMT_BALANCE"):
        aggs.append(F.avg("AMT_BALANCE").alias("CC_BALANCE_MEAN"))
    if _has(cc, "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL"):
        aggs.append(F.avg(X.utilization("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")).alias("CC_UTILIZATION_MEAN"))
    if _has(cc, "SK_DPD"):
        aggs.append(F.avg("SK_DPD").alias("CC_DPD_MEAN"))
    return _keyed(cc, id_col).groupBy(id_col).agg(*aggs)


AGGREGATORS = {
    "previous_application": agg_previous_apps,
    "installments_payments": agg_installments,
    "pos_cash_balance": agg_pos,
    "credit_card_balance": agg_credit_card,
}


def build_aggregates(sources: dict[str, DataFrame], id_col: str = ID) -> dict[str, DataFrame]:
    """Dispatch loaded sources to their aggregators; bureau_balance folds into bureau."""
    out: dict[str, DataFrame] = {}
    if "bureau" in sources:
        out["bureau"] = agg_bureau(sources["bureau"], sources.get("bureau_balance"), id_col)
    for name, fn in AGGREGATORS.items():
        if name in sources:
            out[name] = fn(sources[name], id_col)
    return out


def nonempty_sources(sources: dict[str, DataFrame], id_col: str = ID) -> set[str]:
    """Names of sources with at least one keyed row, probed in ONE job (LIMIT 1 per source)."""
    from functools import reduce
    probes = [src.where(F.col(id_col).isNotNull()).select(F.lit(name).alias("name")).limit(1)
              for name, src in sources.items() if id_col in src.columns]
    if not probes:
        return set()
    return {r["name"] for r in reduce(DataFrame.unionByName, probes).collect()}


def enrich(base: DataFrame, aggregates: dict[str, DataFrame | None], id_col: str = ID,
           count_prefixes: tuple[str, ...] = COUNT_PREFIXES, sources: dict[str, DataFrame] | None = None,
           skip_empty: bool = False) -> DataFrame:
    """Successive left equi-joins on the id; join misses on count columns -> 0.

    Aggregates are one row per id, so the base row count is preserved and
    no join can skew. Each aggregate arrives hash-partitioned on the id, so
    sort-merge joins chain without re-shuffling them (AQE may broadcast the
    small ones).

    By default the output schema depends only on the input schemas (an
    empty source contributes count 0 / NULL features). ``skip_empty=True``
    drops the columns of sources with no keyed row, as the pandas pipeline
    does, at the cost of one LIMIT-1 probe job over all sources.
    """
    _require_id(base, "application table", id_col)
    out = base
    added: list[str] = []
    probed = ({n: s for n, s in (sources or {}).items() if n in aggregates and id_col in s.columns}
              if skip_empty else {})
    present = nonempty_sources(probed, id_col) if probed else set()
    for name, agg in aggregates.items():
        if agg is None:
            continue
        if name in probed and name not in present:
            continue
        new_cols = [c for c in agg.columns if c != id_col]
        out = out.join(agg, id_col, "left")
        added += new_cols
    fill = [c for c in added if c.startswith(count_prefixes)]
    if fill:
        out = out.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in fill else F.col(c)
                           for c in out.columns])
    return out


def enrich_applications(base: DataFrame, sources: dict[str, DataFrame], id_col: str = ID,
                        skip_empty: bool = False) -> DataFrame:
    """Flagship: roll up every present source and join the features onto the applications."""
    return enrich(base, build_aggregates(sources, id_col), id_col, sources=sources, skip_empty=skip_empty)
