"""Population segments and segment-level KPIs.

Every segment table is a ``groupBy(label)``: partial aggregation keeps a
hot segment (one band holding a third of the rows) to one row per map
task. Quantile edges come from the exact bounded-task primitive and are
parameter-sized (n-1 doubles), so they are inlined as literals.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expr import rround

from riskweave.functions import expr as X
from riskweave.operators.ordered import bucket_by_edges
from riskweave.operators.quantiles import column_quantiles, quantile_edges
from riskweave.session import reliable_checkpoint

SEGMENT_COLS = ["segment_name", "segment_value", "n", "default_rate"]


def quantile_labels(n: int) -> list[str]:
    return [f"q{i}" for i in range(1, n + 1)]


def quantile_bin(df: DataFrame, col: str, n: int = 5, labels: list[str] | None = None,
                 out_col: str | None = None, edges: list[float] | None = None) -> DataFrame:
    """Label i = first i with x <= Q(i/n) (linear quantiles over non-null); above all -> last.

    Tied quantiles collapse bins (the earlier label wins). NULL -> NULL.
    ``edges`` may be passed when they were computed together with others.
    """
    labels = labels or quantile_labels(n)
    if edges is None:
        edges = quantile_edges(df, col, [i / n for i in range(1, n)])
    out_col = out_col or f"{col}_bin"
    if edges is None:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    idx = bucket_by_edges(F.col(col).cast("double"), edges)
    lab = F.array(*[F.lit(x) for x in labels])
    return df.withColumn(out_col, F.when(idx.isNull(), F.lit(None).cast("string")).otherwise(
        F.element_at(lab, idx)))


def risk_band(df: DataFrame, p: str = "y_proba", out_col: str = "risk_band") -> DataFrame:
    """Low / Medium / High at the 1/3, 2/3 score quantiles (<= is the lower band), unrounded score."""
    return quantile_bin(df, p, 3, ["Low", "Medium", "High"], out_col)


def _segment(df: DataFrame, name: str, label: Column, target: str) -> DataFrame:
    g = df.select(label.alias("segment_value"), F.col(target).alias("__y")).where(
        F.col("segment_value").isNotNull())
    return g.groupBy("segment_value").agg(
        F.count(F.lit(1)).alias("n"), rround(F.avg("__y"), 6).alias("default_rate")
    ).select(F.lit(name).alias("segment_name"), "segment_value", "n", "default_rate")


def segments_by_quantile(df: DataFrame, measure: str, name: str, n: int = 5, target: str = "TARGET",
                         edges: list[float] | None = None) -> DataFrame:
    """Quantile bins of a measure; per non-empty label n and round(mean target, 6)."""
    binned = quantile_bin(df.select(measure, target), measure, n, out_col="__band", edges=edges)
    return _segment(binned, name, F.col("__band"), target)


def segments_by_band(df: DataFrame, days_birth: str = "DAYS_BIRTH", name: str = "age_band",
                     target: str = "TARGET") -> DataFrame:
    """Age band of the rounded age in years."""
    return _segment(df, name, X.age_band(X.age_years(days_birth)), target)


def segments_by_category(df: DataFrame, col: str, name: str, target: str = "TARGET") -> DataFrame:
    """Every non-null category."""
    return _segment(df, name, F.col(col).cast("string"), target)


def _edges_or_empty(e):
    # an all-NULL measure has no edges: every label is NULL and the segment is empty
    return e if e is not None else []


def population_segments(df: DataFrame, target: str = "TARGET") -> DataFrame:
    """Income band, age band, credit band, gender, in that order (segment_order column)."""
    cols = [c for c in ("AMT_INCOME_TOTAL", "DAYS_BIRTH", "AMT_CREDIT", "CODE_GENDER", target) if c in df.columns]
    # several passes (two quantile edge lists + the segment aggregates): materialise the
    # narrow projection once on shared storage instead of re-running the upstream plan
    df = reliable_checkpoint(df.select(*cols))
    measures = [c for c in ("AMT_INCOME_TOTAL", "AMT_CREDIT") if c in df.columns]
    # both measures' quintile edges from one value-count pass
    edges = column_quantiles(df, measures, [i / 5 for i in range(1, 5)]) if measures else {}
    parts = []
    if "AMT_INCOME_TOTAL" in df.columns:
        parts.append(segments_by_quantile(df, "AMT_INCOME_TOTAL", "income_band", 5, target,
                                          _edges_or_empty(edges["AMT_INCOME_TOTAL"])))
    parts.append(segments_by_band(df, "DAYS_BIRTH", "age_band", target))
    if "AMT_CREDIT" in df.columns:
        parts.append(segments_by_quantile(df, "AMT_CREDIT", "credit_amount_band", 5, target,
                                          _edges_or_empty(edges["AMT_CREDIT"])))
    parts.append(segments_by_category(df, "CODE_GENDER", "gender", target))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def segment_extremes(segments: DataFrame) -> DataFrame:
    """Per segment_name the n-weighted mean rate, riskiest/safest value and the spread.

    Ties on the rate resolve to the smallest segment value.
    """
    return segments.groupBy("segment_name").agg(
        F.try_divide(F.sum(F.col("default_rate") * F.col("n")), F.sum("n").cast("double")).alias("weighted_default_rate"),
        F.min(F.struct((-F.col("default_rate")).alias("r"), F.col("segment_value").alias("v"))).alias("hi"),
        F.min(F.struct(F.col("default_rate").alias("r"), F.col("segment_value").alias("v"))).alias("lo"),
    ).select("segment_name", "weighted_default_rate",
             F.col("hi.v").alias("riskiest_value"), (-F.col("hi.r")).alias("riskiest_rate"),
             F.col("lo.v").alias("safest_value"), F.col("lo.r").alias("safest_rate"),
             ((-F.col("hi.r")) - F.col("lo.r")).alias("spread"))


# ---- K1–K3: contract tables promised by the reference, built from the same pieces
def decision_table(preds: DataFrame, app: DataFrame, threshold: float = 0.2, id_col: str = "application_id",
                   app_id: str = "SK_ID_CURR", p: str = "y_proba") -> DataFrame:
    """K2: predictions + decision, threshold_used, risk band and segment columns."""
    banded = risk_band(preds, p)
    seg = app.select(F.col(app_id).alias(id_col),
                     X.age_band(X.age_years("DAYS_BIRTH")).alias("age_band"),
                     F.col("CODE_GENDER").alias("gender"))
    j = banded.join(seg, id_col, "left")
    return j.select("*",
                    F.when(X.approve(p, threshold), F.lit("approve")).otherwise(F.lit("decline")).alias("decision"),
                    F.lit(float(threshold)).alias("threshold_used"))


def segment_kpis(decisions: DataFrame, segment_cols: list[str] = ("risk_band", "age_band", "gender"),
                 p: str = "y_proba", y: str = "y_true") -> DataFrame:
    """K1: approval rate, mean PD and estimated bad rate (mean PD of approved) per segment value."""
    parts = []
    for s in segment_cols:
        approved = F.col("decision") == "approve"
        parts.append(decisions.where(F.col(s).isNotNull()).groupBy(F.col(s).alias("segment_value")).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(approved.cast("int")).alias("approval_rate"),
            F.avg(p).alias("avg_pd"),
            F.avg(F.when(approved, F.col(p))).alias("estimated_bad_rate"),
            F.avg(y).alias("observed_default_rate"),
        ).select(F.lit(s).alias("segment_name"), "*"))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def fairness_report(decisions: DataFrame, group_col: str = "gender", y: str = "y_true") -> DataFrame:
    """K3: per group approval rate and true-positive rate (defaults declined) vs the overall rates.

    The overall row is one more grouping set of the same aggregation, so
    the table is one pass; the gap is a window over <= groups + 1 rows.
    """
    d = decisions.where(F.col(group_col).isNotNull())
    declined = (F.col("decision") == "decline").cast("int")
    g = d.rollup(F.col(group_col).alias("group_value")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("decision") == "approve").cast("int")).alias("approval_rate"),
        F.try_divide(F.sum(F.when(F.col(y) == 1, declined)).cast("double"),
                     F.sum((F.col(y) == 1).cast("int")).cast("double")).alias("tpr"),
        F.grouping_id().alias("_gid"))
    w = Window.partitionBy()
    overall_ar = F.max(F.when(F.col("_gid") == 1, F.col("approval_rate"))).over(w)
    overall_tpr = F.max(F.when(F.col("_gid") == 1, F.col("tpr"))).over(w)
    out = g.select("*", overall_ar.alias("_ar"), overall_tpr.alias("_tpr")).where(F.col("_gid") == 0)
    return out.select(F.lit(group_col).alias("group_name"), "group_value", "n", "approval_rate", "tpr",
                      (F.col("approval_rate") - F.col("_ar")).alias("approval_rate_gap"),
                      (F.col("tpr") - F.col("_tpr")).alias("tpr_gap"))
