"""Ranking, calibration and classification metrics.

One ``score_counts`` aggregate (positives/negatives per distinct score,
map-side combined) feeds every order-based metric; the cumulative sums
over scores use :func:`running_totals`, so no global sort or single-task
window over raw rows is ever planned. Point metrics (Brier, log-loss,
confusion counts) are one-pass global aggregates.
"""
from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expr import rround

from riskweave.functions import expr as X
from riskweave.operators.ordered import bucket_by_edges, running_totals
from riskweave.operators.quantiles import column_quantiles

LOG_LOSS_EPS = float(np.finfo(np.float64).eps)   # 2**-52


def fold_rows(dfs: list[DataFrame]) -> DataFrame:
    """Merge one-row DataFrames with disjoint columns into one row: union + one aggregate, no join."""
    from functools import reduce
    cols = [(c, df.schema[c].dataType) for df in dfs for c in df.columns]
    parts = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in cols])
             for df in dfs]
    return reduce(DataFrame.unionByName, parts).agg(*[F.max(c).alias(c) for c, _ in cols])


def class_totals(cumulated: DataFrame) -> tuple[int, int]:
    """(positives, negatives) from a cumulated score table: two numbers."""
    r = cumulated.agg(F.max("cum_pos"), F.max("cum_neg")).first()
    return int(r[0] or 0), int(r[1] or 0)


def score_counts(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """(score, pos, neg) per distinct non-null score."""
    yc = F.col(y).cast("int")
    return (df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
            .groupBy(F.col(p).cast("double").alias("score"))
            .agg(F.sum((yc == 1).cast("long")).alias("pos"), F.sum((yc == 0).cast("long")).alias("neg")))


def _cum(df: DataFrame, y: str, p: str, descending: bool, n_buckets: int | None = None) -> DataFrame:
    sc = score_counts(df, y, p)
    if descending:
        sc = sc.withColumn("_k", -F.col("score"))
    else:
        sc = sc.withColumn("_k", F.col("score"))
    return running_totals(sc, "_k", ["pos", "neg"], n_buckets=n_buckets)


def auc_roc(df: DataFrame, y: str = "y_true", p: str = "y_proba", n_buckets: int | None = None) -> DataFrame:
    """H1: exact ROC AUC (trapezoid == Mann–Whitney with ties counted half). NULL if one class."""
    c = _cum(df, y, p, descending=False, n_buckets=n_buckets)
    part = c.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("s"),
                 F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return part.select(F.try_divide(F.col("s"), (F.col("P") * F.col("N")).cast("double")).alias("auc_roc"))


def average_precision(df: DataFrame, y: str = "y_true", p: str = "y_proba", n_buckets: int | None = None) -> DataFrame:
    """H2: step-wise AP = sum over distinct scores (descending) of dRecall * precision."""
    c = _cum(df, y, p, descending=True, n_buckets=n_buckets)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    part = c.agg(F.sum(F.col("pos") * prec).alias("s"), F.sum("pos").alias("P"))
    return part.select(F.try_divide(F.col("s"), F.col("P").cast("double")).alias("average_precision"))


def ks_statistic(df: DataFrame, y: str = "y_true", p: str = "y_proba", n_buckets: int | None = None) -> DataFrame:
    """G1: max |CDF_bad - CDF_good| over distinct scores, round 4; NULL with one class only."""
    c = _cum(df, y, p, descending=False, n_buckets=n_buckets)
    P, N = class_totals(c)
    if P == 0 or N == 0:
        return c.agg(F.lit(None).cast("double").alias("ks_statistic"))
    gap = F.abs(F.col("cum_pos") / F.lit(float(P)) - F.col("cum_neg") / F.lit(float(N)))
    return c.agg(rround(F.max(gap), 4).alias("ks_statistic"))


def _roc_points(cumulated: DataFrame, positives: int, negatives: int) -> DataFrame:
    body = cumulated.select(F.col("score").alias("threshold"),
                            F.try_divide(F.col("cum_neg").cast("double"), F.lit(float(negatives))).alias("fpr"),
                            F.try_divide(F.col("cum_pos").cast("double"), F.lit(float(positives))).alias("tpr"))
    origin = cumulated.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(body)


def roc_curve(df: DataFrame, y: str = "y_true", p: str = "y_proba", n_buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, descending, plus the (inf, 0, 0) origin."""
    c = _cum(df, y, p, descending=True, n_buckets=n_buckets)
    return _roc_points(c, *class_totals(c))


def roc_corners(df: DataFrame, y: str = "y_true", p: str = "y_proba", n_buckets: int | None = None) -> DataFrame:
    """The ROC curve's points but those on the straight line between their neighbours; the same curve and area.

    A point lies on the line where the counts of its score and of the next lower one are in the same
    proportion, which whole numbers decide exactly. Origin and last point stay.
    """
    sc = score_counts(df, y, p).where("pos + neg > 0").withColumn("_k", -F.col("score"))
    c = running_totals(sc, "_k", ["pos", "neg"], n_buckets=n_buckets, ahead=["pos", "neg"])
    P, N = class_totals(c)

    def wide(name):
        return F.col(name).cast("decimal(19,0)")

    bends = wide("pos") * wide("next.neg") != wide("neg") * wide("next.pos")
    return _roc_points(c.where(F.col("next").isNull() | bends), P, N)


def gini(auc: DataFrame) -> DataFrame:
    """round(2 * AUC - 1, 3)."""
    return auc.select(rround(2 * F.col("auc_roc") - 1, 3).alias("gini"))


def brier_score(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """H3: mean squared error of the probability."""
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y).cast("double"), 2)).alias("brier_score"))


def _log_loss_expr(y: str, p: str):
    q = F.least(F.greatest(F.col(p), F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    yc = F.col(y).cast("double")
    return -(yc * F.ln(q) + (1 - yc) * F.ln(1 - q))


def log_loss(df: DataFrame, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """H4: mean negative log-likelihood, p clipped to [eps, 1 - eps]."""
    return df.agg(F.avg(_log_loss_expr(y, p)).alias("log_loss"))


def classification_metrics(df: DataFrame, y: str = "y_true", p: str = "y_proba", digits: int = 6,
                           n_buckets: int | None = None) -> DataFrame:
    """H5: AUC, AP, Brier and log-loss in one row from ONE score-level aggregate.

    Brier and log-loss are sums over rows, so they regroup exactly by
    distinct score: pos * loss(p, 1) + neg * loss(p, 0).
    """
    c = _cum(df, y, p, descending=True, n_buckets=n_buckets)
    s_, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    q = F.least(F.greatest(s_, F.lit(LOG_LOSS_EPS)), F.lit(1 - LOG_LOSS_EPS))
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    agg = c.agg(
        F.sum(pos * prec).alias("ap_s"),
        # descending cumulation: a negative at score s outranks the positives strictly below
        F.sum(neg * (F.col("cum_pos") - pos / 2.0)).alias("auc_s"),
        F.sum(pos * F.pow(s_ - 1, 2) + neg * F.pow(s_, 2)).alias("br_s"),
        F.sum(-(pos * F.ln(q) + neg * F.ln(1 - q))).alias("ll_s"),
        F.sum(pos).alias("P"), F.sum(neg).alias("N"))
    n = (F.col("P") + F.col("N")).cast("double")
    return agg.select(
        rround(F.try_divide(F.col("auc_s"), (F.col("P") * F.col("N")).cast("double")), digits)
         .alias("auc_roc"),
        rround(F.try_divide(F.col("ap_s"), F.col("P").cast("double")), digits).alias("average_precision"),
        rround(F.try_divide(F.col("br_s"), n), digits).alias("brier_score"),
        rround(F.try_divide(F.col("ll_s"), n), digits).alias("log_loss"))


def metrics_compare(labelled: dict[str, DataFrame]) -> DataFrame:
    """H6: union of one-row metric tables with a leading ``model`` column."""
    out = None
    for name, m in labelled.items():
        if m is None:
            return None
        row = m.select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def confusion_matrix(df: DataFrame, threshold: float = 0.2, y: str = "y_true", p: str = "y_proba") -> DataFrame:
    """H7: tn, fp, fn, tp at predicted default = p >= t; precision/recall 0.0 when undefined."""
    pred = X.predicted_default(p, threshold)
    yc = F.col(y).cast("int")
    c = df.agg(
        F.sum((~pred & (yc == 0)).cast("long")).alias("true_negative"),
        F.sum((pred & (yc == 0)).cast("long")).alias("false_positive"),
        F.sum((~pred & (yc == 1)).cast("long")).alias("false_negative"),
        F.sum((pred & (yc == 1)).cast("long")).alias("true_positive"))
    c = c.na.fill(0)
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return c.select(
        F.lit(float(threshold)).alias("threshold"), "true_negative", "false_positive", "false_negative",
        "true_positive",
        rround(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)), 6).alias("precision"),
        rround(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)), 6).alias("recall"))


def f1_score(confusion: DataFrame) -> DataFrame:
    """H8: 2PR / (P + R), 0 when undefined."""
    pr, rc = F.col("precision"), F.col("recall")
    return confusion.select("threshold", "precision", "recall",
                            rround(F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0)), 6)
                            .alias("f1"))


# ---- H9: equal-width calibration bins with pandas.cut-style display edges -----
def _shown(x: float, digits: int) -> float:
    """x to ``digits`` decimals, or for |x| < 1 to ``digits`` significant digits."""
    d = Decimal(repr(x))
    if d and abs(d) < 1:
        digits -= d.adjusted() + 1
    return float(round(d, digits))


def _display_edges(edges: list[float], digits: int = 3) -> list[float]:
    """Edges as they are printed: with the fewest digits (from 3 on) that keep them apart, as they are if none
    does; the first is lowered by one unit of that precision, so the lowest value lies inside."""
    for n in range(digits, 20):
        shown = [_shown(e, n) for e in edges]
        if len(set(shown)) == len(edges):
            return [shown[0] - 10.0 ** -n, *shown[1:]]
    return list(edges)


def cut_edges(lo: float, hi: float, n: int) -> list[float]:
    """Equal-width edges over [lo, hi]; the lowest is widened by 0.1% of the range."""
    if lo == hi:
        d = 0.001 * abs(lo) if lo != 0 else 0.001
        return [float(v) for v in np.linspace(lo - d, hi + d, n + 1)]
    e = np.linspace(lo, hi, n + 1)
    e[0] -= (hi - lo) * 0.001
    return [float(v) for v in e]


def calibration_bins(df: DataFrame, y: str = "y_true", p: str = "y_proba", n_bins: int = 10) -> DataFrame:
    """H9: equal-width, right-closed score bins; empty bins kept (n = 0, rate NULL).

    Only the score range (one row) visits the driver; rows are bucketed
    against the parameter-sized edge list and grouped.
    """
    mm = df.agg(F.min(p).alias("lo"), F.max(p).alias("hi")).collect()[0]
    spark = df.sparkSession
    schema = "bin int, prob_bin string, _lo double, _hi double"
    if mm["lo"] is None:
        return spark.createDataFrame([], "bin int, prob_bin string, predicted_midpoint double, n bigint, "
                                         "actual_default_rate double")
    edges = cut_edges(float(mm["lo"]), float(mm["hi"]), n_bins)
    disp = _display_edges(edges)
    rows = [(i + 1, f"({disp[i]!r}, {disp[i + 1]!r}]", disp[i], disp[i + 1]) for i in range(n_bins)]
    bins = spark.createDataFrame(rows, schema).select(
        "bin", "prob_bin", rround((F.col("_lo") + F.col("_hi")) / 2, 4).alias("predicted_midpoint"))
    inner = edges[1:-1]
    pc = F.col(p).cast("double")
    scored = df.where(pc.isNotNull()).select(bucket_by_edges(pc, inner).alias("bin"), F.col(y).cast("double").alias("_y"))
    agg = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("actual_default_rate"))
    out = bins.join(agg, "bin", "left").na.fill(0, ["n"])
    return out.select("bin", "prob_bin", "predicted_midpoint", "n", "actual_default_rate")


def reliability_curve(df: DataFrame, scores: dict[str, str], y: str = "y_true", n_bins: int = 10,
                      digits: int = 6) -> DataFrame:
    """Quantile-binned reliability rows (bin = #interior edges < p), empty bins dropped,
    one block per method (score column), unioned."""
    out = None
    all_edges = column_quantiles(df, list(scores.values()), [i / n_bins for i in range(1, n_bins)])
    for method, p in scores.items():
        edges = all_edges[p]
        if edges is None:
            continue
        pc = F.col(p).cast("double")
        part = (df.where(pc.isNotNull()).select(bucket_by_edges(pc, edges).alias("bin"), pc.alias("_p"),
                                                 F.col(y).cast("double").alias("_y"))
                .groupBy("bin").agg(rround(F.avg("_p"), digits).alias("mean_predicted"),
                                    rround(F.avg("_y"), digits).alias("fraction_positive"))
                .select(F.lit(method).alias("method"), "bin", "mean_predicted", "fraction_positive"))
        out = part if out is None else out.unionByName(part)
    return out


def calibration_report(df: DataFrame, raw: str, calibrated: str, y: str = "y_true",
                       n_buckets: int | None = None) -> DataFrame:
    """AUC of the calibrated score, Brier and log-loss raw vs calibrated, and the
    Brier improvement as the difference of the *rounded* values."""
    auc = auc_roc(df, y, calibrated, n_buckets).select(rround("auc_roc", 6).alias("auc_roc"))
    pts = df.agg(
        rround(F.avg(F.pow(F.col(raw) - F.col(y).cast("double"), 2)), 6).alias("raw_brier"),
        rround(F.avg(F.pow(F.col(calibrated) - F.col(y).cast("double"), 2)), 6).alias("calibrated_brier"),
        rround(F.avg(_log_loss_expr(y, raw)), 6).alias("raw_log_loss"),
        rround(F.avg(_log_loss_expr(y, calibrated)), 6).alias("calibrated_log_loss"))
    j = fold_rows([auc, pts])
    return j.withColumn("brier_improvement", rround(F.col("raw_brier") - F.col("calibrated_brier"), 6))


def headline_metrics(kpi: DataFrame, compare: DataFrame, ks: DataFrame, champion: str, baseline: str) -> DataFrame:
    """Default rate, champion AUC, AUC delta vs baseline, Gini and KS in one row.

    One-row inputs are stacked as (metric, value) and folded by one
    aggregate — no join between them.
    """
    parts = kpi.select(F.lit("default_rate").alias("metric"), F.col("default_rate").alias("value")).unionByName(
        compare.where(F.col("model") == champion).select(F.lit("champion_auc").alias("metric"),
                                                         F.col("auc_roc").alias("value"))).unionByName(
        compare.where(F.col("model") == baseline).select(F.lit("baseline_auc").alias("metric"),
                                                         F.col("auc_roc").alias("value"))).unionByName(
        ks.select(F.lit("ks").alias("metric"), F.col("ks_statistic").alias("value")))
    m = lambda k: F.max(F.when(F.col("metric") == k, F.col("value")))
    row = parts.agg(m("default_rate").alias("default_rate"), m("champion_auc").alias("champion_auc"),
                    m("baseline_auc").alias("baseline_auc"), m("ks").alias("ks_statistic"))
    return row.select("default_rate", "champion_auc",
                      rround(F.col("champion_auc") - F.col("baseline_auc"), 6).alias("auc_delta_vs_baseline"),
                      rround(2 * F.col("champion_auc") - 1, 3).alias("gini"), "ks_statistic")


def importance_rank(imp: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Rank 1..n by importance descending, feature name ascending on ties.

    The input has one row per model feature (schema-bounded), so a single
    ordered window is bounded by the feature count, not the data.
    """
    w = Window.orderBy(F.col(value).desc(), F.col(feature).asc())
    return imp.select(feature, value, F.row_number().over(w).alias("rank"))


def top_features(imp: DataFrame, by: str, n: int, feature: str = "feature", absolute: bool = False,
                 where=None) -> DataFrame:
    """Top-n rows by ``by`` (|by| when ``absolute``), ties by feature name (TakeOrderedAndProject)."""
    src = imp.where(where) if where is not None else imp
    key = F.abs(F.col(by)) if absolute else F.col(by)
    return src.orderBy(key.desc(), F.col(feature).asc()).limit(n)


def importance_by_group(imp: DataFrame, top_n: int = 20, feature: str = "feature",
                        value: str = "importance") -> DataFrame:
    """Summed importance per importance group over the top-n features, descending."""
    top = top_features(imp, value, top_n, feature)
    return (top.groupBy(X.importance_group(F.col(feature)).alias("group"))
            .agg(F.sum(value).alias("importance")).orderBy(F.col("importance").desc(), "group"))


def score_histogram(df: DataFrame, y: str = "y_true", p: str = "y_proba", n_bins: int = 50) -> DataFrame:
    """Counts by class in fixed equal bins on [0, 1] (p = 1 falls in the last bin)."""
    b = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    return (df.where(F.col(p).isNotNull()).groupBy(F.col(y).alias("y_true"), b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("y_true", "bin", (F.col("bin") / F.lit(float(n_bins))).alias("bin_lo"),
                    ((F.col("bin") + 1) / F.lit(float(n_bins))).alias("bin_hi"), "n"))
