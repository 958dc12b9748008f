"""Decision economics over a (label, probability) table.

Every score is bucketed once against the sorted threshold list
(``#thresholds <= p``), grouped, and prefix-summed over <= T+1 bucket
rows — one scan and one tiny aggregate whatever the row count, instead of
a rows x thresholds loop or a cross join with a parameter table.
"""
from __future__ import annotations

from itertools import accumulate, repeat, takewhile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.expr import rround

from riskweave.operators.checks import validate_scenarios, validate_scores, validate_sweep
from riskweave.operators.ordered import count_below

# Default sweep and economics (the reference configuration).
DEFAULT_SWEEP = (0.05, 0.95, 0.05)
DEFAULT_PROFIT_IF_GOOD = 0.2
DEFAULT_LOSS_GIVEN_DEFAULT = 1.0
DEFAULT_SCENARIOS = [
    {"name": "Base", "threshold": 0.2, "profit_if_good": 0.2, "loss_given_default": 1.0},
    {"name": "Conservative", "threshold": 0.1, "profit_if_good": 0.2, "loss_given_default": 1.0},
    {"name": "Aggressive", "threshold": 0.3, "profit_if_good": 0.25, "loss_given_default": 1.0},
]


def sweep_thresholds(start: float, stop: float, step: float) -> list[float]:
    """Thresholds by float accumulation, each rounded to 4 places (0.05..0.95 by 0.05 gives 18)."""
    start, stop, step = validate_sweep(start, stop, step)
    return [round(t, 4) for t in takewhile(lambda t: t <= stop, accumulate(repeat(step), initial=start))]


def approval_counts(df: DataFrame, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """Per threshold j: n (all rows), approved (p < t_j), good/bad among approved.

    Returns <= len(thresholds) rows: j, threshold, n, approved, good, bad.
    """
    spark: SparkSession = df.sparkSession
    ts = sorted(set(float(t) for t in thresholds))
    pc, yc = F.col(p), F.col(y).cast("int")
    # a missing score is never approved (NaN < t is false in the pandas original)
    bucket = F.when(pc.isNull() | F.isnan(pc), F.lit(len(ts))).otherwise(count_below(pc, ts, inclusive=True))
    counts = df.select(bucket.alias("b"), yc.alias("y")).groupBy("b").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum((F.col("y") == 0).cast("long")).alias("g"),
        F.sum((F.col("y") == 1).cast("long")).alias("d"))
    grid = spark.createDataFrame([(j, t) for j, t in enumerate(ts)] + [(len(ts), None)],
                                 "b int, threshold double")
    # grid and counts both have <= T+1 rows: this window/join is parameter-sized
    full = grid.join(F.broadcast(counts), "b", "left").na.fill(0, ["cnt", "g", "d"])
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy()
    out = full.select("b", "threshold",
                      F.sum("cnt").over(wall).alias("n"),
                      F.sum("cnt").over(w).alias("approved"),
                      F.sum("g").over(w).alias("good"),
                      F.sum("d").over(w).alias("bad"))
    return out.where(F.col("threshold").isNotNull()).withColumnRenamed("b", "j")


def _economics(c: DataFrame, profit, loss) -> DataFrame:
    n, a = F.col("n").cast("double"), F.col("approved").cast("double")
    return c.select(
        "*",
        F.when(F.col("n") > 0, a / n).otherwise(F.lit(0.0)).alias("_ar"),
        F.when(F.col("approved") > 0, F.col("bad") / a).otherwise(F.lit(0.0)).alias("_dr"),
        (F.col("good") * profit).alias("_pr"),
        (F.col("bad") * loss).alias("_lo"))


def threshold_sweep(df: DataFrame, y: str = "y_true", p: str = "y_proba",
                    start: float = DEFAULT_SWEEP[0], stop: float = DEFAULT_SWEEP[1], step: float = DEFAULT_SWEEP[2],
                    profit_if_good: float = DEFAULT_PROFIT_IF_GOOD,
                    loss_given_default: float = DEFAULT_LOSS_GIVEN_DEFAULT) -> DataFrame:
    """approval/default/profit/loss/value per threshold (approved = p < t), round 6.

    Raises if a score is missing or not a probability.
    """
    ts = sweep_thresholds(start, stop, step)
    validate_scores(df, p)
    e = _economics(approval_counts(df, y, p, ts), F.lit(float(profit_if_good)), F.lit(float(loss_given_default)))
    return e.select(
        "threshold",
        rround("_ar", 6).alias("approval_rate"),
        rround("_dr", 6).alias("default_rate_among_approved"),
        rround("_pr", 6).alias("expected_profit"),
        rround("_lo", 6).alias("expected_loss"),
        rround(F.col("_pr") - F.col("_lo"), 6).alias("expected_value"))


def scenario_results(df: DataFrame, scenarios: list[dict] | None = None, y: str = "y_true",
                     p: str = "y_proba") -> DataFrame:
    """the same measures per named (threshold, profit, loss) scenario, in one scan."""
    sc = validate_scenarios(scenarios if scenarios is not None else DEFAULT_SCENARIOS)
    counts = approval_counts(df, y, p, [s["threshold"] for s in sc])
    params = df.sparkSession.createDataFrame(
        [(i, s["name"], s["threshold"], s["profit_if_good"], s["loss_given_default"]) for i, s in enumerate(sc)],
        "scenario_order int, scenario_name string, threshold double, profit_if_good double, "
        "loss_given_default double")
    j = params.join(counts, "threshold", "left")
    e = _economics(j, F.col("profit_if_good"), F.col("loss_given_default"))
    return e.select(
        "scenario_order", "scenario_name", "threshold", "profit_if_good", "loss_given_default",
        rround("_ar", 6).alias("approval_rate"), rround("_dr", 6).alias("default_rate"),
        rround("_pr", 6).alias("expected_profit"), rround("_lo", 6).alias("expected_loss"),
        rround(F.col("_pr") - F.col("_lo"), 6).alias("net_value"))


def optimal_threshold(sweep: DataFrame) -> DataFrame:
    """the row maximising expected_value (ties -> lowest threshold)."""
    return sweep.orderBy(F.col("expected_value").desc(), F.col("threshold").asc()).limit(1)


def value_vs_optimal(sweep: DataFrame) -> DataFrame:
    """every sweep row with its value gap to the optimum (<= T rows)."""
    best = F.max("expected_value").over(Window.partitionBy())
    return sweep.select("*", (F.col("expected_value") - best).alias("delta_vs_optimal"))


def portfolio_projection(sweep: DataFrame, scale: float = 100.0) -> DataFrame:
    """profit, loss and value scaled to a portfolio multiple."""
    s = F.lit(float(scale))
    return sweep.select("threshold", s.alias("scale"),
                        (F.col("expected_profit") * s).alias("projected_profit"),
                        (F.col("expected_loss") * s).alias("projected_loss"),
                        (F.col("expected_value") * s).alias("projected_value"))


def best_scenario(results: DataFrame, reference_name: str = "Conservative") -> DataFrame:
    """the scenario with the highest net value (ties -> first listed) and the reference's value."""
    agg = results.agg(
        F.min(F.struct((-F.col("net_value")).alias("nv"), F.col("scenario_order").alias("o"),
                       F.col("scenario_name").alias("name"), F.col("default_rate").alias("dr"))).alias("b"),
        F.max(F.when(F.col("scenario_name") == reference_name, F.col("net_value"))).alias("ref"))
    return agg.select(F.col("b.name").alias("best_scenario"), (-F.col("b.nv")).alias("best_net_value"),
                      F.col("b.dr").alias("best_default_rate"), F.col("ref").alias("reference_net_value"))
