"""Exact quantiles of whole columns: sketch a bracket, then rank only what lies inside it.

One wide aggregate sketches a bracket around each wanted quantile (no row is multiplied), one counts the values below each bracket, and
only values inside a bracket, about a thousandth of the rows, are grouped and ranked. The result is exact; where a sketch misses, all
values of that column are ranked. Numbers that reach the driver: a few a column and quantile.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ordered import running_totals, value_counts
from riskweave.session import reliable_checkpoint

#: Rank resolution of the quantile sketch, and the margin in its units that brackets a quantile for sure.
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 5


def refine(wide: DataFrame, brackets: list[tuple]) -> dict[tuple[str, int], float]:
    """Exact quantiles from brackets (column, probability index, low, high, first rank, second rank, fraction).

    One aggregate counts the values below each bracket; only values inside a bracket (about a thousandth of the
    rows) are grouped and ranked. At most two values per bracket reach the driver.
    """
    if not brackets:
        return {}
    below = wide.agg(*[F.count_if(F.col(f"`{c}`") < F.lit(lo)).alias(f"b{k}") for k, (c, _, lo, *_) in enumerate(brackets)]).first()
    inside = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.when(F.col(f"`{c}`").between(lo, hi), F.col(f"`{c}`")).alias("v"))
                                for k, (c, _, lo, hi, *_) in enumerate(brackets)]), lambda e: e["v"].isNotNull())
    counts = (wide.select(F.explode(inside).alias("e")).select("e.k", "e.v").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    ranked = running_totals(counts, "v", ["n"], ["k"])
    wanted = wide.sparkSession.createDataFrame(
        [(k, side, r - below[f"b{k}"]) for k, x in enumerate(brackets) for side, r in enumerate(x[4:6])], "k int, side int, r long")
    got = {(x["k"], x["side"]): x["v"] for x in ranked.join(wanted, "k").where("cum_n - n <= r and r < cum_n").select("k", "side", "v").collect()}
    out = {}
    for k, (c, j, _, _, *ranks, fraction) in enumerate(brackets):
        if (k, 0) not in got or (k, 1) not in got:
            # the sketch missed this quantile: rank all values of the column
            every = running_totals(value_counts(wide, c), "_v", ["_n"])
            for side, r in enumerate(ranks):
                got[k, side] = every.where((F.col("cum__n") - F.col("_n") <= r) & (F.lit(r) < F.col("cum__n"))).first()["_v"]
        out[c, j] = got[k, 0] + (got[k, 1] - got[k, 0]) * fraction
    return out


def sketched_quantiles(wide: DataFrame, counts: dict[str, int], probs: list[float], exact: bool = True) -> dict[tuple[str, int], float]:
    """(column, probability index) to the linear-interpolated quantile of a column's ``counts`` non-null values; sketches alone if not ``exact``."""
    def around(n: int) -> list[float]:
        margin = SKETCH_MARGIN / SKETCH_ACCURACY + 2 / n if exact and n else 0.0
        return [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]

    held = [c for c, n in counts.items() if n]
    if not held or not probs:
        return {}
    # sketches of all tasks are merged in one: no more tasks than cores make them
    few = wide.coalesce(wide.sparkSession.sparkContext.defaultParallelism)
    sketch = few.agg(*[F.percentile_approx(f"`{c}`", around(counts[c]), SKETCH_ACCURACY).alias(f"q{i}") for i, c in enumerate(held)]).first()
    quantiles, brackets = {}, []
    for i, c in enumerate(held):
        for j, p in enumerate(probs):
            lo, hi = sketch[f"q{i}"][2 * j:2 * j + 2]
            at = p * (counts[c] - 1)
            if lo == hi:
                quantiles[c, j] = lo
            else:
                brackets.append((c, j, lo, hi, int(at), math.ceil(at), at - int(at)))
    return quantiles | refine(wide, brackets)


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Quantiles of each column over its non-null values (NumPy 'linear' / SQL quantile_cont); None where all are NULL."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    wide = reliable_checkpoint(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]))
    row = wide.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(cols)]).first()
    got = sketched_quantiles(wide, {c: row[f"n{i}"] for i, c in enumerate(cols)}, probs)
    return {c: [got[c, j] for j in range(len(probs))] if row[f"n{i}"] else None for i, c in enumerate(cols)}


def quantile_edges(df: DataFrame, value_col: str, probs: list[float]) -> list[float] | None:
    """The quantile list of one column (None if all NULL)."""
    return column_quantiles(df, [value_col], probs)[value_col]
