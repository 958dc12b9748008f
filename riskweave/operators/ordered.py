"""Distributed ordered primitives: running totals and exact quantiles.

A global ``Window.orderBy`` (or ``partitionBy(class)``) funnels every row
into one task. These primitives keep the exact answer while bounding the
work per task, by one path for any number of rows or groups:

1. rows are range-partitioned on (groups, key): the engine samples the
   splitters, so a group or key range that holds most rows is cut into many
   partitions,
2. the ranged rows are written once (reliable checkpoint), so every later
   step sees the same partitions,
3. running sums inside each (group, partition),
4. totals of the (group, partition) pairs before, at most one pair per
   partition and group, are joined back null-safely and added.

The partitions only split the work; the result is exact wherever they end.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint


def running_totals(df: DataFrame, order_key: str, measures: list[str], group_cols: list[str] | tuple = (),
                   tie_breakers: list[str] | tuple = (), n_buckets: int | None = None,
                   prefix: str = "cum_", ahead: list[str] | tuple = ()) -> DataFrame:
    """Inclusive running sums of ``measures`` ordered by (order_key, *tie_breakers) within groups.

    Every row stays, whatever its group or key: NULL is a group like others, and NULL keys come first.
    Rows should be unique on (group, order_key, tie_breakers) for a
    deterministic order. Adds ``{prefix}{m}`` for every measure, and with ``ahead`` a struct ``next`` of those
    columns of the group's next row (NULL at its end); a partition's last row meets the first of the next one.
    """
    group_cols = list(group_cols)
    parts = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(order_key).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in tie_breakers]]
    ranged = reliable_checkpoint(
        df.repartitionByRange(parts, *[F.col(g).asc_nulls_first() for g in group_cols], *order)
        .withColumn("_part", F.spark_partition_id()))
    key = [*group_cols, "_part"]
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(m).over(within).alias(f"_loc_{m}") for m in measures])
    heads, nexts, found = [], [], []
    if ahead:
        local = local.withColumn("_inside", F.lead(F.struct(*ahead)).over(Window.partitionBy(*key).orderBy(*order)))
        heads = [F.min_by(F.struct(*ahead), F.struct(order_key, *tie_breakers)).alias("_head")]
        nexts = [F.lead("_head").over(Window.partitionBy(*group_cols).orderBy("_part")).alias("_beyond")]
        found = [F.coalesce("_inside", "_beyond").alias("next")]
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*key).agg(*[F.sum(m).alias(f"_tot_{m}") for m in measures], *heads)
    offsets = totals.select(*[F.col(k).alias(f"_at_{k}") for k in key],
                            *[F.coalesce(F.sum(f"_tot_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
                            *nexts)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"_off_{m}") + F.col(f"_loc_{m}")).alias(f"{prefix}{m}") for m in measures], *found)


def value_counts(df: DataFrame, value_col: str, group_cols: list[str] | tuple = (), keep_nulls: bool = False,
                 materialize: bool = True) -> DataFrame:
    """(group..., _v, _n): occurrences of every distinct value, map-side combined.

    A hot value (a third of all rows) collapses to one row per map task.
    The table feeds several passes (edges, ranks, totals), so by default it
    is written once to the shared checkpoint folder instead of recomputing
    the upstream plan for each pass.
    """
    g = list(group_cols)
    src = df if keep_nulls else df.where(F.col(value_col).isNotNull())
    counts = src.groupBy(*g, F.col(value_col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return reliable_checkpoint(counts) if materialize else counts


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], group_cols: list[str] | tuple,
                    n_buckets: int | None = None, out_col: str = "quantiles",
                    counts: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles (NumPy 'linear' / SQL quantile_cont) over non-null values.

    Returns one row per group with ``out_col`` = array of quantiles in
    ``probs`` order. Groups with no non-null value produce no row.
    Groups are matched by equality: name a NULL group before the call. Work per task is bounded: values are first collapsed to (value, count)
    with map-side combine (or passed in as ``counts`` with columns
    group..., _v, _n), then ranked with :func:`running_totals`.
    """
    g = list(group_cols)
    if not g:
        raise ValueError("name the groups; column_quantiles takes whole columns")
    if counts is None:
        counts = value_counts(df, value_col, g)
    counts = counts.where(F.col("_v").isNotNull())
    ranked = running_totals(counts, "_v", ["_n"], g, n_buckets=n_buckets)
    ranked = ranked.withColumn("_before", F.col("cum__n") - F.col("_n"))
    n_tot = counts.groupBy(*g).agg(F.sum("_n").alias("_N"))
    prob_arr = F.array(*[F.lit(float(p)) for p in probs])
    targets = (n_tot.select(*g, "_N", F.posexplode(prob_arr).alias("_j", "_p"))
               .withColumn("_pos", F.col("_p") * (F.col("_N") - 1))
               .withColumn("_lo", F.floor("_pos").cast("long"))
               .withColumn("_hi", F.ceil("_pos").cast("long"))
               .withColumn("_frac", F.col("_pos") - F.col("_lo")))
    want = targets.select(*g, "_j", F.explode(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("_lo").alias("_rank")),
        F.struct(F.lit(1).alias("_side"), F.col("_hi").alias("_rank")))).alias("_t")
    ).select(*g, "_j", "_t._side", "_t._rank")
    hit = ranked.join(want, g, "inner").where(
        (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("cum__n")))
    vals = hit.groupBy(*g, "_j").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_vhi"))
    q = vals.join(targets.select(*g, "_j", "_frac"), g + ["_j"]).select(
        *g, "_j", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("_q"))
    out = q.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("_j", "_q"))).alias("_s"))
    return out.select(*g, F.transform("_s", lambda s: s["_q"]).alias(out_col))


def count_below(x: Column, edges: Sequence[float], inclusive: bool = False) -> Column:
    """Number of edges below x (or equal, if ``inclusive``): a balanced CASE tree, so codegen and log(edges) comparisons."""
    edges = sorted(float(e) for e in edges)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        above = (x >= F.lit(edges[mid])) if inclusive else (x > F.lit(edges[mid]))
        return F.when(above, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(edges))


def bucket_by_edges(x: Column, edges: list[float]) -> Column:
    """1-based label index: 1 + #edges strictly below x; NULL stays NULL."""
    return F.when(x.isNotNull(), count_below(x, edges or []) + 1)
