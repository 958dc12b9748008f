"""Shape, missingness, types, target stats, KPI row, feature summary, correlation.

Column-wise statistics run as *one* wide aggregate per table (partial
aggregation: one row per map task crosses the network) or as an unpivot to
(feature, value) followed by ``groupBy(feature)``; quantiles use the
bounded-task exact primitive. Column names and types are schema metadata,
so they are read from ``df.schema`` at plan-build time.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expr import rround
from pyspark.sql import types as T

from riskweave.functions import expr as X
from riskweave.operators.quantiles import sketched_quantiles
from riskweave.session import reliable_checkpoint

SUMMARY_PROBS = [0.05, 0.5, 0.95]


def is_numeric(dt: T.DataType) -> bool:
    """Numeric = integral/fractional/decimal; booleans are categorical (pandas kind 'b')."""
    return isinstance(dt, T.NumericType)


def split_columns(df: DataFrame, drop: list[str] | tuple = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature lists in schema order."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        (num if is_numeric(f.dataType) else cat).append(f.name)
    return num, cat


def data_shape(df: DataFrame) -> DataFrame:
    """One row (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def _missing_row(df: DataFrame) -> DataFrame:
    """One wide aggregate: total rows + NULL count of every column (one scan)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"__m{i}") for i, c in enumerate(df.columns)]
    return df.agg(*aggs)


def missingness(df: DataFrame, digits: int = 6) -> DataFrame:
    """(column, missing_ratio) per column, ratio = round(nulls / rows, 6)."""
    row = _missing_row(df)
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"),
                      rround(F.try_divide(F.col(f"__m{i}").cast("double"), F.col("__n").cast("double")),
                              digits).alias("missing_ratio"))
             for i, c in enumerate(df.columns)]
    return row.select(F.explode(F.array(*pairs)).alias("s")).select("s.column", "s.missing_ratio")


def column_types(df: DataFrame) -> DataFrame:
    """(column, dtype, n_present): Spark's type name and the number of non-null values, in one aggregate."""
    row = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(df.schema.fields)])
    pairs = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"_{i}").alias("n_present"))
             for i, f in enumerate(df.schema.fields)]
    return row.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def target_stats(df: DataFrame, target: str = "TARGET") -> DataFrame:
    """Count per target value ascending; pct over ALL rows (NULL-target rows in the denominator)."""
    counts = df.groupBy(F.col(target).alias("target_value")).agg(F.count(F.lit(1)).alias("count"))
    # at most a handful of rows (validated binary): a global window here is bounded
    total = F.sum("count").over(Window.partitionBy())
    return (counts.select("target_value", "count",
                          rround(F.col("count") / total * 100, 4).alias("pct"))
            .where(F.col("target_value").isNotNull()))


def kpi_overview(df: DataFrame, run_id: str, created_at: str, target: str = "TARGET") -> DataFrame:
    """One KPI row computed from a single wide aggregate (no driver round trip)."""
    n_cols = len(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(target)).alias("__t"),
                 *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"__m{i}") for i, c in enumerate(df.columns)])
    rates = F.array(*[F.col(f"__m{i}") / F.col("__n") for i in range(n_cols)])
    return row.select(
        F.lit(run_id).alias("run_id"),
        F.lit(created_at).alias("created_at"),
        F.col("__n").alias("n_rows"),
        F.lit(n_cols).alias("n_cols"),
        rround(F.try_divide(F.col("__t").cast("double"), F.col("__n").cast("double")), 6).alias("default_rate"),
        rround(F.aggregate(rates, F.lit(0.0), lambda acc, r: acc + r) / n_cols, 6).alias("avg_missing_rate"),
        rround(F.size(F.filter(rates, lambda r: r > 0.4)) / F.lit(float(n_cols)) * 100, 4)
         .alias("pct_columns_missing_gt_40"),
    )


def _dtype_map(df: DataFrame) -> Column:
    kv = []
    for f in df.schema.fields:
        kv += [F.lit(f.name), F.lit(f.dataType.simpleString())]
    return F.create_map(*kv)


def missingness_by_feature(df: DataFrame) -> DataFrame:
    """B4 + dtype + feature group (C10 over the feature-name column)."""
    m = missingness(df)
    return m.select(F.col("column").alias("feature"), F.col("missing_ratio").alias("missing_rate"),
                    _dtype_map(df)[F.col("column")].alias("dtype"),
                    X.feature_group(F.col("column")).alias("feature_group"))


def category_counts(df: DataFrame, categorical: list[str]) -> DataFrame:
    """(feature, value, c): occurrences of every value of the categorical columns, NULL included, map-side combined.

    Each column is grouped on its own over that column alone, so no row is multiplied.
    """
    parts = [df.groupBy(F.col(f"`{c}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("c")).select(F.lit(c).alias("feature"), "value", "c")
             for c in categorical]
    return reliable_checkpoint(reduce(DataFrame.unionByName, parts))


def _numeric_summary(df: DataFrame, wide: DataFrame, numeric: list[str], exact: bool) -> DataFrame:
    """Wide aggregates (no row is multiplied) for counts, moments and quantile sketches; then the brackets are refined."""
    row = wide.agg(F.count(F.lit(1)).alias("rows"), *[e for i, c in enumerate(numeric) for e in (
        F.count(f"`{c}`").alias(f"n{i}"), F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_samp(f"`{c}`").alias(f"s{i}"))]).first()

    quantiles = sketched_quantiles(wide, {c: row[f"n{i}"] for i, c in enumerate(numeric)}, SUMMARY_PROBS, exact)
    rows = [(c, row["rows"], row[f"n{i}"], row[f"m{i}"], row[f"s{i}"] if row[f"n{i}"] > 1 else None,
             *(quantiles.get((c, j)) for j in range(len(SUMMARY_PROBS)))) for i, c in enumerate(numeric)]
    stats = df.sparkSession.createDataFrame(
        rows, "feature string, _rows long, n long, mean double, std double, p05 double, p50 double, p95 double")
    return stats.select(
        "feature", _dtype_map(df)[F.col("feature")].alias("dtype"), "n",
        rround(F.try_divide((F.col("_rows") - F.col("n")).cast("double"), F.col("_rows").cast("double")), 6).alias("missing_rate"),
        *[rround(c, 6).alias(c) for c in ("mean", "std", "p05", "p50", "p95")],
        F.lit(None).cast("string").alias("top1"), F.lit(None).cast("double").alias("top1_rate"),
        F.lit(None).cast("string").alias("top2"), F.lit(None).cast("double").alias("top2_rate"),
        X.feature_group(F.col("feature")).alias("feature_group"))


def _as_doubles(df: DataFrame, numeric: list[str]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(c) for c in numeric]


def _categorical_summary(df: DataFrame, allvc: DataFrame) -> DataFrame:
    """Top-2 via ``min(struct(-count, value))`` twice — partially aggregated, no per-feature window."""
    base = allvc.groupBy("feature").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))),
                                                   F.lit(0)).alias("n"), F.sum("c").alias("_rows"))
    vc = allvc.where(F.col("value").isNotNull())
    top1 = vc.groupBy("feature").agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col("value").alias("v"))).alias("t1"))
    rest = vc.join(top1, "feature").where(F.col("value") != F.col("t1.v"))
    top2 = rest.groupBy("feature").agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col("value").alias("v"))).alias("t2"))
    out = base.join(top1, "feature", "left").join(top2, "feature", "left")
    rate = lambda t: rround(F.try_divide((-F.col(f"{t}.nc")).cast("double"), F.col("n").cast("double")) * 100, 4)
    return out.select(
        "feature", _dtype_map(df)[F.col("feature")].alias("dtype"), "n",
        rround((F.col("_rows") - F.col("n")) / F.col("_rows"), 6).alias("missing_rate"),
        *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "p05", "p50", "p95")],
        F.col("t1.v").alias("top1"), rate("t1").alias("top1_rate"),
        F.col("t2.v").alias("top2"), rate("t2").alias("top2_rate"),
        X.feature_group(F.col("feature")).alias("feature_group"))


def feature_summary_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """E9 numeric part: n, missing_rate, mean, sample std, p05/p50/p95 (linear), round 6; the numeric columns are written once."""
    num, _ = split_columns(df)
    if not num:
        return _empty_summary(df)
    return _numeric_summary(df, reliable_checkpoint(df.select(*_as_doubles(df, num))), num, exact)


def feature_summary_categorical(df: DataFrame) -> DataFrame:
    """E9 categorical part: two most frequent values and their % of non-null rows (ties: value asc)."""
    _, cat = split_columns(df)
    return _categorical_summary(df, category_counts(df, cat)) if cat else _empty_summary(df)


def _empty_summary(df: DataFrame) -> DataFrame:
    schema = ("feature string, dtype string, n bigint, missing_rate double, mean double, std double, "
              "p05 double, p50 double, p95 double, top1 string, top1_rate double, top2 string, "
              "top2_rate double, feature_group string")
    return df.sparkSession.createDataFrame([], schema)


def feature_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Numeric stats or categorical tops per column, other kind's cells NULL — the table is written once and read in passes."""
    num, cat = split_columns(df)
    if not num and not cat:
        return _empty_summary(df)
    wide = reliable_checkpoint(df.select(*_as_doubles(df, num), *[F.col(f"`{c}`") for c in cat]))
    parts = [_numeric_summary(df, wide, num, exact)] if num else []
    if cat:
        parts.append(_categorical_summary(df, category_counts(wide, cat)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def correlation_top(df: DataFrame, target: str = "TARGET", digits: int = 6) -> DataFrame:
    """Pearson r of every numeric column with the target, pairwise-complete.

    Constant columns (min = max on the complete pairs) have no defined r and
    are dropped, as are columns with no complete pair. ``F.corr`` is avoided:
    under ANSI it raises on a constant column.
    """
    num, _ = split_columns(df, drop=[target])
    if not num:
        return df.sparkSession.createDataFrame([], "feature string, corr_with_target double")
    sel = df.select(F.col(f"`{target}`").cast("double").alias("__y"),
                    *[F.col(f"`{c}`").cast("double").alias(c) for c in num])
    long = sel.unpivot(["__y"], num, "feature", "x").where(F.col("x").isNotNull() & F.col("__y").isNotNull())
    st = long.groupBy("feature").agg(
        F.covar_pop("x", "__y").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("__y").alias("sy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("__y").alias("y0"), F.max("__y").alias("y1"))
    r = F.when((F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1")), F.lit(None)).otherwise(
        F.try_divide(F.col("cov"), F.col("sx") * F.col("sy")))
    out = st.select("feature", r.alias("r")).where(F.col("r").isNotNull() & ~F.isnan("r"))
    return out.select("feature", rround("r", digits).alias("corr_with_target"))


def correlation_top_sorted(df: DataFrame, target: str = "TARGET") -> DataFrame:
    """E10 in display order: |r| descending, feature name ascending on ties."""
    c = correlation_top(df, target)
    return c.orderBy(F.abs("corr_with_target").desc(), "feature")
