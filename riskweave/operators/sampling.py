"""Deterministic, stratified splitting and sampling.

Row order inside a class is a hash of (id, seed) — md5, so any SQL engine
reproduces the same split. Splits and samples find one cutoff per class
from narrow (class, hash) counts and label rows in place; folds need
every rank, by :func:`running_totals`. Only class counts and cutoffs
(a few numbers) visit the driver. A NULL label is a class of its own.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ordered import running_totals


def hash_key(id_col: str, seed) -> Column:
    """60-bit order key: first 15 hex digits of md5(id || '|' || seed)."""
    m = F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|"), F.lit(str(seed))))
    return F.conv(F.substring(m, 1, 15), 16, 10).cast("long")


#: More label values than this are refused: a stratum per value only makes sense for classes.
MAX_CLASSES = 1_000
#: Hash prefixes that locate a quota; a class of N rows has about N / PREFIXES rows per prefix.
PREFIX_BITS = 16


def class_counts(df: DataFrame, y: str) -> dict:
    """Rows per class, NULL included (at most MAX_CLASSES rows reach the driver)."""
    rows = df.groupBy(y).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{y} has more than {MAX_CLASSES} values: not a class column")
    return {r[0]: int(r[1]) for r in rows}


def _first_of_class(df: DataFrame, y: str, id_col: str, seed, quotas: dict) -> Column:
    """Flag of the first quotas[class] rows of each class in hash order, as a narrow expression.

    The hash is uniform, so (class, prefix) counts locate the prefix that holds each class's quota; only
    that prefix's (hash, id) pairs are ranked, which gives one cutoff pair per class. Rows themselves
    are never shuffled: they compare their own pair with the cutoff. Rows without an id are never first.
    """
    keyed = df.select(F.col(y).alias("_y"), F.col(id_col).alias("_id"), hash_key(id_col, seed).alias("_h")).where("_h is not null")
    keyed = keyed.withColumn("_b", F.shiftright("_h", 60 - PREFIX_BITS))
    upto = Window.partitionBy("_y").orderBy("_b")
    wanted = F.lit(0)
    for k, q in quotas.items():
        wanted = F.when(F.col("_y").eqNullSafe(F.lit(k)), F.lit(q)).otherwise(wanted)
    counts = (keyed.groupBy("_y", "_b").agg(F.count(F.lit(1)).alias("_n"))          # <= classes x 2^PREFIX_BITS rows
              .withColumn("_cum", F.sum("_n").over(upto)).withColumn("_want", wanted))
    spots = (counts.where("_cum - _n < _want").groupBy("_y")
             .agg(F.max(F.struct("_b", (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_left"), "_n")).alias("s"))
             .select("_y", "s.*").collect())                                     # one row per class
    if not spots:
        return F.lit(False)
    inside, rank = F.lit(False), F.lit(0)
    for r in spots:
        here = F.col("_y").eqNullSafe(F.lit(r["_y"])) & (F.col("_b") == F.lit(r["_b"]))
        inside = inside | here
        rank = F.when(here, F.lit(min(r["_left"], r["_n"]))).otherwise(rank)
    cuts = (keyed.where(inside).withColumn("_at", rank)
            .withColumn("_rank", F.row_number().over(Window.partitionBy("_y").orderBy("_h", "_id")))
            .where("_rank = _at").select("_y", "_h", "_id").collect())            # one row per class
    h, i, first = hash_key(id_col, seed), F.col(id_col), F.lit(False)
    for r in cuts:
        first = first | (F.col(y).eqNullSafe(F.lit(r["_y"])) & ((h < r["_h"]) | ((h == r["_h"]) & (i <= F.lit(r["_id"])))))
    return F.coalesce(first, F.lit(False))


def stratified_split(df: DataFrame, y: str = "TARGET", id_col: str = "SK_ID_CURR", test_frac: float = 0.2,
                     seed=42, out_col: str = "split", labels: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Per class (NULL is one), the first ceil(frac * n_class) rows in hash order are 'test'."""
    if not 0 < test_frac < 1:
        raise ValueError("test_frac must be in (0, 1)")
    quotas = {k: math.ceil(test_frac * n) for k, n in class_counts(df, y).items()}
    return df.withColumn(out_col, F.when(_first_of_class(df, y, id_col, seed, quotas), F.lit(labels[1]))
                         .otherwise(F.lit(labels[0])))


def three_way_split(df: DataFrame, y: str = "TARGET", id_col: str = "SK_ID_CURR", test_frac: float = 0.2,
                    calib_frac: float = 0.25, seed=42, out_col: str = "split") -> DataFrame:
    """Outer stratified test slice, then a stratified calibration slice of the remainder."""
    outer = stratified_split(df, y, id_col, test_frac, f"{seed}-outer", "_outer", ("train", "test"))
    train = outer.where(F.col("_outer") == "train")
    quotas = {k: math.ceil(calib_frac * n) for k, n in class_counts(train, y).items()}
    calib = _first_of_class(train, y, id_col, f"{seed}-inner", quotas)
    return outer.withColumn(out_col, F.when(F.col("_outer") == "test", F.lit("test")).when(calib, F.lit("calib"))
                            .otherwise(F.lit("fit"))).drop("_outer")


def stratified_sample(df: DataFrame, n: int, y: str = "TARGET", id_col: str = "SK_ID_CURR", seed=42) -> DataFrame:
    """Class-proportional sample of about n rows (quota ceil(n_class * n / N)); all rows if n >= N."""
    counts = class_counts(df, y)
    total = sum(counts.values())
    if n >= total:
        return df
    quotas = {k: math.ceil(c * n / total) for k, c in counts.items()}
    return df.where(_first_of_class(df, y, id_col, seed, quotas))


def stratified_folds(df: DataFrame, k: int, y: str = "TARGET", id_col: str = "SK_ID_CURR", seed=42,
                     out_col: str = "fold") -> DataFrame:
    """I4: class-balanced fold id in [0, k): (rank - 1) mod k in hash order within each class (NULL is one)."""
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_one", F.lit(1))
    ranked = running_totals(keyed, "_h", ["_one"], [y], tie_breakers=[id_col], prefix="_rank")
    return ranked.withColumn(out_col, ((F.col("_rank_one") - 1) % k).cast("int")).drop("_rank_one", "_h", "_one")


def sample_rows(df: DataFrame, n: int, id_col: str = "SK_ID_CURR", seed=42) -> DataFrame:
    """Uniform sample of n rows: the n smallest hash keys (per-partition top-n, then merge)."""
    return (df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h"))
