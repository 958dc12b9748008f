"""Isotonic calibration by pooling adjacent violators in blocks, on any number of distinct scores.

Scores are first counted (one row a distinct score, map-side combined). Then rounds: rows are ranked in score order, cut into groups of
``block_rows`` ranks, and each group pools its violators. Pooling shrinks the table, so later groups span wider score ranges; every other
round shifts the cuts by half a group, so that what two groups leave at a cut is seen together in the next.
Pools are the same in whatever order violators are pooled, so the rounds end with the exact fit: when one group holds all, or when neither a
round nor the shifted one pools anything. No task holds more than ``block_rows`` rows and the driver sees one count a round.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.ordered import count_below, running_totals
from riskweave.session import reliable_checkpoint

BLOCK_ROWS = 50_000
#: Pools up to this number are broadcast to score rows (24 bytes each); more are joined by score range.
SHARED_POOLS = 500_000
_POOL = "lo double, hi double, positives long, n long"


def pooled(frame: pd.DataFrame) -> pd.DataFrame:
    """Adjacent pools (lo, hi, positives, n) of which the lower has no smaller mean are one; means are compared in whole numbers."""
    frame = frame.sort_values("lo")
    out: list[list] = []
    for row in zip(frame["lo"].tolist(), frame["hi"].tolist(), frame["positives"].tolist(), frame["n"].tolist(), strict=True):
        at = list(row)
        while out and out[-1][2] * at[3] >= at[2] * out[-1][3]:
            before = out.pop()
            at = [before[0], at[1], before[2] + at[2], before[3] + at[3]]
        out.append(at)
    return pd.DataFrame(out, columns=["lo", "hi", "positives", "n"])


@dataclass
class IsotonicCalibrator:
    """Pools (lo, hi, positives, n) in score order: constant inside a pool, linear between two, clipped outside."""
    pools: DataFrame

    def save(self, path: str) -> str:
        self.pools.write.mode("overwrite").parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsotonicCalibrator:
        return IsotonicCalibrator(spark.read.schema(_POOL).parquet(path))

    def transform(self, df: DataFrame, p: str = "y_proba", out_col: str = "y_proba_calibrated", shared: int = SHARED_POOLS,
                  bucket_pools: int = BLOCK_ROWS, salts: int = 16) -> DataFrame:
        """df with the calibrated score; NULL scores stay NULL, and all are NULL if nothing was fitted."""
        n = self.pools.count()
        if n == 0:
            return df.withColumn(out_col, F.lit(None).cast("double"))
        if n <= shared:
            knots = df.sparkSession.sparkContext.broadcast(_knots(self.pools.toPandas()))    # at most ``shared`` rows

            @F.pandas_udf("double")
            def value(s: pd.Series) -> pd.Series:
                return pd.Series(np.interp(s, *knots.value)).where(s.notna().to_numpy())
            return df.withColumn(out_col, value(F.col(p).cast("double")))
        # pools by rank into buckets; the first of a bucket also ends the one before, for the scores between them
        ranked = running_totals(self.pools.withColumn("one", F.lit(1)), "lo", ["one"]).withColumn("r", F.col("cum_one") - 1)
        splitters = [r["lo"] for r in ranked.where((F.col("r") % bucket_pools == 0) & (F.col("r") > 0)).orderBy("lo").select("lo").collect()]  # one a bucket
        bucket = F.floor(F.col("r") / bucket_pools).cast("int")
        ends = F.array_distinct(F.array(bucket, F.greatest(F.lit(0), F.floor((F.col("r") - 1) / bucket_pools).cast("int"))))
        pools = ranked.select(F.explode(ends).alias("bucket"), "lo", "hi", "positives", "n") \
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        scores = df.select(F.col(p).cast("double").alias("score")).where("score is not null").distinct() \
            .withColumn("bucket", count_below(F.col("score"), splitters, inclusive=True)).withColumn("salt", F.pmod(F.xxhash64("score"), F.lit(salts)).cast("int"))
        mapped = scores.groupBy("bucket", "salt").cogroup(pools.groupBy("bucket", "salt")).applyInPandas(_values, "_score double, _value double")
        return df.join(mapped, F.col(p).cast("double") == F.col("_score"), "left").select(*[df[c] for c in df.columns], F.col("_value").alias(out_col))


def _knots(pools: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pools = pools.sort_values("lo")
    x = pools[["lo", "hi"]].to_numpy(float).reshape(-1)
    y = np.repeat((pools["positives"] / pools["n"]).to_numpy(), 2)
    first = np.append(True, x[1:] != x[:-1])
    return x[first], y[first]


def _values(scores: pd.DataFrame, pools: pd.DataFrame) -> pd.DataFrame:
    if not len(scores):
        return pd.DataFrame({"_score": [], "_value": []})
    return pd.DataFrame({"_score": scores["score"], "_value": np.interp(scores["score"], *_knots(pools))})


def fit_isotonic(calib: DataFrame, p: str = "y_proba", y: str = "TARGET", block_rows: int = BLOCK_ROWS) -> IsotonicCalibrator:
    """Exact non-decreasing least-squares fit of the 0/1 label on the score; rows without either are left out."""
    counts = calib.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy((F.col(p).cast("double") + F.lit(0.0)).alias("lo")) \
        .agg(F.sum(F.col(y).cast("long")).alias("positives"), F.count(F.lit(1)).alias("n"))
    blocks = reliable_checkpoint(counts.select("lo", F.col("lo").alias("hi"), "positives", "n"))
    total, shift, unchanged = blocks.count(), 0, 0
    while total > block_rows and unchanged < 2:
        ranked = running_totals(blocks.withColumn("one", F.lit(1)), "lo", ["one"])
        group = F.floor((F.col("cum_one") - 1 + shift) / block_rows)
        blocks = reliable_checkpoint(ranked.groupBy(group.alias("g")).applyInPandas(pooled, _POOL))
        now = blocks.count()
        total, shift, unchanged = now, block_rows // 2 - shift, unchanged + 1 if now == total else 0
    if total <= block_rows:
        blocks = reliable_checkpoint(blocks.groupBy(F.lit(0).alias("g")).applyInPandas(pooled, _POOL))
    return IsotonicCalibrator(blocks)
