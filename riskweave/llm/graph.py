"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a join and two grouped minima; the edge table shrinks towards one star
per component. Rounds are cut with reliable checkpoints. No component or neighbourhood
is ever gathered in one task: the driver sees one count per round. Tables are dealt by node over
as many partitions as their rows ask for (``ROWS_PER_PARTITION``), once a step: a round of a small table is a few tasks,
one of a large table as many as it needs, and each dealing serves the minimum, the join and the removal of repeats.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

ROWS_PER_PARTITION = 100_000


def _dealt(edges: DataFrame, parts: int) -> DataFrame:
    """Edges without loops and repeats, dealt by u."""
    return edges.where(F.col("u") != F.col("v")).repartition(parts, "u").dropDuplicates(["u", "v"])


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of edges (u, v) the smallest node it is connected to.

    Nulls and loops are ignored; an empty table gives an empty result.
    """
    e = reliable_checkpoint(_directed(edges.select("u", "v")).where("u <> v").distinct())
    state = _state(e)
    while True:
        parts = 1 + state[0] // ROWS_PER_PARTITION
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(parts, "u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _dealt(both.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")), parts)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        e = reliable_checkpoint(_dealt(_directed(small.unionByName(low2.withColumnRenamed("m", "v"))), parts))
        now = _state(e)
        if now == state:
            break
        state = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
