"""Mixing sources to target weights by systematic sampling.

Each source gets a target (words the mix should take from it). A document's expected copies are
target / size of its source; within the source the documents stand in a fixed order, their
expected copies are prefix-summed from one random offset, and a document is emitted once per
integer boundary that its step crosses. The order is by size, which makes the systematic sample
a stratified one: the words taken miss the target by about one large document at most.

The prefix sum never needs a source in one task: rows are range-partitioned on (source, size, id),
ranked inside each partition, and shifted by the counts of the partitions before. Steps and
offsets are integers (units of 2**-20 copies), so results do not depend on summation order; the
offset comes from the source's name, so reruns agree.

Defined results: null text has size 0; a null source is a source of its own, last in order; a
source without words has target 0 and is not taken; repeated rows are documents of their own;
null doc_ids sort first; an empty table gives an empty result; extra columns are ignored
(``mixed`` keeps them, and repeats rows as the mix takes them).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
CAP = 2
UNIT = 1 << 20
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of the total by weight, capped, the excess reshared.

    One row per source from here on. Filling up by weight stops at a level L with target =
    min(cap * size, L * weight); sources sorted by cap * size / weight reach their cap in that order.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = (total.withColumn("weight", weight)
         .withColumn("limit", F.col("source_size") * float(cap))
         .withColumn("reach", F.col("limit") / F.col("weight"))
         .withColumn("level", (F.sum("source_size").over(all_) * float(share) - F.coalesce(F.sum("limit").over(fill), F.lit(0.0)))
                     / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
         .withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "level"))).over(all_)["level"]))
    return t.select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs (doc_id, source, text)."""
    spark: SparkSession = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("size", "mixed", F.col("doc_id").asc_nulls_first())
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("mixed"))
    ranged = reliable_checkpoint(
        sized.repartitionByRange(parts, F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()))
    goal = reliable_checkpoint(targets(ranged))  # one row per source
    before = (ranged.groupBy("source", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))
              .join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
              .select(F.col("source").alias("of"), F.col("part").alias("at"), "before", "source_size", "target"))
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0))
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 5), 16, 10).cast("long")
    return (ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy(*order)) - 1)
            .join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
            .withColumn("at", F.col("before") + F.col("rank"))
            .withColumn("copies", F.floor((offset + (F.col("at") + 1) * step) / UNIT) - F.floor((offset + F.col("at") * step) / UNIT))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs, all columns, each as many times as the mix takes it."""
    keys = ("_id", "_source", "_size")
    same = Window.partitionBy(*keys).orderBy(F.lit(0))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(_WORD)), F.lit(0)).cast("long").alias("_size"))
    taken = mix(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    rows, taken = (x.withColumn("_nth", F.row_number().over(same)) for x in (rows, taken))
    r, t = rows.alias("r"), taken.where("copies > 0").alias("t")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in (*keys, "_nth")]
    return (r.join(t, on[0] & on[1] & on[2] & on[3])
            .select("r._row", F.explode(F.sequence(F.lit(1), F.col("t.copies").cast("int"))).alias("_copy")).select("_row.*"))


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS mixed FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS reach FROM w),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(lim) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM r),
g AS (SELECT source, source_size, least(lim, (SELECT min_by(level, reach) FROM f WHERE level <= reach) * weight) AS target FROM f),
n AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, mixed, doc_id NULLS FIRST) - 1 AS i FROM d),
c AS (SELECT n.*, g.source_size, g.target,
             CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size * 1048576)::BIGINT ELSE 0 END AS step,
             ('0x' || substr(md5(coalesce(n.source, '')), 1, 5))::BIGINT AS u
      FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
       ((((u + (i + 1) * step) // 1048576) - ((u + i * step) // 1048576)) * size)::BIGINT AS taken FROM c
"""
