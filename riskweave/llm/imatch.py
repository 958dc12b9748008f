"""I-Match document fingerprints, in DataFrame functions alone.

Terms are lower-cased runs without white space, by 64-bit hash. Their document frequencies are counted
exactly over all documents; the lexicon keeps the terms within a band of inverse document frequency,
log(documents / df). The band's upper end bounds the lexicon whatever the corpus: terms in at least a
share x of the documents number at most (mean distinct terms of a document) / x. Its hashes reach the
tasks sorted by ``SLOTS`` slots, with a bit set of the slots that are filled: a term whose bit is unset is
outside, any other is looked up among the few lexicon terms of its slot, so the band is exact.

A fingerprint hashes the sorted distinct lexicon terms of a text under several subsets of the lexicon:
the whole, and ``DRAWS`` draws of randomised subsets. A draw quarters the lexicon again and again
(``LEVELS`` times, by seeded hashes, passing over a quarter in which the text has no term) and
hashes the terms left at the end, so long and short texts all find a subset of a fitting density.
Likeness is the share of equal subset hashes. A text without lexicon terms uses all its terms.

Documents meet their successor (by doc_id) inside range buckets; each bucket gets a copy of the next
bucket's first document, so no window spans the whole table.

Defined results: null text counts as empty; texts without terms are alike (1.0) among each other; null
doc_ids sort first, equal ids by text; repeated rows follow each other; a lone document is its own
successor; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import itertools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

IDF_BAND = (1.6, 6.2)
SLOTS = 1 << 18
DRAWS = 16
LEVELS = 8


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the terms of a text."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


class Lexicon(NamedTuple):
    """SQL array literals: bits of the filled slots, terms in slot order, and where each group of 64 slots begins."""

    bits: str
    terms: str
    starts: str


def lexicon(docs: DataFrame, band=IDF_BAND) -> Lexicon:
    """The terms of docs (text) within the idf band."""
    n = docs.count()
    low, high = n * math.exp(-band[1]), n * math.exp(-band[0])
    df = docs.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    groups = (df.where((F.col("df") >= low) & (F.col("df") <= high))
              .select("t", F.expr(f"t & {SLOTS - 1}").alias("slot")).groupBy(F.expr("slot >> 6").alias("word"))
              .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"),
                   F.array_sort(F.collect_list("t")).alias("terms")).collect())  # bounded: see above
    of = {r["word"]: r for r in groups}
    found = [of[i]["terms"] if i in of else [] for i in range(SLOTS // 64)]
    return Lexicon(_literal((of[i]["bits"] if i in of else 0 for i in range(SLOTS // 64)), "bigint"),
                   _literal((t for group in found for t in group), "bigint"),
                   _literal(itertools.accumulate((len(group) for group in found), initial=1), "int"))


def _literal(values, kind: str) -> str:
    text = ",".join(map(str, values))
    return f"cast(split('{text}', ',') as array<{kind}>)" if text else f"cast(array() as array<{kind}>)"


def fingerprint(text: Column, lexicon: Lexicon) -> Column:
    """DRAWS + 1 subset hashes of a text; none if it has no term."""
    bits, within, starts = (F.expr(sql) for sql in lexicon)

    def known(x):
        group = (F.shiftright(x.bitwiseAND(F.lit(SLOTS - 1)), 6) + 1).cast("int")
        first = F.element_at(starts, group)
        return (F.getbit(F.element_at(bits, group), x.bitwiseAND(F.lit(63)).cast("int")) == 1) & F.array_contains(
            F.slice(within, first, F.element_at(starts, group + 1) - first), x)

    def bound(value, then):  # a value that is used several times is computed once
        return F.transform(F.array(value), then)[0]

    def thinned(ids, r, j):
        left = F.filter(ids, lambda x: F.xxhash64(x, r, j).bitwiseAND(F.lit(3)) == 0)
        return bound(left, lambda n: F.when(F.size(n) > 0, n).otherwise(ids))

    def draw(r, ids):
        return F.xxhash64(F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), ids, lambda left, j: F.when(
            F.size(left) > 1, thinned(left, r, j)).otherwise(left)))

    kept = bound(terms(text), lambda t: bound(F.filter(t, known), lambda k: F.array_sort(F.when(F.size(k) > 0, k).otherwise(t))))
    return bound(kept, lambda ids: F.when(F.size(ids) > 0, F.concat(
        F.array(F.xxhash64(ids)), F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda r: draw(r, ids)))).otherwise(
        F.array().cast("array<bigint>")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes; of texts without terms, 1 to each other and 0 to the rest."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def as_string(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))))), ".")


def in_order():
    return Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), F.col("text"))


def successors(docs: DataFrame) -> DataFrame:
    """(bucket, copy, doc_id, text, next_text) from (doc_id, text): each row and the text after it by doc_id.

    Rows stand in order inside their bucket; one that is marked as a copy is the next bucket's first.
    """
    spark: SparkSession = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    stride = max(1, math.isqrt(len(cuts)))
    coarse = F.lit(cuts[::stride]) if cuts else F.expr("cast(array() as array<bigint>)")
    fine = F.lit(cuts) if cuts else coarse
    below = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))  # first among every stride-th cut, then among the rest
    start = F.greatest(F.lit(0), below - 1) * stride
    bucket = F.when(F.col("doc_id").isNull() | (below == 0), F.lit(0)).otherwise(
        start + F.size(F.filter(F.slice(fine, start + 1, F.lit(stride)), lambda c: c <= F.col("doc_id"))))
    rows = docs.withColumn("bucket", bucket)
    # at most one row a bucket from here on: the smallest id of each, then its first text
    ids = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("low"))
    ids = reliable_checkpoint(ids.select(F.col("bucket").alias("of"), "low.id"))
    heads = (rows.join(F.broadcast(ids), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
             .groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("head")))
    around = Window.orderBy("bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(around), F.first("head").over(whole)).alias("head"))
    every = rows.select("bucket", F.lit(False).alias("copy"), "doc_id", "text").unionByName(
        heads.select("bucket", F.lit(True).alias("copy"), "head.doc_id", "head.text"))
    return every.withColumn("next_text", F.lead("text").over(in_order()))


def fingerprints(docs: DataFrame, band=IDF_BAND) -> DataFrame:
    """Fingerprints of each row of docs (doc_id, text), of its text edited with the next one's, and their likeness."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(base, band)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return (successors(base).withColumn("fp", fingerprint(F.col("text"), known))
            .withColumn("next_fp", F.lead("fp").over(in_order())).where("not copy")
            .withColumn("n_chars", F.char_length("text").cast("long"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                                           F.substring("next_text", F.lit(1), half)))
            .withColumn("edited_fp", fingerprint(F.col("edited"), known))
            .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("fp")).alias("fingerprint"),
                    as_string(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("next_fp")).alias("near_next")))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
