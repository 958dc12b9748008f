"""Spelling variants by PartEnum signatures over letter multisets, in DataFrame functions alone.

A word's letter multiset is a binary vector: one dimension for each letter and occurrence number. One inserted
or deleted code point changes one dimension, one replaced code point at most two, so words at one edit
lie within Hamming distance two.

* *Partition and enumerate*: letters are dealt to ``PARTS`` = 7 parts, by falling frequency, so the vector falls into seven
  projections. Vectors at distance two or less agree on at least five of them, whatever the two
  differences are: for each of the 21 ways of leaving two parts out, the remaining five (and which they are) form one exact
  signature. Words at one edit share at least one.
* *Join*: signatures held by one word alone are dropped after a count, the rest are joined on equality. A signature with more
  than ``HOT`` words is joined on the signature and a half of the word instead: of two words at one edit, the shorter of m code points,
  one keeps the first or the last floor(m / 2) code points of the other. No pair is lost.
* *Verify*: pairs whose lengths differ by more than one, then pairs not at one edit (code points), are dropped; a pair that
  several signatures found counts once.

Runs ``[A-Za-z\\u00C0-\\u00FF]+`` are read from whole texts, only A-Z is lower-cased, and a run whose crc32 with its document's id
is divisible by ``SLIP`` loses one code point (the contract's planted misspellings).

Defined results: null text has no runs; a null doc_id counts as an empty one; repeated rows count each time; ties of n go to the
smallest word in code-point order; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import reliable_checkpoint

PARTS = 7
HOT = 32
SLIP = 199
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column, slip: int = SLIP) -> Column:
    """The run, without code point h % length (from 0) where slip divides h, the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n) of all words of at least min_length code points and min_count occurrences."""
    runs = docs.select(F.col("doc_id").alias("d"), F.explode(F.regexp_extract_all(
        F.translate("text", _UPPER, _LOWER), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    # a slip only shortens a run: shorter ones cannot become words
    words = runs.where(F.length("run") >= min_length).select(slipped(F.col("d"), F.col("run"), slip).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _letter_parts(words: DataFrame) -> list[str]:
    """Letters of each part: dealt by falling count, forwards and backwards in turn (an alphabet's rows reach the driver)."""
    seen = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()
    parts = [""] * PARTS
    for i, r in enumerate(seen):
        turn, place = divmod(i, PARTS)
        parts[place if turn % 2 == 0 else PARTS - 1 - place] += r["letter"]
    return parts


def signatures(words: DataFrame, parts: list[str]) -> DataFrame:
    """(word, sig): 21 signatures of each word."""
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    kept = [F.xxhash64(F.lit(i), F.translate("_letters", parts[a] + parts[b], ""))
            for i, (a, b) in enumerate(combinations(range(PARTS), 2))]
    return words.withColumn("_letters", letters).select("word", F.explode(F.array(*kept)).alias("sig"))


def _halves() -> Column:
    """First and last floor(m / 2) code points for m the word's length and one less: what a word at one edit shares."""
    keys = []
    for less in (0, 1):
        h = F.floor((F.length("word") - less) / 2).cast("int")
        keys += [F.concat(F.lit("<"), F.substring("word", F.lit(1), h)), F.concat(F.lit(">"), F.substring("word", -h, h))]
    return F.array_distinct(F.array(*keys))


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): words at exactly one inserted, deleted or replaced code point, each pair once, a < b."""
    sigs = signatures(words, _letter_parts(words))
    shared = sigs.groupBy("sig").agg(F.count("*").alias("words")).where("words > 1")
    posted = reliable_checkpoint(
        sigs.join(shared.hint("merge"), "sig").withColumn("half", F.explode(F.when(F.col("words") > hot, _halves()).otherwise(F.array(F.lit("")))))
        .select("sig", "half", "word"))
    left, right = posted.withColumnRenamed("word", "a"), posted.withColumnRenamed("word", "b")
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)
    return left.join(right, ["sig", "half"]).where(close).where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def variants(words: DataFrame, factor: int = FACTOR, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words (word, n).

    form is the near word of largest n where that is at least factor times the word's; root follows forms to the last.
    """
    words = reliable_checkpoint(words)
    pairs = near_pairs(words, hot)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n_of = words.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    # the smallest of (-n, word) is the largest n, ties to the smallest word: a partially aggregated minimum
    best = (both.join(n_of, "b").groupBy(F.col("a").alias("word"))
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form"))).alias("top"))
            .select("word", "n_near", F.col("top.form").alias("form"), (-F.col("top.less")).alias("form_n")))
    far = F.col("form_n") >= F.lit(factor) * F.col("n")
    formed = reliable_checkpoint(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")))
    # n grows by the factor at every step, so a chain has at most log(largest n) steps; each round doubles the steps taken
    top = formed.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(top, max(2, factor))) + 1
    to = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = reliable_checkpoint(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
