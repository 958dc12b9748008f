"""MinHash near-duplicates by a signature-coordinate inverted join.

A text's set holds its distinct word shingles (lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``).
Texts with the same set form a class; one signature of K 64-bit minima stands for each class (of 32 bits, unrelated
classes would share tokens by accident, corpus shingles / 2**33 a token). Hashes of the
K (coordinate, value) pairs are its tokens, and classes are posted under them:

* *match threshold*: at similarity s each coordinate agrees with probability s, so classes at
  the link threshold agree on 0.8 K of K coordinates. Pairs with fewer than ``min_matches``
  agreements (4.4 standard deviations below) are left aside.
* *prefix*: two classes that agree on ``min_matches`` tokens share one of the rarest
  K - min_matches + 1 tokens of each, in one global order (rarest first). Only those are posted,
  and a token that one class alone has is counted but never posted.
* *skip*: posting lists that share a class go to one task, as a family. There each class merges its
  lists, so only classes that share a posted token meet; those already connected with it, and those
  whose sizes rule the similarity out, are skipped; of the rest the collisions are counted, and pairs
  above the threshold are confirmed on full shingle sets, most collisions first. A task emits at most
  one link per class, never pairs.
* *large families* are dealt into blocks. A class goes to a pair of blocks only if a list of its own has
  members in the other one: a long chain of texts costs what its lists hold, not the square of the
  family. Lists are met by (token, block), so a frequent token is spread over its blocks.

Links between classes, not copies: a group of equal texts costs one class.

Defined results: null text counts as empty; a text without words has size 0 and is a component
of its own; rows repeat as they are given; a null doc_id takes the smallest other id of its
component as component_id (null if none) and is kept only where there is no other. Extra
columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm import text as T
from riskweave.llm.graph import components
from riskweave.session import reliable_checkpoint

COORDINATES = 64
MIN_MATCHES = 37
BLOCK_CLASSES = 1024
BLOCK_SHINGLES = 2_000_000
_rng = np.random.default_rng(815)
_SCALE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int):
    """(row, sorted distinct shingle hashes) of every text; a text of fewer words has one, of none an empty set."""
    for first, end, data, offs in T.chunks(column):
        low = T.LOWER[data]
        starts, ends, bounds = T.word_spans(low, offs, T.NON_BLANK)
        h = T.span_hashes(low, starts, ends)
        grams = T.gram_hashes(h, words)
        for i in range(end - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= words:
                g = np.sort(grams[a:b - words + 1])
                yield first + i, g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif b > a:
                yield first + i, T.gram_hashes(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield first + i, np.zeros(0, np.uint64)


def _signatures(words: int, k: int):
    def run(batches):
        for batch in batches:
            ids, sizes, digests, sigs = batch.column(0), [], [], []
            pack, packed = [], 0

            def flush():
                if not pack:
                    return
                x = np.concatenate(pack)
                at = np.cumsum([0] + [len(p) for p in pack[:-1]])
                out = np.empty((k, len(pack)), np.uint64)
                for j in range(k):
                    out[j] = np.minimum.reduceat(x * _SCALE[j] + _SHIFT[j], at)
                sigs.extend(out.T.copy().view(np.int64))
                pack.clear()

            for _, s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                pack.append(s if len(s) else np.zeros(1, np.uint64))
                packed += len(s)
                if packed > 200_000:
                    flush()
                    packed = 0
            flush()
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * k), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), sig, *batch.columns[2:]],
                                             ["doc_id", "n_shingles", "digest", "sig", *batch.schema.names[2:]])
    return run


def _sets(words: int):
    """Rows (doc_id, text, cid, digest) to (cid, set); only the text that has the wanted digest."""
    def run(batches):
        for batch in batches:
            cids, want, keep, sets = batch.column(2), batch.column(3).to_pylist(), [], []
            for row, s in shingle_sets(batch.column(1), words):
                if hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() == want[row]:
                    keep.append(row)
                    sets.append(s.view(np.int64))
            offs = np.cumsum([0] + [len(s) for s in sets], dtype=np.int64).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [cids.take(pa.array(keep, pa.int64())),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))],
                ["cid", "shingles"])
    return run


def _lists(sig: np.ndarray, posted: list) -> list[list[np.ndarray]]:
    """Per class the posting lists of its prefix, each cut before the class itself."""
    before: list[list[np.ndarray]] = [[] for _ in posted]
    rows = np.repeat(np.arange(len(posted)), [len(p) for p in posted])
    places = np.concatenate(posted)
    for place in np.unique(places):
        members = rows[places == place]
        order = members[np.argsort(sig[members, place], kind="stable")]
        value = sig[order, place]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        for start, end in zip(first, np.append(first[1:], len(order))):
            for at in range(start + 1, end):
                before[order[at]].append(order[start:at])
    return before


def _links(min_matches: int, percent: int):
    """Within one block, or across one pair of blocks, of a family: links that join its classes."""
    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        cid, side = block["cid"].to_numpy(), block["side"].to_numpy()
        sig = np.stack(block["sig"].to_list())
        sets = [np.asarray(s) for s in block["shingles"]]
        size = np.array([len(s) for s in sets])
        root, out = np.arange(len(cid)), []
        across = key[1] != key[2]
        for i, lists in enumerate(_lists(sig, [np.asarray(p) for p in block["posted"]])):
            if not lists:
                continue
            j = np.flatnonzero(np.bincount(np.concatenate(lists)))
            j = j[(root[j] != root[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
            if across:
                j = j[side[j] != side[i]]
            if not len(j):
                continue
            matches = (sig[j] == sig[i]).sum(1)
            for x in j[np.argsort(-matches, kind="stable")][:int((matches >= min_matches).sum())]:
                if root[x] == root[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[x] - both):
                    out.append((cid[i], cid[x]))
                    root[root == root[x]] = root[i]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _meetings(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, other): the blocks in which a class (cid, side) of a large family shares a posted token with another or itself."""
    lists = postings.join(classes.select("cid", "side"), "cid")
    blocks = lists.select("token", "side").distinct()
    pairs = blocks.join(blocks.select("token", F.col("side").alias("other")), "token")
    return lists.join(pairs, ["token", "side"]).select("cid", "other").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES,
                    min_matches: int = MIN_MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Texts are linked when 100 * |A and B| >= percent * |A or B| over their sets of ``words``-word shingles.
    """
    return _components(docs, words, percent, coordinates, min_matches).drop("text_hash")


def _components(docs: DataFrame, words: int, percent: int, coordinates: int, min_matches: int) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = reliable_checkpoint(base.select("doc_id", "text", F.md5("text").alias("text_hash")).mapInArrow(
        _signatures(words, coordinates), "doc_id long, n_shingles long, digest string, sig array<bigint>, text_hash string"))
    classes = reliable_checkpoint(
        signed.where("n_shingles > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id()))

    tokens = classes.select("cid", F.posexplode("sig")).select(
        "cid", "pos", F.xxhash64("pos", "col").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    rest = coordinates - min_matches + 1
    posted = reliable_checkpoint(
        tokens.join(common, "token").groupBy("cid")
        .agg(F.array_sort(F.collect_list(F.struct("f", "token", "pos"))).alias("s"))  # at most K entries
        .select("cid", F.slice("s", F.lit(1), F.greatest(F.lit(0), rest - (coordinates - F.size("s")))).alias("s"))
        .select("cid", F.col("s.token").alias("tokens"), F.col("s.pos").alias("posted")))
    postings = posted.select("cid", F.explode("tokens").alias("token"))
    heads = postings.groupBy("token").agg(F.min("cid").alias("head"), F.count("*").alias("n")).where("n > 1")
    family = components(postings.join(heads, "token").where("cid <> head")
                        .select(F.col("cid").alias("u"), F.col("head").alias("v")))
    family = reliable_checkpoint(family.join(classes.withColumnRenamed("cid", "node"), "node")
                                 .join(posted.select(F.col("cid").alias("node"), "posted"), "node")
                                 .select(F.col("node").alias("cid"), F.col("component").alias("family"),
                                         "class_id", "digest", "n_shingles", "sig", "posted"))

    sets = (base.join(family.select(F.col("class_id"), "cid", "digest"), F.col("doc_id").eqNullSafe(F.col("class_id")))
            .select("doc_id", "text", "cid", "digest").mapInArrow(_sets(words), "cid long, shingles array<bigint>")
            .groupBy("cid").agg(F.any_value("shingles").alias("shingles")))
    large = reliable_checkpoint(family.groupBy("family").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        .where("blocks > 1"))
    members = family.select("cid", "family", "sig", "posted").join(large, "family", "left").withColumn(
        "side", F.coalesce(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"), F.lit(0)))
    placed = members.where("blocks is null").withColumn("other", F.lit(0))
    if not large.isEmpty():
        cut = members.where("blocks is not null")
        placed = placed.unionByName(cut.join(_meetings(postings, cut), "cid"))
    dealt = placed.join(sets, "cid").select(
        "family", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"),
        "side", "cid", "sig", "posted", "shingles")
    links = dealt.groupBy("family", "lo", "hi").applyInPandas(_links(min_matches, percent), "u long, v long")
    joined = components(links)
    best = joined.join(classes.select(F.col("cid").alias("node"), "class_id"), "node") \
        .groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = (classes.select("cid", "digest", "class_id")
                .join(joined.withColumnRenamed("node", "cid"), "cid", "left").join(best, "component", "left")
                .select("digest", F.coalesce("component_id", "class_id").alias("component_id")))
    return (signed.select("doc_id", "n_shingles", "digest", "text_hash").join(of_class, "digest", "left")
            .select("doc_id", "n_shingles", "text_hash",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, all columns, one for each component: that of the smallest doc_id.

    Rows that repeat both id and text are one, that of the smallest hash of all columns. Rows without an id stay where their
    component has no id; of those with one text, one stays. Texts move once, dealt by id, which serves the join and the repeats.
    """
    names = docs.columns
    mark, key = (_free(names, n) for n in ("kept", "key"))
    labelled = _components(docs, words, percent, COORDINATES, MIN_MATCHES)
    kept = labelled.where("kept").select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).distinct()
    rows = docs.withColumn(mark, F.md5(F.coalesce("text", F.lit(""))))
    named = rows.where(F.col("doc_id").isNotNull()).join(
        kept.where(F.col(key).isNotNull()).select(key).distinct(), F.col("doc_id").cast("long") == F.col(key), "left_semi")
    nameless = rows.where(F.col("doc_id").isNull()).join(kept.where(F.col(key).isNull()).select(mark).distinct(), mark, "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*names)))
    return named.withColumn(key, first).where(F.col(key) == 1).select(*names).unionByName(
        nameless.withColumn(key, first).where(F.col(key) == 1).select(*names))


def _free(names: list[str], wanted: str) -> str:
    """A column name that docs does not have."""
    name = f"_{wanted}"
    while name in names:
        name += "_"
    return name


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS sh FROM w),
c AS (SELECT min(doc_id) AS cid, len(list_sort(sh)) AS n, list_sort(sh) AS k FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
x AS (SELECT cid, n, unnest(k) AS g FROM c),
p AS (SELECT a.cid AS a, b.cid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
      FROM x a JOIN x b ON a.g = b.g AND a.cid < b.cid AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT cid AS a, cid AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS cid, min(b) AS comp FROM r GROUP BY a),
o AS (SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id
      FROM s LEFT JOIN c ON len(s.sh) > 0 AND list_sort(s.sh) = c.k LEFT JOIN m ON m.cid = c.cid)
SELECT doc_id, n_shingles::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM o
"""
