"""Benchmark decontamination with suffix arrays over the training text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lowered text. Every task cuts its
documents into shards (chunks of about a megabyte; a longer document is a shard of its own) and
builds a suffix array of the shard's words: positions sorted by their next four words, each word
by 16 bits of its hash. Every test suffix of the benchmark is binary-searched in every shard; the
range it finds is refined word by word on full 64-bit hashes until the longest verbatim match is
known. Matches of a whole window (13 words; an item of fewer words is one window) mark document
words as hit.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass over the
documents per block, so what is broadcast is bounded whatever the benchmark's size; the documents
are never shuffled unless there are several blocks.

Defined results: null or empty text has no words, is not hit and stays; an empty benchmark hits
nothing; items without words are ignored; a null item_id cannot be named and is ignored; repeated
rows each get their own result; extra columns are ignored (``decontaminate`` keeps them).
"""
from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import text as T

WINDOW = 13
#: Documents go when at least one word in this many is hit.
MIN_HIT_SHARE = 20
BLOCK_BYTES = 16 << 20
_DEPTH = 4


def _item_words(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, end, data, offs in T.chunks(column):
        low = T.LOWER[data]
        starts, ends, bounds = T.word_spans(low, offs, T.ALNUM)
        h = T.span_hashes(low, starts, ends)
        out += [h[bounds[i]:bounds[i + 1]] for i in range(len(offs) - 1)]
    return out


def _prefix_keys(h: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Sort key of each suffix: 16 bits of each of its next four words, 0 beyond its text's end."""
    top = (h >> np.uint64(48)) | np.uint64(1)
    key = np.zeros(len(h), np.uint64)
    for j in range(_DEPTH):
        key <<= np.uint64(16)
        if len(h) > j:
            key[:len(h) - j] |= np.where(left[:len(h) - j] > j, top[j:], np.uint64(0))
    return key


class TestSuffixes:
    """All suffixes of the items of a block that can hold a whole window."""

    def __init__(self, ids: list, words: list[np.ndarray], window: int):
        keep = [(i, w) for i, w in zip(ids, words, strict=True) if i is not None and len(w)]
        self.ids = [str(i) for i, _ in keep]
        sizes = np.array([len(w) for _, w in keep], np.int64)
        self.words = np.concatenate([w for _, w in keep]) if keep else np.zeros(0, np.uint64)
        ends = np.cumsum(sizes)
        item = np.repeat(np.arange(len(keep)), sizes)
        left = ends[item] - np.arange(len(self.words)) if keep else np.zeros(0, np.int64)
        need = np.minimum(sizes, window)[item] if keep else left
        self.at = np.flatnonzero((left >= need) & ((need == window) | (left == sizes[item]))) if keep else left
        self.left, self.item, self.need = left[self.at], item[self.at], need[self.at]
        self.key = _prefix_keys(self.words, left)[self.at]
        # an item of fewer words than the key's depth matches every key that starts with its words
        self.high = self.key | np.where(self.left < _DEPTH, (np.uint64(1) << (np.uint64(16) * (
            np.uint64(_DEPTH) - np.minimum(self.left, _DEPTH).astype(np.uint64)) % np.uint64(64))) - np.uint64(1), np.uint64(0))


def matches(h: np.ndarray, bounds: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard position, test suffix, words matched) for every verbatim match of at least a window."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(tests.at):
        return none, none, none
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(h))
    key = _prefix_keys(h, left)
    array = np.argsort(key)
    key = key[array]
    lo, hi = np.searchsorted(key, tests.key, "left"), np.searchsorted(key, tests.high, "right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none, none, none
    pos, which, length = [], [], []
    for part in np.array_split(found, max(1, int((hi - lo)[found].sum()) // 500_000)):
        n = (hi - lo)[part]
        q = np.repeat(part, n)
        p = array[np.repeat(lo[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        most = np.minimum(left[p], tests.left[q])
        ok = most >= tests.need[q]
        p, q, most = p[ok], q[ok], most[ok]
        size, open_ = np.zeros(len(p), np.int64), np.arange(len(p))
        while len(open_):  # refine by one more word; a suffix leaves at its first mismatch
            j = size[open_]
            same = h[p[open_] + j] == tests.words[tests.at[q[open_]] + j]
            open_ = open_[same]
            size[open_] += 1
            open_ = open_[size[open_] < most[open_]]
        ok = size >= tests.need[q]
        pos.append(p[ok])
        which.append(q[ok])
        length.append(size[ok])
    return np.concatenate(pos), np.concatenate(which), np.concatenate(length)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list) -> list:
    """Sorted spans with touching and overlapping ones joined."""
    out: list = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _scan(block, window: int, last: bool):
    """Rows (row, text, n_words, spans, item_ids), to which this block's matches are added."""
    def run(batches):
        ids, texts = block.value
        tests = TestSuffixes(ids, _item_words(pa.array(texts, pa.string())), window)
        for batch in batches:
            n_words, spans, items = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for first, _, data, offs in T.chunks(batch.column(1)):
                low = T.LOWER[data]
                starts, ends, bounds = T.word_spans(low, offs, T.ALNUM)
                p, q, size = matches(T.span_hashes(low, starts, ends), bounds, tests)
                n_words += np.diff(bounds).tolist()
                doc = np.searchsorted(bounds, p, "right") - 1
                for d in np.unique(doc).tolist():
                    m = doc == d
                    at = (p[m] - bounds[d]).tolist()
                    row = first + d
                    spans[row] = _merged(spans[row] + [{"start": x, "end": x + n} for x, n in zip(at, size[m].tolist())])
                    items[row] = sorted({*items[row], *(tests.ids[i] for i in set(tests.item[q[m]].tolist()))})
            text = pa.nulls(len(n_words), pa.string()) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(n_words, pa.int64()), pa.array(spans, _SPAN),
                 pa.array(items, pa.list_(pa.string()))], ["row", "text", "n_words", "spans", "item_ids"])
    return run


def _blocks(benchmark: DataFrame):
    """The benchmark as lists (ids, texts) of at most BLOCK_BYTES of text (one longer item alone)."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        more = len(row["text"].encode("utf-8", "surrogatepass"))
        if ids and size + more > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += more
    yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, n_words, n_hit, item_ids, spans, contaminated) for each row of docs, held whole in ``row``.

    spans are the hit word ranges (end exclusive); contaminated: hit at all, and at least one word in 20.
    """
    found = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("item_ids"))
    blocks = _blocks(benchmark)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        found = found.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), window, after is None), found.schema)
        block = after
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (found.drop("text").withColumn("n_hit", hit)
            .withColumn("contaminated", F.expr(f"n_hit > 0 and {MIN_HIT_SHARE} * n_hit >= n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that the benchmark does not contaminate."""
    return contamination(docs, benchmark, window).where("not contaminated").select("row.*")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
v AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
k AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n,
             unnest([array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') FOR i IN range(1, len(ws) - least(13, len(ws)) + 2)]) AS g
      FROM v WHERE len(ws) > 0 AND item_id IS NOT NULL),
z AS (SELECT DISTINCT n FROM k),
d AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM w, z WHERE len(ws) >= n),
m AS (SELECT d.doc_id, d.i, d.n, k.item_id FROM d JOIN k ON k.n = d.n AND k.g = array_to_string(d.ws[d.i:d.i + d.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
