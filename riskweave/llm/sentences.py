"""Repeated sentence spans, removed everywhere but where they stand first.

Sentences end at a line's end, or after a word that ends in ``.``, ``!`` or ``?``. From every sentence
a span slides on until it holds at least ``SENTENCES`` sentences and ``WORDS`` words; its words are
hashed, blanks between them aside. Span hashes are counted over all documents (pre-aggregated in every
task); where a span repeats, its first occurrence is joined to its rows, and every sentence that lies in
a repeated span which is not the first occurrence (by doc_id, then place) is removed.

With ``pieces`` (the query takes ``PIECE_WORDS``), a sentence of more words is cut into pieces, which then count
as sentences: before each word whose hash is the leftmost least of some ``STRIDE`` words of the sentence. A cut
depends on the ``STRIDE`` - 1 words on either side alone, and no piece is longer than ``PIECE_WORDS``; so any 50
words that stand in two places hold a span with the same bounds in both, sentence ends or not. Text
without blanks (CJK, Thai, Khmer, ...) is first cut into words of one to three characters in the same way,
full-width stops end a sentence, and a text's last span is also taken back from its end, so that a text of
``WORDS`` words or more lies in spans whole.

Defined results: null text counts as empty; a document of fewer sentences (pieces) or words than a span keeps all;
rows that repeat both id and text count as one document, each with that document's result; null doc_ids
sort first, told apart and ordered among themselves by 93 bits of hashes of their texts (rows of one id by 31; ids are
taken to be above -2**62); an empty table gives an empty result; extra columns are ignored. With ``pieces``, n_sentences and
n_removed count pieces.
"""
from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import text as T
from riskweave.session import ensure_checkpoint_dir

SENTENCES = 2
WORDS = 15
#: Longest sentence that is not cut, and words of which one is chosen to cut at.
PIECE_WORDS = 14
STRIDE = 7
_CHARS = 3
_END = T.byte_class(lambda b: b in b".!?")
_SPAN = "did long, place long, last int, span long"
_STOPS = (0x0964, 0x3002, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61)
#: Code points of scripts without blanks at which a word can begin (no marks).
_UNSPACED = np.zeros(1 << 16, bool)
for _a, _b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF)):
    _UNSPACED[_a:_b + 1] = [unicodedata.category(chr(c)) not in ("Mn", "Mc") for c in range(_a, _b + 1)]


def chosen(h: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the leftmost least of some ``width`` neighbours, all of one part (parts ascend)."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(part[:len(h) - width + 1] == part[width - 1:])
    return np.unique(at + np.lib.stride_tricks.sliding_window_view(h, width)[at].argmin(1))


def units(data: np.ndarray, offs: np.ndarray):
    """(starts, ends, row bounds) of words, those without blanks between them cut at chosen characters."""
    starts, ends, bounds = T.word_spans(data, offs, T.NON_BLANK)
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return starts, ends, bounds
    code = ((data[lead] & 15).astype(np.uint32) << 12) | ((data[lead + 1] & 63).astype(np.uint32) << 6) | (data[lead + 2] & 63)
    four = data[lead] >= 0xF0
    keep = np.where(four, data[lead + 1] >= 0xA0, _UNSPACED[code & 0xFFFF])
    after = lead[~four & np.isin(code, _STOPS)] + 3
    word = np.searchsorted(starts, after - 1, "right") - 1
    after = after[after < ends[word]]
    at = lead[keep]
    word = np.searchsorted(starts, at, "right") - 1
    cut = at[chosen(T.span_hashes(data, at, at + np.where(four[keep], 4, 3)), word, _CHARS)]
    every = np.unique(np.concatenate((starts, cut, after)))
    word = np.searchsorted(starts, every, "right") - 1
    stop = ends[word]
    same = word[1:] == word[:-1]
    stop[:-1][same] = every[1:][same]
    return every, stop, np.searchsorted(every, offs)


def sentence_bounds(data: np.ndarray, offs: np.ndarray, pieces: int = 0):
    """(word starts, word ends, first word of each sentence, sentence bounds of the texts)."""
    starts, ends, bounds = units(data, offs) if pieces else T.word_spans(data, offs, T.NON_BLANK)
    if not len(starts):
        return starts, ends, starts, np.zeros(len(offs), np.int64)
    lines = np.concatenate(([0], np.cumsum(data == 0x0A)))
    last = _END[data[ends - 1]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    if pieces:
        wide = np.flatnonzero((ends - starts >= 3) & (data[ends - 1] >= 0x80) & (data[ends - 3] >= 0xE0))
        tail = ends[wide]
        last[wide] |= np.isin(((data[tail - 3] & 15).astype(np.uint32) << 12) | ((data[tail - 2] & 63).astype(np.uint32) << 6)
                              | (data[tail - 1] & 63), _STOPS)
    first = np.concatenate(([True], last[:-1]))
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    if pieces:
        part = np.cumsum(first)
        over = np.flatnonzero(np.bincount(part)[part] > pieces)
        if len(over):
            first[over[chosen(T.span_hashes(data, starts, ends)[over], part[over], min(STRIDE, pieces))]] = True
    heads = np.flatnonzero(first)
    return starts, ends, heads, np.searchsorted(heads, bounds)


def spans(data: np.ndarray, offs: np.ndarray, sentences: int, words: int, pieces: int = 0):
    """(row, first sentence, last sentence, hash) of every span, sentences numbered within their text."""
    starts, ends, heads, bounds = sentence_bounds(data, offs, pieces)
    none = np.zeros(0, np.int64)
    if not len(heads):
        return none, none, none, none.astype(np.uint64)
    h = T.span_hashes(data, starts, ends)
    tails = np.append(heads[1:], len(h))  # word after each sentence
    i = np.arange(len(heads))
    j = np.maximum(i + sentences - 1, np.searchsorted(tails, heads + words))
    row = np.searchsorted(bounds, i, "right") - 1
    ok = j < bounds[row + 1]
    if pieces:  # the last start of a text that can span runs on to the text's end
        final = np.flatnonzero(ok & ~np.append(ok[1:] & (row[1:] == row[:-1]), False))
        final = final[j[final] < bounds[row[final] + 1] - 1]
        i, j, row = (np.concatenate((x[ok], y)) for x, y in ((i, final), (j, bounds[row[final] + 1] - 1), (row, row[final])))
    else:
        i, j, row = i[ok], j[ok], row[ok]
    a, b = heads[i], tails[j]
    return row, i - bounds[row], j - bounds[row], T.run_hashes(h, a, b)


def _spans(sentences: int, words: int, pieces: int):
    """Rows (did, tid, text) to a row a span; place holds the first sentence, then 31 bits of tid."""
    def run(batches):
        for batch in batches:
            tid = batch.column(1).to_numpy()
            for first, _, data, offs in T.chunks(batch.column(2)):
                row, i, j, h = spans(data, offs, sentences, words, pieces)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + first)), pa.array((i << 31) | tid[row + first]),
                     pa.array(j.astype(np.int32)), pa.array(h.view(np.int64))], ["did", "place", "last", "span"])
    return run


def _without(pieces: int):
    """Rows (doc_id, text, gone: sentence ranges) to counts and the text that stays."""
    def run(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            gone = batch.column(2).to_pylist()
            for first, end, data, offs in T.chunks(batch.column(1)):
                starts, _, heads, bounds = sentence_bounds(data, offs, pieces)
                raw = data.tobytes()
                for r in range(end - first):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    out = np.zeros(b - a, bool)
                    for g in gone[first + r] or ():
                        out[g["first"]:g["last"] + 1] = True
                    cut = [int(offs[r]), *starts[heads[a + 1:b]].tolist(), int(offs[r + 1])]
                    kept.append((b"".join(raw[cut[k]:cut[k + 1]] for k in np.flatnonzero(~out)) if b > a
                                 else raw[cut[0]:cut[1]]).decode())
                    counts.append(b - a)
                    removed.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"])
    return run


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, pieces: int = 0) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text): each row of docs (doc_id, text) without its repeated sentences.

    Sentences of more than ``pieces`` words are cut, 0 cuts none.
    """
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.expr(f"xxhash64(text, 1) & {(1 << 62) - 1}") - F.lit((1 << 63) - 1) - 1).alias("did"),
        F.expr("xxhash64(text) & 2147483647").alias("tid"))
    every = base.select("did", "tid", "text").mapInArrow(_spans(sentences, words, pieces), _SPAN)
    twice = every.groupBy("span").agg(F.count("*").alias("n")).where("n > 1").select("span")
    path = f"{ensure_checkpoint_dir(spark)}/spans-{uuid.uuid4().hex}"
    every.join(twice, "span").select("did", "place", "last", "span").write.parquet(path)
    repeated = spark.read.schema(_SPAN).parquet(path)
    first = (repeated.groupBy("span").agg(F.min(F.struct("did", "place")).alias("first"))
             .select("span", F.col("first.did").alias("did0"), F.col("first.place").alias("place0")))
    gone = (repeated.join(first, "span").where("did <> did0 or place <> place0")
            .select("did", F.expr("place & 2147483647").alias("tid"), F.expr("cast(shiftright(place, 31) as int)").alias("first"), "last")
            .groupBy("did", "tid").agg(F.collect_list(F.struct("first", "last")).alias("gone")))
    return base.join(gone, ["did", "tid"], "left").select("doc_id", "text", "gone").mapInArrow(
        _without(pieces), "doc_id long, n_sentences long, n_removed long, text string")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated sentence spans of all documents, long sentences in pieces."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces=PIECE_WORDS)
