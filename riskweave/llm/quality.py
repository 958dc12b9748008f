"""Quality: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Every text is described by ``STATISTICS`` numbers (kinds of characters, words, repetition, sentences,
lines), read from the whole text in one numpy pass. Cosines of random projections approximate a Gaussian
kernel over the standardised statistics. The fit uses a bounded sample of labelled documents
(``MAX_LABELLED``, by hash of doc_id): tasks sum moments, then normal equations, over their rows, and
the driver adds ``FIT_PARTITIONS`` matrices of fixed size. One sampled document in five is kept for
isotonic calibration. Every document is scored in place, without a shuffle.

Defined results: null text counts as empty and gets a score like others; rows with a null or unlabelled id
are never learnt from; repeated rows each get their score; without labels the score is 0.5; extra columns
are ignored.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from riskweave.llm import text as T
from riskweave.llm.toxicity import FUNCTION_WORDS, labelled
from riskweave.session import reliable_checkpoint

MAX_LABELLED = 40_000
FIT_PARTITIONS = 8
FEATURES = 256
RIDGE = 1.0
HELD_OUT_OF, HELD_OUT = 4, 2
APART = 5
CUT = 0.7
STATISTICS = 26


def _kinds() -> np.ndarray:
    """Kind of each byte: other, lower, upper, digit, blank, line end, stop, comma, exclamation, bar, bracket, symbol, beyond ASCII."""
    table = np.zeros(256, np.int64)
    for kind, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r",
                                    ".?", ",;:", "!", "|", "()[]{}<>\"'", "#$%&*@^~=+_/\\-"), 1):
        table[np.frombuffer(members.encode(), np.uint8)] = kind
    table[128:] = 12
    return table


_KINDS = _kinds()
_MARKS = np.sort(np.concatenate([T.span_hashes(d, s, e) for d in [
    np.frombuffer(" ".join(FUNCTION_WORDS.values()).encode(), np.uint8)]
    for s, e, _ in [T.word_spans(d, np.array([0, len(d)]), T.NON_BLANK)]]))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    out = []
    for _, _, data, offs in T.chunks(column):
        n = len(offs) - 1
        size = np.diff(offs)
        row = np.repeat(np.arange(n), size)
        kinds = np.bincount(row * 13 + _KINDS[data], minlength=13 * n).reshape(n, 13)
        starts, ends, bounds = T.word_spans(data, offs, T.NON_BLANK)
        words = np.diff(bounds)
        of = np.repeat(np.arange(n), words)
        length = ends - starts

        def per(flags, of=of, n=n):
            return np.bincount(of[flags] if flags.dtype == bool else of, None if flags.dtype == bool else flags, minlength=n)

        low = T.LOWER[data]
        h = T.span_hashes(low, starts, ends)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        first, last = data[starts] if len(starts) else data[:0], data[ends - 1] if len(ends) else data[:0]
        upper = (first >= 65) & (first <= 90)
        shouted = upper & (last < 97) & (length > 1)
        odd = np.isin(_KINDS[last], (8, 9, 11))
        plain = (_KINDS[last] == 1) | (_KINDS[last] == 12)
        stop = np.isin(last, np.frombuffer(b".!?", np.uint8))
        marked = _MARKS[np.minimum(np.searchsorted(_MARKS, h), len(_MARKS) - 1)] == h
        grams = T.gram_hashes(h, 4)
        distinct, again, commonest = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                w = np.sort(h[a:b])
                edge = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
                distinct[i], commonest[i] = len(edge) - 1, np.diff(edge).max()
                if b - a >= 4:
                    g = np.sort(grams[a:b - 3])
                    again[i] = (g[1:] == g[:-1]).sum()
        letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 12]
        x = [np.log1p(size), np.log1p(words), _share(letters, size), _share(kinds[:, 2], letters), _share(kinds[:, 3], size),
             _share(kinds[:, 4], size), _share(kinds[:, 5], words), _share(kinds[:, 6], words), _share(kinds[:, 7], words),
             _share(kinds[:, 8], words), _share(kinds[:, 9], words), _share(kinds[:, 10], words), _share(kinds[:, 11], size),
             _share(kinds[:, 0], size), _share(per(length.astype(float)), words), np.sqrt(_share(per((length * length).astype(float)), words)),
             _share(per(upper), words), _share(per(shouted), words), _share(per(same), words), _share(per(odd), words),
             _share(per(plain), words), _share(per(stop), words), _share(per(marked), words), _share(distinct, words),
             _share(again, words), _share(commonest, words)]
        out.append(np.stack(x, 1))
    return np.concatenate(out) if out else np.zeros((0, STATISTICS))


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(41)
    return rng.normal(0, 0.25, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics (beyond 4 deviations they are levelled), and a constant."""
    w, b = _projection()
    z = 4 * np.tanh((x - mean) / scale / 4)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))], 1)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (mean z, mean y) of the pools of adjacent violators, from the lowest z on."""
    pools: list[list[float]] = []
    order = np.argsort(z, kind="stable")
    for a, b in zip(z[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _summed(rows: DataFrame, of) -> np.ndarray:
    """Sum over partitions of a fixed-size array computed from each one's (statistics, label) rows."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                part = of(x, batch.column(1).to_numpy().astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sum"])
    parts = [np.frombuffer(r["sum"], "<f8") for r in rows.select("x", "label").mapInArrow(run, "sum binary").collect()]
    return np.sum(parts, 0) if parts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, rest: str = f"crc32(cast(doc_id as string)) % {HELD_OUT_OF} <> {HELD_OUT}",
        most: int = MAX_LABELLED):
    """(mean, scale, weights, knots) from the labelled documents that satisfy ``rest``; None without any."""
    def described(batches):
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), flat),
                 batch.column(2), batch.column(0)], ["x", "label", "key"])

    sample = labelled(docs, labels, "quality", rest, most).select("key", "text", "label")
    sample = reliable_checkpoint(sample.mapInArrow(described, "x array<double>, label int, key long")
                                 .repartitionByRange(FIT_PARTITIONS, "key").sortWithinPartitions("key"))
    apart = F.pmod("key", F.lit(APART)) == 0
    learn, calibrate = sample.where(~apart), sample.where(apart)
    moments = _summed(learn, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not len(moments):
        return None
    mean = moments[1:STATISTICS + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[STATISTICS + 1:] / moments[0] - mean * mean, 1e-12)) + 1e-6

    def equations(x, y):
        f = features(x, mean, scale)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    sums, k = _summed(learn, equations), FEATURES + 1
    weights = np.linalg.solve(sums[:k * k].reshape(k, k) + RIDGE * np.eye(k) * moments[0] / 1e4, sums[k * k:])
    held = calibrate.collect()  # at most MAX_LABELLED / APART rows of statistics
    if not held:
        return mean, scale, weights, (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    held.sort(key=lambda r: r["key"])
    z = features(np.array([r["x"] for r in held]), mean, scale) @ weights
    return mean, scale, weights, isotonic(z, np.array([r["label"] for r in held], float))


def _score(model):
    def run(batches):
        found = pickle.loads(model.value)
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if found is not None:
                mean, scale, weights, knots = found
                z = features(statistics(batch.column(1)), mean, scale) @ weights
                # between knots the score rises; a trace of the ridge score itself orders what the ends level
                score = 0.999 * np.interp(z, *knots) + 0.001 / (1 + np.exp(-4 * (z - 0.5)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["row", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, score) for each row of docs, held whole in ``row``."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, labels)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), ST.StructType([rows.schema["row"], ST.StructField("score", ST.DoubleType())]))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT
    return scored.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
