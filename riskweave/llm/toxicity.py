"""Toxicity: a convolutional text classifier with thresholds calibrated by language.

The classifier (``convnet``) is trained in numpy on a bounded sample of labelled documents
(``MAX_LABELLED``, by hash of doc_id) in one task; its parameters are about 2 MB whatever the
corpus. One labelled document in five is left out of training and sets a threshold per language,
where the language is read off the text itself (its most frequent function words), never from a
column. A score is the logistic of the logit's distance from its language's threshold, so 0.5 is
the threshold everywhere. Every document is scored whole, in place, without a shuffle.

Defined results: null or empty text gets the score of a text without words; rows with a null or
unlabelled id are scored like others and never learnt from; repeated rows each get their score;
without labels every document gets a low constant score; extra columns are ignored (``keep_clean``
keeps them).
"""
from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from riskweave.llm import convnet
from riskweave.llm import text as T

MAX_LABELLED = 10_000
HELD_OUT_EVERY = 5
CUT = 0.5
MIN_POSITIVE = 20
#: Frequent function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was",
    "de": "der die und das den von ist nicht mit ein",
    "fr": "le les des une et du est pour dans que",
    "es": "el los las que del en una por con y",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _marks() -> np.ndarray:
    table = np.zeros((1 << convnet.ROWS_BITS, len(FUNCTION_WORDS)), np.int32)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        rows, _ = next(convnet.word_rows(pa.array([words])))
        table[rows[:, 0], k] = 1
    return table


def languages(rows: np.ndarray, bounds: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES for each text: the language with most function words, or other."""
    total = np.zeros((len(rows) + 1, marks.shape[1]), np.int64)
    np.cumsum(marks[rows[:, 0]], axis=0, out=total[1:])
    count = total[bounds[1:]] - total[bounds[:-1]]
    return np.where(count.max(1) > 0, count.argmax(1), len(FUNCTION_WORDS)) if len(count) else np.zeros(0, np.int64)


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F1, midway to the next lower one."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    best = int(np.argmax(2 * hit / (np.arange(1, len(z) + 1) + y.sum())))
    low = z[order][min(best + 1, len(z) - 1)]
    return float((z[order][best] + low) / 2)


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.sort_values(["key", "doc_id"], kind="stable")
    rows, y = [], sample["label"].to_numpy(np.int64)
    for r, bounds in convnet.word_rows(pa.array(sample["text"], pa.string())):
        rows += np.split(r, bounds[1:-1])
    apart = np.arange(len(rows)) % HELD_OUT_EVERY == 0
    p = convnet.train([r for r, a in zip(rows, apart, strict=True) if not a], y[~apart])
    held = [r for r, a in zip(rows, apart, strict=True) if a]
    flat, bounds = np.concatenate(held), np.concatenate(([0], np.cumsum([len(r) for r in held])))
    z, of, yh = convnet.Scorer(p).logits(flat, bounds), languages(flat, bounds, _marks()), y[apart]
    every = _threshold(z, yh) if 0 < yh.sum() < len(yh) else 0.0
    cuts = [_threshold(z[of == k], yh[of == k]) if MIN_POSITIVE <= yh[of == k].sum() < (of == k).sum() else every
            for k in range(len(LANGUAGES))]
    return pd.DataFrame({"model": [pickle.dumps((p, cuts))]})


def labelled(docs: DataFrame, labels: DataFrame, column: str, rest: str, most: int = MAX_LABELLED) -> DataFrame:
    """(key, doc_id, text, label): at most ``most`` labelled documents that satisfy ``rest``, first by hash of doc_id."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
              .where(f"doc_id is not null and label in (0, 1) and {rest}").dropDuplicates(["doc_id"])
              .withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rest: str = f"crc32(cast(doc_id as string)) % {HELD_OUT_EVERY} <> 0",
        most: int = MAX_LABELLED):
    """(parameters, thresholds) from the labelled documents that satisfy ``rest``."""
    models = (labelled(docs, labels, "toxic", rest, most).groupBy(F.lit(0).alias("one"))
              .applyInPandas(lambda sample: _fit(sample), "model binary").collect())
    return pickle.loads(models[0]["model"]) if models else (convnet.train([], np.zeros(0, np.int64)), [0.0] * len(LANGUAGES))


def _score(model):
    def run(batches):
        p, cuts = model.value
        scorer, marks, cuts = convnet.Scorer(p), _marks(), np.array(cuts)
        for batch in batches:
            out = [np.zeros(0)]
            for rows, bounds in convnet.word_rows(batch.column(1)):
                z = scorer.logits(rows, bounds).astype(np.float64) - cuts[languages(rows, bounds, marks)]
                out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["row", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """(row, score) for each row of docs, held whole in ``row``; learns from fit_on (docs if not given)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if fit_on is None else fit_on, labels))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), ST.StructType([rows.schema["row"], ST.StructField("score", ST.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, that score below the cut."""
    return toxicity(docs, labels).where(F.col("score") < cut).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))) % HELD_OUT_EVERY == 0
    return scored.select(F.col("row.doc_id").alias("doc_id"), held.alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
