"""Fingerprints against plain Python: exact band, hashes of Spark's own xxhash64, every draw and likeness."""
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from riskweave.llm import imatch


def _rows():
    r = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    weights = [1 / (i + 1) for i in range(900)]
    texts = [" ".join(r.choices(words, weights, k=r.randint(1, 60))) for _ in range(120)] + ["", None, " \t", "rareword", "w0 w0 W0"]
    return list(enumerate(texts))


def _hashes(spark, values, schema, *columns):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(F.xxhash64(*columns)).collect()]


def _terms(text):
    return {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}


def test_band_and_draws_equal_plain_python(spark):
    rows = _rows()
    band = (1.0, 3.5)
    df = Counter(w for _, t in rows for w in _terms(t))
    low, high = len(rows) * math.exp(-band[1]), len(rows) * math.exp(-band[0])
    inside = {w for w, n in df.items() if low <= n <= high}
    assert 10 < len(inside) < len(df) / 2

    order = [t or "" for _, t in rows]
    edited = []
    for i, t in enumerate(order):
        half, after = len(t) // 2, order[(i + 1) % len(order)]
        edited.append(t[:len(t) - half] + after[:half])
    every = sorted(set().union(*(_terms(t) for t in order + edited)))
    code = dict(zip(every, _hashes(spark, [(w,) for w in every], "w string", "w"), strict=True))
    draws = [(code[w], x, j) for w in every for x in range(1, imatch.DRAWS + 1) for j in range(imatch.LEVELS)]
    low_bits = {d: h & 3 for d, h in zip(draws, _hashes(spark, draws, "t long, r int, j int", "t", "r", "j"), strict=True)}

    def subsets(text):
        terms = _terms(text)
        ids = sorted(code[w] for w in (terms & inside or terms))
        if not ids:
            return []
        out = [ids]
        for x in range(1, imatch.DRAWS + 1):
            left = ids
            for j in range(imatch.LEVELS):
                if len(left) > 1:
                    left = [t for t in left if low_bits[t, x, j] == 0] or left
            out.append(left)
        return out

    kept = {t: subsets(t) for t in order + edited}
    flat = sorted({tuple(s) for subset in kept.values() for s in subset})
    digest = dict(zip(flat, _hashes(spark, [(list(s),) for s in flat], "s array<long>", "s"), strict=True))
    prints = {t: [digest[tuple(s)] for s in subset] for t, subset in kept.items()}

    def alike(a, b):
        if not a and not b:
            return 1.0
        return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))

    got = {r["doc_id"]: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), band).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(order):
        row = got[i]
        shown = [".".join(f"{h & 0xFFFFFFFF:x}" for h in prints[x]) for x in (t, edited[i])]
        assert [row["fingerprint"], row["edited_fingerprint"]] == shown
        assert row["near_edited"] == alike(prints[t], prints[edited[i]])
        assert row["near_next"] == alike(prints[t], prints[order[(i + 1) % len(order)]])


def test_empty_lexicon(spark):
    rows = [(1, "a b c"), (2, "a b c")]
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), (50.0, 60.0)).collect()
    assert [r["near_next"] for r in got] == [1.0, 1.0] and got[0]["fingerprint"]
