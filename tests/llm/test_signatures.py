"""Unrelated texts share no signature values, at the value width that the corpus needs."""
import numpy as np
import pyarrow as pa

from riskweave.llm import near_dedup


def test_unrelated_texts_share_no_tokens():
    """Five million different shingles: 32-bit minima meet by accident about nine times in this many."""
    r = np.random.default_rng(4)
    texts = [r.bytes(40_000).hex(" ", 4) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = next(near_dedup._signatures(4, near_dedup.COORDINATES)([batch]))
    sig = out.column(3).flatten().to_numpy().reshape(500, near_dedup.COORDINATES)
    assert all(len(np.unique(sig[:, j])) == 500 for j in range(near_dedup.COORDINATES))


def test_similar_texts_agree_as_often_as_their_sets():
    r = np.random.default_rng(5)
    words = [w.hex() for w in (r.bytes(4) for _ in range(4000))]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 1], pa.int64()), pa.array([" ".join(words[:3000]), " ".join(words[1000:])])], ["doc_id", "text"])
    a, b = next(near_dedup._signatures(1, 256)([batch])).column(3).to_pylist()
    assert 0.4 < np.mean(np.array(a) == np.array(b)) < 0.6  # 2,000 of 4,000 are shared
