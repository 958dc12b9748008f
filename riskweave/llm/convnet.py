"""A small convolutional text classifier in numpy.

A word's vector is the sum of two hashed rows of an embedding, one of the word and one of its first
four bytes, so unseen forms of a word share its stem. Filters of several widths slide over the words, the largest
response of each filter in the text is kept, and a logistic unit weighs those. Texts of any length
are read whole. One embedding column starts at each word's smoothed log-odds in the fitted texts,
and one filter of width 1 starts by looking at it; all parameters are then trained by Adagrad, in
which only the words that won a maximum move.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from riskweave.llm import text as T

ROWS_BITS = 16
STEM = 4
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 5
RATE = 0.05
PRIOR_TEXTS = 10.0


def word_rows(column: pa.Array):
    """(embedding rows of all words, two each; bounds of the texts) for runs of texts."""
    for _, _, data, offs in T.chunks(column):
        low = T.LOWER[data]
        starts, ends, bounds = T.word_spans(low, offs, T.ALNUM)
        stem = T.span_hashes(low, starts, np.minimum(ends, starts + STEM)) * np.uint64(0x9E3779B97F4A7C15)
        h = np.stack([T.span_hashes(low, starts, ends), stem], 1)
        yield (h >> np.uint64(64 - ROWS_BITS)).astype(np.int32), bounds


def _log_odds(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = np.zeros((2, 1 << ROWS_BITS))
    for rows, label in zip(texts, y.tolist(), strict=True):
        count[label, np.unique(rows)] += 1
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    return np.log((count[1] + PRIOR_TEXTS * share) / (count[0] + PRIOR_TEXTS * (1 - share))) - np.log(share / (1 - share))


def train(texts: list[np.ndarray], y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters from word rows and 0/1 labels of a bounded sample."""
    rng = np.random.default_rng(seed)
    emb = np.zeros(((1 << ROWS_BITS) + 1, DIM), np.float32)  # the last row is the padding behind a text
    emb[:-1] = rng.normal(0, 0.1, (1 << ROWS_BITS, DIM))
    emb[:-1, 0] = _log_odds(texts, y)
    filters = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    filters[1][:, :, 0] = 0
    filters[1][0, 0, 0] = 1
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.01
    p = {"emb": emb, "out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
         "bias": np.array([np.log(share / (1 - share)) - 1], np.float32),
         "shift": np.zeros(len(WIDTHS) * FILTERS, np.float32)} | {f"w{w}": f for w, f in filters.items()}
    p["out"][0] = 1
    seen = {k: np.full_like(v, 1e-2) for k, v in p.items()}

    def move(key, at, grad):
        seen[key][at] += grad * grad
        p[key][at] -= RATE * grad / np.sqrt(seen[key][at])

    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    for _ in range(EPOCHS if len(y) else 0):
        for i in rng.permutation(len(texts)).tolist():
            rows, label = texts[i], int(y[i])
            if not len(rows):
                continue
            n = len(rows)
            padded = np.concatenate([rows, np.full((max(WIDTHS) - 1, 2), 1 << ROWS_BITS, rows.dtype)])
            x = p["emb"][padded[:, 0]] + p["emb"][padded[:, 1]]
            top, at = [], []
            for w in WIDTHS:
                a = sum(x[j:j + n] @ p[f"w{w}"][j] for j in range(w))
                k = a.argmax(0)
                at.append(k)
                top.append(a[k, np.arange(FILTERS)])
            pre = np.concatenate(top) + p["shift"]
            pooled = np.maximum(pre, 0)
            z = float(pooled @ p["out"] + p["bias"][0])
            g = weight[label] * (1 / (1 + np.exp(-min(max(z, -30), 30))) - label)
            back = g * p["out"] * (pre > 0)
            move("out", slice(None), g * pooled)
            move("bias", slice(None), np.array([g], np.float32))
            move("shift", slice(None), back)
            for b, w in enumerate(WIDTHS):
                d, f, k = back[b * FILTERS:(b + 1) * FILTERS], p[f"w{w}"], at[b]
                if not d.any():
                    continue
                for j in range(w):
                    grad_emb = f[j].T * d[:, None]  # one row per filter, for the word it won with
                    move(f"w{w}", j, x[k + j].T * d)
                    won = padded[k + j]
                    for (r, stem), ge, on in zip(won.tolist(), grad_emb, d != 0, strict=True):
                        if on and r < 1 << ROWS_BITS:
                            move("emb", r, ge)
                            move("emb", stem, ge)
    return p


class Scorer:
    """Logits of whole texts; responses per word and filter tap are tables, so a text costs gathers."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.taps = {w: [p["emb"] @ p[f"w{w}"][j] for j in range(w)] for w in WIDTHS}

    def logits(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        pad = max(WIDTHS)
        n = len(bounds) - 1
        padded = np.full((len(rows) + pad * n, 2), 1 << ROWS_BITS, np.int32)
        starts, ends = bounds[:-1] + pad * np.arange(n), bounds[1:] + pad * np.arange(n)
        padded[np.arange(len(rows)) + pad * np.repeat(np.arange(n), np.diff(bounds))] = rows
        word, stem = padded[:, 0].copy(), padded[:, 1].copy()
        cuts = np.stack([starts, ends], 1).ravel()
        pooled = []
        for w in WIDTHS:
            size = len(padded) - w + 1
            a = np.zeros((size, FILTERS), np.float32)
            for j in range(w):
                a += self.taps[w][j][word[j:j + size]]
                a += self.taps[w][j][stem[j:j + size]]
            pooled.append(np.maximum.reduceat(a, np.minimum(cuts, size - 1), axis=0)[::2])
        pooled = np.maximum(np.concatenate(pooled, 1) + self.p["shift"], 0)
        pooled[starts == ends] = 0
        return pooled @ self.p["out"] + self.p["bias"][0]
