"""Vectorised word spans and hashes over the UTF-8 bytes of Arrow string columns.

Helpers for Arrow-batch functions: a batch is walked in chunks of about
half a megabyte (a longer text is a chunk of its own), so memory follows the chunk, not
the batch. Nothing here knows Spark.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_GRAM_SEED = 97
#: Values of a run that one polynomial covers.
BLOCK = 32
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def byte_class(keep) -> np.ndarray:
    """Table of 256 flags: which bytes belong to a word."""
    return np.array([bool(keep(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``: everything but ASCII blanks (bytes above 127 only occur inside other characters).
NON_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z and everything beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix constants), in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the odd base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = n + n // 8
        for key, base in (("up", _ODD), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts of about ``limit`` bytes."""
    if len(column) == 0:
        return
    data, offs = string_buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row bounds): byte spans of all words, and for row i the words bounds[i] to bounds[i + 1]."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    filled = offs[:-1][offs[1:] > offs[:-1]]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = inside[1:].copy() if len(data) else np.zeros(0, bool)
    after[offs[1:][offs[1:] > offs[:-1]] - 1] = False
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of 64-bit values, equal for equal runs wherever they stand.

    A polynomial modulo 2**64 alone is the same for some pairs of long runs of two values (a Thue-Morse word of
    1,024 letters and its complement). So runs of more than ``BLOCK`` values are hashed in blocks from their start,
    and what is summed are the mixed hashes of the numbered blocks.
    """
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])

    def polynomial(a, b):
        h = (total[b] - total[a]) * down[a]
        h += (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)

    out = polynomial(starts, ends)
    long = np.flatnonzero(ends - starts > BLOCK)
    if len(long):
        n = -(-(ends[long] - starts[long]) // BLOCK)
        head = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(head, n)
        a = np.repeat(starts[long], n) + BLOCK * place
        b = np.minimum(a + BLOCK, np.repeat(ends[long], n))
        out[long] = mix(np.add.reduceat(mix(polynomial(a, b) + (place + 1).astype(np.uint64) * _ODD), head))
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    return run_hashes(_BYTE[data], starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position that has n words ahead of it (rows are cut by the caller)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    scale = np.random.default_rng(_GRAM_SEED).integers(0, 1 << 64, max(n, 1), dtype=np.uint64) | np.uint64(1)
    for j in range(n):
        out += words[j:len(words) - n + 1 + j] * scale[j]
    return mix(out)
