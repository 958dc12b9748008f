"""Static range asymmetric numeral system over token ids, interleaved over lanes, with checkpoints.

A container holds one frequency table and blocks of ids; every block is decoded on its own, from
its start or from any of its checkpoints. Layout (little endian):

    magic "RWTK1", u8 table bits, u32 symbols, u32 table bytes, u32 blocks
    table, deflated: u32 symbol (differences), u32 frequency; frequencies sum to 2**bits
    directory: u64 offset of each block and of the end, from the container's first byte
    block: u32 ids, u32 lanes, u32 words, u32 checkpoint every so many steps, u32 checkpoints,
           then for each checkpoint u32 first word, u32 crc32 of its ids, u64 state of each lane,
           then the u32 words, then u32 crc32 of all that goes before in the block

Lane j has the ids j, j + lanes, ...; a step takes one id of every lane. A state lies in
[2**31, 2**63) and passes 32 bits at a time to the words, which stand in decoding order.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RWTK1"
BITS = 20
BLOCK_IDS = 1 << 18
LANES = 2048
CHECKPOINT_STEPS = 64
_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)
_HEAD, _BLOCK = struct.Struct("<5sBIII"), struct.Struct("<IIIII")


def frequencies(ids: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): every symbol at least 1, in sum 2**bits."""
    symbols, count = np.unique(ids, return_counts=True)
    if not len(symbols):
        return symbols.astype(np.uint32), np.zeros(0, np.uint32)
    if len(symbols) > 1 << bits:
        raise ValueError("more symbols than the table has room for")
    freq = np.maximum(1, (count * ((1 << bits) / count.sum())).astype(np.int64))
    short = (1 << bits) - int(freq.sum())
    for i in np.argsort(-freq, kind="stable"):  # largest first: a surplus is taken where it costs least
        if short >= 0:
            freq[i] += short
            break
        take = min(int(freq[i]) // 2, -short)
        freq[i] -= take
        short += take
    while short < 0:
        i = int(np.argmax(freq))
        take = min(int(freq[i]) - 1, -short)
        freq[i] -= take
        short += take
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def _encode_block(rank: np.ndarray, ids: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int) -> bytes:
    n = len(rank)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    shift, words, marks = np.uint64(bits), [], []
    room = np.uint64(63 - bits)
    for s in range(steps - 1, -1, -1):
        r = rank[s * lanes:(s + 1) * lanes]
        f, x = freq[r], state[:len(r)]
        full = x >= (f << room)
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> _U32, x)
        q = x // f
        state[:len(r)] = (q << shift) + (x - q * f) + start[r]
        if s % CHECKPOINT_STEPS == 0:
            part = ids[s * lanes:(s + CHECKPOINT_STEPS) * lanes]
            marks.append((sum(map(len, words)), zlib.crc32(part.astype("<u4").tobytes()), state.copy()))
    total = sum(map(len, words))
    out = [_BLOCK.pack(n, lanes, total, CHECKPOINT_STEPS, len(marks))]
    for left, crc, at in reversed(marks):
        out.append(struct.pack("<II", total - left, crc) + at.astype("<u8").tobytes())
    out += [w.astype("<u4").tobytes() for w in reversed(words)]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def pack(ids: np.ndarray, bits: int = BITS) -> bytes:
    """The container of ids (unsigned 32 bit)."""
    symbols, freq = frequencies(ids, bits)
    wide = freq.astype(np.uint64)
    start = np.cumsum(wide) - wide
    lookup = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int64)
    lookup[symbols] = np.arange(len(symbols))
    blocks = [_encode_block(lookup[part], part, wide, start, bits)
              for part in (ids[i:i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS))]
    table = zlib.compress(np.concatenate([np.diff(symbols, prepend=np.uint32(0)), freq]).astype("<u4").tobytes(), 1)
    head = _HEAD.pack(MAGIC, bits, len(symbols), len(table), len(blocks)) + table
    at = len(head) + 8 * (len(blocks) + 1) + np.cumsum([0] + [len(b) for b in blocks])
    return b"".join([head, at.astype("<u8").tobytes(), *blocks])


class Reader:
    """Blocks of a container, each decodable on its own."""

    def __init__(self, data: bytes):
        magic, self.bits, symbols, size, self.blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token container")
        table = np.frombuffer(zlib.decompress(data[_HEAD.size:_HEAD.size + size]), "<u4", 2 * symbols)
        self.symbols = np.cumsum(table[:symbols], dtype=np.uint32)
        self.freq = table[symbols:].astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        if symbols and int(self.freq.sum()) != 1 << self.bits:
            raise ValueError("damaged frequency table")
        self.slots = np.repeat(np.arange(symbols, dtype=np.uint32), table[symbols:])
        self.at = np.frombuffer(data, "<u8", self.blocks + 1, _HEAD.size + size).astype(np.int64)
        self.data = data

    def block(self, k: int, checkpoint: int = 0, to_end: bool = True) -> np.ndarray:
        """Ids of block k from a checkpoint on: to the block's end, or to the next checkpoint."""
        body = self.data[self.at[k]:self.at[k + 1]]
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        n, lanes, words, every, marks = _BLOCK.unpack_from(body)
        size = 8 + 8 * lanes
        stream = np.frombuffer(body, "<u4", words, _BLOCK.size + marks * size)
        mark = [struct.unpack_from("<II", body, _BLOCK.size + c * size) for c in range(marks)]
        state = np.frombuffer(body, "<u8", lanes, _BLOCK.size + checkpoint * size + 8).astype(np.uint64)
        pos, shift, mask = mark[checkpoint][0], np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        first = checkpoint * every
        last = -(-n // lanes) if to_end else min(first + every, -(-n // lanes))
        out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
        for s in range(first, last):
            x = state[:min(lanes, n - s * lanes)]
            slot = x & mask
            r = self.slots[slot]
            x = self.freq[r] * (x >> shift) + slot - self.start[r]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << _U32) | stream[pos:pos + len(low)]
            pos += len(low)
            state[:len(x)] = x
            out[(s - first) * lanes:(s - first) * lanes + len(x)] = r
        ids = self.symbols[out]
        for c in range(checkpoint, checkpoint + -(-(last - first) // every)):
            part = ids[(c * every - first) * lanes:((c + 1) * every - first) * lanes]
            if zlib.crc32(part.astype("<u4").tobytes()) != mark[c][1]:
                raise ValueError(f"block {k}: wrong ids after checkpoint {c}")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint32)
