"""Token ids of whole texts from a public tokenizer, with the library's results memoised per piece.

A byte-level BPE tokenizer first cuts a text into pieces (words with their leading blank, numbers,
punctuation, white space) and then its model encodes every piece on its own. Pieces repeat, so each
distinct one goes through the library's model once per worker and its ids are gathered from then on.
Texts that hold characters outside ``PLAIN`` or a special token's string are encoded by the library whole.
"""
from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from riskweave.llm import text as T

#: Code points below this have had their classes since the oldest Unicode version in use.
PLAIN = 0x0530
MEMO_PIECES = 1_000_000
MEMO_IDS = 5_000_000
CHUNK_BYTES = 1 << 20
#: White space as Unicode's property has it, below PLAIN.
_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
_OTHER, _LETTER, _NUMBER, _BLANK = 0, 1, 2, 3
_CONTRACTED = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}


def _classes() -> np.ndarray:
    of = {"L": _LETTER, "N": _NUMBER}
    table = np.array([of.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(PLAIN)], np.uint8)
    table[list(_SPACE)] = _BLANK
    return table


def _byte_letters() -> dict:
    """The character that byte-level BPE writes for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def piece_starts(points: np.ndarray, text: str, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First code point of every piece; ``bounds``: where each text begins, and the end of the last.

    Runs of letters, numbers and other signs take one blank (U+0020) before them along; other white
    space is cut before its last character if something follows; 's 't 're 've 'm 'll 'd are pieces.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[np.minimum(points, PLAIN - 1)]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    cut = edge[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    cut[0] = True
    run = np.flatnonzero(cut)
    # a white-space run that something follows in its text: its last character starts a new piece,
    # and where that is a plain blank, the run that follows joins it
    ends = np.append(run[1:], n)
    inner = (kind[run] == _BLANK) & ~edge[ends]
    last = ends[inner] - 1
    cut[last] = True
    joined = last[points[last] == 0x20] + 1
    cut[joined] = False
    # contractions start at an apostrophe that is a run of its own and has no blank before it
    quote = np.flatnonzero((points == 0x27) & cut)
    for q in quote.tolist():
        if q + 1 < n and kind[q + 1] == _LETTER and not edge[q + 1]:
            for size in (1, 2):
                if _CONTRACTED.get(text[q + 1:q + 1 + size]) == size and not edge[q + 1:q + 1 + size].any():
                    cut[q + 1] = False
                    if q + 1 + size < n and kind[q + 1 + size] == _LETTER:
                        cut[q + 1 + size] = True
                    break
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, end id appended; the memo lives as long as the Python worker."""

    _of: dict = {}

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.letters = _byte_letters()
        self.classes = _classes()
        self.end_id = end_id
        self._forget()

    @classmethod
    def of(cls, path: str, end_id: int) -> "Encoder":
        if (path, end_id) not in cls._of:
            cls._of[path, end_id] = cls(path, end_id)
        return cls._of[path, end_id]

    def _forget(self) -> None:
        self.keys = np.zeros(1, np.uint64)  # key 0: the end of a text
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.array([self.end_id], np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array([*self.library.encode(text, add_special_tokens=False).ids, self.end_id], np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        split, letters, blank = self.model.tokenize, self.letters, chr(self.letters[0x20])
        new = [[t.id for t in split(p.replace(" ", blank) if p.isascii() and p.isprintable()
                                    else p.encode().decode("latin-1").translate(letters))] for p in pieces]
        size = np.array([len(i) for i in new], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first, self.size = np.insert(self.first, at, first), np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, np.array([x for i in new for x in i], np.uint32)])

    def encode(self, column: pa.Array):
        """(ids, ids per text) for runs of texts, in order."""
        for _, _, data, offs in T.chunks(column, CHUNK_BYTES):
            raw = data.tobytes()
            text = raw.decode("utf-8")
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            heads = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
            bounds = heads[offs]
            odd = points >= PLAIN
            count = np.concatenate(([0], np.cumsum(odd)))
            direct = set(np.flatnonzero(count[bounds[1:]] > count[bounds[:-1]]).tolist())
            for s in self.special:
                if s in text:
                    direct |= {i for i in range(len(bounds) - 1) if s in text[bounds[i]:bounds[i + 1]]}
            starts = piece_starts(points, text, bounds, self.classes)
            ends = np.append(starts[1:], len(points))
            key = self._hashes(points, starts, ends)
            owner = np.searchsorted(bounds, starts, "right") - 1
            if direct:
                keep = ~np.isin(owner, list(direct))
                starts, ends, key, owner = starts[keep], ends[keep], key[keep], owner[keep]
            distinct, index, back = np.unique(key, return_index=True, return_inverse=True)
            if len(self.keys) + len(distinct) > MEMO_PIECES or len(self.ids) > MEMO_IDS:
                self._forget()
            at = np.searchsorted(self.keys, distinct)
            new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct)
            if len(new):
                self._learn(distinct[new], [text[starts[i]:ends[i]] for i in index[new].tolist()])
                at = np.searchsorted(self.keys, distinct)
            slot = at[back]
            per_text = np.searchsorted(owner, np.arange(len(offs)))  # pieces before each text
            slot = np.insert(slot, per_text[1:], 0)  # its end follows each text
            size, first = self.size[slot], self.first[slot]
            done = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.repeat(first - done[:-1], size) + np.arange(done[-1])]
            counts = np.diff(done[per_text + np.arange(len(offs))])
            if direct:
                rows = np.split(ids, np.cumsum(counts)[:-1])
                for i in direct:
                    rows[i] = self._whole(text[bounds[i]:bounds[i + 1]])
                ids, counts = np.concatenate(rows), np.array([len(r) for r in rows])
            yield ids, counts

    @staticmethod
    def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        v = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        v ^= v >> np.uint64(29)
        return np.maximum(T.run_hashes(v, starts, ends), np.uint64(1))
