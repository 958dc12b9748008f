"""Plain Python versions of the operators, quadratic and single-threaded, for small fixtures."""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows, k, percent=80):
    """(doc_id, n_shingles, component_id) for each row."""
    sets = [shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def repeated_substrings(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(r[s:s + length] for _, r in raws for s in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for s in range(len(r) - length + 1):
            if seen[r[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, window=13):
    """(doc_id, n_words, n_hit, item ids) for each row."""
    tests = []
    for i, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        n = min(window, len(w))
        tests += [(i, w[a:a + n]) for a in range(len(w) - n + 1)] if w and i is not None else []
    out = []
    for d, t in rows:
        w, hit, ids = ALNUM.findall((t or "").translate(UPPER)), set(), set()
        for i, g in tests:
            for a in range(len(w) - len(g) + 1):
                if w[a:a + len(g)] == g:
                    hit.update(range(a, a + len(g)))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


def targets(sizes, weights=(3, 1, 2)):
    """Target of each source, by repeated resharing of what exceeds the caps."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def sentence_spans(rows, at_least, words):
    """(doc_id, n_sentences, n_removed, text) for each row; first occurrences by doc_id (None first), then place."""
    docs = []
    for d, t in rows:
        raw = (t or "").encode()
        ws = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        sents, cur = [], []
        for k, (_, b) in enumerate(ws):
            cur.append(k)
            if raw[b - 1:b] in (b".", b"!", b"?") or k + 1 == len(ws) or b"\n" in raw[b:ws[k + 1][0]]:
                sents.append(cur)
                cur = []
        spans = []
        for i in range(len(sents)):
            n = 0
            for j in range(i, len(sents)):
                n += len(sents[j])
                if j - i + 1 >= at_least and n >= words:
                    spans.append((i, j, tuple(raw[a:b] for s in sents[i:j + 1] for a, b in (ws[k] for k in s))))
                    break
        docs.append((d, raw, ws, sents, spans))
    first: dict = {}
    for d, raw, _, _, spans in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        for i, _, key in spans:
            first.setdefault(key, (d, raw, i))
    out = []
    for d, raw, ws, sents, spans in docs:
        gone = {s for i, j, key in spans if first[key] != (d, raw, i) for s in range(i, j + 1)}
        cut = [0, *(ws[s[0]][0] for s in sents[1:]), len(raw)]
        kept = b"".join(raw[cut[k]:cut[k + 1]] for k in range(len(sents)) if k not in gone) if sents else raw
        out.append((d, len(sents), len(gone), kept.decode()))
    return out


def base_secrets(text):
    """(start, kind, end) of the base patterns, letter case written out."""
    t = text or ""
    either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile("(?:" + either + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))
