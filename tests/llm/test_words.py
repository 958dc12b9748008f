"""op12 and op13 against plain versions."""
import random
import re
import zlib
from collections import Counter

import pytest

from riskweave.llm import collocations, spelling
from tests.llm.brute import UPPER
from tests.llm.conftest import ordered, plain


def words_of(rows, slip=spelling.SLIP, length=6, least=5):
    c = Counter()
    for d, t in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            m = m.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{m}".encode())
            if h % slip == 0:
                m = m[:h % len(m)] + m[h % len(m) + 1:]
            if len(m) >= length:
                c[m] += 1
    return {w: n for w, n in c.items() if n >= least}


def at_one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_of(counts):
    near = {w: [v for v in counts if at_one_edit(w, v)] for w in counts}
    form = {}
    for w, s in near.items():
        best = min(s, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def spelled(seed=2):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 9))) for _ in range(60)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = r.choice(stems[:r.choice((3, 10, 60))])
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice((w[:at] + w[at + 1:], w[:at] + r.choice("abcdeé×") + w[at:], w[:at] + r.choice("abcdeÉ") + w[at + 1:]))
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice((" ", "-", "1", "日")).join(words)))
    return rows + [(900, None), (None, rows[0][1]), (901, ""), rows[3], rows[3]]


def test_words_are_counted_as_in_the_contract(spark, rows, docs):
    data = spelled()
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in data], "doc_id long, text string, n long, word string")
    for slip in (spelling.SLIP, 3):
        assert dict((r["word"], r["n"]) for r in spelling.word_counts(df, slip=slip).collect()) == words_of(data, slip)
    assert dict((r["word"], r["n"]) for r in spelling.word_counts(docs).collect()) == words_of(rows)


@pytest.mark.parametrize("hot", [spelling.HOT, 1])
def test_variants_equal_all_pairs(spark, hot):
    counts = words_of(spelled())
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = plain(spelling.variants(df, hot=hot), *COLUMNS)
    assert got == ordered(variants_of(counts))
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_chains_of_forms_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 20000, "zzzzzz": 5, "zzzzzy": 50, "zzzzzx": 50,
              "éééééé": 5, "ééééé×e": 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = plain(spelling.variants(df), *COLUMNS)
    assert got == ordered(variants_of(counts))
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "abbbbb" and {r[0]: r[1] for r in got}["zzzzzz"] == "zzzzzx"


def test_no_words(spark, nothing):
    assert spelling.variants(spelling.word_counts(nothing)).count() == 0


def collocations_of(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    best = {}
    for (lang, p), a in phrases.items():
        if len(p) == 2 and any(100 * b >= 50 * a for (lg, q), b in phrases.items() if len(q) == 3 and lg == lang and p in (q[:2], q[1:])):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, held in best.items()
            for i, (s, a, p, left, right) in enumerate(sorted(held)[:top], 1)]


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def spoken(seed=4):
    r = random.Random(seed)
    vocabulary = ["a", "b", "été", "Da", "x y", "日本", "c"]
    rows = [(r.choice((None, "und", "en", "de")), "".join(r.choice(vocabulary) + r.choice((" ", "  ", "\t", " ", ", ", "\n", ".", " ")) for _ in range(r.randint(0, 60))))
            for _ in range(120)]
    passage = "one two three four five six seven eight nine ten"
    return rows + [("en", passage)] * 12 + [("fr", "a a a a a a a a a a a a a a a"), ("fr", None), ("fr", " , .\n"), (None, "b")]


def test_collocations_equal_plain_counts(spark):
    data = spoken()
    df = spark.createDataFrame([(lang, t, "p", 1) for lang, t in data], "lang string, text string, phrase string, n long").repartition(3)
    want = collocations_of(data, 5, 9)
    assert plain(collocations.collocations(df, min_count=5, top=9), *PHRASE) == ordered(want)
    assert any(" ".join(("one", "two")) in r[2] for r in collocations_of(data, 5, 2000))


def test_texts_longer_than_a_part(spark, monkeypatch):
    data = spoken()
    batches = spark.createDataFrame([(t, lang) for lang, t in data], "text string, lang string").fillna({"lang": "und", "text": ""}).toArrow().to_batches()
    def counted():
        c = Counter()
        for b in collocations._edges(batches):
            for r in b.to_pylist():
                c[r["lang"], r["head"], None] += r["flow"]
                for e in r["nexts"].split("\t") if r["nexts"] else ():
                    w, _, n = e.partition(" ")
                    c[r["lang"], r["head"], w] += int(n or 1)
        return c
    whole = counted()
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(collocations, "_PART_WORDS", size)
        assert counted() == whole


def test_paths_hold_every_edge_once(spark):
    data = spoken()
    df = spark.createDataFrame(data, "lang string, text string")
    nodes, _, edges = collocations.graph(df, 5)
    flow = {(r["lang"], r["node"]): r["flow"] for r in nodes.collect()}
    want = ordered((r["lang"], f"{r['node']} {r['next']}", r["n"], flow[r["lang"], r["node"]]) for r in edges.collect())
    for rounds in (0, 1, 6):
        runs = collocations.paths(nodes, edges, rounds).collect()
        got = [(r["lang"], " ".join(r["words"][i:i + 3]), c, r["flows"][i]) for r in runs for i, c in enumerate(r["counts"])]
        assert ordered(got) == want
    assert max(len(r["counts"]) for r in runs) > 3                            # the passage's edges stand in one row


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 8_999_999_999_999)], "first1 long, last1 long, a long")
    got = df.select(collocations._cut("first1", "last1", 1).alias("c")).first()["c"]["score"]
    assert got == 1000000 * 8_999_999_999_999 ** 2 // (9_000_000_000_000 * 9_000_000_000_001)


def test_no_documents(spark, nothing):
    assert collocations.collocations(nothing).count() == 0
