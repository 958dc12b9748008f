"""Repeated passages whether or not their sentences end inside them."""
import random

import numpy as np
import pyarrow as pa

from riskweave.llm import sentences
from riskweave.llm import text as T
from tests.llm.conftest import plain

WINDOW = 50


def prose(r, n, stops=0.0):
    return " ".join("".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(1, 7))) + ("." if r.random() < stops else "")
                    for _ in range(n))


def han_prose(r, n):
    return "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))


def windows(text, n=WINDOW):
    w = text.split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_passages_without_sentence_ends(spark):
    r = random.Random(8)
    rows = []
    for stops in (0.0, 0.02, 0.1, 0.5):
        passage = prose(r, 60, stops)
        rows += [f"{prose(r, r.randint(0, 40))} {passage} {prose(r, r.randint(0, 40))}" for _ in range(4)]
    whole = prose(r, 80)
    rows += [whole, whole, prose(r, 15)] + [prose(r, 30, 0.1)] * 2
    han = han_prose(r, 150)
    rows += [han_prose(r, 20) + han + han_prose(r, 20) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [t for _, t in plain(sentences.repeated_spans(df, pieces=sentences.PIECE_WORDS), "doc_id", "text")]
    seen: set = set()
    for t in got[:16]:
        assert not windows(t) & seen
        seen |= windows(t)
    assert got[16] == whole and got[17] == "" and got[18] == rows[18]
    assert got[19] == rows[19] and got[20] == ""
    assert got[21] == rows[21]
    for before, after in zip(rows[22:24], got[22:24], strict=True):
        assert len(after) < len(before) - 110 and all(han[k:k + WINDOW] not in after for k in range(len(han) - WINDOW))
    plain_rule = plain(sentences.repeated_spans(df), "doc_id", "n_removed")
    assert plain_rule[17][1] == 0  # the sentence rule alone leaves the copy of one long sentence


def test_every_window_holds_a_span():
    """A run of 50 words has a span with the same words in whatever text it stands."""
    r = random.Random(9)
    for trial in range(300):
        run = prose(r, WINDOW, r.choice([0, 0.03, 0.1, 0.3, 0.8]))
        if trial % 5 == 0:
            run = " ".join(r.choice(["x", "y", "x."]) for _ in range(WINDOW))
        found = []
        for _ in range(2):
            text = f"{prose(r, 40, r.choice([0, 0.2]))}q {run} {prose(r, 40, r.choice([0, 0.2]))}".encode()
            found.append(set(sentences.spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]), sentences.SENTENCES,
                                             sentences.WORDS, sentences.PIECE_WORDS)[3].tolist()))
        assert found[0] & found[1], run


def test_full_width_stops_and_scripts_without_blanks():
    texts = ["今日は天気です。明日も晴れる！そう？はい", "ก็ดี" * 30, "plain words here.", "", "𠀀𠀁𠀂𠀃", "入門PySpark入門", None]
    for first, end, data, offs in T.chunks(pa.array(texts, pa.string())):
        starts, ends, bounds = sentences.units(data, offs)
        raw = data.tobytes()
        for k in range(end - first):
            a, b = bounds[k], bounds[k + 1]
            assert b"".join(raw[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)).decode() == (texts[k] or "").replace(" ", "")
        assert all(raw[x:y].decode() for x, y in zip(starts, ends, strict=True))
        _, _, heads, held = sentences.sentence_bounds(data, offs, 1000)
        assert held[1] == 4 and held[2] - held[1] == 1
        assert bounds[2] - bounds[1] >= 20
