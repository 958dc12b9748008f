"""Texts that polynomial hashes take for equal are told apart: two-letter words, mirrored shingles."""
import numpy as np
import pyarrow as pa

from riskweave.llm import decontam, near_dedup, sentences
from riskweave.llm import text as T
from riskweave.llm.tokens import Encoder
from tests.llm.conftest import plain

ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_runs_are_equal_where_their_values_are():
    r = np.random.default_rng(2)
    runs = [r.integers(0, 3, n).astype(np.uint64) for n in r.integers(0, 200, 300)]
    runs += [run.copy() for run in runs[::3]]
    values, sizes = np.concatenate(runs), np.array([len(x) for x in runs])
    ends = np.cumsum(sizes)
    h = T.run_hashes(values, ends - sizes, ends)
    of = {}
    for run, x in zip(runs, h.tolist(), strict=True):
        assert of.setdefault(run.tobytes(), x) == x
    assert len(set(of.values())) == len(of)


def test_near_duplicates_of_two_letter_words_and_mirrored_shingles(spark):
    texts = [ONE, OTHER, ONE, "a b b a", "b a a b", "a b b a", "x y y x z", "y x x y z"]
    got = plain(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4),
                "doc_id", "component_id")
    assert got == [(0, 0), (1, 1), (2, 0), (3, 3), (4, 4), (5, 3), (6, 6), (7, 7)]


def test_contamination_by_two_letter_words(spark):
    docs = spark.createDataFrame([(0, f"one {ONE}"), (1, f"one {OTHER}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ONE)], "item_id long, text string")
    assert plain(decontam.contamination(docs, bench).select("row.doc_id", "n_hit"), "doc_id", "n_hit") == [(0, 1), (1, 0)]


def test_encoder_of_two_letter_words():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), Encoder(path, 2)
    for text in (ONE, OTHER):
        ids, _ = next(iter(coder.encode(pa.array([text]))))
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_sentence_spans_of_two_letter_words(spark):
    rest = " ".join(f"w{i}" for i in range(20)) + "."
    docs = spark.createDataFrame([(1, f"{ONE} {rest} End."), (2, f"{OTHER} {rest} End.")], "doc_id long, text string")
    assert plain(sentences.repeated_spans(docs, sentences=2, words=22), "doc_id", "n_removed") == [(1, 0), (2, 0)]
    letters = " ".join(ONE) + "."
    mirrored = " ".join(OTHER) + "."
    docs = spark.createDataFrame([(1, f"{letters} End."), (2, f"{mirrored} End.")], "doc_id long, text string")
    assert plain(sentences.repeated_spans(docs, sentences=2, words=20), "doc_id", "n_removed") == [(1, 0), (2, 0)]


def test_rows_without_ids_are_told_apart(spark):
    shared = " ".join(f"s{i}" for i in range(20)) + ". Also here."
    docs = spark.createDataFrame([(None, f"{shared} Text {i}.") for i in range(40)], "doc_id long, text string")
    got = [r["n_removed"] for r in sentences.repeated_spans(docs).collect()]
    assert sorted(got)[0] == 0 and sorted(got)[1] > 0
