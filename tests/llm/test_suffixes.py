"""Multikey quicksort of suffixes by their own bytes, and strings that polynomial hashes take for equal."""
import numpy as np
import pytest

from riskweave.llm import substrings
from tests.llm import brute


@pytest.mark.parametrize("seed", range(6))
def test_multikey_order_equals_plain_sort(seed):
    r = np.random.default_rng(seed)
    tokens = [r.integers(0, 1 + seed, 300).astype(np.uint64) for _ in range(7)]
    order, same = substrings.multikey_order([lambda at, t=t: t[at] for t in tokens])
    rows = list(zip(*(t.tolist() for t in tokens), strict=True))
    assert sorted(order.tolist()) == list(range(300))
    assert [rows[i] for i in order] == sorted(rows)
    assert same.tolist() == [k > 0 and rows[order[k]] == rows[order[k - 1]] for k in range(300)]


def test_words_and_empty():
    assert substrings._words(np.frombuffer(b"abcdefghi", np.uint8)).tolist() == [int.from_bytes(b"abcdefgh", "big"), int.from_bytes(b"bcdefghi", "big")]
    assert len(substrings._words(np.frombuffer(b"abc", np.uint8))) == 0
    order, same = substrings.multikey_order([np.zeros(0, np.uint64)] * 2)
    assert len(order) == len(same) == 0


@pytest.mark.parametrize("length", [64, 61])
def test_equal_hashes_are_not_equal_strings(spark, length):
    """A Thue-Morse word and its complement, between the same bytes: hashes modulo 2^64 agree, bytes do not."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    edge = "The quick brown fox jumps over a lazy dog, 0123456789."
    rows = [(1, edge + word + edge), (2, edge + other + edge), (3, edge[:30] + word[:500])]
    got = substrings.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(brute.repeated_substrings(rows, length))
