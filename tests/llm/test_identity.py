"""Texts made so that a polynomial hash modulo a power of two can't tell them apart, and other odd texts."""

import numpy as np
import pyarrow as pa
import pytest

from blockwright.llm import language, near_dup, packing
from blockwright.llm import text as tx
from blockwright.llm import tokens as tk


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048])
def test_ids_of_pieces_with_equal_hashes(n):
    bpe = tk.WordBpe(tk.tokenizer_path("word_bpe_49k.json"))
    a, b = thue_morse(n)
    for texts in ([a, "x " + b + " y", "plain words"], [b], [a + ". " + b, a]):  # in one block, and in later ones
        ids, off = bpe.encode(*tx.buffers(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == bpe.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_and_texts_that_differ_stay_apart(spark, n):
    a, b = thue_morse(n)
    words = tx.Words(*tx.buffers(pa.array([a, b, "Ⅷ" * n, "Ⅷ" * (n - 1)])))
    assert len(set(words.hash.tolist())) == 4
    rows = [(1, a), (2, b), (3, a + "."), (4, f"{b} {a}"), (5, f"{b}, {a}!"), (6, f"{a} {b}"), (7, "!?"), (8, "?!"), (9, "!?")]
    got = dict(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 7}


def test_digests_don_t_depend_on_the_block():
    texts = ["a b", " a b", "a  b.", "A-B", "ab", "", "b a", "…a b", "a b…"]
    data, off = tx.buffers(pa.array(texts))
    got = tx.Words(data, off).digests(data, off)
    for i, t in enumerate(texts):
        d, o = tx.buffers(pa.array([t]))
        assert (tx.Words(d, o).digests(d, o)[0] == got[i]).all()
    assert len({tuple(x) for x in got[:4].tolist()}) == 1 and len({tuple(x) for x in got.tolist()}) == 6


def test_letters_by_unicode_category():
    texts = ["½²①Ⅷ", "123 !", "½x", "é", "日", "٣", "ª", "", "_"]
    column = pa.array(texts)
    assert language.has_letter(column, *tx.buffers(column)).tolist() == [False, False, True, True, True, False, True, False, False]


@pytest.mark.parametrize("seed", range(40))
def test_repeated_patterns_give_the_bins_of_one_by_one(seed, monkeypatch):
    """The same function with each pattern applied once: bins of the same contents."""
    rng = np.random.default_rng(seed)
    for _ in range(20):
        capacity = int(rng.integers(5, 40))
        counts = np.zeros(capacity + 1, np.int64)
        at = rng.integers(1, capacity + 1, rng.integers(1, 8))
        counts[at] = rng.integers(1, 30, len(at))

        def bins(times_of):
            return sorted(tuple(c) for times, c in packing.pack_counts(counts, capacity, times_of).bins for _ in range(times))

        assert bins(None) == bins(1)
