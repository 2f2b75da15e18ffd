import random

import numpy as np

from skyfold.llm import _text as X
from tests.llm.brute import words


def test_words_and_window_hashes_tell_sequences_apart():
    r = random.Random(1)
    texts = [None, "", "  ", " a b\tc\n a b c d e f g ", "é ñ ü x", "w" * 9000] + [" ".join(r.choice("abcde") for _ in range(40)) for _ in range(5)]
    block = X.of_texts(texts)
    w = X.Words(block)
    flat = [x.encode() for t in texts for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    assert [block.data[a:b].tobytes() for a, b in zip(w.start, w.end)] == flat
    for k in (1, 2, 3, 5, 12, 13, 25, 31):
        h, named = X.windows(w.hash, k), {}
        for i in range(len(flat) - k + 1):
            assert named.setdefault(tuple(flat[i : i + k]), h[i]) == h[i]
        assert len(set(named.values())) == len(named)


def test_blocks_hold_whole_texts():
    import pyarrow as pa

    texts = ["x" * n for n in (3, 0, 5, 200, 1, 0)]
    found = [b.text(i).decode() for b in X.blocks(pa.array(texts).slice(0), 8) for i in range(len(b))]
    assert found == texts
    assert list(X.blocks(pa.array([], pa.string()))) == []
    sliced = [b.text(i).decode() for b in X.blocks(pa.array(texts).slice(2, 3), 8) for i in range(len(b))]
    assert sliced == texts[2:5]


def test_repeated_counts_within_a_document_only():
    h, doc = np.array([5, 5, 7, 5, 7, 7], np.uint64), np.array([0, 0, 0, 1, 1, 1])
    twice, later = X.repeated(h, doc)
    assert twice.tolist() == [True, True, False, False, True, True]
    assert later.tolist() == [False, True, False, False, False, True]
