import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from skyfold.llm import _text as X
from skyfold.llm import sentencepiece_viterbi as S

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load(MODEL)


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts_of_all_kinds():
    r = random.Random(3)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    texts += ["", None, " ", "  a  b ", "\n\t\n", "日本語 テキスト😀", "a" * 300, "hello world", "aaaa aaa ababab"]
    texts += [" " * k + "ab" + " " * (37 - k) for k in range(0, 38, 5)]
    texts += ["".join(r.choice("abcdeé中 ") for _ in range(400)), "".join(r.choice("etaoinshrdlu") for _ in range(3000))]
    return texts + ["".join(r.choice("etaoinshrdlu") for _ in range(k)) for k in (33, 70) for _ in range(S.FEW + 5)]


def test_ids_are_those_of_the_vocabularys_own_encoder_and_decode_to_the_text(vocabulary, own):
    texts = texts_of_all_kinds()
    block, encoder = X.of_texts(texts), S.Encoder(vocabulary)
    for _ in range(2):  # the second time from the cache
        ids, at = encoder.encode(block)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == own.encode(text or ""), text
            assert ids[at[i] : at[i + 1]].tolist() == encoder.encode_alone((text or "").encode()).tolist()
        data, edge = encoder.decode(ids, at)
        assert (data == block.data).all() and (edge == block.offsets).all()


def test_a_separator_of_the_text_comes_back(vocabulary):
    block, encoder = X.of_texts(["▁x ▁", "x▁y", "▁"]), S.Encoder(vocabulary)
    ids, at = encoder.encode(block)
    data, edge = encoder.decode(ids, at)
    assert (data == block.data).all() and (edge == block.offsets).all()


def test_a_full_cache_is_forgotten(vocabulary, own, monkeypatch):
    monkeypatch.setattr(S, "CACHE_IDS", 50)
    encoder, texts = S.Encoder(vocabulary), ["the cat sat on the mat", "a dog, and another dog", "the dog sat " * 40]
    for text in texts * 2:
        ids, _ = encoder.encode(X.of_texts([text]))
        assert ids.tolist() == own.encode(text)


def test_the_window_stays_small(vocabulary, own):
    stream = S.StreamingViterbi(vocabulary)
    r = random.Random(1)
    points = [S.SEPARATOR] + [ord(r.choice("abcdefgh")) for _ in range(5000)]
    early = list(stream.feed(points))
    assert stream.widest <= 4 * vocabulary.longest and len(early) > 1000
    assert early + stream.finish() == own.encode("".join(chr(p) for p in points[1:]))


def test_a_window_in_lockstep_grows_where_paths_do_not_meet(vocabulary, own, monkeypatch):
    lockstep = S.Lockstep(vocabulary)
    lockstep.width = vocabulary.longest + 2  # soon full
    words = ["".join(random.Random(k).choice("abcdefgh") for _ in range(200)) for k in range(5)]
    flat, used = lockstep.run(np.array([[S.SEPARATOR] + [ord(c) for c in w] for w in words]))
    assert flat.tolist() == [x for w in words for x in own.encode(w)]


def test_which_pieces_stay_beside_each_other(vocabulary, own):
    """A pair stays if the two pieces' text is cut into just these."""
    r, ids = random.Random(7), [i for p, i in vocabulary.pieces.items() if p.isascii() and p.isalpha()]
    a, b = np.array([r.choice(ids) for _ in range(4000)]), np.array([r.choice(ids) for _ in range(4000)])
    got = vocabulary.stay(a, b)
    ranks = {p: int(vocabulary.rank[i]) for p, i in vocabulary.pieces.items() if len(p) > 1}
    for x, y, stays in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        parts = list((vocabulary.spelled[x] + vocabulary.spelled[y]).decode())
        while True:
            best = min(((ranks.get(p + q, 1 << 40), i) for i, (p, q) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert stays == ([p.encode() for p in parts] == [vocabulary.spelled[x], vocabulary.spelled[y]])


def test_frames(spark, vocabulary):
    rows = [(1, "hello world", "x"), (None, None, None), (2, "", "y"), (1, "hello world", "x")]
    out = S.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), vocabulary)
    assert out.where("not round_trip").count() == 0 and out.count() == 4
    assert sorted(r.text for r in S.decode(out, vocabulary).collect()) == ["", "", "hello world", "hello world"]
    assert S.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string").where("false"), vocabulary).count() == 0
