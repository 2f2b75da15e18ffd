import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyfold.llm import _text as X
from skyfold.llm import langid

SAMPLES = {"xx": [b"abab abba\nabab", b"baba"], "yy": ["çédé cdcd".encode(), b"ccdd"]}


def code_length(samples, text, order):
    """Method C with frozen counts, a dictionary a context."""
    seen = defaultdict(Counter)
    for t in samples:
        padded = b"\n" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[padded[i - k : i]][padded[i]] += 1
    bits, padded = 0.0, b"\n" * order + text
    for i in range(order, len(padded)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            here = seen.get(padded[i - k : i])
            if not here:
                continue
            mass = sum(here.values()) + len(here)
            if here[padded[i]]:
                bits -= math.log2(here[padded[i]] / mass)
                break
            bits -= math.log2(len(here) / mass)
    return bits


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_are_those_of_context_trees(order):
    model = langid.Model(SAMPLES, order)
    texts = ["abab", "cdcd é", "", "zzz ab", "\nabba\n"]
    got = model.bits(X.of_texts(texts))
    want = [[code_length(SAMPLES[l], t.encode(), order) for l in model.langs] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_predictions_and_edges(spark):
    rows = [(i, t, l, 1) for i, (t, l) in enumerate([("ab ab ab abab", "xx"), ("cd cd cd cdcd", "yy")] * 20)]
    rows += [(100, None, "xx", 1), (101, "", None, None), (102, "12 34 !", "yy", 1), (None, "abab", None, 1), (103, "abab abab", None, 1), (103, "abab abab", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    out = langid.identify(docs, langid.train(docs)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"} and by[102].score == 0
    assert by[0].lang_pred == "xx" and by[1].lang_pred == "yy" and by[103].lang_pred == "xx" and by[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in out)
    empty = docs.where("false")
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from skyfold.llm import queries

    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
