"""Quality classifier by histogram gradient-boosted trees (operator 3).

Statistics of a text (lengths, character classes, repetition, diversity) are
measured in numpy over blocks of texts. Boosted trees are fitted on their quantile
bins from a bounded sample of labelled rows; each tree is complete and flattened
into arrays of features, thresholds and leaf values, so a block of texts moves down
one level of all of a tree at a time.

Defined results: a null text scores as an empty one; rows with a null or repeated
doc_id are scored like any other; labels with a null doc_id or quality, or whose
document is missing, teach nothing, and repeated labels of a document count by their
largest quality; without two classes to learn from every score is the share of
label 1, or 0.5 without labels. Only doc_id, text, and the labels' doc_id and
quality are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

#: About so many labelled rows are learnt at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000

_CLASS = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 other ASCII, 4 space, 5 part of another letter
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[0x20, *range(0x09, 0x0E)]] = 4
_MARKS = [b"#*$%&|<>", b".,;:", b"!?", b"\"'()[]{}", b"@/\\=+_-~^`"]

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "short_words", "long_words", "lower", "upper", "digit", "other", "space", "beyond_ascii",
    "symbols", "stops", "shouts", "brackets", "marks", "distinct_words", "top_word", "same_as_previous", "repeat_2", "repeat_3", "repeat_5",
    "lines", "words_a_line", "dup_lines", "capital_words", "one_char_words", "solid_symbol_words", "lone_stop_words",
)


def features(block: X.Block) -> np.ndarray:
    """The FEATURES of each text of a block."""
    n, data = len(block), block.data
    words = X.Words(block)
    size = np.diff(block.offsets).astype(float)
    doc = block.doc_of_byte()
    nw = words.counts.astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(nw, 1)
    wlen = (words.end - words.start).astype(float)
    sums = lambda x: np.bincount(words.doc, x, n)
    mean = sums(wlen) * per_word
    kinds = np.bincount(doc * 6 + _CLASS[data], minlength=6 * n).reshape(n, 6) * per_byte[:, None]
    marks = []
    for chars in _MARKS:
        on = np.zeros(256, bool)
        on[list(chars)] = True
        marks.append(np.bincount(doc[on[data]], minlength=n) * per_byte)
    symbol = np.zeros(256, bool)
    symbol[list(_MARKS[0])] = True
    held = np.concatenate(([0], np.cumsum(symbol[data])))
    # distinct words and the commonest
    h = words.hash
    order = np.lexsort((h, words.doc))
    hs, ds = h[order], words.doc[order]
    fresh = np.ones(len(hs), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(hs)))
    top = np.zeros(n)
    np.maximum.at(top, ds[at], runs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = []
    for k in (2, 3, 5):
        w = X.whole(words, k)
        twice, _ = X.repeated(X.windows(h, k)[w], words.doc[w])
        repeats.append(sums(X.covered(len(h), w[twice], k).astype(float)) * per_word)
    feeds = np.flatnonzero(data == 0x0A)
    lines = np.bincount(doc[feeds], minlength=n) + 1.0
    start = np.unique(np.concatenate((block.offsets[:-1][size > 0], feeds + 1)))
    start = start[start < len(data)]
    owner = np.searchsorted(block.offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), block.offsets[owner + 1])
    _, later = X.repeated(X.span_hash(data, start, end), owner)
    first = data[words.start] if len(h) else np.empty(0, np.uint8)
    columns = [
        np.log1p(size), np.log1p(nw), mean, np.sqrt(np.maximum(sums(wlen**2) * per_word - mean**2, 0)), sums(wlen <= 3) * per_word, sums(wlen >= 12) * per_word,
        *kinds.T, *marks, np.bincount(ds[at], minlength=n) * per_word, top * per_word, sums(again) * per_word, *repeats,
        np.log1p(lines), nw / lines, np.bincount(owner[later], minlength=n) / lines, sums((first >= 65) & (first < 91)) * per_word, sums(wlen == 1) * per_word,
        sums((held[words.end] - held[words.start]) * 2 >= wlen) * per_word, sums((wlen == 1) & symbol[first]) * per_word,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


class Trees:
    """Boosted complete trees of one depth in flat arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature = np.empty((0, 2**depth - 1), np.int32)
        self.threshold = np.empty((0, 2**depth - 1), np.float32)
        self.leaf = np.empty((0, 2**depth), np.float32)

    def add(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray) -> None:
        self.feature = np.vstack((self.feature, feature[None].astype(np.int32)))
        self.threshold = np.vstack((self.threshold, threshold[None].astype(np.float32)))
        self.leaf = np.vstack((self.leaf, leaf[None].astype(np.float32)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins."""
    if not len(y):
        return Trees(depth, 0.0)
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = Trees(depth, float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin b: cuts[b-1] < v <= cuts[b]
    raw, width, m = np.full(len(y), model.base), bins, x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            local = node - first
            gain_best, pick, cut = np.full(k, 1e-9), np.full(k, -1), np.zeros(k, np.int64)
            for f in range(m):
                cell = local * width + binned[:, f]
                G = np.bincount(cell, g, k * width).reshape(k, width).cumsum(1)
                H = np.bincount(cell, h, k * width).reshape(k, width).cumsum(1)
                gl, hl = G[:, :-1], H[:, :-1]
                gr, hr = G[:, -1:] - gl, H[:, -1:] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - G[:, -1:] ** 2 / (H[:, -1:] + l2)
                gain[(hl < least) | (hr < least)] = -1
                gain[:, len(cuts[f]) :] = -1
                b = gain.argmax(1)
                better = gain[np.arange(k), b] > gain_best
                gain_best, pick, cut = np.where(better, gain[np.arange(k), b], gain_best), np.where(better, f, pick), np.where(better, b, cut)
            for i in np.flatnonzero(pick >= 0):
                feature[first + i], threshold[first + i] = pick[i], cuts[pick[i]][cut[i]]
            f_of = feature[node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f_of] > threshold[node])
        leaf_of = node - (2**depth - 1)
        leaf = -rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + l2)
        raw += leaf[leaf_of]
        model.add(feature, threshold, leaf)
    return model


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of ``keep`` and the features of text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", x array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch.column(len(keep))):
                x = features(block)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(block.first, len(block)) for i in range(len(keep))), values], names=[*keep, "x"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **params) -> Trees:
    """Trees of the labelled documents given. About ``sample_rows`` labels are learnt; only their statistics come to the driver."""
    labels = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    n = labels.count()
    if n > sample_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(sample_rows / n * (1 << 30))))
    # the sample is bounded by its parameter, so the texts need no shuffle
    joined = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    table = _measured(joined, "doc_id", "_quality").orderBy("doc_id", "x").toArrow()
    x = np.array(table["x"].combine_chunks().flatten(), np.float32).reshape(-1, len(FEATURES)) if table.num_rows else np.empty((0, len(FEATURES)), np.float32)
    y = np.array(table["_quality"].to_pylist(), float)
    return fit(x, (y > 0).astype(float), **params)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and the score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in X.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(model.score(features(block)))], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, score double")
