"""Language identification by prediction by partial matching (operator 1).

One byte context tree for each language holds how often each byte followed each
context of up to ``order`` bytes in the training sample. The statistics are then
frozen, and the exact code length of a text under each language is summed byte by
byte: at the longest context that the language knows, a byte seen there costs
-log2(n / (N + D)) bits, any other costs the escape -log2(D / (N + D)) and is tried
one context shorter; below order 0 every byte costs 8 bits (method C, without
exclusion). The language of the shortest code is predicted.

The trees of all languages share hash tables: a row holds the costs of one n-gram
under every language with the escapes above it already added, so most bytes take
one lookup for all languages together.

Defined results: a null text, an empty one or one without letters is ``und`` with
score 0; equal code lengths go to the first language in order of name; rows with a
null or repeated doc_id are scored like any other; rows with a null lang, text or
doc_id teach nothing; without any row to learn from everything is ``und``. Only the
columns doc_id, text and lang are read, and lang only while training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

UND = "und"
#: Bounds of the training sample: documents of a language that are expected in it, the
#: bytes of one of them, and languages.
SAMPLE_DOCS, SAMPLE_BYTES, MAX_LANGUAGES = 400, 1 << 18, 256
U64 = np.uint64
_PAD = 0x0A
_EMPTY = U64(2**64 - 1)


class HashIndex:
    """Row numbers of distinct 64-bit keys, looked up many at a time (open addressing)."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))) + 1)
        self.slots = np.full(1 << self.bits, _EMPTY)
        self.rows = np.zeros(1 << self.bits, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int64), self._home(keys)
        while len(todo):
            free = self.slots[at] == _EMPTY
            here, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[here], self.rows[here] = keys[todo[won]], todo[won]
            lost = np.ones(len(todo), bool)
            lost[won] = False
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._home(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.rows[at], -1)
        todo = np.flatnonzero((got != keys) & (got != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            got = self.slots[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.rows[at[todo[hit]]]
            todo = todo[~hit & (got != _EMPTY)]
        return out


def contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as a number; line feeds stand before a text."""
    inside = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = data.astype(np.uint64)
    for j in range(1, order + 1):
        back = np.full(len(data), _PAD, np.uint8)
        back[j:] = data[: len(data) - j]
        back[inside < j] = _PAD
        key |= back.astype(np.uint64) << U64(8 * j)
    return key


class Model:
    """Frozen statistics of all languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 4):
        if not 0 <= order <= 6:
            raise ValueError("order must be from 0 to 6")
        self.order, self.langs = order, sorted(samples)
        grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            texts = samples[lang]
            data = np.frombuffer(b"".join(texts), np.uint8)
            key = contexts(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64), order)
            grams.append([np.unique(key & U64(256 ** (k + 1) - 1), return_counts=True) for k in range(order + 1)])
        self.gram, self.cost, self.ctx, self.escape = [], [], [], []
        below_keys, below = None, None
        for k in range(order + 1):
            each = [g[k] for g in grams]
            keys = np.unique(np.concatenate([x for x, _ in each])) if each else np.empty(0, np.uint64)
            heads = np.unique(keys >> U64(8))
            cost = np.full((len(keys), len(each)), 8.0)
            if k:
                cost[:] = below[np.searchsorted(below_keys, keys & U64(256**k - 1))]
            escape = np.zeros((len(heads), len(each)))
            for l, (own, n) in enumerate(each):
                head, start, kinds = np.unique(own >> U64(8), return_index=True, return_counts=True)
                if not len(own):
                    continue
                mass = np.add.reduceat(n, start) + kinds
                escape[np.searchsorted(heads, head), l] = -np.log2(kinds / mass)
                cost[:, l] += escape[np.searchsorted(heads, keys >> U64(8)), l]
                cost[np.searchsorted(keys, own), l] = -np.log2(n / np.repeat(mass, kinds))
            self.gram.append(HashIndex(keys))
            self.cost.append(cost.astype(np.float32))
            self.ctx.append(HashIndex(heads))
            self.escape.append(escape.astype(np.float32))
            below_keys, below = keys, cost

    def bits(self, block: X.Block) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(block), len(self.langs)))
        if not len(block.data):
            return out
        key = contexts(block.data, block.offsets, self.order)
        cost = np.zeros((len(key), len(self.langs)), np.float32)
        todo = np.arange(len(key))
        for k in range(self.order, -1, -1):
            own = key[todo] & U64(256 ** (k + 1) - 1)
            row = self.gram[k].find(own)
            hit = row >= 0
            cost[todo[hit]] += self.cost[k][row[hit]]
            todo, own = todo[~hit], own[~hit]
            head = self.ctx[k].find(own >> U64(8))
            known = head >= 0
            cost[todo[known]] += self.escape[k][head[known]]
        cost[todo] += 8
        full = np.flatnonzero(np.diff(block.offsets))
        out[full] = np.add.reduceat(cost, block.offsets[full], axis=0, dtype=np.float64)
        return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = 4) -> Model:
    """A model of the rows' (doc_id, text, lang).

    About ``sample_docs`` documents of each language are learnt, chosen by a hash of
    doc_id over all of the table; texts of more than SAMPLE_BYTES bytes are not.
    """
    rows = rows.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and octet_length(text) > 0")
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model({}, order)
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("lang", "doc_id", "text")
    samples: dict[str, list[bytes]] = {}
    for r in picked.select("lang", "text").toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return Model(samples, order)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score and bits_per_byte of every text, beside the columns of ``keep``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, bits_per_byte double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UND], object)
        for batch in batches:
            for block in X.blocks(batch.column(len(keep))):
                n = len(block)
                pred, score, each = np.full(n, len(model.langs)), np.zeros(n), np.full(n, 8.0)
                if model.langs:
                    bits = model.bits(block)
                    best = bits.argmin(axis=1)
                    gap = (bits - bits[np.arange(n), best][:, None]) * np.log(2)
                    ok = np.array([has_letter(block.text(i)) for i in range(n)], bool)
                    pred, score = np.where(ok, best, pred), np.where(ok, 1 / np.exp(-gap).sum(axis=1), 0.0)
                    size = np.maximum(np.diff(block.offsets), 1)
                    each = np.where(ok, bits[np.arange(n), best] / size, each)
                kept = [batch.column(i).slice(block.first, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[pred], pa.string()), pa.array(score), pa.array(each)], names=[*keep, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)
