"""Substring deduplication by level-wise doubling (operator 8).

A window of ``length`` consecutive words is removed where its word sequence also
starts in a document with a smaller doc_id. Windows are found level by level, from a
short length on that doubles until it is the full one or no candidate survives:

* At a level below the last, every window of the full length that is still a candidate
  is stood for by one of the level's shorter windows within it, that of the least hash.
  Equal windows have equal least hashes, so only these (one in about nineteen at 13
  words) are compared between documents. What occurs in one document alone goes no
  further; documents without a candidate are not read again.
* At the last level the candidates themselves are compared, by 128-bit hashes of their
  words; all but those of the least doc_id lose it.

Each level sends hashes in binary blocks. Within a block of texts equal windows are
settled before anything is sent, so a passage held by a third of all documents costs
a reducer one entry for a block. The texts are dealt by their rows' keys once; all
levels, and the cutting at the end, read this one exchange.

Defined results: a null or empty text has no words and the digest of the empty
string; a row with a null doc_id keeps its words and removes none elsewhere; rows
that repeat a doc_id remove nothing from each other. doc_id must be an integer. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._io import partitions

U64 = np.uint64
_SCHEMA = "part int, hashes binary, rows binary, at binary, ids binary, keys binary"


def _sliding(op: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """op over x[i:i+k] for each i."""
    length, part = 1, x
    while length * 2 <= k:
        part = op(part[: len(part) - length], part[length:])
        length *= 2
    return op(part[: len(x) - k + 1], part[k - length : k - length + len(x) - k + 1])


#: Words of the shortest level at least.
SHORTEST = 12


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """The levels' lengths: each is twice the one before it (or one less), the last is the length."""
    out = [length]
    while (half := (out[-1] + 1) // 2) >= max(shortest, 2) and half < out[-1]:
        out.append(half)
    return out[::-1]


class Level:
    """The windows of full length of a block of texts, and what stands for them at a level."""

    def __init__(self, block: X.Block, length: int):
        self.words, self.length = X.Words(block), length
        self.at = X.whole(self.words, length)
        self.doc = self.words.doc[self.at]

    def least(self, short: int) -> np.ndarray:
        """Of each window, the least hash of its windows of so many words."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        return _sliding(np.minimum, X.windows(self.words.hash, short), self.length - short + 1)[self.at]

    def full(self) -> np.ndarray:
        """Of each window, its 128-bit hash in two columns."""
        if not len(self.at):
            return np.empty((0, 2), np.uint64)
        return np.stack([X.windows(h, self.length)[self.at] for h in (self.words.hash, self.words.second_hash())], axis=1)


def _pack(n_out: int, h: np.ndarray, row: np.ndarray, at: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> list[tuple]:
    """A row for each part of the hash space that has entries: hashes, rows, places, and the rows' ids and keys."""
    part = ((h[:, 0] >> U64(40)) % U64(n_out)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    h, row, at, part = h[order], row[order], at[order], part[order]
    cuts = np.searchsorted(part, np.arange(n_out + 1))
    out = []
    for p in range(n_out):
        i, j = cuts[p], cuts[p + 1]
        if j > i:
            used, local = np.unique(row[i:j], return_inverse=True)
            out.append((p, h[i:j].tobytes(), local.astype(np.int32).tobytes(), at[i:j].astype(np.int32).tobytes(), ids[used].tobytes(), keys[used].tobytes()))
    return out


def _settled(row: np.ndarray, value: np.ndarray, ids: np.ndarray, keys: np.ndarray, n_out: int) -> list[tuple]:
    """Rows that need no comparison: the values found for each document row, with no hashes."""
    out = []
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order]
    cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.empty(0, np.int64)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        r = row[i]
        out.append((int(ids[r]) % n_out, None, None, np.unique(value[i:j]).tobytes(), ids[r : r + 1].tobytes(), keys[r : r + 1].tobytes()))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["part", "hashes", "rows", "at", "ids", "keys"])


def _gather(batches: Iterator[pa.RecordBatch], columns: int):
    """All entries of a part (hash, row, place; rows' ids and keys), and the settled rows."""
    h, row, at, ids, keys, settled, n = [], [], [], [], [], [], 0
    for batch in batches:
        for r in batch.to_pylist():
            if r["hashes"] is None:
                settled.append((int(np.frombuffer(r["ids"], np.int64)[0]), int(np.frombuffer(r["keys"], np.int64)[0]), r["at"]))
                continue
            h.append(np.frombuffer(r["hashes"], np.uint64).reshape(-1, columns))
            row.append(np.frombuffer(r["rows"], np.int32).astype(np.int64) + n)
            at.append(np.frombuffer(r["at"], np.int32))
            ids.append(np.frombuffer(r["ids"], np.int64))
            keys.append(np.frombuffer(r["keys"], np.int64))
            n += len(ids[-1])
    cat = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
    return np.concatenate([np.empty((0, columns), np.uint64), *h]), cat(row, np.int64), cat(at, np.int32), cat(ids, np.int64), cat(keys, np.int64), settled


_FOUND = "part int, rows binary, at binary, ids binary, keys binary"


def _deliver(n_out: int, ids: np.ndarray, keys: np.ndarray, row: np.ndarray, value: np.ndarray, settled: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Values of document rows, in a block for each part of the documents."""
    if settled:
        each = [np.frombuffer(x, value.dtype) for _, _, x in settled]
        row = np.concatenate((row, np.repeat(np.arange(len(settled)) + len(ids), [len(x) for x in each])))
        value = np.concatenate((value, *each))
        ids = np.concatenate((ids, np.array([x[0] for x in settled], np.int64)))
        keys = np.concatenate((keys, np.array([x[1] for x in settled], np.int64)))
    part = (X.mix(ids.view(np.uint64)) % U64(n_out)).astype(np.int64)[row]
    order = np.argsort(part, kind="stable")
    row, value, part = row[order], value[order], part[order]
    cuts = np.searchsorted(part, np.arange(n_out + 1))
    for p in range(n_out):
        i, j = cuts[p], cuts[p + 1]
        if j > i:
            used, local = np.unique(row[i:j], return_inverse=True)
            columns = [[p], *([x.tobytes()] for x in (local.astype(np.int32), value[i:j], ids[used], keys[used]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["part", "rows", "at", "ids", "keys"])


def _collected(found: DataFrame, dtype: type) -> DataFrame:
    """(doc_id, key, found): one row for each document that has values, with all of them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, value, ids, keys, n = [], [], [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                row.append(np.frombuffer(r["rows"], np.int32).astype(np.int64) + n)
                value.append(np.frombuffer(r["at"], dtype))
                ids.append(np.frombuffer(r["ids"], np.int64))
                keys.append(np.frombuffer(r["keys"], np.int64))
                n += len(ids[-1])
        if not row:
            return
        name, which = np.unique(np.stack((np.concatenate(ids), np.concatenate(keys)), axis=1), axis=0, return_inverse=True)
        row, value = which.ravel()[np.concatenate(row)], np.concatenate(value)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        cuts = np.searchsorted(row, np.arange(len(name) + 1))
        for i in range(0, len(name), 5_000):
            part = range(i, min(i + 5_000, len(name)))
            blobs = [np.unique(value[cuts[k] : cuts[k + 1]]).tobytes() for k in part]
            yield pa.RecordBatch.from_arrays([pa.array(name[part, 0]), pa.array(name[part, 1]), pa.array(blobs, pa.binary())], names=["doc_id", "key", "found"])

    return found.repartition(partitions(found.sparkSession), "part").mapInArrow(run, "doc_id bigint, key bigint, found binary")


def _order(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, *h.T[::-1]))


def _groups(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries by hash and then id: the least and the largest id of each entry's hash."""
    new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1)))
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.append(at[1:], len(h)) - 1
    return ids[at][group], ids[last][group]


def _below(sent: DataFrame, n_out: int) -> DataFrame:
    """(doc_id, key, found): of the hashes sent, those of each document that another document has, too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, row, _, ids, keys, settled = _gather(batches, 1)
        if len(h):
            order = _order(h, ids[row])
            h, row = h[order], row[order]
            low, high = _groups(h, ids[row])
            h, row = h[low != high], row[low != high]
        yield from _deliver(n_out, ids, keys, row, h[:, 0], settled)

    return _collected(sent.repartition(n_out, "part").mapInArrow(compare, _FOUND), np.uint64)


def _last(sent: DataFrame, n_out: int) -> DataFrame:
    """(doc_id, key, found): of the windows sent, the starts in each document of those that a smaller doc_id has, too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, row, at, ids, keys, settled = _gather(batches, 2)
        if len(h):
            order = _order(h, ids[row])
            h, row, at = h[order], row[order], at[order]
            low, _ = _groups(h, ids[row])
            lost = ids[row] > low
            row, at = row[lost], at[lost]
        yield from _deliver(n_out, ids, keys, row, at, settled)

    return _collected(sent.repartition(n_out, "part").mapInArrow(compare, _FOUND), np.int32)


def _level(docs: DataFrame, before: int | None, short: int, length: int, n_out: int) -> DataFrame:
    """What is sent for docs (doc_id, key, text, and found of the level before, if there is one)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_keys = np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64)
            for block in X.blocks(batch.column(2)):
                ids, keys = (x[block.first : block.first + len(block)] for x in (all_ids, all_keys))
                level = Level(block, length)
                keep = np.ones(len(level.at), bool)
                if before is not None:
                    least = level.least(before)
                    first = np.searchsorted(level.doc, np.arange(len(block) + 1))
                    for i in range(len(block)):
                        a, b = first[i], first[i + 1]
                        if b > a:
                            kept = np.frombuffer(batch.column(3)[block.first + i].as_py(), np.uint64)
                            keep[a:b] = kept[np.minimum(np.searchsorted(kept, least[a:b]), len(kept) - 1)] == least[a:b]
                if not keep.any():
                    continue
                row, at = level.doc[keep], level.at[keep]
                if short == length:
                    h, value = level.full()[keep], (at - level.words.first[row]).astype(np.int32)
                    order = _order(h, ids[row])
                    h, row, value = h[order], row[order], value[order]
                    low, _ = _groups(h, ids[row])
                    known = ids[row] > low
                    sent = ~known
                else:
                    h = level.least(short)[keep][:, None]
                    fresh = np.ones(len(h), bool)
                    fresh[1:] = (h[1:, 0] != h[:-1, 0]) | (row[1:] != row[:-1])
                    h, row = h[fresh], row[fresh]
                    order = np.lexsort((row, ids[row], h[:, 0]))
                    h, row = h[order], row[order]
                    value = h[:, 0]
                    low, high = _groups(h, ids[row])
                    known = low != high
                    first = np.concatenate(([True], (h[1:, 0] != h[:-1, 0]) | (row[1:] != row[:-1])))
                    sent = first & (~known | (low == ids[row]))
                places = value[sent] if short == length else np.zeros(int(sent.sum()), np.int32)
                yield _batch(_pack(n_out, h[sent], row[sent], places, ids, keys) + _settled(row[known], value[known], ids, keys, n_out))

    return docs.mapInArrow(send, _SCHEMA)


def substring_dedup(docs: DataFrame, length: int = 50, with_text: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document, and with ``with_text`` the kept words."""
    if length < 2:
        raise ValueError("length must be 2 or more")
    n_out = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # keys that are never null, so that no join asks for a filter of its own and all read the same exchange
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row"), F.xxhash64("doc_id", "text").alias("key"), "text")
    dealt = docs.repartition(n_out, "row", "key")
    found, before = None, None
    for short in levels(length, shortest):
        if found is None:
            source = docs.where("doc_id is not null").select("doc_id", "key", "text")
        else:
            source = dealt.join(found.withColumnRenamed("doc_id", "row"), ["row", "key"]).select("doc_id", "key", "text", "found")
        sent = _level(source, before, short, length, n_out)
        found = _last(sent, n_out) if short == length else _below(sent, n_out)
        before = short
    lost = found.select(F.col("doc_id").alias("row"), "key", F.col("found").alias("lost"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lost = batch.column(0), batch.column(1), batch.column(2)
            n_words, n_removed, digest, kept = [], [], [], []
            for text, found in zip(texts, lost, strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if found.is_valid:
                    starts = np.frombuffer(found.as_py(), np.int32).astype(np.int64)
                    gone = X.covered(len(words), starts, length)
                    words = [words[i] for i in np.flatnonzero(~gone)]
                n_removed.append(n_words[-1] - len(words))
                left = b" ".join(words)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    joined = dealt.join(lost, ["row", "key"], "left").select("doc_id", "text", "lost")
    return joined.mapInArrow(cut, schema)
