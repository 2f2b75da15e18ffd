"""Words, lines and rolling hashes of many texts at once, in numpy.

A ``Block`` is a run of texts in Arrow's own layout (one byte buffer and
offsets), so no Python object is made for a text. Words are runs of bytes other
than space and \\x09-\\x0D, which is ``[^\\x20\\x09-\\x0D]+`` on UTF-8.

Hashes are polynomials over random 64-bit values modulo 2**64. The hash of a
longer window is put together from two shorter ones, so a window of k words
costs about log2(k) additions a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
R = U64(0x9E3779B97F4A7C15 | 5)
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | U64(1)
_VALUE_2 = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW = _powers(R, 4096)
_BLOCK = (_LOW[-1:] * _LOW[1:2])[0]


def power(e: np.ndarray) -> np.ndarray:
    """R**e for each exponent, from two small tables."""
    if e.size == 0 or (top := int(e.max())) < 4096:
        return _LOW[e]
    high = _powers(_BLOCK, top // 4096 + 1)
    return _LOW[e & 4095] * high[e >> 12]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Block:
    """Texts ``offsets[i]:offsets[i+1]`` of ``data``; a null is an empty text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def doc_of_byte(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, at


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive blocks of a column, whole texts each."""
    if not len(column):
        return
    data, at = layout(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Block(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def of_texts(texts: list[str | None]) -> Block:
    data, at = layout(pa.array(texts, pa.string()))
    return Block(data[at[0] : at[-1]], at - at[0])


class Words:
    """The words of a block: byte ranges, the document of each, and hashes."""

    def __init__(self, block: Block, lower: bool = False):
        a = _LOWER[block.data] if lower else block.data
        solid = ~_SPACE[a]
        edge = np.zeros(len(a) + 1, bool)
        edge[block.offsets] = True  # a text begins or ends here
        before = np.empty(len(a), bool)
        after = np.empty(len(a), bool)
        if len(a):
            before[0], before[1:] = True, ~solid[:-1]
            after[-1], after[:-1] = True, ~solid[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.doc = np.searchsorted(block.offsets, self.start, "right") - 1
        #: words of document i are first[i]:first[i+1]
        self.first = np.searchsorted(self.start, block.offsets)
        self.block, self._a, self._solid, self._hash = block, a, solid, None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self._a, self.start, self.end)
        return self._hash

    def second_hash(self) -> np.ndarray:
        """Hashes of the words that are independent of ``hash``."""
        return span_hash(self._a, self.start, self.end, _VALUE_2)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.concatenate(([0], np.cumsum((self.block.data & 0xC0) != 0x80)))
        return lead[self.end] - lead[self.start]


def span_hash(a: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """Hashes of the disjoint, ascending byte ranges start:end; an empty one gives a fixed value."""
    size = end - start
    full = size > 0
    out = np.zeros(len(start), np.uint64)
    if full.any():
        s, n = start[full], size[full]
        total = np.concatenate(([0], np.cumsum(n)))
        inside = np.arange(total[-1]) - np.repeat(total[:-1], n)
        v = values[a[inside + np.repeat(s, n)]] * power(inside)
        out[full] = np.add.reduceat(v, total[:-1])
    return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """hash of h[i:i+k] for each i; windows may still cross documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, length, out, done = h, 1, None, 0
    while True:
        if k & length:
            out = part if out is None else out[: len(out) - length] + part[done : done + len(out) - length] * power(np.array([done]))[0]
            done += length
        if done == k:
            return mix(out[:n] + U64(k))
        part = part[: len(part) - length] + part[length:] * power(np.array([length]))[0]
        length *= 2


def whole(words: Words, k: int) -> np.ndarray:
    """Starts i whose window of k words lies in one document."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])


def repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more in their document, and which have occurred before in it. doc ascends."""
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    same = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def covered(n: int, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of n items lie in a window of k items that begins at one of the starts."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + k, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def per_doc(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, n).astype(np.int64)
