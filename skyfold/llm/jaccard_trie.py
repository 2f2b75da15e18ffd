"""N-gram Jaccard join by prefix tries (operator 6).

A document is the set of its word shingles. Two sets link when
``100 * |x & y| >= percent * |x | y|``; the result is the connected components.

1. *Sets.* One pass gives each document's set size, a 128-bit digest of its set and a
   parity sketch. Equal sets are one from here on: the least doc_id stands for all.
2. *Meeting.* Sets that link differ in at most d shingles, d growing with their
   size, so of d + 1 + e bands into which the shingles are dealt by hash, 1 + e are
   alike in both; for a set whose partners are small e is larger (``_spare``). A second pass deals every set of a size class into the class's
   bands, once in a task however many copies the task sees, and sends (band digest,
   set) in binary blocks; sets that share a band meet. e makes up for empty bands and for
   crowded ones, which many sets share: only the few sets that have more of them than e meet there, so no
   linked pair is lost. Pairs that meet are dropped where
   parity sketches prove that they differ in more than d shingles (``Place``): a number
   of edges in proportion to the sets is kept, and none of a pair that may link is lost.
3. *Join.* Sets that meet, directly or through others, form a cluster. The text of one
   representative of each goes to its cluster's task; a cluster larger
   than a bundle is split and every two parts meet in a task of their own. There the
   sets, ordered by one global order (rarest first), are put in a trie. The trie is
   traversed with one set at a time; branches share the overlap of their common
   prefix, and a subtree is left as soon as the shingles still to come, on either
   side, cannot raise the overlap to what the percentage needs. Pairs that a chain
   of links has already connected need no test.

Work per task is bounded by the bundle, not by a group; nothing is capped or
sampled. The digests only decide who meets: links are tested on the sets.

Defined results: a null or empty text, or one of white space, has no shingles and is
alone; a text of fewer words than a shingle has one shingle, all of its words; a row
with a null doc_id has a null component; rows that repeat a doc_id are each
returned and take the least component of any of them. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._io import cut, discard, partitions
from .components import components

U64 = np.uint64
#: The most representatives, and the most shingles, of one part of a cluster.
BUNDLE_SETS, BUNDLE_SHINGLES = 1_000, 2_000_000
#: Sets that share a band are compared by sketch, each with each if they are up to so many, else by leaders, up to so many.
PLACE_PAIRS, PLACE_LEADERS = 12, 2_000
#: Copies of one set are dealt over so many keys when they learn their component.
SALTS = 32
#: A band that more sets share is crowded.
CROWD = 12
SPARSE = 1 << 40
#: Bytes of a digest that are sent (little-endian, the lowest).
SHORT = 5
#: Rows of a part that are spread out and sorted together where sets meet.
MEET_ROWS = 250_000


def shingle_sets(block: X.Block, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    words = X.Words(block, lower)
    at = X.whole(words, k)
    h, doc = X.windows(words.hash, k)[at] if len(at) else np.empty(0, np.uint64), words.doc[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):
        alone = [X.windows(words.hash[words.first[i] : words.first[i + 1]], int(words.counts[i]))[0] for i in few]
        h, doc = np.concatenate((h, np.array(alone, np.uint64))), np.concatenate((doc, few))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(block) + 1))


def _sum(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each run first[i]:first[i+1]."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(h, first[full])
    return out


def identities(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Size, two digests, and one digest of all three of each run first[i]:first[i+1]."""
    n = np.diff(first).astype(np.int64)
    d1, d2 = _sum(X.mix(h), first), _sum(X.mix(h ^ U64(0xC0FFEE)), first)
    return n, d1.view(np.int64), d2.view(np.int64), X.mix(X.mix(d1 + n.astype(np.uint64)) ^ d2).view(np.int64)


def _bands(top: np.ndarray, percent: int) -> np.ndarray:
    """Bands of classes of sets of up to top shingles."""
    d = most_apart(top, top, percent)
    return d + 1 + np.where(d > 0, 4 + d // 10, 0)


def _spare(n: np.ndarray, top: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many empty and how many crowded bands sets of n have to spare in classes of up to top shingles.

    Sets agree in all bands but as many as they differ in shingles, and a set of n can link only
    with sets near its own size; so if it has no more of both together, it shares another band
    with each of these.
    """
    spare = _bands(top, percent) - 1 - most_apart(n, np.minimum(top, n * 100 // percent), percent)
    return (spare + 1) // 2, spare // 2


def _tops(largest: int, percent: int) -> np.ndarray:
    """The largest size of each class: sets that link lie in the same class or in neighbours."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return np.array([*tops, max(tops[-1] + 1, tops[-1] * 100 // percent)], np.int64)


def band_digests(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests by which sets meet those they may link with, and the number of the set of each.

    A set is dealt in the class of its size, and in the next one as well if a set of that
    class can still link with it. Two sets that are dealt in a class differ in at most d
    shingles, so in at most d of its bands. The lowest bit of a digest says whether its set
    sends its empty bands, the next one whether the class is odd; sets meet by the others.
    """
    n = np.diff(first)
    tops = _tops(int(n.max(initial=1)), percent)
    own = np.searchsorted(tops, n)
    digests, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for step in (0, 1):
        sets = np.flatnonzero((n > 0) if step == 0 else (n > 0) & (n * 100 >= (tops[own] + 1) * percent))
        if not len(sets):
            continue
        level = own[sets] + step
        k = _bands(tops[level], percent)
        begin = np.concatenate(([0], np.cumsum(k)))
        size = n[sets]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        v = h[inside + np.repeat(first[sets], size)]
        slot = np.repeat(begin[:-1], size) + (X.mix(v ^ U64(0xA5A5A5A5)) % np.repeat(k, size).astype(np.uint64)).astype(np.int64)
        v = X.mix(v + U64(0x51ED))
        low = np.bincount(slot, (v & U64(0xFFFFFFFF)).astype(np.float64), begin[-1]).astype(np.uint64)
        high = np.bincount(slot, (v >> U64(32)).astype(np.float64), begin[-1]).astype(np.uint64)
        count = np.bincount(slot, minlength=begin[-1])
        doc = np.repeat(np.arange(len(sets)), k)
        band = (np.arange(begin[-1]) - begin[doc]).astype(np.uint64)
        digest = X.mix(X.mix(low ^ X.mix(high ^ count.astype(np.uint64))) ^ X.mix(band * U64(0x10001) + level[doc].astype(np.uint64)))
        empty = count == 0
        sparse = (np.bincount(doc, empty) > _spare(n[sets], tops[level], percent)[0])[doc]
        send = ~empty | sparse
        digest = (digest & ~U64(3)) | ((level[doc] & 1) << 1 | sparse).astype(np.uint64)
        digests.append(digest[send])
        docs.append(sets[doc[send]])
    return np.concatenate(digests), np.concatenate(docs)


def sketch(h: np.ndarray) -> bytes:
    """The parity of the set's shingles in each of a power of two of cells, about two for a shingle.

    Two sets differ in at least as many shingles as their sketches differ in cells; a sketch of
    more cells folds to one of fewer.
    """
    cells = max(64, 1 << int(2 * max(len(h), 1) - 1).bit_length())
    parity = np.bincount((X.mix(h) % U64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def most_apart(n, m, percent: int):
    """The most shingles in which sets of n and m can differ and still link."""
    return (100 - percent) * (n + m) // (100 + percent)


def fold(x: bytes, size: int) -> np.ndarray:
    """A sketch folded to so many bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)


class Place:
    """Sets that share a band, of which a few edges are kept that tie all pairs that may link.

    Up to PLACE_PAIRS sets are compared each with each. Of more, leaders are kept: a set within
    reach of the nearest leader is tied to it, any other is a leader. Distances of sketches obey
    the triangle inequality, so sets of two leaders can link only if the leaders are no further
    apart than their sets reach and a link allows; such leaders are tied. With more than
    PLACE_LEADERS leaders all sets are tied to the first. Sets must come by size of sketch.
    """

    def __init__(self, percent: int):
        self.percent, self.held, self.edges = percent, [], []
        self.ids: list[int] | None = None

    def add(self, rep: int, n: int, drawn: bytes) -> None:
        if self.ids is None:
            self.held.append((rep, n, drawn))
            if len(self.held) > PLACE_PAIRS:
                first, self.ids = self.held, []
                self.size = len(first[0][2])
                self.marks, self.sizes, self.reach = np.empty((16, self.size), np.uint8), np.empty(16, np.int64), np.zeros(16, np.int64)
                self.largest = 0
                for x in first:
                    self._lead(*x)
                self.held = first[:1]
        else:
            self._lead(rep, n, drawn)

    def _lead(self, rep: int, n: int, drawn: bytes) -> None:
        self.largest = max(self.largest, n)
        k = len(self.ids)
        if k > PLACE_LEADERS:
            self.edges.append((self.ids[0], rep))
            return
        mark = fold(drawn, self.size)
        if k:
            apart = np.bitwise_count(self.marks[:k] ^ mark).sum(axis=1, dtype=np.int64)
            best = int(apart.argmin())
            if apart[best] <= most_apart(self.sizes[best], n, self.percent):
                self.reach[best] = max(self.reach[best], apart[best])
                self.edges.append((self.ids[best], rep))
                return
        if k == len(self.marks):
            self.marks, self.sizes, self.reach = (np.concatenate((x, np.zeros_like(x))) for x in (self.marks, self.sizes, self.reach))
        self.marks[k], self.sizes[k], self.reach[k] = mark, n, 0
        self.ids.append(rep)

    def close(self) -> list[tuple[int, int]]:
        """The edges."""
        if self.ids is None:
            for i, (b, m, y) in enumerate(self.held):
                for a, n, x in self.held[:i]:
                    size = min(len(x), len(y))
                    if min(n, m) * 100 >= self.percent * max(n, m) and int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= most_apart(n, m, self.percent):
                        self.edges.append((a, b))
        elif len(self.ids) > PLACE_LEADERS:
            self.edges += [(self.ids[0], x) for x in self.ids[1:]]
        else:
            k, link = len(self.ids), most_apart(self.largest, self.largest, self.percent)
            for i in range(1, k):
                apart = np.bitwise_count(self.marks[:i] ^ self.marks[i]).sum(axis=1, dtype=np.int64)
                self.edges += [(self.ids[j], self.ids[i]) for j in np.flatnonzero(apart <= self.reach[:i] + self.reach[i] + link)]
        return self.edges


def _sizes(docs: DataFrame, k: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch.column(1)):
                h, first = shingle_sets(block, k)
                columns = identities(h, first)
                drawn = pa.array([sketch(h[first[i] : first[i + 1]]) for i in range(len(block))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), *map(pa.array, columns), drawn], names=["doc_id", "n_shingles", "d1", "d2", "set", "sketch"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, set bigint, sketch binary")


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The bytes of all rows of a binary column as one array, not copied."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind)


def _met_rows(place: np.ndarray | None, sets: np.ndarray, odd: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
    place = pa.nulls(len(sets), pa.int64()) if place is None else pa.array(place)
    return pa.RecordBatch.from_arrays([place, pa.array(sets), pa.array(odd.astype(np.int32)), pa.array(crowded)], names=["place", "set", "odd", "crowded"])


def meet(batches: Iterator[pa.RecordBatch], crowd: int, at_once: int = MEET_ROWS) -> Iterator[pa.RecordBatch]:
    """(place, set, odd, crowded) of a part's (part, digests, sets).

    The part stays as it was sent, 13 bytes a row; about so many rows at once, those of a range of digests, are
    spread out and sorted.
    """
    sent = [(_flat(batch.column(1), np.uint8).reshape(-1, SHORT), _flat(batch.column(2), np.int64)) for batch in batches if len(batch)]
    n_ranges = min(1 << 16, -(-sum(len(x) for _, x in sent) // at_once))
    # the highest bytes of what was sent tell the range: neither the part nor the two flags depend on them
    ranges = [((d[:, -1].astype(np.uint32) << 8 | d[:, -2]) * np.uint32(n_ranges) >> 16).astype(np.uint16) for d, _ in sent]
    known = np.empty(0, np.int64)
    for r in range(n_ranges):
        rows = [np.flatnonzero(x == r) for x in ranges]
        held = np.concatenate([x[i] for (_, x), i in zip(sent, rows, strict=True)])
        if not len(held):
            continue
        digest = np.zeros((len(held), 8), np.uint8)
        np.concatenate([d[i] for (d, _), i in zip(sent, rows, strict=True)], out=digest[:, :SHORT])
        digest = digest.view(np.uint64)[:, 0]
        order = np.lexsort((held, digest >> U64(1)))
        digest, held = digest[order], held[order]
        sparse, digest = (digest & U64(1)).astype(np.int64), digest >> U64(1)
        fresh = np.ones(len(digest), bool)  # tasks may have sent the same set
        fresh[1:] = (digest[1:] != digest[:-1]) | (held[1:] != held[:-1])
        digest, held, sparse = digest[fresh], held[fresh], sparse[fresh]
        at = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
        size = np.diff(np.append(at, len(held)))
        # a place is named for its sets, so that equal places are one
        name = X.mix(np.add.reduceat(X.mix(held.view(np.uint64)), at) + size.astype(np.uint64))
        odd = np.where(size > crowd, (digest[at] & U64(1)).astype(np.int64), -1)
        name = np.where(odd < 0, name, X.mix(name + odd.view(np.uint64))).view(np.int64)
        _, once = np.unique(name, return_index=True)
        once = once[size[once] > 1]
        once = once[~np.isin(name[once], known)]
        known = np.concatenate((known, name[once]))
        n = size[once]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # every crowded band counts, whether or not its place is there already
        for o in (0, 1):
            own = np.repeat(odd == o, size)
            sets, which, count = np.unique(held[own], return_inverse=True, return_counts=True)
            count += SPARSE * (np.bincount(which, sparse[own], len(sets)) > 0)
            for i in range(0, len(sets), 100_000):
                yield _met_rows(None, sets[i : i + 100_000], np.full(len(sets[i : i + 100_000]), o), count[i : i + 100_000])
        place, odd, held = np.repeat(name[once], n), np.repeat(odd[once], n), held[inside + np.repeat(at[once], n)]
        for i in range(0, len(held), 100_000):
            yield _met_rows(place[i : i + 100_000], held[i : i + 100_000], odd[i : i + 100_000], np.zeros(len(held[i : i + 100_000]), np.int64))


def _dealt(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(part, digests, sets): the bands of all sets in binary blocks, each task with one part of the digests."""
    n_out = partitions(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.int64)  # sets of this task, in order
        for batch in batches:
            for block in X.blocks(batch.column(0)):
                h, first = shingle_sets(block, k)
                own = identities(h, first)[3]
                new = np.zeros(len(own), bool)
                new[np.unique(own, return_index=True)[1]] = True
                if len(seen):
                    new &= seen[np.minimum(np.searchsorted(seen, own), len(seen) - 1)] != own
                seen = np.union1d(seen, own)
                size = np.diff(first)
                h, own = h[np.repeat(new, size)], own[new]
                first = np.concatenate(([0], np.cumsum(size[new])))
                digest, which = band_digests(h, first, percent)
                part = (digest >> U64(40)).astype(np.int64) % n_out
                order = np.lexsort((digest, part))
                digest, held, part = digest[order], own[which[order]], part[order]
                cuts = np.searchsorted(part, np.arange(n_out + 1))
                short = digest.view(np.uint8).reshape(-1, 8)[:, :SHORT]  # the part tells the rest
                rows = [(p, short[i:j].tobytes(), held[i:j].tobytes()) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "digests", "sets"])

    dealt = docs.where("doc_id is not null").select(F.col("text").alias("_text")).mapInArrow(deal, "part int, digests binary, sets binary")
    return dealt.repartitionById(n_out, "part")  # by a hash some tasks would get several parts and others none


def _meetings(docs: DataFrame, k: int, percent: int, crowd: int = CROWD) -> DataFrame:
    """(place, set, odd, crowded): sets with the same place share a band.

    odd is -1 at places of up to crowd sets. At others it tells whether their class is odd, and rows
    without a place sum up the crowded bands of a set in the odd and in the even one of its classes.
    A set that sends its empty bands has SPARSE more.
    """
    dealt = _dealt(docs, k, percent)
    met = dealt.mapInArrow(lambda batches: meet(batches, crowd), "place bigint, set bigint, odd int, crowded bigint")
    return met.groupBy("place", "set", "odd").agg(F.sum("crowded").alias("crowded"))


def _uncrowded(met: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """(place, set) of those of _meetings by which every two sets that may link still meet.

    If one of the two has no more empty and no more crowded bands than it can spare, they share a
    band that is neither; so crowded places need only the other sets. Two others agree in a crowded
    band, or else in empty ones alone, which both send.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            odd, crowded, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            tops = _tops(int(n.max()), percent)
            own = np.searchsorted(tops, n)
            spare = _spare(n, tops[own + ((own & 1) != odd)], percent)[1]
            yield batch.filter(pa.array(crowded > spare)).select(["set", "odd"])

    counts = met.where("place is null").select("set", "odd", "crowded").join(drawn.select("set", "n_shingles"), "set")
    need = counts.select("set", "odd", "crowded", "n_shingles").mapInArrow(run, "set bigint, odd int").distinct()
    met = met.where("place is not null").select("place", "set", "odd")
    return met.where("odd < 0").unionByName(met.where("odd >= 0").join(need, ["set", "odd"], "left_semi")).select("place", "set")


def _likely(met: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that tie the sets of (place, rep, n_shingles, sketch) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, place, edges = None, None, []

        def out() -> pa.RecordBatch:
            got = np.unique(np.array(edges, np.int64).reshape(-1, 2), axis=0)
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            for p, rep, n, drawn in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != name:
                    if place is not None:
                        edges += place.close()
                    name, place = p, Place(percent)
                place.add(rep, n, drawn)
                if len(place.edges) + len(edges) >= 50_000:
                    edges += place.edges
                    place.edges = []
                    yield out()
        if place is not None:
            edges += place.close()
        yield out()

    met = met.repartition(partitions(met.sparkSession), "place").sortWithinPartitions("place", F.octet_length("sketch"), "rep")
    return met.mapInArrow(run, "a bigint, b bigint").distinct()


class Trie:
    """Sets in one global order (rarest shingle first, then by hash) as the leaves of a trie.

    The leaves are kept in preorder with the depth at which each leaves the path of the one
    before it; that is the whole trie, without an object for a node.
    """

    def __init__(self, sets: list[np.ndarray]):
        values, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, count))] = np.arange(len(values))
        ranked = np.split(rank[where], np.cumsum([len(s) for s in sets])[:-1])
        ranked = [np.sort(s) for s in ranked]
        # big-endian bytes compare as the sequences do
        self.leaf = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        self.path = [ranked[i] for i in self.leaf]
        self.depth = [0] * len(sets)
        for p, (x, y) in enumerate(zip(self.path, self.path[1:]), 1):
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            self.depth[p] = int(differ[0]) if len(differ) else n
        self.universe = len(values)


def links(sets: list[np.ndarray], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of the non-empty sets that connect all that links connect (a spanning forest).

    side: with it only pairs of different sides count.
    """
    if len(sets) < 2:
        return []
    trie, found = Trie(sets), []
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = [len(x) for x in trie.path]
    within = np.zeros(trie.universe, bool)
    for p in range(1, len(sets)):
        x, own = trie.path[p], size[p]
        within[x] = True
        longest = own * 100 // percent
        # of a set of y shingles at least (own + y) * percent / (100 + percent) must be in x
        most_missed = longest - -(-(own + longest) * percent // (100 + percent))
        misses, common = None, 0  # misses of the path looked at last, at each depth; what the present path shares of it
        q = 0
        while q < p:
            if q:
                common = min(common, trie.depth[q])
            y, n = trie.path[q], size[q]
            if min(own, n) * 100 < percent * max(own, n) or (side is not None and side[trie.leaf[q]] == side[trie.leaf[p]]) or root(trie.leaf[q]) == root(trie.leaf[p]):
                q += 1
                continue
            if misses is None or not common:
                misses, common = np.cumsum(~within[y]), n
            else:
                misses, common = np.concatenate((misses[:common], misses[common - 1] + np.cumsum(~within[y[common:]]))), n
            overlap = n - int(misses[-1])
            if 100 * overlap >= percent * (own + n - overlap):
                found.append((trie.leaf[p], trie.leaf[q]))
                parent[root(trie.leaf[q])] = root(trie.leaf[p])
                q += 1
                continue
            # no set below the depth at which too many are missed can link
            dead = int(np.searchsorted(misses, most_missed, "right")) + 1
            q += 1
            while q < p and trie.depth[q] >= dead:
                q += 1  # leaves of the pruned subtree keep its path, so common holds
        within[x] = False
    return found


def _bundles(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within each (cluster, i, j) of texts (cluster, i, j, part, doc_id, text)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, ids, parts = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                got = links(sets, percent, parts if key[1] != key[2] else None)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in got], pa.int64()), pa.array([ids[b] for _, b in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            for block in X.blocks(batch.column(5)):
                h, first = shingle_sets(block, k)
                for i in range(len(block)):
                    *new, part, doc = keys[block.first + i]
                    if new != key:
                        yield from done()
                        key, sets, ids, parts = new, [], [], []
                    if first[i + 1] > first[i]:
                        sets.append(h[first[i] : first[i + 1]].copy())
                        ids.append(doc)
                        parts.append(part)
        yield from done()

    return texts.mapInArrow(join, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85, bundle_sets: int = BUNDLE_SETS, bundle_shingles: int = BUNDLE_SHINGLES, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    if not 70 <= percent <= 100:
        raise ValueError("percent must be from 70 to 100")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    name = ["n_shingles", "d1", "d2"]
    sizes = cut(_sizes(docs, shingle), "sets")
    filled = sizes.where("doc_id is not null and n_shingles > 0")
    group = filled.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    drawn = filled.groupBy(*name).agg(F.min("doc_id").alias("rep"), F.min("set").alias("set"), F.min("sketch").alias("sketch"))
    met = cut(_meetings(docs, shingle, percent, crowd), "met")
    meet = _uncrowded(met, drawn, percent)
    likely = cut(_likely(meet.join(drawn, "set").select("place", "rep", "n_shingles", "sketch"), percent), "likely")
    discard(met)
    rep = group.select("rep", "n_shingles").join(components(likely).withColumnRenamed("node", "rep"), "rep")
    width = rep.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total")).where("sets > 1")
    width = width.select("component", F.greatest(F.ceil(F.col("sets") / bundle_sets), F.ceil(F.col("total") / bundle_shingles)).cast("int").alias("n_parts"))
    rep = rep.join(width, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("n_parts")).cast("int"))
    texts = docs.join(rep.select(F.col("rep").alias("doc_id"), "component", "part", "n_parts").distinct(), "doc_id")
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    texts = texts.select(F.col("component").alias("cluster"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "text")
    texts = texts.repartition(partitions(docs.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")
    found = cut(_bundles(texts, shingle, percent), "links")
    discard(likely)
    # a doc_id of several sets ties them
    several = filled.groupBy("doc_id").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least <> most").select("doc_id")
    own = filled.join(several, "doc_id").select("doc_id", *name).join(group.select(*name, "rep"), name).where("doc_id <> rep")
    tied = components(found.unionByName(own.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    # what is no longer its own: copies, and the sets of components; many copies of one set are dealt over salts
    told = group.join(tied.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or component is not null")
    salts = min(SALTS, partitions(docs.sparkSession))
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    told = told.select(*name, F.coalesce("component", "rep").alias("component"), F.explode(F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(salt("rep")))).alias("salt"))
    salted = filled.select("doc_id", *name, salt("doc_id").alias("salt"))
    out = salted.join(told, [*name, "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    rest = sizes.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)
