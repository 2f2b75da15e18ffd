"""SentencePiece encoding and decoding by streaming Viterbi (operator 4).

The vocabulary's pieces are merges with a priority each, so the path that counts is not
one of a largest sum: of two pieces that follow one another, the one path of the
vocabulary's own encoder has no merge across their boundary that would have come before
one within them. This is a matter of the two pieces alone (``Vocabulary.stays``, which
undoes their merges from the last one back), so it is the lattice's transition: the
state of a position is its last piece, one predecessor survives, and the ids are those
of the vocabulary's own encoder.

A text is read from left to right. Only a window of positions is kept, as far back as
the longest piece reaches; as soon as the back pointers of all positions that a later
piece can start from meet in one boundary, the ids before it are final and leave the
window. ``StreamingViterbi`` does so for one stream, ``Lockstep`` for many streams of
one length at once in numpy. Where no piece has a word separator after another
character, every path meets at the start of a word, so each word is a stretch of its
own; different stretches are encoded once a worker, as long as its bounded cache
holds them.

Spaces are written as U+2581 with one more in front, as the vocabulary's own encoder
does; characters without a piece, and a U+2581 of the text itself (the only case in which
ids are not those of the vocabulary's own encoder, which takes it for a space), fall back
to their UTF-8 bytes, so decoding gives the text back exactly.

Defined results: a null or empty text has no ids and is given back as an empty text;
rows with a null or repeated doc_id are encoded like any other.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from .langid import HashIndex

U64 = np.uint64
SEPARATOR, LITERAL = 0x2581, 0x110000  # of the vocabulary; a U+2581 of the text
#: Fewer streams than this of one length are read one by one, more in lockstep.
FEW = 24
#: Bytes of texts that are encoded together, and ids of stretches that are remembered at most.
ENCODE_BYTES, CACHE_IDS = 3 << 20, 2 << 20
_TOP = U64(44)
_NEVER, _FIRST = np.iinfo(np.int32).max, -1  # ranks: of no piece; of a single character


def _value(points: np.ndarray) -> np.ndarray:
    """What a code point adds to the key of a piece."""
    return X.mix((points + 1).astype(np.uint64))


def _merged(piece: str, ranks: dict[str, int]) -> tuple[str, str] | None:
    """The last merge that makes the piece of its characters, or None if the merges do not make it."""
    parts, last = list(piece), None
    while len(parts) > 1:
        best = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == _NEVER:
            return None
        last = (parts[best[1]], parts[best[1] + 1])
        parts[best[1] : best[1] + 2] = ["".join(last)]
    return last


class Vocabulary:
    """Pieces by rank of their merge (the larger the score the earlier; equal scores from the left)."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], spelled: list[bytes]):
        order = {v: r for r, v in enumerate(sorted({v for p, (_, v) in scores.items() if len(p) > 1}, reverse=True))}
        ranks = {p: order[v] for p, (_, v) in scores.items() if len(p) > 1}
        splits = {p: _merged(p, ranks) for p in ranks}
        self.pieces = {p: i for p, (i, _) in scores.items() if len(p) == 1 or splits[p]}
        self.byte_ids, self.spelled = tuple(byte_ids), tuple(spelled)
        self.longest = max(map(len, self.pieces), default=1)
        self.words_apart = not any(re.search(f"[^{chr(SEPARATOR)}]{chr(SEPARATOR)}", p) for p in self.pieces)
        # by id: rank, the parts of the last merge, length and key; a row of the index for each piece
        n = len(spelled)
        self.rank, self.left, self.right = np.full(n, _FIRST, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.length, self.key = np.ones(n, np.int64), np.zeros(n, np.uint64)
        names, self.ids = list(self.pieces), np.array(list(self.pieces.values()), np.int64)
        points = np.array([ord(c) for p in names for c in p], np.int64)
        size = np.array([len(p) for p in names], np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
        if len(names):
            self.key[self.ids] = np.add.reduceat(_value(points) * X.power(inside), at[:-1])
        self.length[self.ids] = size
        for p, i in self.pieces.items():
            if len(p) > 1:
                self.rank[i], self.left[i], self.right[i] = ranks[p], self.pieces[splits[p][0]], self.pieces[splits[p][1]]
        self.index = HashIndex(self.key[self.ids])
        self.maybe = np.zeros(1 << 20, bool)  # by the top bits of keys: whether there may be a piece
        self.maybe[self.key[self.ids] >> _TOP] = True
        self.name = uuid.uuid4().hex
        self._stays: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The vocabulary of a file of merges; a file of pieces with probabilities is refused."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, spelled = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                pieces[piece] = (i, model.get_score(i))
                spelled.append(piece.replace(chr(SEPARATOR), " ").encode())
        if any(v != int(v) for _, v in pieces.values()):
            raise ValueError("the pieces' scores are no order of merges")
        return cls(pieces, byte_ids, spelled)

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary between the pieces a and b (ids; negative: any other character)."""
        out = np.ones(len(a), bool)
        rows = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[rows], b[rows]
        until_a = until_b = np.full(len(rows), _NEVER, np.int64)  # the rank at which a piece is merged away
        while len(rows):
            key = self.key[a] + self.key[b] * X.power(self.length[a])
            may = np.flatnonzero(self.maybe[key >> _TOP])
            row = self.index.find(key[may])
            joined = np.where(row >= 0, self.rank[self.ids[row]], _NEVER)
            crossed = may[(joined < until_a[may]) & (joined <= until_b[may]) & (joined < _NEVER)]  # of equal ranks the left one comes first
            out[rows[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo = ra > rb
            go = undo | (rb > _FIRST)
            go[crossed] = False
            go = np.flatnonzero(go)
            rows, a, b, ra, rb, undo, until_a, until_b = (x[go] for x in (rows, a, b, ra, rb, undo, until_a, until_b))
            until_a, until_b = np.where(undo, ra, until_a), np.where(undo, until_b, rb)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def stays(self, a: int, b: int) -> bool:
        """``stay`` of one pair, remembered."""
        if a < 0 or b < 0:
            return True
        found = self._stays.get((a, b))
        if found is None:
            if len(self._stays) > 1 << 18:
                self._stays.clear()
            found = self._stays[a, b] = bool(self.stay(np.array([a]), np.array([b]))[0])
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_stays": {}}


class StreamingViterbi:
    """Ids of a stream of code points, given out as they become final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.base = 0  # the last boundary on which all paths have met
        self.back, self.code, self.text = [0], [-LITERAL - 2], ""
        self.widest = 0  # positions held at once at most

    def feed(self, points: list[int]) -> Iterator[int]:
        """Codes: an id, or -1 - the code point of a fallback."""
        pieces, stays, longest = self.v.pieces, self.v.stays, self.v.longest
        for p in points:
            self.text += chr(p) if p != LITERAL else "\U0010ffff"
            i = len(self.text)
            back, code = i - 1, -1 - p
            if p != LITERAL:
                for j in range(max(0, i - longest), i):
                    got = pieces.get(self.text[j:i])
                    if got is not None and stays(self.code[j], got):
                        back, code = j, got
                        break
            self.back.append(back)
            self.code.append(code)
            self.widest = max(self.widest, i)
            if i >= 2 * longest:
                yield from self._commit()

    def _commit(self) -> Iterator[int]:
        i = len(self.text)
        alive = set(range(max(0, i - self.v.longest + 1), i + 1))
        while len(alive) > 1:  # follow the furthest until all have met
            j = max(alive)
            alive.remove(j)
            alive.add(self.back[j])
        at = alive.pop()
        if at:
            yield from self._path(at)
            self.text = self.text[at:]
            self.back = [0, *(max(b - at, 0) for b in self.back[at + 1 :])]
            self.code = self.code[at:]
            self.base += at

    def _path(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.code[at])
            at = self.back[at]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._path(len(self.text))


class Lockstep:
    """The same for the rows of points (n, length) at once. Position p of the window is kept in
    column p modulo its width, which is doubled if a row's paths have not met when it is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.width = 2 * vocabulary.longest

    def run(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all rows, one after another, and how many each row has."""
        n, length = points.shape
        v, w = self.v, self.width
        value, rows = np.ascontiguousarray(_value(points).T), np.arange(n)
        self.back, self.code = np.zeros((n, w), np.int64), np.full((n, w), -1, np.int64)
        self.done = np.zeros(n, np.int64)  # the boundary before which ids are final
        out, used = np.zeros((n, length), np.int64), np.zeros(n, np.int64)
        for i in range(1, length + 1):
            far = min(i, v.longest)
            keys = np.zeros((far + 1, n), np.uint64)
            for k in range(1, far + 1):  # the key of the last k from that of the last k - 1
                keys[k] = value[i - k] + keys[k - 1] * X.R
            back, code = np.full(n, i - 1), -1 - points[:, i - 1]
            todo = np.ones(n, bool)
            for k in range(far, 0, -1):
                own = np.flatnonzero(v.maybe[keys[k] >> _TOP] & todo)
                row = v.index.find(keys[k][own])
                own, row = own[row >= 0], row[row >= 0]
                got = v.ids[row]
                if i > k:
                    fits = v.stay(self.code[own, (i - k) % w], got)
                    own, got = own[fits], got[fits]
                back[own], code[own] = i - k, got
                todo[own] = False
            self.back[:, i % w], self.code[:, i % w] = back, code
            if i < length and (i % v.longest == 0 or i - self.done.min() >= w - 1):
                self._commit(i, out, used)
                while i + 1 - self.done.min() >= w:
                    w = self._widen(i)
        self._emit(rows, np.full(n, length), out, used)
        self.width = 2 * v.longest
        order = np.arange(length)[None, :] < used[:, None]
        return out[order], used

    def _widen(self, i: int) -> int:
        w = self.width
        held = np.arange(max(0, i + 1 - w), i + 1)
        back, code = self.back[:, held % w], self.code[:, held % w]
        self.width = 2 * w
        self.back, self.code = np.zeros((len(back), 2 * w), np.int64), np.zeros((len(back), 2 * w), np.int64)
        self.back[:, held % (2 * w)], self.code[:, held % (2 * w)] = back, code
        return self.width

    def _commit(self, i: int, out: np.ndarray, used: np.ndarray) -> None:
        """Give out what all paths from the last positions have in common."""
        alive = np.maximum(np.arange(i - self.v.longest + 1, i + 1), 0)[None, :].repeat(len(out), 0)
        alive = np.maximum(alive, self.done[:, None])
        rows = np.arange(len(out))
        while len(rows):
            far = alive[rows].max(axis=1)
            back = np.maximum(self.back[rows, far % self.width], self.done[rows])
            alive[rows] = np.where(alive[rows] == far[:, None], np.where(far > self.done[rows], back, far)[:, None], alive[rows])
            rows = rows[alive[rows].min(axis=1) < alive[rows].max(axis=1)]
        self._emit(np.arange(len(out)), alive[:, 0], out, used)
        self.done = alive[:, 0].copy()

    def _emit(self, rows: np.ndarray, at: np.ndarray, out: np.ndarray, used: np.ndarray) -> None:
        """Append the codes of the path from each row's boundary to at."""
        steps, pos = [], at.copy()
        while (live := pos > self.done[rows]).any():
            code = np.where(live, self.code[rows, pos % self.width], 0)
            steps.append((live, code))
            pos = np.where(live, self.back[rows, pos % self.width], pos)
        for live, code in reversed(steps):
            out[rows[live], used[rows[live]]] = code[live]
            used[rows[live]] += 1


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.lockstep = vocabulary, Lockstep(vocabulary)
        self.flat = np.frombuffer(b"".join(vocabulary.spelled), np.uint8)
        self.spelled = np.concatenate(([0], np.cumsum([len(s) for s in vocabulary.spelled])))
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.count, self.codes = np.empty(0, np.uint64), *(np.empty(0, np.int32) for _ in range(3))

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """Remember the codes of new stretches."""
        if len(self.codes) + len(codes) > CACHE_IDS:
            self._forget()
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known)
        self.known = known[order]
        self.begin = np.concatenate((self.begin, (begin + len(self.codes)).astype(np.int32)))[order]
        self.count = np.concatenate((self.count, count.astype(np.int32)))[order]
        self.codes = np.concatenate((self.codes, codes.astype(np.int32)))

    def encode(self, block: X.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the block, and where each text's begin."""
        full = np.flatnonzero(np.diff(block.offsets))
        data = np.insert(block.data, block.offsets[full], 0x20)
        offsets = block.offsets + np.searchsorted(full, np.arange(len(block) + 1))
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(block) + 1, np.int64)
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][full]] = True
        if self.v.words_apart:
            space = data == 0x20
            begins[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        name, first, which = np.unique(X.span_hash(data, start, end), return_index=True, return_inverse=True)
        new = np.ones(len(name), bool)
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, name), len(self.known) - 1)] != name
        if new.any():
            fresh = self._distinct(data, start[first[new]], end[first[new]])
            held = len(self.codes) + len(fresh[0]) <= CACHE_IDS
            if not held:  # all that this block has, anew
                self._forget()
                new[:] = True
                fresh = self._distinct(data, start[first], end[first])
            self._learn(name[new], *fresh)
        row = np.searchsorted(self.known, name)
        begin, count = self.begin[row].astype(np.int64), self.count[row].astype(np.int64)
        n = count[which]
        at = np.concatenate(([0], np.cumsum(n)))
        flat = self.codes[np.arange(at[-1]) - np.repeat(at[:-1] - begin[which], n)].astype(np.int64)
        return self._spell_out(flat, at[np.searchsorted(start, offsets)])

    def encode_alone(self, text: bytes) -> np.ndarray:
        """Ids of one text as one stream."""
        points = [SEPARATOR, *(LITERAL if c == chr(SEPARATOR) else SEPARATOR if c == " " else ord(c) for c in text.decode())] if text else []
        stream = StreamingViterbi(self.v)
        flat = np.array([*stream.feed(points), *stream.finish()], np.int64)
        return self._spell_out(flat, np.array([0, len(flat)]))[0]

    def _distinct(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all stretches, and where each one's begin and how many it has."""
        size = end - start
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = data[inside + np.repeat(start, size)]
        points = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == SEPARATOR] = LITERAL
        points[points == 0x20] = SEPARATOR
        lead = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
        edge = np.concatenate(([0], np.cumsum(size)))
        n = np.diff(lead[edge])
        at = lead[edge[:-1]]
        begin, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        parts, total = [np.empty(0, np.int64)], 0
        order = np.argsort(n, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
            length = int(n[rows[0]])
            if len(rows) < FEW:
                each = []
                for r in rows:
                    stream = StreamingViterbi(self.v)
                    each.append(np.array([*stream.feed(points[at[r] : at[r] + length].tolist()), *stream.finish()], np.int64))
                flat, used = np.concatenate(each), np.array([len(x) for x in each])
            else:
                flat, used = self.lockstep.run(points[at[rows][:, None] + np.arange(length)])
            begin[rows], count[rows] = total + np.cumsum(used) - used, used
            parts.append(flat)
            total += len(flat)
        return np.concatenate(parts), begin, count

    def _spell_out(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fallbacks become the ids of their bytes."""
        bad = np.flatnonzero(flat < 0)
        if not len(bad):
            return flat.astype(np.int32), at
        point, which = np.unique(-1 - flat[bad], return_inverse=True)
        spelled = [[self.v.byte_ids[b] for b in chr(SEPARATOR if p == LITERAL else p).encode()] for p in point.tolist()]
        n = np.ones(len(flat), np.int64)
        n[bad] = np.array([len(s) for s in spelled])[which]
        end = np.concatenate(([0], np.cumsum(n)))
        out = np.repeat(flat, n)
        table = np.array([s + [0] * (4 - len(s)) for s in spelled])
        for k in range(4):
            has = n[bad] > k
            out[end[bad[has]] + k] = table[which[has], k]
        return out.astype(np.int32), end[at]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text's begin."""
        n = np.diff(self.spelled)[ids]
        end = np.concatenate(([0], np.cumsum(n)))
        data = self.flat[np.arange(end[-1]) - np.repeat(end[:-1] - self.spelled[ids], n)]
        edge = end[at]
        full = np.flatnonzero(np.diff(edge))
        return np.delete(data, edge[full]), edge - np.searchsorted(full, np.arange(len(edge)))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder of the vocabulary, with what it remembers from earlier tasks."""
    if vocabulary.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.name] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.name]


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, ids, n_ids and round_trip (whether decoding gives the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>, n_ids bigint, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for block in X.blocks(batch.column(len(keep)), ENCODE_BYTES):
                ids, at = encoder.encode(block)
                data, edge = encoder.decode(ids, at)
                same = np.diff(edge) == np.diff(block.offsets)
                if same.all() and len(data):
                    full = np.flatnonzero(np.diff(edge))
                    same[full] = np.bitwise_or.reduceat(data ^ block.data, edge[full]) == 0
                if not same.all():  # two stretches of one hash
                    each = [ids[at[i] : at[i + 1]] if same[i] else encoder.encode_alone(block.text(i)) for i in range(len(block))]
                    ids, at = np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))
                    data, edge = encoder.decode(ids, at)
                    same = np.array([data[edge[i] : edge[i + 1]].tobytes() == block.text(i) for i in range(len(block))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                kept = [batch.column(i).slice(block.first, len(block)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(np.diff(at)), pa.array(same)], names=[*keep, "ids", "n_ids", "round_trip"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            data, edge = encoder.decode(np.concatenate([np.empty(0, np.int64), *lists]), np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))))
            texts = [data[edge[i] : edge[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
