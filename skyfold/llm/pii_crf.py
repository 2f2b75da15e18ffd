"""Personal data by a semi-Markov conditional random field (operator 10).

Zones of a text are its runs of neighbouring tokens with a digit or an at sign. A
segment is one to MOST_TOKENS tokens of a zone and at most MOST_CHARS characters, its
outer punctuation put off, and is scored as a whole for each type by features of the
span (digit counts and groups, Luhn, number ranges, the parts of an address, the word
before it). A dynamic program over the zone, bounded by the longest entity, chooses
boundaries and types together; what is no entity scores 0. The weights maximise the
conditional likelihood (forward-backward over segmentations) of

* made-up zones (``writings``): numbers and addresses of each type in many writings,
  most of which the base formats do not know, among dates, prices, versions, hexadecimal
  strings and numbers that fail their check digit, which are no entities;
* zones of a bounded sample of the corpus, chosen by hash, with the spans that the base
  formats find in them.

The formats' own spans are the base and always stay; the field adds those it finds that
overlap none of them. What is longer than MOST_TOKENS tokens or MOST_CHARS characters is
never added: such is the bounded entity of the method.

Defined results: a null text is an empty one and has no spans; rows with a null or
repeated doc_id are searched like any other; without a sample the weights are those of
the made-up zones. Only doc_id and text are read. Every text is searched whole and in
time linear in its length.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_CHARS = 8, 80
#: Documents of the training sample that are expected, chosen by a hash of doc_id, bytes of one of them, and zones; made-up zones.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_ZONES, MADE_UP = 1_500, 1 << 17, 400, 900

# The formats.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9][0-9.]*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_HINT = re.compile(r"[0-9@]")
_PUNCTUATION = ".,;:!?\"'<>[]{}="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBERS.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        at, run, begin = m.start(), [], 0
        for part in parts:
            if not part:
                run = []
            else:
                if not run:
                    begin = at
                run.append(part)
                if len(run) == 4:
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in run):
                        yield begin, at + len(part)
                    run = []
            at += len(part) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the formats' matches, in that order."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    found += [(1, a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def zones(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens (start, end) with a digit or an at sign that follow one another; an at sign alone takes its neighbours along."""
    zone, pos = [], 0
    while m := _HINT.search(text, pos):
        start, end = m.start(), m.end()
        while start > pos and text[start - 1] not in _SPACE:
            start -= 1
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        tokens = [(start, end)]
        if text[start:end].strip("()[]<>") == "@":
            before = start - 1
            while before > pos and text[before - 1] not in _SPACE:
                before -= 1
            if before >= pos and before < start - 1 and text[start - 1] == " ":
                tokens.insert(0, (before, start - 1))
            after = end + 1
            while after < len(text) and text[after] not in _SPACE:
                after += 1
            if end + 1 < after <= len(text) and text[end] == " ":
                tokens.append((end + 1, after))
        if zone and (tokens[0][0] != zone[-1][1] + 1 or text[zone[-1][1]] != " "):
            yield zone
            zone = []
        zone += tokens
        pos = tokens[-1][1]
    if zone:
        yield zone


# Words that tell what follows, by kind.
CUES = (
    frozenset("mail email e-mail courriel correo contact write".split()),
    frozenset("ip host server address addr client".split()),
    frozenset("card visa mastercard amex carte karte tarjeta cc".split()),
    frozenset("tel phone telephone call fax mobile cell telefon numéro teléfono".split()),
)
_AT = re.compile(r" ?[(\[<]?@[)\]>]? ?")
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*")
FEATURES = 36


def features(s: str, cue: str = "") -> list[float]:
    """What the field knows of a whole span and of the word before it."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, at = len(digits), s.count("@")
    letters = sum(c.isalpha() for c in s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    sizes = [len(g) for g in groups]
    plain = letters == 0 and at == 0
    ends = _AT.split(s)
    whole = len(ends) == 2 and bool(_NAME.fullmatch(ends[0])) and bool(_HOST.fullmatch(ends[1]))
    gaps = set(re.findall(r"[^0-9]+", s[1:-1]))
    quad = plain and len(groups) == 4 and len(gaps) == 1 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    word = cue.strip(_PUNCTUATION).lower()
    check = plain and 15 <= n < 20 and luhn(digits)
    return [
        1.0, at == 1, at > 1, whole, whole and "." in ends[-1], quad, quad and gaps == {"."}, quad and gaps != {"."}, plain and s[:1] == "+", "(" in s and ")" in s,
        sizes[-3:] == [3, 3, 4], sizes in ([3, 3, 4], [1, 3, 3, 4]), sizes == [2] * 5 and s[:1] == "0", sizes[-2:] == [3, 4],
        n < 7, 7 <= n < 10, 10 <= n < 12, 12 <= n < 15, 15 <= n < 16, 16 <= n < 20, n >= 20, check, check and len(groups) == 1, plain and n >= 15 and not check, plain,
        letters > 0 and at == 0, " " in s, len(gaps) > 1, len(groups) == 1, len(groups) > 5, s[:2] == "00" and len(groups) > 1, bool(set(s) - set("0123456789+-. ()@[]")) and at == 0,
        *(word in c for c in CUES),
    ]


def segments(text: str, zone: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first token, tokens, start, end) of the segments of a zone that may be entities."""
    out = []
    for i in range(len(zone)):
        for n in range(1, min(MOST_TOKENS, len(zone) - i) + 1):
            a, b = zone[i][0], zone[i + n - 1][1]
            if b - a > MOST_CHARS:
                break
            while a < b and text[a] in _PUNCTUATION:
                a += 1
            while b > a and text[b - 1] in _PUNCTUATION:
                b -= 1
            if b > a:
                out.append((i, n, a, b))
    return out


def spans_features(text: str, zone: list[tuple[int, int]], parts: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The features of the segments of a zone."""
    head = text[max(0, zone[0][0] - MOST_CHARS) : zone[0][0]].split()
    cues = [head[-1] if head else "", *(text[a:b] for a, b in zone)]
    return np.array([features(text[a:b], cues[i]) for i, _, a, b in parts], float)


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def decode(scores: np.ndarray, parts: list[tuple[int, int, int, int]], tokens: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation; of equal ones that of fewer entities."""
    best, back = [0.0] + [0.0] * tokens, [None] * (tokens + 1)
    ending: dict[int, list[int]] = {}
    for k, (i, n, _, _) in enumerate(parts):
        ending.setdefault(i + n, []).append(k)
    for j in range(1, tokens + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            kind = int(scores[k].argmax())
            if best[parts[k][0]] + scores[k, kind] > best[j]:
                best[j], back[j] = best[parts[k][0]] + scores[k, kind], (k, kind)
    out, j = [], tokens
    while j:
        if back[j] is None:
            j -= 1
        else:
            k, kind = back[j]
            out.append((kind, parts[k][2], parts[k][3]))
            j = parts[k][0]
    return out[::-1]


def prepared(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> list[tuple]:
    """Of each zone of the examples: features, segments, tokens, and the (segment, kind) that are true."""
    data = []
    for text, gold in examples:
        want = {(a, b): kind for kind, a, b in gold}
        for zone in zones(text):
            parts = segments(text, zone)
            if parts:
                data.append((spans_features(text, zone, parts), parts, len(zone), [(k, want[p[2], p[3]]) for k, p in enumerate(parts) if (p[2], p[3]) in want]))
    return data


def likelihood(w: np.ndarray, data: list[tuple], l2: float) -> tuple[float, np.ndarray]:
    """Log-likelihood of the true segmentations, less the penalty, and its gradient."""
    total, g = -0.5 * l2 * len(data) * float((w * w).sum()), -l2 * len(data) * w
    for x, parts, tokens, y in data:
        scores = x @ w.T
        top = scores.max(axis=1)
        whole = (top + np.log(np.exp(scores - top[:, None]).sum(axis=1))).tolist()
        ending, starting = [[] for _ in range(tokens + 1)], [[] for _ in range(tokens + 1)]
        for k, (i, n, _, _) in enumerate(parts):
            ending[i + n].append((i, whole[k]))
            starting[i].append((i + n, whole[k]))
        forward, backward = [0.0] * (tokens + 1), [0.0] * (tokens + 1)
        for j in range(1, tokens + 1):
            forward[j] = _logsum([forward[j - 1], *(forward[i] + v for i, v in ending[j])])
        for j in range(tokens - 1, -1, -1):
            backward[j] = _logsum([backward[j + 1], *(backward[i] + v for i, v in starting[j])])
        outside = np.array([forward[i] + backward[i + n] - forward[tokens] for i, n, _, _ in parts])
        g -= np.exp(outside[:, None] + scores).T @ x
        total -= forward[tokens]
        for k, kind in y:
            g[kind] += x[k]
            total += scores[k, kind]
    return total, g


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 80, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights (kinds, FEATURES) from texts and their spans, by ascent with a step for each weight."""
    w = np.zeros((len(KINDS), FEATURES))
    data = prepared(examples)
    if not data:
        return np.full((len(KINDS), FEATURES), -1.0)
    grad_sq = np.full_like(w, 1e-6)
    for _ in range(rounds):
        _, g = likelihood(w, data, l2)
        grad_sq += g * g
        w += rate * g / np.sqrt(grad_sq)
    return w


def _with_check_digit(r: random.Random, n: int) -> str:
    head = str(r.randint(3, 6)) + "".join(str(r.randrange(10)) for _ in range(n - 2))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _number(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randrange(10)) for _ in range(n - 1))


def _cut(digits: str, sizes: tuple[int, ...], gap: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return gap.join(out)


def _email(r: random.Random) -> str:
    name = "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) + r.choice(("", ".x", "_9", str(r.randint(1, 99))))
    host = "".join(r.choice("klmnopqrs") for _ in range(r.randint(3, 9))) + r.choice((".com", ".org", ".example.net", ".ca", "", "7"))
    return name + r.choice(("@", "@", " @ ", "[@]", "(@)", " [@] ")) + host


def _ip(r: random.Random) -> str:
    return r.choice((".", ".", "-", "[.]", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))


def _card(r: random.Random) -> str:
    n = r.choice((15, 16, 16, 16, 19))
    sizes = {15: (4, 6, 5), 16: (4, 4, 4, 4), 19: (4, 4, 4, 4, 3)}[n]
    return _cut(_with_check_digit(r, n), r.choice(((n,), sizes, sizes)), r.choice((" ", "-", ".", "  ")[:3]))


def _phone(r: random.Random) -> str:
    form = r.randrange(6)
    ten = r.choice("23456789") + _number(r, 9)
    if form == 0:
        return f"({ten[:3]}) {ten[3:6]}-{ten[6:]}"
    if form == 1:
        return _cut(ten, (3, 3, 4), r.choice("-. "))
    if form == 2:
        return _cut("0" + _number(r, 9), (2, 2, 2, 2, 2), r.choice(" -"))
    if form == 3:
        return _cut("1" + ten, (1, 3, 3, 4), r.choice("-. "))
    if form == 4:
        return "00" + _cut(_number(r, 11), (2, 2, 7), " ")
    return "+" + _cut(_number(r, 11), (1, 3, 3, 4), r.choice(" -"))


def _none(r: random.Random) -> str:
    """What is no personal datum."""
    form = r.randrange(14)
    if form < 2:  # as long as a card, without its check digit
        digits = _with_check_digit(r, 16)
        digits = digits[:-1] + str((int(digits[-1]) + r.randint(1, 9)) % 10)
        return digits if form else _cut(digits, (4, 4, 4, 4), r.choice(" -"))
    if form == 2:
        return r.choice(('"', "", "'")) + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40)))) + r.choice(('"', "", "'"))
    return (
        f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", f"{r.randint(0, 23)}:{r.randint(0, 59):02}", f"${_number(r, 1)},{_number(r, 3)}.{r.randint(10, 99)}",
        f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", f"{r.randint(1, 9)}.0.", _number(r, r.randint(1, 6)), f"978-{r.randint(0, 9)}-{_number(r, 2)}-{_number(r, 6)}-{r.randint(0, 9)}",
        f"{r.randint(1, 90)}-{r.randint(91, 300)}", _number(r, r.randint(7, 14)), "@" + "".join(r.choice("abcdefgh") for _ in range(6)),
    )[form - 3]


def writings(seed: int, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n made-up texts with their spans: a sentence with one to three numbers or addresses, some of them personal data."""
    r, out = random.Random(seed), []
    filler = "on the of and we had a was for it in by then est los der une".split()
    for _ in range(n):
        text, gold = " ".join(r.choices(filler, k=r.randint(0, 3))), []
        for _ in range(r.randint(1, 3)):
            kind = r.choice((0, 1, 2, 3, None, None))
            cue = r.choice(sorted(CUES[r.randrange(4) if kind is None else kind])) + r.choice((" ", ": ")) if r.random() < 0.3 else ""
            text += (" " if text else "") + cue
            span = (_none if kind is None else (_email, _ip, _card, _phone)[kind])(r)
            if kind is not None:
                gold.append((kind, len(text), len(text) + len(span)))
            text += span + r.choice(("", "", ".", ",", "!"))
            if r.random() < 0.7:
                text += " " + " ".join(r.choices(filler, k=r.randint(1, 3)))
        out.append((text, gold))
    return out


def examples_of(texts: list[str], most: int = SAMPLE_ZONES) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Zones of texts, up to so many and those of the least hashes, with the spans that the formats find in them."""
    seen = {}
    for text in texts:
        for zone in zones(text):
            piece = text[zone[0][0] : zone[-1][1]]
            if len(piece) <= 4 * MOST_CHARS:
                shape = re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]+", "a", piece))
                name = hashlib.sha256(piece.encode()).hexdigest()
                if (shape, name[0]) not in seen or name < seen[shape, name[0]][0]:
                    seen[shape, name[0]] = (name, piece)  # up to sixteen of one shape
    return [(piece, base_spans(piece)) for _, piece in sorted(seen.values())[:most]]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Weights learnt from made-up zones and those of about ``sample_docs`` documents with a digit."""
    rows = docs.select("doc_id", "text").where("doc_id is not null").where(F.rlike("text", F.lit("[0-9]")) & (F.octet_length("text") <= SAMPLE_BYTES))
    n = rows.count()
    if n > sample_docs:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(sample_docs / n * (1 << 30)))
    return train(writings(1, MADE_UP) + examples_of([r["text"] for r in rows.select("text").toLocalIterator()]))


def find(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the field adds; each (kind, start, end) in that order."""
    base, added = base_spans(text), []
    taken = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    for zone in zones(text):
        parts = segments(text, zone)
        if not parts:
            continue
        scores = spans_features(text, zone, parts) @ weights.T
        if scores.max() <= 0:
            continue
        for kind, a, b in decode(scores, parts, len(zone)):
            before = bisect.bisect_left(starts, b)  # base spans that begin before b
            if not before or furthest[before - 1] <= a:
                added.append((kind, a, b))
    return base, added


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def pii(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_<kind> of the base, base_sha256, spans and n_added of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hints = np.zeros(256, bool)
    hints[[*range(48, 58), 64]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for block in X.blocks(batch.column(1)):
                n = len(block)
                counts, digest, spans, more = np.zeros((4, n), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
                held = np.concatenate(([0], np.cumsum(hints[block.data])))[block.offsets]
                for i in np.flatnonzero(np.diff(held)):
                    base, added = find(block.text(i).decode(), weights)
                    for k, _, _ in base:
                        counts[k, i] += 1
                    if base:
                        digest[i] = hashlib.sha256(told(base).encode()).hexdigest()
                    spans[i], more[i] = told(base + added), len(added)
                columns = [*(pa.array(c) for c in counts), pa.array(digest), pa.array(spans), pa.array(more)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), *columns], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint")
