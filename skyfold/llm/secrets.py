"""Secret scans through a trigram inverted index (operator 9), in DataFrame functions alone.

From each rule's pattern a Boolean query over three-letter substrings is derived: what
every text that matches must hold (``trigram_query``). The index lists for each of these
trigrams the rows that hold it; the lists are intersected and united as the queries say,
by counting each row's entries, and only the rows found are searched with the pattern
itself. A rule whose pattern asks for no trigram searches every row.

The index ignores case, so it only ever finds too much. A row is listed by a 64-bit digest
of doc_id and text, so two rows that clash are both searched. Lists are never gathered:
they are rows, dealt by key.

Spans are in code points, the end exclusive. A kind's matches are leftmost and do not
overlap; those that fail the kind's own test are dropped without another try.

Defined results: a null text is an empty one and has no spans; rows with a null or
repeated doc_id are searched like any other; other columns are kept only by ``redact``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # of java.util.regex, with nothing that Python's parser does not read alike
    group: int = 0
    least: int = 0  # characters of the group
    base: bool = False


_KEYWORD = r"((?i:password|passwd|secret|token|api_?key))"
_PEM = r"[A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_GAP, _LINE = r"[\x09-\x0D\x20\\]+(?:r\\)?", "[A-Za-z0-9+/=]"  # line ends may be escaped
# A private key: to its footer if no other five hyphens come before it, or else the header and the base64 that
# follows, up to what is neither base64 nor white space: words right after it go too. (No group is repeated for each line, as
# java.util.regex recurses for it.)
_KEY = (
    rf"-----BEGIN {_PEM}(?:[^-]*(?:-{{1,4}}[^-]+){{0,64}}-----END {_PEM}"
    rf"|(?:[\x09-\x0D\x20]*[A-Z][A-Za-z-]*: [^\x0A]*\x0A){{0,8}}{_GAP}{_LINE}{{16,}}[A-Za-z0-9+/=\x09-\x0D\x20\\]*)?"
)
# The formats of the kinds, in the order in which they are listed.
RULES = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),  # of AKIA[A-Z0-9]+ those of 20 and more
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # of [0-9a-f]+ those of 24 and more
    Rule("pem", _KEY),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
)

#: Strings of a pattern's part that are spelled out at most.
MOST_STRINGS = 64

# Queries: True (anything), ("gram", g), ("and", ...), ("or", ...).


def _all(*parts):
    flat = [q for p in parts if p is not True for q in (p[1:] if p[0] == "and" else [p])]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _any(*parts):
    if True in parts or not parts:
        return True
    parts = [q for p in dict.fromkeys(parts) for q in (p[1:] if p[0] == "or" else [p])]
    asks = [frozenset(p[1:] if p[0] == "and" else [p]) for p in parts]
    # what asks for more than another alternative adds nothing
    kept = [p for i, p in enumerate(parts) if not any(asks[j] < asks[i] or (asks[j] == asks[i] and j < i) for j in range(len(parts)))]
    return kept[0] if len(kept) == 1 else ("or", *kept)


def _grams(text: str):
    return _all(*(("gram", text[i : i + 3]) for i in range(len(text) - 2)))


class _Part:
    """What a part of a pattern matches: exactly the strings, or if None anything that satisfies the
    query, beginning with one of heads and ending with one of tails."""

    def __init__(self, strings=None, query=True, heads=frozenset({""}), tails=frozenset({""})):
        if strings is not None and len(strings) > MOST_STRINGS:
            query, heads, tails, strings = _any(*map(_grams, strings)), {s[:2] for s in strings}, {s[-2:] for s in strings}, None
        self.strings = strings
        self.query = query if strings is None else _any(*map(_grams, strings))
        self.heads = frozenset(s[:2] for s in strings) if strings is not None else frozenset(heads)
        self.tails = frozenset(s[-2:] for s in strings) if strings is not None else frozenset(tails)
        if len(self.heads) > MOST_STRINGS:
            self.heads = frozenset({""})
        if len(self.tails) > MOST_STRINGS:
            self.tails = frozenset({""})

    def then(self, other: _Part) -> _Part:
        if self.strings is not None and other.strings is not None and len(self.strings) * len(other.strings) <= MOST_STRINGS:
            return _Part(frozenset(a + b for a in self.strings for b in other.strings))
        ends = self.strings if self.strings is not None else self.tails
        begins = other.strings if other.strings is not None else other.heads
        seam = True
        if len(ends) * len(begins) <= MOST_STRINGS:
            seam = _any(*(_grams(a[-2:] + b[:2]) for a in ends for b in begins))
        heads = frozenset(a + b for a in self.strings for b in begins) if self.strings is not None and len(self.strings) * len(begins) <= MOST_STRINGS else self.heads
        tails = frozenset(a + b for a in ends for b in other.strings) if other.strings is not None and len(ends) * len(other.strings) <= MOST_STRINGS else other.tails
        return _Part(None, _all(self.query, seam, other.query), {h[:2] for h in heads}, {t[-2:] for t in tails})

    def either(self, other: _Part) -> _Part:
        if self.strings is not None and other.strings is not None:
            return _Part(self.strings | other.strings)
        return _Part(None, _any(self.query, other.query), self.heads | other.heads, self.tails | other.tails)


_NOTHING, _ANY = _Part(frozenset({""})), _Part(None)


def _characters(items) -> _Part:
    found = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return _ANY
    return _Part(frozenset(found)) if len(found) <= 8 else _ANY


def _part(tree) -> _Part:
    out = _NOTHING
    for op, value in tree:
        if op is C.LITERAL:
            part = _Part(frozenset({chr(value).lower()}))
        elif op is C.IN:
            part = _characters(value)
        elif op is C.SUBPATTERN:
            part = _part(value[-1])
        elif op is C.BRANCH:
            part = _part(value[1][0])
            for x in value[1][1:]:
                part = part.either(_part(x))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            inner = _part(inner)
            if (least, most) == (0, 1):
                part = _NOTHING.either(inner)
            elif least == 0:
                part = _ANY
            else:
                part = inner
                for _ in range(min(least, 3) - 1):
                    part = part.then(inner)
                if least != most or least > 3:
                    part = part.then(_ANY)
        elif op is C.AT:
            part = _NOTHING
        else:
            part = _ANY
        out = out.then(part)
    return out


def trigram_query(pattern: str):
    """A Boolean query over lower-case trigrams that every text with a match satisfies; True if there is none."""
    return _part(_parser.parse(pattern)).query


def alternatives(query) -> list[frozenset[str]]:
    """The query as alternatives: trigrams of which a text holds all, for one alternative at least."""
    if query[0] == "gram":
        return [frozenset([query[1]])]
    parts = [alternatives(q) for q in query[1:]]
    if query[0] == "or":
        return list(dict.fromkeys(x for p in parts for x in p))
    out = [frozenset()]
    for p in parts:
        out = list(dict.fromkeys(x | y for x in out for y in p))
    return out


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The postings (gram, key): a row for each row of docs and each of the trigrams that it holds, gram its place in the list."""
    low = docs.select(row_key().alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    # explode_outer: for explode, Spark would compute the array once more to filter rows by its size
    return low.select(F.explode_outer(held).alias("gram"), "key").where("gram is not null").distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, mask): the rows that a rule's query finds; bit i of mask for rule i."""
    asked = [(i, grams) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True for grams in alternatives(q)]
    grams = sorted(set().union(*(g for _, g in asked)))
    if not grams:
        return docs.select(row_key().alias("key"), F.lit(0).cast("bigint").alias("mask")).where("false")
    postings = build_index(docs, grams)
    # the lists of an alternative's trigrams are intersected: a row is in all of them if it comes up as often as there are lists
    user = F.array(*(F.array(*(F.lit(a) for a, (_, g) in enumerate(asked) if gram in g)) for gram in grams))
    size = F.array(*(F.lit(len(g)) for _, g in asked))
    bit = F.array(*(F.lit(1 << i).cast("bigint") for i, _ in asked))
    met = postings.select(F.explode(F.element_at(user, F.col("gram") + 1)).alias("asked"), "key").groupBy("key", "asked").agg(F.count("*").alias("n"))
    met = met.where(F.col("n") == F.element_at(size, F.col("asked") + 1))
    return met.groupBy("key").agg(F.bit_or(F.element_at(bit, F.col("asked") + 1)).alias("mask"))


#: Matches, and characters, that are folded or cut together; a fold copies what it has for each, so it is taken in two levels.
FOLD, PIECE = 256, 4096
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _walk(items: Column, kind: str, step) -> tuple[Column, Column]:
    """Go along items from place 0: step(at, x) gives the next place and what it adds, an array of the kind. All that was
    added, and the last place."""
    none = F.array().cast(kind)
    grow = lambda a, x: _let(step(a["at"], x), lambda s: F.struct(s["at"].alias("at"), F.concat(a["out"], s["add"]).alias("out")))
    inner = lambda a, part: F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("out")), grow)
    outer = lambda a, part: _let(inner(a, part), lambda s: F.struct(s["at"].alias("at"), F.concat(a["out"], F.array(s["out"])).alias("out")))
    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / FOLD).cast("int")), lambda i: F.slice(x, i * FOLD + 1, FOLD))
    whole = _let(items, lambda x: F.when(F.size(x) > 0, F.aggregate(parts(x), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), outer)))
    return F.coalesce(F.flatten(whole["out"]), none), F.coalesce(whole["at"], F.lit(0))


def _rule_spans(rule: Rule, order: int, text: Column) -> Column:
    """The rule's spans as structs (start, kind's place, end), in order of place."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(matches, F.char_length)
    # between the matches lie the pieces that a split at the pattern leaves
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length) if rule.group else lengths

    def step(at: Column, x: Column) -> Column:
        span = F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("kind"), (at + x["gap"] + x["n"]).alias("end"))
        return F.struct((at + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("at"), F.when(x["tested"] >= rule.least, F.array(span)).otherwise(F.array().cast(_SPANS)).alias("add"))

    walked, _ = _walk(F.arrays_zip(gaps.alias("gap"), lengths.alias("n"), tested.alias("tested")), _SPANS, step)
    return F.when(F.rlike(text, pattern), walked).otherwise(F.array().cast(_SPANS))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and found, an array of structs (start, kind, end) for each rule."""
    source = docs.select(*dict.fromkeys((*keep, "doc_id", "text"))).withColumn("_key", row_key())
    asked = [trigram_query(r.pattern) is not True for r in rules]
    mask = candidates(docs, rules).select(F.col("key").alias("_key"), F.col("mask").alias("_mask"))
    joined = source.join(mask, "_key", "left")
    none = F.array().cast(_SPANS)
    text = F.coalesce("text", F.lit(""))
    found = [F.when(F.coalesce("_mask", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0, _rule_spans(r, i, text)).otherwise(none) if asked[i] else _rule_spans(r, i, text) for i, r in enumerate(rules)]
    return joined.select(*keep, F.array(*found).alias("found"))


def _joined(found: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    told = F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(told, ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256 and spans of every row."""
    kinds = [r.kind for r in rules]
    base = [i for i, r in enumerate(rules) if r.base]
    found = spans(docs, rules)
    counts = [F.size(F.col("found")[i]).cast("bigint").alias(f"n_{kinds[i]}") for i in base]
    digest = F.sha2(_joined(F.flatten(F.array(*(F.col("found")[i] for i in base))), kinds), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _joined(F.flatten("found"), kinds).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The columns of docs, with every span of text put out: overlapping spans become one mark. n_chars follows, if it is there."""
    columns = tuple(docs.columns)
    # the row goes along in one column, so that none of its names can clash
    found = spans(docs.select(F.struct(*columns).alias("row"), "doc_id", "text"), rules, keep=("row",))
    ordered, text = F.array_sort(F.flatten("found")), F.col("row.text")
    # the text in pieces of PIECE characters, so that cutting out a stretch does not read the text from its beginning
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def stretch(cut: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, as an array of strings."""
        one = lambda k: F.substring(F.element_at(cut, k + 1), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        return F.when(b > a, F.transform(F.sequence(first, F.greatest(first, last)), one)).otherwise(F.array().cast("array<string>"))

    def put_out(cut: Column) -> Column:
        def step(at: Column, s: Column) -> Column:
            return F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] >= at, F.concat(stretch(cut, at, s["start"]), F.array(F.lit(mark)))).otherwise(F.array().cast("array<string>")).alias("add"))

        kept, at = _walk(ordered, "array<string>", step)
        return F.array_join(F.concat(kept, stretch(cut, at, F.char_length(text))), "")

    new = F.when(F.size(ordered) > 0, _let(pieces, put_out))
    out = found.select("row", new.alias("new"))

    def value(c: str) -> Column:
        if c == "text":
            return F.coalesce("new", text)
        if c == "n_chars":
            return F.when(F.col("new").isNotNull(), F.char_length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType)
        return F.col("row")[c]

    return out.select(*(value(c).alias(c) for c in columns))
