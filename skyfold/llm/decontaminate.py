"""Benchmark decontamination over all windows of an item's length (operator 7), in DataFrame
functions alone.

1. *Hits.* A document's shingles are met with the items' by hash: a hit is a place in the
   document with a shingle of the item. Hits are dealt by document, item and stretch of the
   document: a stretch is as many starts as the item has words, and has the hits of all
   windows that begin in it, so that no group is larger than twice the item.
2. *Windows.* Every start in the document is a window, as long as the item in words. Its
   hits are at least what it shares with the item, so only windows with as many hits as the
   similarity needs are kept; all of them are found by going along the hits. Windows of one
   document and item differ in nothing but what is shared, so of a stretch those are left
   out that share less than another one of it: whose hits are fewer than another's different
   shared shingles. None of the best is lost.
3. *Verification.* The similarity of the shingles, each weighted by how often it
   occurs, is computed exactly: sum of the lesser counts over sum of the greater.

SimHash fingerprints in multi-index Hamming blocks (``simhash``, ``_filed``, ``_blocks``)
decide nothing here: the hits give every pair that can reach the similarity, and a radius
could only lose some of these.

A window begins no earlier than its document and ends no later; a document shorter than
an item is one window. An item shorter than a shingle is one shingle, all of its words.
Words are compared in lower case.

Defined results: null and empty texts and items match nothing; rows with a null doc_id
are reported with it; rows that repeat a doc_id, and items that repeat an item_id, are
reported once for each pair of ids, at the best window. Of equally similar windows those
come first in which a shared shingle is at its own place in the item, and of these the
first. Only doc_id, text, item_id are read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS, RADIUS, BITS = 6, 17, 64
#: Benchmark shingles are broadcast if they are so many at most; beyond that they are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000

_BLOCKS = [(b * BITS // BLOCKS, (b + 1) * BITS // BLOCKS) for b in range(BLOCKS)]


def words(text: Column) -> Column:
    """Lower-case words, cut at ASCII white space."""
    return F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " "), "")


def _shingles(w: Column, k: Column) -> Column:
    """The shingles of k words of the array w, in order; of fewer words none."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def _counts(shingles: Column) -> Column:
    """Distinct shingles with their weights."""
    return F.transform(F.array_distinct(shingles), lambda s: F.struct(s.alias("s"), F.size(F.filter(shingles, lambda x: x == s)).alias("c")))


def simhash(shingles: Column) -> Column:
    """Bit b is set if more than half of the shingles' hashes have it set."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    bit = lambda h, b: F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1))
    ones = F.aggregate(
        hashes,
        F.array(*[F.lit(0)] * BITS),
        lambda acc, h: F.array(*(acc[b] + bit(h, b).cast("int") for b in range(BITS))),
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.struct(F.lit(0).cast("bigint").alias("v"), ones.alias("n")),
        lambda a, b: F.struct(F.when(2 * F.element_at(a["n"], b + 1) > F.size(shingles), a["v"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(a["v"]).alias("v"), a["n"].alias("n")),
        lambda a: a["v"],
    )


def _turned(block: int, value: Column):
    return lambda mask: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(mask.cast("bigint")).alias("value"))


def _filed(fingerprint: str) -> Column:
    """Blocks of a fingerprint with every value that they take with up to RADIUS // BLOCKS bits turned."""
    turned = RADIUS // BLOCKS
    each = []
    for b, (low, high) in enumerate(_BLOCKS):
        masks = [sum(1 << i for i in chosen) for n in range(turned + 1) for chosen in itertools.combinations(range(high - low), n)]
        value = F.shiftrightunsigned(F.col(fingerprint), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        each.append(F.transform(F.array(*map(F.lit, masks)), _turned(b, value)))
    return F.flatten(F.array(*each))


def _blocks(fingerprint: str) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(fingerprint), low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value")) for b, (low, high) in enumerate(_BLOCKS)))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _kept(hits: Column, n: Column, k: Column, m: Column, first: Column, need: Column) -> Column:
    """The windows (start, aligned) of a stretch from word first on that have need hits and may be the best. hits: structs (pos, h, ats) by place."""
    last = F.greatest(F.lit(0), m - n)  # of the document's starts
    pos = lambda i: F.element_at(hits, i)["pos"]
    # starts whose first hit is the i-th, and which reach the hit that makes up the number
    low = lambda i: F.greatest(F.lit(0), first, pos(i + need - 1) - (n - k), F.when(i > 1, pos(F.greatest(i - 1, F.lit(1))) + 1))
    high = lambda i: F.least(pos(i), first + n - 1, last)
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(hits) - need + 1), lambda i: F.when(low(i) <= high(i), F.sequence(low(i), F.greatest(low(i), high(i)))).otherwise(F.array().cast("array<int>"))))
    own = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.transform(x["ats"], lambda at: F.greatest(F.lit(0), F.least(x["pos"] - at, last))))))

    def counted(aligned):
        within = lambda s: F.filter(hits, lambda x: x["pos"].between(s, s + n - k))
        return lambda s: _let(within(s), lambda x: F.struct(s.alias("start"), F.array_contains(aligned, s).alias("aligned"), F.size(x).alias("most"), F.size(F.array_distinct(F.transform(x, lambda y: y["h"]))).alias("least")))

    def best(windows):
        floor = lambda w: F.coalesce(F.array_max(F.transform(w, lambda x: x["least"])), F.lit(0))
        bounds = F.struct(floor(windows).alias("any"), floor(F.filter(windows, lambda x: x["aligned"])).alias("own"))
        chosen = _let(bounds, lambda b: F.filter(windows, lambda x: (x["most"] >= b["any"]) & (x["aligned"] | (x["most"] > b["own"]))))
        return F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["aligned"].alias("aligned")))

    return _let(_let(own, lambda aligned: F.transform(starts, counted(aligned))), best)


def contamination(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, start_word, n_shared, n_union) of each pair of similarity n_shared / n_union >= percent / 100."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("n", F.size("w")).withColumn("k", F.least("n", F.lit(shingle)))
    items = items.withColumn("item_row", F.xxhash64("item_id", "w"))
    placed = items.select("item_row", "n", "k", F.posexplode(_shingles(F.col("w"), F.col("k"))).alias("at", "shingle"))
    placed = placed.groupBy("item_row", "n", "k", F.xxhash64("shingle").alias("h")).agg(F.collect_set("at").alias("ats"))
    widths = sorted(r["k"] for r in placed.select("k").distinct().collect())
    few = placed.count() <= broadcast_shingles
    source = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("row", F.xxhash64("doc_id", "w"))
    found = None
    for k in widths:
        # a row a word; the shingle is put together from the array beside it
        row = source.where(F.size("w") >= k).select("doc_id", "row", "w", F.posexplode("w").alias("pos", "word")).where(F.col("pos") <= F.size("w") - k)
        text = F.concat_ws(" ", "word", *(F.element_at("w", F.col("pos") + 1 + i) for i in range(1, k)))
        seed = placed.where(F.col("k") == k)
        # a join by shuffle takes no words along: the windows' words are looked up after it
        row = row.withColumn("h", F.xxhash64(text)).withColumn("m", F.size("w"))
        hit = row.join(F.broadcast(seed), "h") if few else row.drop("w", "word").join(seed, "h")
        stretch = F.floor(F.col("pos") / F.col("n")).cast("int")
        hit = hit.withColumn("stretch", F.explode(F.when(stretch > 0, F.array(stretch - 1, stretch)).otherwise(F.array(stretch))))
        seg = F.slice("w", F.col("stretch") * F.col("n") + 1, 2 * F.col("n")) if few else F.lit(None).cast("array<string>")
        part = hit.select("doc_id", "row", "item_row", "stretch", "n", "k", "m", F.struct("pos", "h", "ats").alias("hit"), seg.alias("seg"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select("doc_id").crossJoin(benchmark.select("item_id")).where("false").select("doc_id", "item_id", F.lit(0).alias("start_word"), F.lit(0).cast("bigint").alias("n_shared"), F.lit(0).cast("bigint").alias("n_union"))
    # shared >= percent / 100 of the union means so many of the shingles of both
    both = F.least("m", "n") + F.col("n") - 2 * F.col("k") + 2
    need = F.greatest(F.lit(1), F.floor((both * percent + 99 + percent) / (100 + percent)).cast("int"))
    groups = found.groupBy("row", "item_row", "stretch", "n", "k", "m").agg(F.first("doc_id").alias("doc_id"), F.first("seg").alias("seg"), F.collect_set("hit").alias("hits"))
    groups = groups.withColumn("need", need).where(F.size("hits") >= F.col("need"))
    if not few:
        seg = F.slice("w", F.col("stretch") * F.col("n") + 1, 2 * F.col("n"))
        groups = groups.drop("seg").join(source.select("row", "w").dropDuplicates(["row"]), "row").withColumn("seg", seg).drop("w")
    first = F.col("stretch") * F.col("n")
    kept = _let(F.array_sort("hits"), lambda hits: _kept(hits, F.col("n"), F.col("k"), F.col("m"), first, F.col("need")))
    windows = groups.select("doc_id", "item_row", "n", "k", "seg", first.alias("first"), F.inline(kept))
    windows = windows.withColumn("sh", _shingles(F.slice("seg", F.col("start") - F.col("first") + 1, F.col("n")), F.col("k")))
    filed = items.select("item_row", "item_id", _shingles(F.col("w"), F.col("k")).alias("item_sh"))
    near = windows.select("doc_id", "item_row", "start", "aligned", "sh").join(filed, "item_row")
    other = _counts(F.col("item_sh"))
    shared = F.aggregate(
        _counts(F.col("sh")),
        F.lit(0).cast("bigint"),
        lambda a, x: a + F.aggregate(F.filter(F.col("_other"), lambda y: y["s"] == x["s"]), F.lit(0).cast("bigint"), lambda b, y: b + F.least(x["c"], y["c"])),
    )
    scored = near.withColumn("_other", other).withColumn("n_shared", shared).withColumn("n_union", F.size("sh") + F.size("item_sh") - F.col("n_shared"))
    scored = scored.where(F.col("n_shared") * 100 >= F.col("n_union") * percent)
    best = F.max_by(F.struct("n_shared", "n_union", "start"), F.struct((F.col("n_shared") / F.col("n_union")).alias("r"), "aligned", (-F.col("start")).alias("s"))).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.start").alias("start_word"), "b.n_shared", F.col("b.n_union").cast("bigint").alias("n_union"))
