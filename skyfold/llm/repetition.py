"""Quality rules by repetition coverage (operator 5).

The n-grams of a text are hashed at several lengths, each length put together from
shorter hashes, and the characters of the words that lie in an n-gram found twice
or more are measured, as are those of lines that equal an earlier line. A text
fails when such a share of its characters is larger than its limit.

Defined results: a null or empty text, or one of white space alone, has zero counts
and fails the base rule on its length; rows with a null or repeated doc_id are
measured like any other. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

# Limits published for web text (Rae et al. 2021, table A1). Words of an n-gram, and the most percent of a
# text's word characters inside n-grams found twice or more; the most percent of word characters in lines equal to an earlier one.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
#: The base rules: fewest words, most percent of words in repeated windows of three.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def coverage(words: X.Words, n: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Which words lie in an n-gram that its document holds twice or more."""
    at = X.whole(words, n)
    if not len(at):
        return np.zeros(len(words), bool)
    h = X.windows(words.hash, n) if hashes is None else hashes
    twice, _ = X.repeated(h[at], words.doc[at])
    return X.covered(len(words), at[twice], n)


def measure(block: X.Block, ngram_limits: dict[int, int], line_limit: int) -> dict[str, np.ndarray]:
    n, data = len(block), block.data
    words = X.Words(block)
    chars = words.chars()
    out = {"n_words": words.counts, "word_chars": X.per_doc(words.doc, n, chars)}
    out["n_symbols"] = X.per_doc(np.searchsorted(block.offsets, np.flatnonzero(_SYMBOL[data]), "right") - 1, n)
    # lines: their starts are the texts' starts and what follows a line feed
    feeds = np.flatnonzero(data == 0x0A)
    full = np.flatnonzero(np.diff(block.offsets))
    start = np.unique(np.concatenate((block.offsets[full], feeds + 1)))
    owner = np.searchsorted(block.offsets, start, "right") - 1
    inside = start < len(data)
    start, owner = start[inside], owner[inside]
    end = np.minimum(np.concatenate((start[1:], [len(data)])), block.offsets[owner + 1])
    end = end - (data[np.maximum(end - 1, 0)] == 0x0A) * (end > start)
    first = np.searchsorted(words.start, start)
    last = np.searchsorted(words.start, end)
    solid = last > first
    start, end, owner, first, last = (x[solid] for x in (start, end, owner, first, last))
    _, later = X.repeated(X.span_hash(data, start, end), owner)
    total = np.concatenate(([0], np.cumsum(chars)))
    line_chars = X.per_doc(owner[later], n, (total[last] - total[first])[later])
    out["n_dup_lines"] = X.per_doc(owner[later], n)
    out["n_repeat_words"] = X.per_doc(words.doc[coverage(words, 3)], n)
    failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    kept = ~failed & (100 * line_chars <= line_limit * out["word_chars"])
    out["base_failed"] = failed
    out["dup_line_chars"] = line_chars
    for k, limit in ngram_limits.items():
        inside = coverage(words, k)
        out[f"dup_{k}gram_chars"] = X.per_doc(words.doc[inside], n, chars[inside])
        kept &= 100 * out[f"dup_{k}gram_chars"] <= limit * out["word_chars"]
    return out | {"kept": kept}


def repetition(docs: DataFrame, ngram_limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> DataFrame:
    """doc_id and the measures of every text; kept is the verdict."""
    limits = dict(ngram_limits or NGRAM_LIMITS)
    names = [*BASE, "dup_line_chars", *(f"dup_{k}gram_chars" for k in limits)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch.column(1)):
                found = measure(block, limits, line_limit)
                columns = [pa.array(found[c]) for c in (*names, "base_failed", "kept")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), *columns], names=["doc_id", *names, "base_failed", "kept"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
