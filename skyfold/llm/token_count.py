"""Token counts by a separator scan (operator 2).

Token files are flat runs of two- or four-byte little-endian ids in which every
document ends with one identifier; nothing says where. A file is cut into blocks of
fixed size, and each block is searched for the identifier in numpy, on its own. A
prefix scan over the blocks' summaries (ends found, tokens before the first, tokens
after the last) then gives each block the number of documents that ended before it
and the tokens that the document running into it has had so far.

``write_token_files`` makes such files of documents. They go to the shared folder and
are renamed when complete; only those that a finished task names are ever scanned, so
a lost executor leaves nothing that counts.

Defined results: a null or empty text has no tokens; rows with a null or repeated
doc_id are counted like any other, each by its place in its file; tokens after a
file's last identifier are a document that is not ``ended``; an empty file has none.
Text that spells the identifier is ordinary text. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import new_path, partitions

#: Ids a block, and bytes after which a writer begins its next file.
BLOCK_IDS, FILE_BYTES = 1 << 20, 256 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level vocabulary file: a base64 token and its id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def write_token_files(docs: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int, folder: str, width: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text, in the order in which rows come, into files under ``folder``.

    Returns (file, n_bytes, ordinal, doc_id): the place of each row; n_bytes is the size of its file.
    """
    if max(ranks.values(), default=0) >= 256**width or end_id >= 256**width or end_id in ranks.values():
        raise ValueError("ids must fit their width, and the end must be no token")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dtype = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pattern = shared.value
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        end = np.array([end_id], dtype).tobytes()
        out, name, size, ids = None, "", 0, []

        def finish() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                store.move(f"{root}/.{name}", f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array([size] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, kind_pa)], names=["file", "n_bytes", "ordinal", "doc_id"])

        for batch in batches:
            kind_pa = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name, size, ids = f"{uuid.uuid4().hex}.bin", 0, []
                    out = store.open_output_stream(f"{root}/.{name}")
                data = np.array(encoding.encode_ordinary(text or ""), dtype).tobytes() + end
                out.write(data)
                size += len(data)
                ids.append(doc)
                if size >= file_bytes:
                    yield from finish()
                    out = None
        yield from finish()

    return docs.select("doc_id", "text").mapInArrow(run, f"file string, n_bytes bigint, ordinal bigint, doc_id {kind}")


def scan(files: DataFrame, folder: str, end_id: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the files (file, n_bytes)."""
    spark = files.sparkSession
    dtype = np.dtype(f"<u{width}")
    step = block_ids * width

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    f.seek(block * step)
                    ids = np.frombuffer(f.read(step), dtype)
                ends = np.flatnonzero(ids == end_id)
                lead = int(ends[0]) if len(ends) else len(ids)
                rest = len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids)
                inner = pa.array([(np.diff(ends) - 1).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([lead], pa.int64()), pa.array([rest], pa.int64()), inner], names=["file", "block", "n_ends", "lead", "rest", "inner"])

    blocks = files.where("n_bytes > 0").select("file", F.explode(F.sequence(F.lit(0), F.expr(f"(n_bytes - 1) div {step}"))).alias("block"))
    found = blocks.repartition(partitions(spark), "file", "block").mapInArrow(search, "file string, block bigint, n_ends bigint, lead bigint, rest bigint, inner array<bigint>")
    # the scan: what is open at a block's start is what came after the last end before it
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("run", F.coalesce(F.sum("rest").over(before), F.lit(0)))
    mark = F.last(F.when(F.col("n_ends") > 0, F.col("run")), ignorenulls=True).over(before)
    found = found.withColumn("open", F.col("run") - F.coalesce(mark, F.lit(0))).withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    ended = found.where("n_ends > 0").select("file", "first", F.posexplode(F.concat(F.array(F.col("open") + F.col("lead")), "inner")).alias("i", "n_tokens"))
    ended = ended.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = F.when(F.col("n_ends") > 0, F.col("rest")).otherwise(F.col("open") + F.col("rest"))
    loose = found.where(F.col("is_last") & (rest > 0)).select("file", (F.col("first") + F.col("n_ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(loose)


def token_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int) -> DataFrame:
    """doc_id and n_tokens of every text, read off flat token files."""
    spark: SparkSession = docs.sparkSession
    folder = new_path(spark, "tokens")
    places = new_path(spark, "places")
    write_token_files(docs, ranks, pattern, end_id, folder).write.parquet(places)
    placed = spark.read.parquet(places)
    counted = scan(placed.select("file", "n_bytes").distinct(), folder, end_id)
    # counted grows out of a few block summaries, whose size would pass for its own: it must not be broadcast
    return placed.hint("merge").join(counted.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
