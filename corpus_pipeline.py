"""A pipeline over documents of five of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import decontaminate, jaccard_trie, langid, queries, secrets, sentencepiece_viterbi
from skyfold.llm._io import cut

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; what is und, or likelier none than one language, goes."""
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    told = langid.identify(docs, model, keep=DOCUMENT)
    return told.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= 0.5) & (F.col("bits_per_byte") <= 8)).select(*DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the least doc_id.

    Rows of one doc_id are one document, and stay or go together. A row without doc_id is in no component and stays.
    """
    docs = docs.select(*DOCUMENT)
    found = jaccard_trie.jaccard_components(docs, shingle=5, percent=80)
    lose = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(lose, "doc_id", "left_anti").select(*DOCUMENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is a benchmark item or nearly so.

    Each row is judged by its own text: of rows that share a doc_id, or have none, only those that hold an item go.
    """
    row = F.xxhash64("doc_id", "text")
    docs = docs.select(*DOCUMENT, row.alias("_row"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs.select(F.col("_row").alias("doc_id"), "text"), benchmark, shingle=5, percent=80)
    return docs.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*DOCUMENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets put out."""
    return secrets.redact(docs.select(*DOCUMENT))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of the text."""
    vocabulary = sentencepiece_viterbi.Vocabulary.load(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    return sentencepiece_viterbi.encode(docs, vocabulary, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
