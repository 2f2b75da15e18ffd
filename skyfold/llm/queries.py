"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL  # noqa: F401
from . import decontaminate, jaccard_trie, langid, pii_crf, quality_gbt, repetition, secrets, sentencepiece_viterbi, substring_dedup, token_count

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: The end-of-document id, which byte_bpe_multi_50k leaves free.
END_ID = 50256
# Fixed value: the pattern by which that vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learnt from the rows outside fold 2 of 4, predicted for every text."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(4) != 2))
    out = langid.identify(docs, model)
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, counted in flat files of its ids."""
    ranks = token_count.read_ranks(f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    return token_count.token_counts(_table(spark, sf_dir, "documents"), ranks, PATTERN, END_ID)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality learnt from the labels outside fold 0 of 5, scored for every text."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_gbt.train(docs, labels.where(_fold(5) != 0))
    out = quality_gbt.score(docs, model)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back."""
    vocabulary = sentencepiece_viterbi.Vocabulary.load(f"{TOKENIZERS}/piece_bpe_32k.model")
    return sentencepiece_viterbi.encode(_table(spark, sf_dir, "documents"), vocabulary)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.jaccard_components(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shingle=5, percent=80)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), length=50)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii_crf.pii(docs, pii_crf.fit(docs))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_token_counts, op3_quality, op4_sentencepiece, op5_repetition, op6_jaccard_components, op7_decontamination, op8_substring_dedup, op9_secrets, op10_pii)
}

