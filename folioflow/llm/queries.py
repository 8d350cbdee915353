"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import (
    conversations,
    fingerprints,
    importance,
    minhash,
    mixing,
    packing,
    quality,
    repetition,
    substrings,
    token_counts,
    token_files,
    topk,
    toxicity,
)
from folioflow.session import table

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path(WORD_BPE))


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), k=5, every=50)


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), end_id=2, capacity=1024)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.7)


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), token_files.scratch_files(spark)
    token_files.write_token_files(docs, path, public_tokenizers.path(WORD_BPE), end_id=2)
    return token_files.read_documents(spark, path)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """A whole corpus' worth of tokens, as even over sources as using none more than 1.25 times allows."""
    return mixing.mix(table(spark, folder, "documents"), budget_share=1.0, repetition=1.25)


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, folder, "documents")).drop("kept_text")


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(table(spark, folder, "conversations"))


def op12_repetition_rules(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.judge(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return importance.resample(docs, target, percent=25, least_words=20)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_top_k, op3_near_duplicates, op4_best_fit, op5_toxicity,
        op6_token_files, op7_quality, op8_mixing, op9_substrings, op10_fingerprints, op11_conversation_repair,
        op12_repetition_rules, op13_importance_resampling,
    )
}
ORACLES: dict[str, str] = {}
