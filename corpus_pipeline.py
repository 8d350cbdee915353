"""From raw documents to packed training sequences: five stages over the operators of folioflow.llm.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import minhash, mixing, packing, quality, substrings
from folioflow.session import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier with its site posteriors accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8."""
    return minhash.keep_one(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document has; n_chars follows."""
    kept = substrings.without_substrings(docs, width=50)
    return kept.selectExpr(
        *("cast(char_length(text) AS bigint) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns)
    )


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, as even over sources as using no document twice allows."""
    return mixing.mixed_documents(docs, budget_share=0.9, repetition=1.0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

# A fitted classifier and a tokenizer can't be said in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in order."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
