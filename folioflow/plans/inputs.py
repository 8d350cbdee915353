"""Inputs the queries share, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import preprocess_query
from folioflow.operators.scale import spread
from folioflow.operators.splitting import split_tokens
from folioflow.session import table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for work that is heavy per row."""
    return spread(documents(spark, folder))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select("doc_id", "lang", "source", "text")
    return split_tokens(docs, 256, 128)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), preprocess_query("text").alias("question")
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn after them, as (query_id, question, answer)."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    given = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return asked.join(given, ["conv_id", "turn"]).select(key.alias("query_id"), "question", "answer")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return answers(spark, folder).select(
        F.col("query_id").alias("pair_id"),
        F.col("question").alias("reference"),
        F.col("answer").alias("candidate"),
    )


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of every label: the question vectors."""
    parts = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["m"]).alias("embedding")
    )


def log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)
