"""Counts, rates and summaries over documents, chunks and query logs.

All of them aggregate before the shuffle. Rates over nothing are 0, not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import count_tokens
from folioflow.operators.scale import bucketed_ordinal, exact_median, join_same


def rate(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole`` with 0 for an empty whole."""
    return F.when(whole > 0, part / whole * scale).otherwise(F.lit(0.0))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def count_by_source(df: DataFrame, source: str = "source") -> DataFrame:
    name = F.coalesce(source, F.lit("Unknown")).alias("source")
    return df.groupBy(name).agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "source")


def source_totals(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count("*").alias("total_documents"),
        *[distinct(F.col(c)).alias(f"unique_{c}") for c in columns],
    )


def count_by_type(df: DataFrame, file_type: Column) -> DataFrame:
    return df.groupBy(file_type.alias("file_type")).agg(F.count("*").alias("files"))


def collection_stats(df: DataFrame, collection: str = "collection", text: str = "text") -> DataFrame:
    return df.groupBy(collection).agg(
        F.count("*").alias("documents"),
        F.sum(F.length(text)).alias("characters"),
        F.round(F.avg(F.length(text)), 6).alias("mean_length"),
    )


def success_rate(log: DataFrame, ok: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Success and error rate in percent."""
    total, good = F.count("*"), F.count_if(ok)
    return log.groupBy(*keys).agg(
        total.alias("total_queries"),
        good.alias("successful_queries"),
        rate(good, total, 100.0).alias("success_rate"),
        F.when(total > 0, 100 - rate(good, total, 100.0)).otherwise(F.lit(0.0)).alias("error_rate"),
    )


def latency_stats(
    log: DataFrame, latency: str, keys: Sequence[str], approximate: bool = False
) -> DataFrame:
    """Mean, median, standard deviation (0 for one row), minimum and maximum."""
    basics = [
        F.avg(latency).alias("mean"),
        F.coalesce(F.stddev_samp(latency), F.lit(0.0)).alias("std_dev"),
        F.min(latency).alias("min"),
        F.max(latency).alias("max"),
    ]
    if approximate:
        return log.groupBy(*keys).agg(*basics, F.percentile_approx(latency, 0.5).alias("median"))
    medians = exact_median(log, keys, latency, "median")
    return join_same(log.groupBy(*keys).agg(*basics), medians, list(keys), "left")


def hit_rate(log: DataFrame, hit: Column, keys: Sequence[str] = ()) -> DataFrame:
    hits, total = F.count_if(hit), F.count("*")
    return log.groupBy(*keys).agg(
        hits.alias("cache_hits"),
        (total - hits).alias("cache_misses"),
        rate(hits, total).alias("hit_rate"),
    )


def benchmark_rows(log: DataFrame, latency: str, ok: Column, hit: Column, tokens: Column) -> DataFrame:
    """Per-record throughput next to the log's overall rates (one-row sub-queries)."""
    total = F.count("*")
    totals = {
        "success_rate": rate(F.count_if(ok), total, 100.0),
        "cache_hit_rate": rate(F.count_if(hit), total, 100.0),
        "token_usage": F.coalesce(F.sum(tokens), F.lit(0)),
    }
    out = log.withColumn("throughput", F.when(F.col(latency) > 0, 1.0 / F.col(latency)).otherwise(F.lit(0.0)))
    for name, value in totals.items():
        out = out.withColumn(name, log.agg(value.alias(name)).scalar())
    return out.withColumn("error_rate", 100 - F.col("success_rate"))


def mean_scores(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[_zero(F.avg(c)).alias(c) for c in columns])


def citation_totals(citations: DataFrame, text: str = "text") -> DataFrame:
    return citations.agg(
        F.count("*").alias("total_citations"),
        _zero(F.avg(F.length(text))).alias("average_length"),
    )


def citation_distribution(citations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (field, value, citations) for every value of the given fields, in one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    return (
        citations.select(pairs.alias("p"))
        .groupBy("p.field", "p.value")
        .agg(F.count("*").alias("citations"))
    )


def timing_summary(log: DataFrame, operation: str, seconds: str) -> DataFrame:
    return log.groupBy(operation).agg(
        F.avg(seconds).alias("average_time"),
        F.sum(seconds).alias("total_time"),
        F.count("*").alias("operations"),
    )


def ingest_summary(df: DataFrame, failed: Column, chunks: str, keys: Sequence[str] = ()) -> DataFrame:
    """Processed and failed files, chunk total, mean chunks per processed file."""
    done = F.count_if(~failed)
    made = F.coalesce(F.sum(F.when(~failed, F.col(chunks))), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("files"),
        done.alias("processed_files"),
        F.count_if(failed).alias("failed_files"),
        made.alias("total_chunks"),
        rate(made, done).alias("chunks_per_file"),
    )


def progress(log: DataFrame, ts: str, step_seconds: int = 3600) -> DataFrame:
    """State of a job at the end of each time step: percent, rate, seconds left.

    Rows are counted per step first; the running sums see one row per step.
    """
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    step = F.floor(second / step_seconds)
    steps = log.groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    run = W.orderBy("step")
    whole = W.partitionBy()
    done = F.sum("n").over(run.rowsBetween(W.unboundedPreceding, 0))
    elapsed = (F.col("step") - F.min("step").over(whole) + 1) * step_seconds
    placed = steps.select(
        "step", done.alias("done"), F.sum("n").over(whole).alias("total"), elapsed.alias("elapsed")
    )
    return placed.withColumns(
        {
            "percent": F.least(F.lit(100.0), rate(F.col("done"), F.col("total"), 100.0)),
            "per_second": rate(F.col("done"), F.col("elapsed")),
        }
    ).withColumn(
        "seconds_left",
        F.when(F.col("per_second") > 0, (F.col("total") - F.col("done")) / F.col("per_second")),
    )


def token_usage(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("answers"), F.sum(count_tokens(text)).alias("tokens")
    )


def document_metrics(chunks: DataFrame, key: str = "doc_id", keys: Sequence[str] = ()) -> DataFrame:
    return chunks.groupBy(*keys).agg(
        F.count_distinct(F.col(key)).alias("total_documents"),
        F.count("*").alias("total_chunks"),
        _zero(F.avg(F.length("chunk_text"))).alias("avg_chunk_size"),
    )


def compare_metrics(before: DataFrame, after: DataFrame, source: str = "source") -> DataFrame:
    """Documents per source before and after, and the difference."""
    a = before.groupBy(source).agg(F.count("*").alias("before"))
    b = after.groupBy(source).agg(F.count("*").alias("after"))
    zero = F.lit(0)
    return a.join(b, source, "full_outer").select(
        source,
        F.coalesce("before", zero).alias("before"),
        F.coalesce("after", zero).alias("after"),
        (F.coalesce("after", zero) - F.coalesce("before", zero)).alias("added"),
    )


def log_summary(log: DataFrame, ts: str, seconds: str) -> DataFrame:
    span = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(
        F.min(F.col(ts).cast("timestamp"))
    )
    return log.agg(
        F.count("*").alias("total_queries"),
        _zero(F.avg(seconds)).alias("average_processing_time"),
        _zero(span / 1e6).alias("uptime_seconds"),
    )


def zip_history(
    history: DataFrame, metric: str, value: str, metrics: Sequence[str], bucket: Column, order: Sequence[Column]
) -> DataFrame:
    """Score series of unequal length, aligned by position; a missing score is 0.

    Positions come from bucketed ordinals, so no series is gathered into one list.
    """
    placed = bucketed_ordinal(history, [metric], bucket, order, "position")
    return placed.groupBy("position").agg(
        *[
            F.coalesce(F.max(F.when(F.col(metric) == m, F.col(value))), F.lit(0.0)).alias(m)
            for m in metrics
        ]
    )
