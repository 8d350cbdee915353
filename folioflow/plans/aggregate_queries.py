"""Counts, rates and summaries. ``value`` is the latency, ``error`` events are failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions.text import count_tokens, file_extension, file_name
from folioflow.operators import aggregates as agg
from folioflow.operators import evaluation, sketches
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import chunks, documents, log, pairs, r6, texts
from folioflow.plans.registry import query
from folioflow.session import scratch_path, table

_K = "json_extract(props, '$.k')::BIGINT"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query(
    "count_by_source",
    "SELECT source, count(*) AS documents FROM documents GROUP BY 1 ORDER BY 2 DESC, 1",
)
def count_by_source(spark, folder):
    return agg.count_by_source(documents(spark, folder))


@query(
    "source_totals",
    """SELECT count(*) AS total_documents, count(DISTINCT source) AS unique_source,
         count(DISTINCT lang) AS unique_lang FROM documents""",
)
def source_totals(spark, folder):
    return agg.source_totals(documents(spark, folder), ["source", "lang"])


@query(
    "count_by_type",
    r"""SELECT lower(regexp_extract(string_split(url, '/')[-1], '^\.*[^.].*(\.[^.]*)$', 1)) AS file_type,
          count(*) AS files FROM pages GROUP BY 1""",
)
def count_by_type(spark, folder):
    return agg.count_by_type(table(spark, folder, "pages"), file_extension(file_name("url")))


@query(
    "collection_stats",
    """SELECT source AS collection, count(*) AS documents, sum(length(text))::BIGINT AS characters,
         round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY 1""",
)
def collection_stats(spark, folder):
    return agg.collection_stats(documents(spark, folder).withColumnRenamed("source", "collection"))


@query(
    "success_rate",
    """SELECT user_id, count(*) AS total_queries, count(*) FILTER (event_type <> 'error') AS successful_queries,
         round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate,
         round(100 - 100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 6) AS error_rate
       FROM events GROUP BY 1""",
)
def success_rate(spark, folder):
    out = agg.success_rate(log(spark, folder), F.col("event_type") != "error", ["user_id"])
    return out.withColumns({c: r6(c) for c in ("success_rate", "error_rate")})


@query(
    "latency_stats",
    """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
         round(coalesce(stddev_samp(value), 0), 6) AS std_dev, min(value) AS min, max(value) AS max
       FROM events GROUP BY 1""",
)
def latency_stats(spark, folder):
    out = agg.latency_stats(log(spark, folder), "value", ["event_type"])
    return out.withColumns({c: r6(c) for c in ("mean", "median", "std_dev")})


@query(
    "merged_summaries",
    """SELECT event_type, count(*) AS rows, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std_dev,
         min(value) AS min, max(value) AS max FROM events GROUP BY 1""",
)
def merged_summaries(spark, folder):
    """Two increments stored as daily summaries, one of them twice, and merged on read."""
    path, events = scratch_path(spark, "summaries"), log(spark, folder)
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for number in (0, 1, 0):
        sketches.add_increment(events.filter(half == number), path, number, "ts", ["event_type"], "value", "user_id")
    out = sketches.merged(sketches.read_summaries(spark, path), ["event_type"])
    rounded = {c: r6(c) for c in ("mean", "std_dev")}
    return out.withColumns(rounded).select("event_type", "rows", "mean", "std_dev", "min", "max")


@query(
    "hit_rate",
    """SELECT event_type, count(*) FILTER (value < 50) AS cache_hits, count(*) FILTER (NOT value < 50) AS cache_misses,
         round(count(*) FILTER (value < 50)::DOUBLE / count(*), 6) AS hit_rate FROM events GROUP BY 1""",
)
def hit_rate(spark, folder):
    out = agg.hit_rate(log(spark, folder), F.col("value") < 50, ["event_type"])
    return out.withColumn("hit_rate", r6("hit_rate"))


@query(
    "benchmark_rows",
    f"""SELECT event_id, value AS latency, round(CASE WHEN value > 0 THEN 1.0::DOUBLE / value ELSE 0 END, 6) AS throughput,
          round(s, 6) AS success_rate, round(100 - s, 6) AS error_rate, round(h, 6) AS cache_hit_rate, t AS token_usage
        FROM events, (SELECT 100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*) AS s,
          100.0::DOUBLE * count(*) FILTER (value < 50) / count(*) AS h, sum({_K})::BIGINT AS t FROM events)""",
)
def benchmark_rows(spark, folder):
    out = agg.benchmark_rows(
        log(spark, folder), "value", F.col("event_type") != "error", F.col("value") < 50, _k()
    )
    return out.select(
        "event_id", F.col("value").alias("latency"), r6("throughput").alias("throughput"),
        r6("success_rate").alias("success_rate"), r6("error_rate").alias("error_rate"),
        r6("cache_hit_rate").alias("cache_hit_rate"), "token_usage",
    )


_R = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(
    "mean_scores",
    f"""WITH {q.ANSWERS} SELECT round(avg(len({_R.format("answer")})), 6) AS answer_tokens,
          round(avg(len({_R.format("question")})), 6) AS question_tokens FROM answers""",
)
def mean_scores(spark, folder):
    sized = pairs(spark, folder).select(
        F.size(evaluation.rouge_tokens("candidate")).alias("answer_tokens"),
        F.size(evaluation.rouge_tokens("reference")).alias("question_tokens"),
    )
    out = agg.mean_scores(sized, ["answer_tokens", "question_tokens"])
    return out.select(r6("answer_tokens").alias("answer_tokens"), r6("question_tokens").alias("question_tokens"))


@query(
    "citation_stats",
    """SELECT 'source' AS field, source AS value, count(*) AS citations, any_value(t) AS total_citations,
         round(any_value(m), 6) AS average_length
       FROM documents, (SELECT count(*) AS t, avg(length(text)) AS m FROM documents) GROUP BY 2
       UNION ALL
       SELECT 'lang', lang, count(*), any_value(t), round(any_value(m), 6)
       FROM documents, (SELECT count(*) AS t, avg(length(text)) AS m FROM documents) GROUP BY 2""",
)
def citation_stats(spark, folder):
    docs = documents(spark, folder)
    totals = agg.citation_totals(docs)
    rows = agg.citation_distribution(docs, ["source", "lang"])
    return rows.withColumns(
        {
            "total_citations": totals.select("total_citations").scalar(),
            "average_length": r6(totals.select("average_length").scalar()),
        }
    )


@query(
    "timing_summary",
    """SELECT event_type AS operation, round(avg(value), 6) AS average_time, round(sum(value), 4) AS total_time,
         count(*) AS operations FROM events GROUP BY 1""",
)
def timing_summary(spark, folder):
    out = agg.timing_summary(log(spark, folder).withColumnRenamed("event_type", "operation"), "operation", "value")
    return out.withColumn("average_time", r6("average_time")).withColumn("total_time", F.round("total_time", 4))


@query(
    "ingest_summary",
    f"""WITH w AS (SELECT source, len({q.words('text')}) AS t, length(text) > 5000 AS failed FROM documents),
          c AS (SELECT source, failed, CASE WHEN t > 0 THEN greatest(ceil((t - 256) / 128.0)::BIGINT, 0) + 1 ELSE 0 END AS n FROM w)
        SELECT source, count(*) AS files, count(*) FILTER (NOT failed) AS processed_files,
          count(*) FILTER (failed) AS failed_files, coalesce(sum(n) FILTER (NOT failed), 0)::BIGINT AS total_chunks,
          round(coalesce(sum(n) FILTER (NOT failed), 0)::DOUBLE / nullif(count(*) FILTER (NOT failed), 0), 6) AS chunks_per_file
        FROM c GROUP BY 1""",
)
def ingest_summary(spark, folder):
    toks = count_tokens("text")
    made = F.when(toks > 0, F.greatest(F.ceil((toks - 256) / 128), F.lit(0)) + 1).otherwise(0)
    docs = texts(spark, folder).select(
        "source", made.alias("chunks"), (F.length("text") > 5000).alias("failed")
    )
    out = agg.ingest_summary(docs, F.col("failed"), "chunks", ["source"])
    return out.withColumn("chunks_per_file", r6("chunks_per_file"))


@query(
    "progress",
    """WITH s AS (SELECT epoch(ts)::BIGINT // 3600 AS step, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1),
         p AS (SELECT step, sum(n) OVER (ORDER BY step)::BIGINT AS done, sum(n) OVER ()::BIGINT AS total,
                 (step - min(step) OVER () + 1) * 3600 AS elapsed FROM s)
       SELECT step, done, total, elapsed, round(least(100.0::DOUBLE, done * 100.0::DOUBLE / total), 6) AS percent,
         round(done::DOUBLE / elapsed, 6) AS per_second, round((total - done) / (done::DOUBLE / elapsed), 4) AS seconds_left
       FROM p""",
)
def progress(spark, folder):
    out = agg.progress(log(spark, folder), "ts")
    return out.withColumns(
        {"percent": r6("percent"), "per_second": r6("per_second"), "seconds_left": F.round("seconds_left", 4)}
    )


@query(
    "token_usage",
    f"""SELECT role, count(*) AS answers, sum(len({q.words('text')}))::BIGINT AS tokens
        FROM conversations GROUP BY 1""",
)
def token_usage(spark, folder):
    return agg.token_usage(table(spark, folder, "conversations"), "text", ["role"])


@query(
    "document_metrics",
    f"""WITH {q.chunk_ctes()} SELECT source, count(DISTINCT doc_id) AS total_documents, count(*) AS total_chunks,
          round(avg(length(chunk_text)), 6) AS avg_chunk_size FROM chunks GROUP BY 1""",
)
def document_metrics(spark, folder):
    out = agg.document_metrics(chunks(spark, folder), keys=["source"])
    return out.withColumn("avg_chunk_size", r6("avg_chunk_size"))


@query(
    "compare_metrics",
    """SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after,
         coalesce(b.n, 0) - coalesce(a.n, 0) AS added
       FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) a
       FULL JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) b USING (source)""",
)
def compare_metrics(spark, folder):
    docs = documents(spark, folder)
    return agg.compare_metrics(docs.filter(F.col("lang") == "en"), docs)


@query(
    "log_summary",
    """SELECT count(*) AS total_queries, round(avg(value), 6) AS average_processing_time,
         round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 6) AS uptime_seconds FROM events""",
)
def log_summary(spark, folder):
    out = agg.log_summary(log(spark, folder), "ts", "value")
    return out.withColumns({c: r6(c) for c in ("average_processing_time", "uptime_seconds")})


@query(
    "zip_history",
    """WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position FROM events)
       SELECT position, coalesce(max(value) FILTER (event_type = 'click'), 0) AS click,
         coalesce(max(value) FILTER (event_type = 'view'), 0) AS view,
         coalesce(max(value) FILTER (event_type = 'error'), 0) AS error,
         coalesce(max(value) FILTER (event_type = 'purchase'), 0) AS purchase,
         coalesce(max(value) FILTER (event_type = 'signup'), 0) AS signup FROM p GROUP BY 1""",
)
def zip_history(spark, folder):
    kinds = ["click", "view", "error", "purchase", "signup"]
    return agg.zip_history(
        log(spark, folder), "event_type", "value", kinds, F.date_trunc("hour", "ts"), [F.asc("ts"), F.asc("event_id")]
    )
