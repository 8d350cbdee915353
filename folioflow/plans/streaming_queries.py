"""Streaming forms over the given tables, read as file streams until the source is drained."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from folioflow.plans import sqltext as q
from folioflow.plans.inputs import r6
from folioflow.plans.registry import query
from folioflow.plans.window_queries import ANCHORED
from folioflow.session import ROCKSDB_PROVIDER
from folioflow.streaming import jobs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark):
    """Row-level state needs RocksDB; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _events(spark, folder):
    return jobs.event_time(jobs.stream_table(spark, folder, "events"))


def _documents(spark, folder):
    return jobs.stream_table(spark, folder, "documents").select("doc_id", "source", "text")


@query(
    "stream_chunks",
    f"WITH {q.chunk_ctes()} SELECT chunk_id, md5(chunk_text) AS chunk_hash FROM chunks",
)
def stream_chunks(spark, folder):
    out = jobs.run_to_files(jobs.stream_chunks(_documents(spark, folder)), "stream-chunks")
    return spark.read.parquet(out).select("chunk_id", F.md5("chunk_text").alias("chunk_hash"))


@query(
    "stream_upsert",
    "SELECT md5(text) AS doc_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1",
)
def stream_upsert(spark, folder):
    return jobs.run_upsert(_documents(spark, folder), "stream-upsert").select("doc_hash", "doc_id")


@query(
    "stream_metrics",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS queries, count(*) FILTER (event_type <> 'error') AS successful,
         round(count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*), 6) AS success_rate,
         round(avg(value), 6) AS mean_latency, round(count(*) FILTER (value < 50)::DOUBLE / count(*), 6) AS hit_rate
       FROM events GROUP BY 1""",
)
def stream_metrics(spark, folder):
    out = jobs.stream_metrics(
        _events(spark, folder), "value", F.col("event_type") != "error", F.col("value") < 50
    )
    rows = jobs.run_complete(out, "stream-metrics")
    return rows.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "queries", "successful",
        r6("success_rate").alias("success_rate"), r6("mean_latency").alias("mean_latency"),
        r6("hit_rate").alias("hit_rate"),
    )


@query("stream_rate_limit", ANCHORED)
def stream_rate_limit(spark, folder):
    with _rocksdb(spark):
        verdicts = jobs.stream_rate_limit(_events(spark, folder), "event_type", 1, 3)
        return spark.read.parquet(jobs.run_to_files(verdicts, "stream-limit"))


@query(
    "stream_progress",
    "SELECT 0 AS batch, count(*) AS documents, sum(length(text))::BIGINT AS characters FROM documents",
)
def stream_progress(spark, folder):
    return jobs.run_progress(_documents(spark, folder), "stream-progress")


@query(
    "sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
       SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS events
       FROM s GROUP BY user_id, n""",
)
def sessions(spark, folder):
    rows = jobs.run_complete(jobs.sessions(_events(spark, folder), "user_id"), "sessions")
    return rows.select(
        "user_id",
        F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"),
        "events",
    )


@query(
    "lockout",
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(m) AS window_start
           FROM events, (VALUES (0), (5), (10)) v(m) WHERE event_type = 'error')
       SELECT event_type, window_start, count(*) AS failures FROM w GROUP BY ALL HAVING count(*) >= 2""",
)
def lockout(spark, folder):
    out = jobs.lockout(_events(spark, folder), "event_type", F.col("event_type") == "error", limit=2)
    rows = jobs.run_complete(out, "lockout")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_last_n",
    """SELECT event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100""",
)
def stream_last_n(spark, folder):
    rows = jobs.run_last_n(
        _events(spark, folder), "stream-history", 100, ["event_type"], [F.desc("ts"), F.desc("event_id")]
    )
    return rows.select("event_id", "event_type", "value")
