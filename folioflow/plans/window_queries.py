"""Histories, conversations and request logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.operators import retrieval, windows
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import chunks, log, questions, r6
from folioflow.plans.registry import query
from folioflow.session import table


def newest():
    return [F.desc("ts"), F.desc("event_id")]


@query(
    "last_n",
    """SELECT event_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100""",
)
def last_n(spark, folder):
    return windows.last_n(log(spark, folder), 100, newest(), ["event_type"]).select(
        "event_id", "event_type", "value"
    )


@query(
    "recent",
    "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10",
)
def recent(spark, folder):
    rows = windows.recent(log(spark, folder), F.col("event_type") == "error", newest())
    return rows.select("event_id", "value")


@query(
    "history_long",
    """SELECT event_id, ts, 'latency' AS metric, value AS score FROM events
       UNION ALL SELECT event_id, ts, 'tokens', coalesce(json_extract(props, '$.k')::DOUBLE, 0) FROM events
       UNION ALL SELECT event_id, ts, 'missing', 0 FROM events""",
)
def history_long(spark, folder):
    wide = log(spark, folder).select(
        "event_id", "ts", F.col("value").alias("latency"),
        F.get_json_object("props", "$.k").alias("tokens"),
        F.lit(None).cast("double").alias("missing"),
    )
    return windows.history_long(wide, ["event_id", "ts"], ["latency", "tokens", "missing"])


PAIRS = """
    heads AS (SELECT conv_id, text AS system_text FROM conversations WHERE turn = 0 AND lower(role) = 'system'),
    paired AS (
      SELECT u.conv_id, u.turn, coalesce(h.system_text, '') AS system_text, u.text AS user_text, a.text AS assistant_text
      FROM conversations u
      JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      LEFT JOIN heads h ON h.conv_id = u.conv_id
      WHERE lower(u.role) IN ('human', 'user') AND lower(a.role) IN ('assistant', 'gpt')
        AND (u.turn - CASE WHEN h.conv_id IS NULL THEN 0 ELSE 1 END) % 2 = 0
        AND u.turn >= CASE WHEN h.conv_id IS NULL THEN 0 ELSE 1 END)
"""


@query("pair_turns", f"WITH {PAIRS} SELECT * FROM paired")
def pair_turns(spark, folder):
    return windows.pair_turns(table(spark, folder, "conversations"))


@query(
    "trim_context",
    f"""WITH w AS (SELECT conv_id, turn, role, len({q.words('text')})::INT AS words FROM conversations),
          r AS (SELECT *, sum(words) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM w WHERE role <> 'system')
        SELECT conv_id, turn, role, words FROM r WHERE run <= 200
        UNION ALL SELECT * FROM w WHERE role = 'system'""",
)
def trim_context(spark, folder):
    out = windows.trim_context(table(spark, folder, "conversations"), 200)
    return out.select("conv_id", "turn", "role", "words")


@query(
    "rerank",
    f"""WITH {q.RETRIEVAL} SELECT query_id, chunk_id, round(score, 6) AS overlap,
          row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS new_rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS old FROM hits)""",
)
def rerank(spark, folder):
    """The prior order is by chunk id, so that re-ranking has something to change."""
    parts = chunks(spark, folder)
    hits = retrieval.nearest_by_terms(questions(spark, folder), parts).drop("rank")
    by_id = W.partitionBy("query_id").orderBy("chunk_id")
    rows = (
        retrieval.hydrate_hits(hits, parts.select("chunk_id", "chunk_text"))
        .join(questions(spark, folder), "query_id")
        .withColumn("rank", F.row_number().over(by_id))
    )
    return retrieval.rerank(rows).select("query_id", "chunk_id", r6("overlap").alias("overlap"), "new_rank")


@query(
    "rate_limit_aligned",
    """WITH m AS (SELECT event_id, event_type, ts, date_trunc('hour', ts) AS h,
           row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS im FROM events),
         a AS (SELECT *, row_number() OVER (PARTITION BY event_type, h, im <= 1 ORDER BY ts, event_id) AS ih FROM m)
       SELECT event_id, im <= 1 AND ih <= 3 AS is_allowed,
         CASE WHEN im > 1 THEN 'Rate limit exceeded: too many requests per minute'
              WHEN ih > 3 THEN 'Rate limit exceeded: too many requests per hour' END AS reason FROM a""",
)
def rate_limit_aligned(spark, folder):
    out = windows.rate_limit_aligned(log(spark, folder), "event_type", "ts", "event_id", 1, 3)
    return out.select("event_id", "is_allowed", "reason")


# One request per step: minute count and reset, hour count and reset.
ANCHORED = """
    WITH RECURSIVE e AS (
      SELECT event_id, event_type, epoch_us(ts)::BIGINT AS t,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    s AS (
      SELECT event_type, 0::BIGINT AS n, 0::BIGINT AS event_id, 0 AS mc, t + 60000000 AS mr, 0 AS hc, t + 3600000000 AS hr,
        false AS md, false AS hd FROM e WHERE n = 1
      UNION ALL
      SELECT event_type, n, event_id,
        CASE WHEN t > mr THEN 0 ELSE mc END + CASE WHEN md OR hd THEN 0 ELSE 1 END,
        CASE WHEN t > mr THEN t + 60000000 ELSE mr END,
        CASE WHEN NOT md AND t > hr THEN 0 ELSE hc END + CASE WHEN md OR hd THEN 0 ELSE 1 END,
        CASE WHEN NOT md AND t > hr THEN t + 3600000000 ELSE hr END, md, hd
      FROM (SELECT *, NOT md AND t <= hr AND hc >= 3 AS hd
            FROM (SELECT e.event_type, e.n, e.event_id, e.t, s.mc, s.mr, s.hc, s.hr, e.t <= s.mr AND s.mc >= 1 AS md
                  FROM s JOIN e ON e.event_type = s.event_type AND e.n = s.n + 1)))
    SELECT event_id, event_type, NOT (md OR hd) AS is_allowed,
      CASE WHEN md THEN 'Rate limit exceeded: too many requests per minute'
           WHEN hd THEN 'Rate limit exceeded: too many requests per hour' END AS reason
    FROM s WHERE n > 0
"""


@query("rate_limit_anchored", ANCHORED)
def rate_limit_anchored(spark, folder):
    out = windows.rate_limit_anchored(log(spark, folder), "event_type", "ts", "event_id", 1, 3)
    return out.select("event_id", "event_type", "is_allowed", "reason")


@query(
    "cache_verdict",
    """SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER
           (PARTITION BY event_type, user_id ORDER BY ts, event_id) <= 7200::BIGINT * 1000000, false) AS is_hit
       FROM events""",
)
def cache_verdict(spark, folder):
    asked = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    out = windows.cache_verdict(log(spark, folder).withColumn("query", asked), "query", "ts", "event_id")
    return out.select("event_id", "is_hit")
