"""Histories, conversations and request logs: ranks, pairs, running sums, limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import count_tokens
from folioflow.operators.scale import (
    bucketed_ordinal,
    bucketed_previous,
    bucketed_running_sum,
    heavy_light_join,
)

# Request limits and window lengths in seconds.
MINUTE_LIMIT = 60
HOUR_LIMIT = 1000
MINUTE, HOUR = 60, 3600
MINUTE_DENIED = "Rate limit exceeded: too many requests per minute"
HOUR_DENIED = "Rate limit exceeded: too many requests per hour"
CACHE_TTL = 7200

USER_ROLES = ("human", "user")
ASSISTANT_ROLES = ("assistant", "gpt")

# Turns and seconds per bucket when a conversation or a log is cut.
TURNS_PER_BUCKET = 256
SECONDS_PER_BUCKET = 300


def last_n(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Newest n rows per key; ``order`` sorts newest first.

    The rank filter is pushed into the map side, so a hot key sends n rows per task.
    One single history is a plain top-n.
    """
    if not keys:
        return df.orderBy(*order).limit(n)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent(df: DataFrame, which: Column, order: Sequence[Column], n: int = 10) -> DataFrame:
    """Newest n rows that satisfy a condition, such as errors."""
    return last_n(df.filter(which), n, order)


def history_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide history to rows (ids, metric, score); a missing score is 0."""
    wide = df.select(
        *ids, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics]
    )
    return wide.unpivot(list(ids), list(metrics), "metric", "score")


def pair_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """User turns with the assistant turn right after them.

    Pairs start at every second turn after a leading system turn; a broken pair does not
    shift that. ``turn`` is the list position. Neighbours meet on (conversation,
    position), and the head of a conversation joins back with hot ones spread.
    """
    t = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.lower(role).alias("_role"), F.col(text).alias("_text"),
    )
    system_text = F.when(F.col("_role") == "system", F.col("_text"))
    head = F.struct(F.col("_role").alias("role"), system_text.alias("text"))
    convs = t.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.max(F.when(F.col("turn") == 0, head)).alias("head")
    )
    asked = t.filter(F.col("_role").isin(*USER_ROLES)).select(
        "conv_id", "turn", F.col("_text").alias("user_text")
    )
    answered = t.filter(F.col("_role").isin(*ASSISTANT_ROLES)).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("_text").alias("assistant_text")
    )
    pairs = heavy_light_join(
        asked.join(answered, ["conv_id", "turn"]), convs, ["conv_id"], "turns", "head"
    )
    system = F.col("head.role") == "system"
    start = F.when(system, 1).otherwise(0)
    return pairs.filter((F.col("turn") >= start) & ((F.col("turn") - start) % 2 == 0)).select(
        "conv_id", "turn",
        F.when(system, F.col("head.text")).otherwise(F.lit("")).alias("system_text"),
        "user_text", "assistant_text",
    )


def trim_context(
    turns: DataFrame, budget: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """System turns, and the newest other turns while their word count fits the budget."""
    counted = turns.withColumn("words", count_tokens(text))
    system = F.lower(role) == "system"
    others = bucketed_running_sum(
        counted.filter(~system), [conv], -F.floor(F.col(turn) / TURNS_PER_BUCKET),
        [F.desc(turn)], "words", "_run",
    ).filter(F.col("_run") <= budget).drop("_run")
    return counted.filter(system).unionByName(others)


def rate_limit_aligned(
    log: DataFrame, key: str, ts: str, tie: str,
    minute_limit: int = MINUTE_LIMIT, hour_limit: int = HOUR_LIMIT,
) -> DataFrame:
    """Verdict per request with windows on the clock.

    A request passes if it is within the limit of its minute and, among those that are,
    within the limit of its hour. Both ordinals are taken per (key, minute).
    """
    minute, hour = F.date_trunc("minute", ts), F.date_trunc("hour", ts)
    timed = log.withColumn("_cell", F.struct(F.col(key).alias("k"), hour.alias("h"), minute.alias("m")))
    order = [F.col(ts).asc(), F.col(tie).asc()]
    numbered = timed.withColumn("_at", F.row_number().over(W.partitionBy("_cell").orderBy(*order)))
    # Requests passed in earlier minutes of the hour: at most 60 rows per (key, hour).
    before = (
        W.partitionBy("_cell.k", "_cell.h").orderBy("_cell.m").rowsBetween(W.unboundedPreceding, -1)
    )
    minutes = (
        timed.groupBy("_cell")
        .agg(F.least(F.count("*"), F.lit(minute_limit)).alias("_passed"))
        .select("_cell", F.coalesce(F.sum("_passed").over(before), F.lit(0)).alias("_earlier"))
    )
    reason = F.when(F.col("_at") > minute_limit, MINUTE_DENIED).when(
        F.col("_earlier") + F.col("_at") > hour_limit, HOUR_DENIED
    )
    return (
        numbered.join(minutes, "_cell")
        .withColumn("reason", reason)
        .withColumn("is_allowed", F.col("reason").isNull())
        .drop("_cell", "_at", "_earlier")
    )


class LimiterState:
    """Counters of one key: windows start at the first request and reset after their end."""

    def __init__(self, minute_limit: int, hour_limit: int):
        self.limits = (minute_limit, hour_limit)
        self.counts = [0, 0]
        self.resets: list[float] | None = None

    def admit(self, now: float, n: int = 1) -> tuple[int, str | None]:
        """Of n requests at one moment: how many pass, and why the others do not."""
        if self.resets is None:
            self.resets = [now + MINUTE, now + HOUR]
        for i, (length, denied) in enumerate(((MINUTE, MINUTE_DENIED), (HOUR, HOUR_DENIED))):
            if now > self.resets[i]:
                self.counts[i], self.resets[i] = 0, now + length
            elif self.counts[i] >= self.limits[i]:
                return 0, denied
        # The first request has passed both checks; a fresh window takes it at any limit.
        room = [limit - c for limit, c in zip(self.limits, self.counts, strict=True)]
        allowed = min(n, max(1, min(room)))
        self.counts = [c + allowed for c in self.counts]
        return allowed, MINUTE_DENIED if room[0] <= room[1] else HOUR_DENIED


def rate_limit_anchored(
    log: DataFrame, key: str, ts: str, tie: str,
    minute_limit: int = MINUTE_LIMIT, hour_limit: int = HOUR_LIMIT, tick_seconds: float = 1e-6,
) -> DataFrame:
    """Verdict per request with windows that start at a key's first request.

    The rule is sequential per key. Requests of one clock tick are merged first, so a
    key sends at most one row per tick to the sequential pass, however hot it is; that
    pass streams sorted rows and holds one state. Verdicts join back per (key, tick).
    """
    micros = max(1, round(tick_seconds * 1_000_000))
    # The key as text that is never null, so that requests without a key share a limit too.
    who = F.concat(F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    ticked = log.withColumn("_who", who).withColumn(
        "_tick", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(micros))
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holder, state = None, None
        for pdf in batches:
            allowed, denied = [], []
            for k, tick, n in zip(pdf["_who"], pdf["_tick"], pdf["_n"], strict=True):
                if k != holder:
                    holder, state = k, LimiterState(minute_limit, hour_limit)
                ok, why = state.admit(tick * micros / 1e6, n)
                allowed.append(ok)
                denied.append(why)
            yield pd.DataFrame(
                {"_who": pdf["_who"], "_tick": pdf["_tick"], "_allowed": allowed, "_why": denied}
            )

    merged = (
        ticked.filter(F.col("_tick").isNotNull()).groupBy("_who", "_tick").agg(F.count("*").alias("_n"))
    )
    verdicts = (
        merged.repartition("_who")
        .sortWithinPartitions("_who", "_tick")
        .mapInPandas(walk, "_who string, _tick long, _allowed long, _why string")
    )
    w = W.partitionBy("_who", "_tick").orderBy(F.col(ts).asc(), F.col(tie).asc())
    numbered = ticked.withColumn("_at", F.row_number().over(w))
    return (
        numbered.join(verdicts, ["_who", "_tick"], "left")
        .withColumn("reason", F.when(F.col("_at") > F.col("_allowed"), F.col("_why")))
        .withColumn("is_allowed", F.col("reason").isNull())
        .drop("_who", "_tick", "_at", "_allowed", "_why")
    )


def cache_verdict(
    log: DataFrame, query: str, ts: str, tie: str, ttl: int = CACHE_TTL
) -> DataFrame:
    """Hit when the same query ran within ``ttl`` seconds before; a hit renews the entry."""
    timed = log.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    bucket = F.floor(F.col("_us") / F.lit(SECONDS_PER_BUCKET * 1_000_000))
    order = [F.col("_us").asc(), F.col(tie).asc()]
    seen = bucketed_previous(timed, [query], "_us", bucket, order, "_prev")
    return seen.withColumn(
        "is_hit", F.coalesce(F.col("_us") - F.col("_prev") <= ttl * 1_000_000, F.lit(False))
    ).drop("_us", "_prev")


def positions(df: DataFrame, conv: str, turn: str, name: str = "position") -> DataFrame:
    """List positions of turns whose numbers have gaps."""
    return bucketed_ordinal(
        df, [conv], F.floor(F.col(turn) / TURNS_PER_BUCKET), [F.asc(turn)], name
    )
