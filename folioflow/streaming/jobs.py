"""Structured Streaming forms: chunking, upserts, metrics, limits, sessions, lock-outs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.functions.text import content_hash
from folioflow.operators.splitting import split_tokens
from folioflow.operators.windows import HOUR_DENIED, HOUR_LIMIT, MINUTE_DENIED, MINUTE_LIMIT, LimiterState, last_n
from folioflow.session import scratch_path


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100
) -> DataFrame:
    """File stream over the parquet files of a table, a single file or a folder of them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A stream takes a folder as it is; a single file must be named by a pattern.
    source = path if _is_folder(spark, path) else f"{folder}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``withWatermark`` wants a timestamp with time zone; the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_files(df: DataFrame, label: str) -> str:
    """Run an append stream until its source is read; returns the parquet folder."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    query = (
        df.writeStream.format("parquet")
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{out}-state")
        .start(out)
    )
    finish(query)
    return out


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _files(spark: SparkSession, name: str):
    """A path and the file system it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _is_folder(spark: SparkSession, name: str) -> bool:
    path, files = _files(spark, name)
    return files.getFileStatus(path).isDirectory()


def _newest(spark: SparkSession, folder: str, name: str) -> int | None:
    """Number of the newest finished batch folder ``name=N``; also after a restart of the driver."""
    path, files = _files(spark, folder)
    jvm = spark.sparkContext._jvm
    if not files.exists(path):
        return None
    done = [
        s.getPath() for s in files.listStatus(path)
        if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max((int(p.getName().removeprefix(f"{name}=")) for p in done), default=None)


def run_complete(df: DataFrame, label: str) -> DataFrame:
    """Run an aggregate stream in complete mode; the rows of its last batch, none if there was no batch."""
    spark = df.sparkSession
    out = scratch_path(spark, label)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    query = (
        df.writeStream.outputMode("complete")
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{out}-state")
        .foreachBatch(keep)
        .start()
    )
    finish(query)
    newest = _newest(spark, out, "batch")
    return spark.createDataFrame([], df.schema) if newest is None else spark.read.parquet(f"{out}/batch={newest}")


def stream_chunks(documents: DataFrame, size: int = 256, overlap: int = 128) -> DataFrame:
    """Chunk stream of a document stream; row-wise, so it needs no state."""
    return split_tokens(documents, size, overlap)


def stream_upsert(documents: DataFrame, stored_path: str, text: str = "text") -> Callable:
    """Batch writer that appends contents the table does not hold yet.

    A batch is cut to one row per hash (only hashes are aggregated) and joined against the
    stored hashes. Rows carry their batch number, and a batch that runs again after a
    failure replaces its own folder.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("doc_hash", content_hash(text))
        # A null text is a content like others, so it has a key of its own to meet by.
        keyed = hashed.withColumn("_content", F.coalesce("doc_hash", F.lit("")))
        first = keyed.groupBy("_content").agg(F.min("doc_id").alias("_first"))
        fresh = keyed.join(first, "_content").filter(F.col("doc_id").eqNullSafe(F.col("_first")))
        fresh = fresh.dropDuplicates(["_content"]).drop("_first", "_content")
        try:
            stored = spark.read.parquet(stored_path).filter(F.col("batch") != n)
            known = stored.select(F.col("doc_hash").alias("_known"))
            fresh = fresh.join(known, F.col("doc_hash").eqNullSafe(F.col("_known")), "left_anti")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh.write.mode("overwrite").parquet(f"{stored_path}/batch={n}")

    return write


def run_upsert(documents: DataFrame, label: str) -> DataFrame:
    spark = documents.sparkSession
    out = scratch_path(spark, label)
    query = (
        documents.writeStream.foreachBatch(stream_upsert(documents, out))
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{out}-state")
        .start()
    )
    finish(query)
    return spark.read.parquet(out)


def stream_metrics(
    log: DataFrame, latency: str, ok: Column, hit: Column, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Counts, success rate, mean latency and hit rate per tumbling window of an event log.

    Append mode emits a window once the watermark has passed it.
    """
    total = F.count("*")
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", window))
        .agg(
            total.alias("queries"),
            F.count_if(ok).alias("successful"),
            (F.count_if(ok) / total * 100).alias("success_rate"),
            F.avg(latency).alias("mean_latency"),
            (F.count_if(hit) / total).alias("hit_rate"),
        )
        .select(F.col("window.start").alias("window_start"), "queries", "successful",
                "success_rate", "mean_latency", "hit_rate")
    )


def sessions(log: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after an idle gap."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), key)
        .agg(F.count("*").alias("events"))
        .select(key, F.col("session_window.start").alias("session_start"),
                F.col("session_window.end").alias("session_end"), "events")
    )


def lockout(
    log: DataFrame, key: str, failed: Column, limit: int = 5, window: str = "15 minutes",
    slide: str = "5 minutes", delay: str = "1 hour",
) -> DataFrame:
    """Windows in which a key failed at least ``limit`` times."""
    return (
        log.filter(failed)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window, slide), key)
        .agg(F.count("*").alias("failures"))
        .filter(F.col("failures") >= limit)
        .select(key, F.col("window.start").alias("window_start"), "failures")
    )


LATE_REQUEST = "Request came too late"
REASONS = (None, LATE_REQUEST, MINUTE_DENIED, HOUR_DENIED)
ROWS_HELD = 10_000


def _numbers(ids: pd.Series) -> np.ndarray:
    return ids.fillna("0").astype("int64").to_numpy()


class _Limiter(StatefulProcessor):
    """Limiter state of one key and the newest time it has seen."""

    def __init__(self, key: str, minute_limit: int, hour_limit: int, delay: float):
        self.key, self.minute_limit, self.hour_limit, self.delay = key, minute_limit, hour_limit, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = "minute_count long, hour_count long, minute_reset double, hour_reset double, newest double"
        self.state = handle.getValueState("limits", fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, newest = LimiterState(self.minute_limit, self.hour_limit), None
        if self.state.exists():
            minute_count, hour_count, minute_reset, hour_reset, newest = self.state.get()
            if minute_reset is not None:
                now.counts, now.resets = [minute_count, hour_count], [minute_reset, hour_reset]
        # Ids come as text, so that none passes through a float beside a missing one; they are held as numbers.
        parts = [(_numbers(pdf["event_id"]), pdf["event_id"].isna().to_numpy(), pdf["at"].to_numpy(float)) for pdf in rows]
        ids, lost, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((ids, lost, at))  # requests without a time come last
        cut_off = None if newest is None else newest - self.delay
        why = np.zeros(len(ids), np.int8)
        for low in range(0, len(ids), ROWS_HELD):
            some = order[low : low + ROWS_HELD]
            for i, moment in zip(some.tolist(), at[some].tolist(), strict=True):
                if moment != moment:
                    continue  # a request without a time is not limited
                if cut_off is not None and moment < cut_off:
                    why[i] = REASONS.index(LATE_REQUEST)
                    continue
                allowed, reason = now.admit(moment)
                if not allowed:
                    why[i] = REASONS.index(reason)
                newest = moment if newest is None else max(newest, moment)
        del at
        resets = now.resets or (None, None)
        self.state.update((*map(int, now.counts), *(None if r is None else float(r) for r in resets), newest))
        for low in range(0, len(ids), ROWS_HELD):
            some = order[low : low + ROWS_HELD]
            yield pd.DataFrame(
                {
                    "event_id": [None if n else str(i) for i, n in zip(ids[some].tolist(), lost[some].tolist(), strict=True)],
                    self.key: [key[0]] * len(some),
                    "is_allowed": why[some] == 0,
                    "reason": [REASONS[w] for w in why[some].tolist()],
                }
            )

    def close(self) -> None:
        pass


def stream_rate_limit(
    log: DataFrame, key: str, minute_limit: int = MINUTE_LIMIT, hour_limit: int = HOUR_LIMIT,
    delay_seconds: float = 600, tick_seconds: float = 1e-6,
) -> DataFrame:
    """Verdict for every request, counters anchored at a key's first request.

    Requests of one micro-batch are taken in the order of time. A request that comes more than
    ``delay_seconds`` behind the newest that its key had in an earlier micro-batch is denied as
    late and moves no counter: nothing is dropped without a word, as a watermark would do.
    ``late_requests`` gives these rows by themselves. Requests without a time pass.

    Needs the RocksDB state store, which keeps five numbers for every key it has seen: without
    a watermark there is no time to let them go. The clock ticks like that of the batch form.
    A task orders the requests of one key and one micro-batch, as some 30 bytes each, so
    ``maxFilesPerTrigger`` bounds what it holds.
    """
    at = F.floor(F.unix_micros("ts") / F.lit(max(1, round(tick_seconds * 1e6)))) * tick_seconds
    rows = log.select(F.col("event_id").cast("string").alias("event_id"), key, at.cast("double").alias("at"))
    key_type = log.schema[key].dataType.simpleString()
    verdicts = rows.groupBy(key).transformWithStateInPandas(
        _Limiter(key, minute_limit, hour_limit, delay_seconds),
        f"event_id string, {key} {key_type}, is_allowed boolean, reason string",
        "Append",
        "None",
    )
    return verdicts.withColumn("event_id", F.col("event_id").cast("long"))


def late_requests(verdicts: DataFrame) -> DataFrame:
    """The requests that ``stream_rate_limit`` found too late."""
    return verdicts.filter(F.col("reason") == LATE_REQUEST)


class ProgressLog(StreamingQueryListener):
    """Keeps the newest observed progress records (name, batch, rows, observed metrics)."""

    def __init__(self, keep: int = 100):
        self.keep, self.records = keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {k: v.asDict() for k, v in p.observedMetrics.items()}
        record = {"batch": p.batchId, "rows": p.numInputRows, "per_second": p.processedRowsPerSecond}
        self.records = [*self.records, {**record, "observed": seen}][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_progress(documents: DataFrame, name: str = "progress") -> DataFrame:
    """The stream itself, with row and character counts observed per micro-batch."""
    return documents.observe(
        name, F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters")
    )


def run_progress(documents: DataFrame, label: str) -> DataFrame:
    """Progress rows (batch, documents, characters) written by a finished stream."""
    spark = documents.sparkSession
    out = scratch_path(spark, label)

    def note(batch: DataFrame, n: int) -> None:
        totals = batch.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
        totals.write.mode("overwrite").parquet(f"{out}/batch={n}")

    query = (
        documents.writeStream.foreachBatch(note)
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{out}-state")
        .start()
    )
    finish(query)
    return spark.read.parquet(out)


def run_last_n(log: DataFrame, label: str, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """Bounded history: every batch merges into the newest n rows per key.

    A batch writes its own folder from the one before, so running it again changes
    nothing.
    """
    spark = log.sparkSession
    out = scratch_path(spark, label)

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{out}/history={number - 1}"))
        last_n(rows, n, order, keys).write.mode("overwrite").parquet(f"{out}/history={number}")

    query = (
        log.writeStream.foreachBatch(merge)
        .trigger(availableNow=True)
        .option("checkpointLocation", f"{out}-state")
        .start()
    )
    finish(query)
    newest = _newest(spark, out, "history")
    return spark.createDataFrame([], log.schema) if newest is None else spark.read.parquet(f"{out}/history={newest}")
