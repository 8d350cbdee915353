import datetime as dt
import os
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folioflow.operators import windows
from folioflow.plans import QUERIES
from folioflow.plans.streaming_queries import _rocksdb
from folioflow.streaming import jobs

UTC = dt.timezone.utc


def test_rate_limit_stream_equals_batch(spark, small):
    got = {r.event_id: r.reason for r in QUERIES["stream_rate_limit"](spark, small).collect()}
    want = {r.event_id: r.reason for r in QUERIES["rate_limit_anchored"](spark, small).collect()}
    assert got == want
    assert any(want.values())


def files(tmp_path, spark, rows, schema):
    """One file per list of rows, read one per micro-batch in this order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        made = next((tmp_path / f"w{i}").glob("*.parquet"))
        target = folder / f"{i}.parquet"
        target.write_bytes(made.read_bytes())
        stamp = 1_700_000_000 + i * 10
        os.utime(target, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def event(i, user, minute):
    return (i, user, dt.datetime(2024, 1, 1, 10, minute))


SCHEMA = "event_id long, user string, ts timestamp"


def test_limits_carry_over_micro_batches(spark, tmp_path):
    batches = [[event(1, "a", 0), event(2, "a", 0), event(3, "b", 0)], [event(4, "a", 0), event(5, "a", 2)]]
    stream = files(tmp_path, spark, batches, SCHEMA)
    with _rocksdb(spark):
        out = jobs.run_to_files(jobs.stream_rate_limit(stream, "user", 2, 1000), "test-limit")
    got = {r.event_id: r.reason for r in spark.read.parquet(out).collect()}
    assert got == {1: None, 2: None, 3: None, 4: windows.MINUTE_DENIED, 5: None}


def test_late_requests_get_a_verdict_of_their_own(spark, tmp_path):
    day = dt.datetime(2024, 1, 5)
    big = 2**53 + 1
    batches = [
        [event(1, "a", 0), event(2, "b", 0)],
        [(3, "a", day), (None, "a", day), (big, None, day)],
        # Three days behind "a", but not behind what "b" had.
        [event(4, "a", 1), event(5, "b", 1), (big + 2, None, day + dt.timedelta(minutes=1)), (7, "a", None)],
        [(8, "a", day - dt.timedelta(minutes=9)), (9, "a", day - dt.timedelta(minutes=11))],
    ]
    stream = files(tmp_path, spark, batches, SCHEMA)
    with _rocksdb(spark):
        out = jobs.run_to_files(jobs.stream_rate_limit(stream, "user", 60, 1000), "test-late-requests")
    verdicts = spark.read.parquet(out)
    rows = verdicts.collect()
    late = {r.event_id for r in jobs.late_requests(verdicts).collect()}
    assert len(rows) == 11 and late == {4, 9}
    assert {r.event_id for r in rows} == {1, 2, 3, None, big, 4, 5, big + 2, 7, 8, 9}
    assert all(r.is_allowed == (r.event_id not in late) for r in rows)


def test_a_stream_without_files_gives_no_rows(spark, tmp_path):
    stream = files(tmp_path, spark, [], SCHEMA)
    assert jobs.run_last_n(stream, "test-none", 3, ["user"], [F.desc("ts")]).count() == 0
    totals = stream.groupBy("user").agg(F.count("*").alias("n"))
    assert jobs.run_complete(totals, "test-none").count() == 0


def test_upsert_skips_known_contents_across_batches(spark, tmp_path):
    batches = [[(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]]
    stream = files(tmp_path, spark, batches, "doc_id long, text string")
    rows = jobs.run_upsert(stream, "test-upsert").collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "a"), (3, "b"), (5, "c")]


def test_last_n_merges_batches(spark, tmp_path):
    batches = [[event(i, "a", i) for i in range(5)], [event(i, "a", i) for i in range(5, 8)]]
    stream = files(tmp_path, spark, batches, SCHEMA)
    rows = jobs.run_last_n(stream, "test-last", 3, ["user"], [F.desc("ts")]).collect()
    assert sorted(r.event_id for r in rows) == [5, 6, 7]


def test_progress_counts_every_batch(spark, tmp_path):
    batches = [[(1, "aa"), (2, "b")], [(3, "cccc")]]
    stream = files(tmp_path, spark, batches, "doc_id long, text string")
    rows = jobs.run_progress(stream, "test-progress").collect()
    assert sorted((r.batch, r.documents, r.characters) for r in rows) == [(0, 2, 3), (1, 1, 4)]


def test_listener_sees_observed_counts(spark, tmp_path):
    stream = files(tmp_path, spark, [[(1, "aa"), (2, "b")]], "doc_id long, text string")
    log = jobs.ProgressLog()
    spark.streams.addListener(log)
    try:
        jobs.run_to_files(jobs.stream_progress(stream, "counts"), "test-observe")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    assert any(r["observed"].get("counts", {}).get("documents") == 2 for r in log.records)


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    batches = [
        [event(1, "a", 0), event(2, "a", 1)],
        [(3, "a", dt.datetime(2024, 1, 5, 0, 0))],
        [(6, "a", dt.datetime(2024, 1, 5, 2, 0))],  # late rows are judged one batch behind
        [event(4, "a", 2), (5, "a", dt.datetime(2024, 1, 9, 0, 0))],
    ]
    stream = files(tmp_path, spark, batches, SCHEMA).withColumn("value", F.lit(1.0))
    metrics = jobs.stream_metrics(stream, "value", F.lit(True), F.lit(False), "1 hour", "10 minutes")
    rows = spark.read.parquet(jobs.run_to_files(metrics, "test-late")).collect()
    first = [r for r in rows if r.window_start.day == 1]
    assert [r.queries for r in first] == [2]


def test_a_table_stream_reads_a_file_and_a_folder_of_files(spark, small, tmp_path):
    whole = spark.read.parquet(f"{small}/documents.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("stream_chunks", "stream_upsert", "stream_progress"):
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert got and got == sorted(map(tuple, QUERIES[name](spark, small).collect()))


class _Kept:
    def exists(self):
        return False

    def update(self, value):
        self.value = value


def test_limiter_holds_a_key_in_few_bytes():
    """300,000 requests of one key, some without a time or an id, in bounded batches."""
    n = 300_000
    rng = np.random.default_rng(3)
    at = rng.integers(0, 10**6, n).astype(float)
    at[::7] = np.nan
    ids = [None if i % 11 == 0 else str((1 << 53) + i) for i in range(n)]
    limiter = jobs._Limiter("user", 1, 3, 600)
    limiter.state = _Kept()
    batches = (pd.DataFrame({"event_id": ids[a : a + 10_000], "user": "u", "at": at[a : a + 10_000]}) for a in range(0, n, 10_000))
    tracemalloc.start()
    try:
        counts, passed, most = Counter(), set(), 0
        for out in limiter.handleInputRows(("u",), batches, None):
            counts.update(zip(out["is_allowed"], out["reason"]))
            passed.update(i for i in out["event_id"][out["is_allowed"]] if i is not None)
            most = max(most, len(out))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    state = windows.LimiterState(1, 3)
    want, verdicts = set(), []
    for i in sorted((i for i in range(n) if i % 7), key=lambda i: (at[i], ids[i] is None, int(ids[i] or 0))):
        ok, why = state.admit(at[i])
        verdicts.append((bool(ok), None if ok else why))
        want |= {ids[i]} if ok else set()
    want |= {ids[i] for i in range(0, n, 7)}
    assert counts == Counter([*verdicts, *[(True, None)] * len(range(0, n, 7))])
    assert passed == want - {None} and limiter.state.value[4] == np.nanmax(at)
    assert most <= 10_000 and peak < 45 << 20
