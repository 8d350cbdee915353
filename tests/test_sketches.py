"""Stored summaries: merged reports against the whole log, within the bounds of the sketches."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import sketches
from folioflow.session import scratch_path


def test_merged_increments_equal_the_whole_log(spark):
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = [
        (rng.choice(["a", "b", None]), day + dt.timedelta(hours=rng.randrange(240)), rng.lognormvariate(1, 1), rng.randrange(4000))
        for _ in range(20_000)
    ]
    rows += [("a", None, 5.0, 1), ("a", day, None, None), ("empty", day, None, None)]
    log = spark.createDataFrame(rows, "key string, ts timestamp, value double, who long")
    path = scratch_path(spark, "summary-test")
    part = F.pmod(F.xxhash64("who", "value"), F.lit(3))
    for number in (0, 1, 2, 1):
        sketches.add_increment(log.filter(part == number), path, number, "ts", ["key"], "value", "who")
    stored = sketches.read_summaries(spark, path)
    got = {r.key: r for r in sketches.merged(stored, ["key"], (0.1, 0.5, 0.99)).collect()}
    assert set(got) == {"a", "b", None, "empty"}
    for key in ("a", "b", None):
        values = np.array([v for k, _, v, _ in rows if k == key and v is not None])
        people = {w for k, _, _, w in rows if k == key and w is not None}
        r = got[key]
        assert r["rows"] == sum(k == key for k, *_ in rows)
        assert np.allclose([r["mean"], r["std_dev"], r["min"], r["max"]], [values.mean(), values.std(ddof=1), values.min(), values.max()])
        assert abs(r["distinct_values"] / len(people) - 1) < 0.03
        ordered = np.sort(values)
        for q, found in zip((0.1, 0.5, 0.99), r["quantiles"], strict=True):
            assert abs(np.searchsorted(ordered, found) / len(ordered) - q) < 0.015
    assert got["empty"]["mean"] is None and got["empty"]["quantiles"] is None and got["empty"]["rows"] == 1


def test_a_span_of_days_reads_its_rows_alone(spark):
    rows = [("a", dt.datetime(2024, 1, d), float(d), d) for d in range(1, 11)]
    log = spark.createDataFrame(rows, "key string, ts timestamp, value double, who long")
    path = scratch_path(spark, "summary-test")
    sketches.add_increment(log, path, 0, "ts", ["key"], "value", "who")
    span = (dt.date(2024, 1, 3), dt.date(2024, 1, 5))
    row = sketches.merged(sketches.read_summaries(spark, path), ["key"], days=span).first()
    assert (row["rows"], row["mean"], row["distinct_values"]) == (3, 4.0, 3)
