"""Resampling of documents towards a target distribution by hashed n-grams.

A text's separators collapse to single spaces; an overlapped regular-expression scan with
lookarounds at the spaces then gives every run of words as a span, and the CRC of its bytes
its bucket. Buckets of the corpus and of the target are counted by all tasks together; the
logarithm of their smoothed ratio is a bucket's gain, a document's weight the mean gain of
its features. Seeded Gumbel noise on the weights draws documents without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.tables import own_columns, written
from folioflow.llm.wordhash import text_bytes

# Letters and digits of ASCII (capitals lowered) and all bytes of other characters; the rest is space.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
BATCH_BYTES = 4 << 20


@cache
def _runs(n: int) -> regex.Pattern:
    """Runs of ``n`` words between single spaces."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def feature_buckets(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a text and the bucket of each of its runs of up to ``longest`` words."""
    plain = b" ".join(text.translate(_PLAIN).split())
    found = [
        np.fromiter((zlib.crc32(m[0]) % buckets for m in _runs(n).finditer(plain, overlapped=True)), np.uint32)
        for n in range(1, longest + 1)
    ]
    return len(found[0]), np.concatenate(found)


def _scan(longest: int, buckets: int):
    """doc_id, n_words, n_features, packed buckets of every row."""
    packed = "<u2" if buckets <= 1 << 16 else "<u4"

    def flush(ids: pa.Array, words: list, features: list, found: list) -> pa.RecordBatch:
        columns = [ids, pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            begin, size = 0, 0
            words, features, found = [], [], []
            for r in range(batch.num_rows):
                n, b = feature_buckets(data[offsets[r] : offsets[r + 1]].tobytes(), longest, buckets)
                words.append(n)
                features.append(len(b))
                found.append(b.astype(packed).tobytes())
                size += len(found[-1])
                if size >= BATCH_BYTES or r + 1 == batch.num_rows:
                    yield flush(batch.column("doc_id").slice(begin, r + 1 - begin), words, features, found)
                    begin, size = r + 1, 0
                    words, features, found = [], [], []

    return run


def hashed_features(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and ``buckets`` (packed numbers) of every row of ``docs``."""
    rows = own_columns(docs, "doc_id", "text")
    shape = T.StructType([rows.schema["doc_id"]]).add("n_words", "long").add("n_features", "long")
    return rows.mapInArrow(_scan(longest, buckets), shape.add("buckets", "binary"))


def bucket_counts(features: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket, summed in the tasks first; at most ``buckets`` rows reach the driver."""
    packed = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in batch.column("buckets"):
                total += np.bincount(np.frombuffer(one.as_buffer(), packed), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    sums = features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """How much likelier each bucket is in the target, smoothed, in thousandths of a natural logarithm."""
    k, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return [
        math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k))))
        for s, t in zip(corpus, target, strict=True)
    ]


def noise(key: object, seed: int) -> int:
    """Gumbel noise of a document, in thousandths; a null key has that of the seed alone."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def _weigh(of: np.ndarray, seed: int):
    packed = "<u2" if len(of) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for one in batch.column("buckets"):
                found = np.frombuffer(one.as_buffer(), packed)
                weights.append(int(of[found].sum()) // len(found) if len(found) else 0)
            scores = [w + noise(k, seed) for w, k in zip(weights, batch.column("doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weights, pa.int64())]
                + [pa.array(scores, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return run


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20,
    longest: int = 2, buckets: int = 10_000, seed: int = 7,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its weight towards ``target`` (text) and its place in the draw.

    Result: doc_id, n_features, weight, score, rank. ``rank`` counts from 1 in the order of
    descending score, ties to the smaller doc_id; only the first ``percent`` of the documents
    with at least ``least_words`` words have one. Features are runs of 1 to ``longest`` words
    with repeats.

    A null or empty text has no features and weight 0. A null doc_id takes the noise of the
    seed alone and comes after others of its score. Rows with equal doc_ids count as
    documents of their own; where their scores tie too, the one with more features comes
    first. A very long text is one row of one task, about 16 bytes a word of it in memory.
    Empty tables give no rows, an empty target leaves only the smoothing; extra columns are
    ignored.

    The texts are scanned once: packed buckets are written and read by both the counts and
    the weights. Places come from ranges of the order, whose sizes are summed; only one
    number for each range meets in one task.
    """
    found = written(hashed_features(docs, longest, buckets), "features")
    aim = hashed_features(target.select(F.lit(0).alias("doc_id"), F.col("text")), longest, buckets)
    of = np.array(gains(bucket_counts(found, buckets), bucket_counts(aim, buckets)), np.int64)
    shape = T.StructType([*found.schema.fields[:3], T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())])
    scored = found.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(_weigh(of, seed), shape)
    order = [
        F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("salt"),
    ]
    # Rows that tie in all of these are alike; the salt lets ranges cut between them.
    placed = written(
        scored.withColumn("able", (F.col("n_words") >= least_words).cast("int"))
        .withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "doc_id", "n_features", "weight", "score", "able", F.spark_partition_id().alias("range"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        ),
        "draw",
    )
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("able").alias("able_n"))
    drawn = (ranges.agg(F.sum("able_n")).first()[0] or 0) * percent // 100
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # One row for each shuffle partition.
    starts = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("place") + 1
    return placed.join(F.broadcast(starts), "range").select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")
    )
