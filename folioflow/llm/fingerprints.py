"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a boundary stands where its low bits are zero, by
a harder mask before the normal chunk size and an easier one after it, so that sizes stay near
normal. Boundaries depend on nearby bytes only: after an edit, chunks fall into step again. A
fingerprint is the set of chunk digests with the bytes each stands for; the likeness of two
fingerprints is their containment: the share of bytes, of the shorter text, whose chunks both have.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.order import range_of, range_starts
from folioflow.llm.tables import own_columns
from folioflow.llm.wordhash import _BYTE, BYTES, mix

SMALLEST, NORMAL, LARGEST = 32, 64, 256
HARD, EASY = np.uint32(0x7F << 25), np.uint32(0x1F << 25)
SLICE = 1 << 20

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)

Chunks = dict[bytes, int]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the 32 bytes up to it."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks. No chunk looks at bytes before its own, as it has 32 at least."""
    size = len(data)
    hard: list[int] = []
    easy: list[int] = []
    for at in range(0, size, SLICE):
        back = min(at, 31)
        h = gear(data[at - back : at + SLICE])[back:]
        loose = np.flatnonzero((h & EASY) == 0)
        easy += (loose + at + 1).tolist()
        hard += (loose[(h[loose] & HARD) == 0] + at + 1).tolist()
    ends, begin, n_hard, n_easy = [], 0, len(hard), len(easy)
    i = j = 0
    while size - begin > SMALLEST:
        i = bisect_left(hard, begin + SMALLEST, i)
        if i < n_hard and hard[i] <= begin + NORMAL:
            end = hard[i]
        else:
            j = bisect_left(easy, begin + NORMAL, j)
            end = easy[j] if j < n_easy and easy[j] <= begin + LARGEST else begin + LARGEST
        if end >= size:
            break
        ends.append(end)
        begin = end
    if size:
        ends.append(size)
    return ends


def chunk_set(text: bytes) -> Chunks:
    """Bytes of the text that each distinct chunk digest (6 bytes) stands for."""
    data = np.frombuffer(text, np.uint8)
    ends = np.array(boundaries(data), np.int64)
    if not len(ends):
        return {}
    starts = np.concatenate([[0], ends[:-1]])
    digests = np.empty(len(ends), np.uint64)
    at = 0
    while at < len(ends):
        low = int(starts[at])
        to = max(int(np.searchsorted(ends, low + SLICE, side="right")), at + 1)
        sums = BYTES.sums(_BYTE[data[low : int(ends[to - 1])]])
        digests[at:to] = BYTES.part(sums, starts[at:to] - low, ends[at:to] - low)
        at = to
    lengths = ends - starts
    digests = mix(digests + lengths.astype(np.uint64)) >> np.uint64(16)
    kinds, where = np.unique(digests, return_inverse=True)
    weights = np.bincount(where, weights=lengths).astype(np.int64)
    return dict(zip(kinds.tolist(), weights.tolist(), strict=True))


def likeness(a: Chunks, b: Chunks) -> float:
    """Share of the shorter text's bytes that lie in chunks of both: 1 where it is contained in the other.

    Two empty sets are alike; an empty set and another are not.
    """
    if not a or not b:
        return float(a == b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = sum(min(n, large.get(k, 0)) for k, n in small.items())
    return common / min(sum(a.values()), sum(b.values()))


def as_string(chunks: Chunks) -> str:
    """Sorted ``digest:bytes`` in hexadecimal, joined by commas."""
    return ",".join(f"{k:012x}:{n:x}" for k, n in chunks.items())


def from_string(fingerprint: str) -> Chunks:
    pairs = (p.split(":") for p in fingerprint.split(",") if p)
    return {int(k, 16): int(n, 16) for k, n in pairs}


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text has its last quarter of code points replaced by the beginning of the next
    document in ascending order of doc_id (then text); the last is followed by the first.
    Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, one row per input row; the last two are containments, as in ``likeness``. A null
    text is empty, an empty text has the empty fingerprint. Rows with a null doc_id come before
    all others in one range of their own. A single row follows itself; an empty table gives no
    rows; extra columns are ignored.

    Texts are shuffled once, by ranges of ids. A row that begins a range also goes to the range
    before it, so that every range is worked through alone.
    """
    rows = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    starts = range_starts(rows, "doc_id")
    with_null = rows.filter("doc_id IS NULL").limit(1).count() > 0
    lowest, highest = -1 if with_null else 0, len(starts) - 1
    ranges = rows.withColumn("_own", range_of(F.col("doc_id"), starts).cast("int"))
    # The range before that of a first id; rows of equal first ids all go there, one is used.
    begins = F.col("doc_id").isNull() | (F.col("doc_id").isin(starts) if starts else F.lit(False))
    previous = F.when(F.col("_own") == lowest, highest).otherwise(F.col("_own") - 1)
    dealt = ranges.select(
        "doc_id", "text",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("_own").alias("range"), F.lit(0).alias("guest")),
                    F.struct(F.when(begins, previous).cast("int").alias("range"), F.lit(1).alias("guest")),
                ),
                lambda x: x["range"].isNotNull(),
            )
        ).alias("to"),
    ).select("doc_id", "text", "to.range", "to.guest")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shape = (
        f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return (
        dealt.repartition(len(starts) + 1, "range")
        .sortWithinPartitions("range", "guest", F.asc_nulls_first("doc_id"), "text")
        .mapInArrow(_follow, shape)
    )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row of a range with the next; the first guest follows the last own row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    names += ["near_edited", "near_next"]
    last: tuple | None = None  # range, id, text, chunks of the row that waits for its follower
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        found: list[tuple] = []
        for of, guest, key, text in zip(
            *(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True
        ):
            if guest and (last is None or last[0] != of):
                continue
            chunks = chunk_set(text.encode("utf-8"))
            if last is not None and last[0] == of:
                found.append(_compared(last, text, chunks))
            last = None if guest else (of, key, text, chunks)
        if found:
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *map(pa.array, columns[2:])], names
            )


def _compared(row: tuple, follower: str, follower_chunks: Chunks) -> tuple:
    _, key, text, chunks = row
    n = len(text)
    edited = (text[: n - n // 4] + follower[: n // 4]).encode("utf-8")
    edited_chunks = chunk_set(edited)
    return (
        key, n, hashlib.sha256(edited).hexdigest(), as_string(chunks), as_string(edited_chunks),
        likeness(chunks, edited_chunks), likeness(chunks, follower_chunks),
    )
