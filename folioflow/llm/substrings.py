"""Removal of word windows that an earlier document already has.

Every window of a fixed number of words gets a Rabin-Karp hash. Tasks keep the first document
of each window of their own batch and settle later ones at once, so that a window in many
documents leaves a task only once. The rest goes to Spark's shuffle as packed blocks of
hashes, dealt by a second, independent hash: windows are equal if both agree. Where a window
is in several documents all but the smallest doc_id get it back for removal; there, repeated
windows merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.tables import own_columns, releasing
from folioflow.llm.wordhash import Words, row_blocks, text_bytes

BATCH_WINDOWS = 1_500_000
RANGE_WINDOWS = 1 << 17
PART_BYTES = 8 << 20


def _first_of_equal(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by hash, beginnings of equal hashes in it, and the smallest owner of each."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, begins, np.minimum.reduceat(owner[order], begins)


def _later(order: np.ndarray, begins: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of hashes whose owner isn't the first."""
    sizes = np.diff(np.append(begins, len(order)))
    return order[owner[order] != np.repeat(first, sizes)]


def _spread_windows(width: int, parts: int):
    """Windows of a task as blocks of (part, doc_ids, counts, hashes); part -1: settled repeats."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, counts, part, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        ids, number = np.unique(keys, return_inverse=True)
        owner = np.repeat(number.astype(np.int32), counts)
        # Equal windows share a part, so ranges of parts are settled one after the other in little memory.
        ranges = min(parts, -(-len(hashes) // RANGE_WINDOWS))
        for k in range(ranges):
            low, high = parts * k // ranges, parts * (k + 1) // ranges
            here = np.flatnonzero((part >= low) & (part < high))
            if len(here):
                yield _batch(settled(ids, owner[here], part[here], hashes[here], low, high))

    def settled(
        ids: np.ndarray, owner: np.ndarray, part: np.ndarray, hashes: np.ndarray, low: int, high: int
    ) -> list[tuple]:
        order, begins, first = _first_of_equal(hashes, owner)
        out: list[tuple] = []
        later = _later(order, begins, first, owner)
        if len(later):
            later = later[np.argsort(owner[later])]
            out.append(_packed(-1, ids, owner[later], hashes[later]))
        kept = order[begins]
        by_part = np.argsort(part[kept].astype(np.int64) * len(ids) + first)
        kept, first = kept[by_part], first[by_part]
        edges = np.searchsorted(part[kept], np.arange(low, high + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            chosen = slice(edges[p], edges[p + 1])
            out.append(_packed(low + p, ids, first[chosen], hashes[kept[chosen]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for low, high in row_blocks(offsets):
                row, _, hashes, second = Words(data, offsets[low : high + 1]).windows(width, second=True)
                if len(hashes):
                    part = ((second >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                    counts = np.bincount(row, minlength=high - low)
                    held.append((keys[low:high].astype(np.int64), counts, part, hashes))
                    size += len(hashes)
                if size >= BATCH_WINDOWS:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    return run


_BLOCK = "part int, ids binary, counts binary, hashes binary"


def _packed(part: int, ids: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> tuple:
    """One block; ``owner`` ascends, ``counts`` says how many hashes each doc_id has."""
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts = np.diff(np.append(begins, len(owner))).astype("<u4")
    return part, ids[owner[begins]].astype("<i8").tobytes(), counts.tobytes(), hashes.astype("<u8").tobytes()


def _batch(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["part", "ids", "counts", "hashes"])


def _unpacked(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray]:
    ids, counts, hashes = (
        np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("ids", "<i8"), ("counts", "<u4"), ("hashes", "<u8"))
    )
    return np.repeat(ids, counts), hashes


def _later_owners(buckets: int):
    """The windows that a smaller doc_id has too, as blocks for buckets of documents.

    The blocks of a task come ordered by part; each part is judged by itself.
    """

    def judged(held: list[tuple], settled: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        if not settled:
            later = _later(*_first_of_equal(hashes, ids), ids)
            ids, hashes = ids[later], hashes[later]
        if not len(ids):
            return
        bucket = np.mod(ids, buckets)
        order = np.lexsort((ids, bucket))
        ids, hashes, bucket = ids[order], hashes[order], bucket[order]
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        keys, owner = np.unique(ids, return_inverse=True)
        spans = zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True)
        yield _batch([_packed(int(bucket[a]), keys, owner[a:z], hashes[a:z]) for a, z in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for r, p in enumerate(batch.column("part").to_pylist()):
                if p != part:
                    yield from judged(held, part == -1)
                    held = []
                part = p
                held.append(_unpacked(batch, r))
                if p == -1:
                    yield from judged(held, True)
                    held = []
        yield from judged(held, part == -1)

    return run


def _next_prime(n: int) -> int:
    """The smallest prime from n on: ids in steps of any size then spread over all buckets."""
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _parts(docs: DataFrame) -> int:
    """One part for every 8 MB of text, never fewer than twice the shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _next_prime(max(2 * partitions, size // PART_BYTES, 2))


def repeated_windows(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Windows to remove, as blocks: bucket (doc_id modulo ``parts``), ids, counts, hashes."""
    rows = own_columns(docs, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks = rows.mapInArrow(releasing(_spread_windows(width, parts)), _BLOCK)
    # Settled repeats (part -1) need no meeting; they are spread by their content.
    place = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.crc32("hashes"), F.lit(parts)))
    return (
        blocks.withColumn("place", place.cast("int"))
        .repartition("place")
        .sortWithinPartitions("part")
        .select("part", "ids", "counts", "hashes")
        .mapInArrow(releasing(_later_owners(parts)), _BLOCK)
        .withColumnRenamed("part", "bucket")
    )


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the words left after removal.

    A word goes if a window of ``width`` words that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. Result: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and ``kept_text``, the text without
    the removed intervals (white space between kept neighbours stays as it was; a text that
    loses nothing stays as it is). One row per input row.

    A null text has no words and a null ``kept_text``. Rows with a null doc_id are kept whole
    and take nothing from others. Rows with equal doc_ids don't take from each other. Extra
    columns are ignored; an empty table gives no rows.
    """
    return _dedup(docs, width, F.lit(None).cast("int")).drop("rest")


def without_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """``docs`` with all its columns, where ``text`` is the ``kept_text`` of ``dedup_substrings``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others))
    kept = _dedup(docs, width, rest)
    return kept.select(
        *(F.col("kept_text").alias("text") if c == "text" else F.col(c if c == "doc_id" else f"rest.`{c}`") for c in docs.columns)
    )


def _dedup(docs: DataFrame, width: int, rest: Column) -> DataFrame:
    """Documents meet their windows bucket by bucket, windows first."""
    rows = docs.select("doc_id", "text", rest.alias("rest"))
    parts = _parts(rows)
    key = F.coalesce(F.col("doc_id").cast("long"), F.crc32(F.coalesce("text", F.lit(""))))
    texts = rows.select(
        F.pmod(key, F.lit(parts)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text", "rest"
    )
    marks = repeated_windows(docs, width, parts).withColumn("kind", F.lit(0))
    fields = {f.name: f for f in rows.schema}
    shape = T.StructType([fields["doc_id"]])
    shape.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    shape.add(fields["rest"])
    return (
        texts.unionByName(marks, allowMissingColumns=True)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "kind")
        .mapInArrow(releasing(_remove(width)), shape)
    )


class _Marks:
    """Windows to remove from the documents of one bucket."""

    def __init__(self) -> None:
        self.blocks: list[tuple] = []
        self.ids = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)

    def settle(self) -> None:
        if self.blocks:
            self.ids, self.hashes = (np.concatenate(x) for x in zip(*self.blocks, strict=True))
            order = np.argsort(self.ids)
            self.ids, self.hashes, self.blocks = self.ids[order], self.hashes[order], []

    def of(self, doc_id: int | None) -> np.ndarray:
        if doc_id is None:
            return self.hashes[:0]
        low, high = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        return self.hashes[low:high]


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, marks = None, _Marks()
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "kind")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                if keys[0, low] != bucket:
                    bucket, marks = keys[0, low], _Marks()
                part = batch.slice(low, high - low)
                if keys[1, low] == 0:
                    marks.blocks += [_unpacked(part, r) for r in range(part.num_rows)]
                    continue
                marks.settle()
                data, offsets = text_bytes(part.column("text"))
                for a, z in row_blocks(offsets):
                    yield _removed(part.slice(a, z - a), Words(data, offsets[a : z + 1]), width, marks)

    return run


def _removed(batch: pa.RecordBatch, words: Words, width: int, marks: _Marks) -> pa.RecordBatch:
    counts = words.counts()
    gone = np.zeros(len(words.start) + 1, np.int32)
    found = {r: m for r, k in enumerate(batch.column("doc_id").to_pylist()) if len(m := marks.of(k))}
    if found:
        row, first, hashes = words.windows(width)
        edges = np.searchsorted(row, np.arange(len(counts) + 1))
        for r, marked in found.items():
            here = slice(edges[r], edges[r + 1])
            begin = first[here][np.isin(hashes[here], marked)]
            gone[begin] += 1
            gone[begin + width] -= 1
    removed = np.cumsum(gone[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    n_removed = total[words.first[1:]] - total[words.first[:-1]]
    texts, digests = [], []
    for r, text in enumerate(batch.column("text")):
        raw = text.as_py()
        digest, kept = _kept(words, removed, r, raw, bool(n_removed[r]))
        digests.append(digest)
        texts.append(kept)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(digests, pa.string()), pa.array(texts, pa.string()), batch.column("rest"),
        ],
        ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "rest"],
    )


def _kept(words: Words, removed: np.ndarray, r: int, text: str | None, any_gone: bool) -> tuple[str, str | None]:
    low, high = int(words.rows[r]), int(words.rows[r + 1])
    raw = words.data[low:high].tobytes()
    if not any_gone:
        return hashlib.sha256(b" ".join(raw.split())).hexdigest(), text
    of = slice(words.first[r], words.first[r + 1])
    gone, start = removed[of], words.start[of] - low
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    # A removed interval runs from its first word to the next kept word.
    starts = np.append(start, len(raw))
    pieces, at = [], 0
    for begin, end in change.reshape(-1, 2).tolist():
        pieces.append(raw[at : starts[begin]])
        at = int(starts[end])
    pieces.append(raw[at:])
    kept = b"".join(pieces)
    return hashlib.sha256(b" ".join(kept.split())).hexdigest(), kept.decode("utf-8")
