"""Bigram counts of texts, and sums of functions of them per row, in packed blocks.

Words and pairs of neighbours are known by 64-bit hashes. Tasks add up the counts of their own
batch before they leave. To be scored, a text's hashes travel as packed blocks past the counts,
of which a task holds one bounded group; only one sum for each row and group comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import words
from folioflow.operators.matching import U64, byte_sums, range_hashes, spread_bits
from folioflow.session import stored

BLOCK_BYTES = 1 << 20
BATCH_WORDS = 1 << 20
PART_BYTES = 16 << 20
GROUP_ITEMS = 4 << 20

_FIRST, _NEXT = U64(0xD1342543DE82EF95), U64(0xC2B2AE3D27D4EB4F)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, first word of each row, word hashes, whether another word follows) of some rows.

    Words stand one space apart.
    """
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    if not len(texts) or data is None:
        return
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    low, rows = 0, len(texts)
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, *_hashed(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def _hashed(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = data != 32
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = rows[(rows > 0) & (rows < len(data))]
    opens[cuts], closes[cuts - 1] = inside[cuts], inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, rows)
    hashes = np.empty(len(start), U64)
    # Slices cut between words bound the memory of a very long text.
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(int(np.searchsorted(end, low + BLOCK_BYTES, side="right")), at + 1)
        sums = byte_sums(data[low : int(end[to - 1])])
        hashes[at:to] = range_hashes(sums, start[at:to] - low, end[at:to] - start[at:to])
        at = to
    follows = np.ones(len(start), bool)
    follows[first[1:][first[1:] > first[:-1]] - 1] = False
    return first, hashes, follows


def _pairs(hashes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(follows)
    return spread_bits(hashes[at] * _FIRST + hashes[at + 1] * _NEXT)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U64(33)) % U64(parts)).astype(np.int32)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


_COUNTS = ["part", "single", "hashes", "counts"]
_COUNT_KINDS = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
_COUNT_SHAPE = "part int, single boolean, hashes binary, counts binary"


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the sums of their counts."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[begins], np.add.reduceat(counts[order].astype(np.int64), begins)


def _count_blocks(parts: int):
    """Counts of a batch of words as rows of ``_COUNTS``; a word counts where another follows."""

    def dealt(single: bool, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        if not len(hashes):
            return
        hashes, counts = _summed(hashes, counts)
        part = _part(hashes, parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            of = order[edges[p] : edges[p + 1]]
            yield p, single, hashes[of].astype("<u8").tobytes(), counts[of].astype("<u4").tobytes()

    def flush(held: list[tuple]) -> pa.RecordBatch:
        single, follows, pair = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = [*dealt(True, single, follows), *dealt(False, pair, np.ones(len(pair), np.uint8))]
        return _batch(rows, _COUNTS, _COUNT_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for _, _, hashes, follows in _blocks(batch.column("body")):
                held.append((hashes, follows, _pairs(hashes, follows)))
                size += len(hashes)
                if size >= BATCH_WORDS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part and kind; they come in order."""

    def whole(of: tuple, held: list[tuple]) -> pa.RecordBatch:
        hashes, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        row = (*of, hashes.astype("<u8").tobytes(), counts.astype("<i8").tobytes())
        return _batch([row], _COUNTS, _COUNT_KINDS)

    of, held = None, []
    for batch in batches:
        for r, cell in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "single")), strict=True)):
            if cell != of:
                if held:
                    yield whole(of, held)
                of, held = cell, []
            # Copies, since a batch would stay whole behind a view of it.
            held.append(tuple(_read(batch, c, r, t).copy() for c, t in (("hashes", "<u8"), ("counts", "<u4"))))
    if held:
        yield whole(of, held)


def _read(batch: pa.RecordBatch, column: str, r: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(column)[r].as_buffer(), kind)


def _score_blocks(parts: int, groups: int):
    """Hashes of rows, dealt to groups: (group, single, keys, counts, hashes); a key has counts[i] hashes."""

    def dealt(single: bool, keys: pa.Array, row: np.ndarray, hashes: np.ndarray) -> Iterator[tuple]:
        group = _part(hashes, parts) % groups
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(edges)).tolist():
            of = order[edges[g] : edges[g + 1]]
            rows = row[of]
            begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            counts = np.diff(np.append(begins, len(rows))).astype("<u4")
            yield g, single, rows[begins], counts.tobytes(), hashes[of].astype("<u8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for low, first, hashes, follows in _blocks(batch.column("body")):
                row = low + np.repeat(np.arange(len(first) - 1), np.diff(first))[follows]
                if not len(row):
                    continue
                rows = [
                    *dealt(True, keys, row, hashes[follows]),
                    *dealt(False, keys, row, _pairs(hashes, follows)),
                ]
                group, single, of, counts, packed = zip(*rows, strict=True)
                ends = np.cumsum([0, *map(len, of)])
                listed = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), keys.take(pa.array(np.concatenate(of)))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group, pa.int32()), pa.array(single, pa.bool_()), listed,
                        pa.array(counts, pa.binary()), pa.array(packed, pa.binary()),
                    ],
                    ["group", "single", "keys", "counts", "hashes"],
                )

    return run


class _Table:
    """Values of hashes; ``none`` for those it lacks."""

    def __init__(self, held: list[tuple], value: Callable[[np.ndarray], np.ndarray]) -> None:
        self.hashes, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        if held:
            self.hashes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(self.hashes)
            self.hashes, counts = self.hashes[order], counts[order]
        with np.errstate(divide="ignore"):
            self.values, self.none = value(counts), float(value(np.zeros(1, np.int64))[0])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.none)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], self.none)


def _sums(k: float, vocabulary: int):
    """(key, bigrams, total) of each block; the counts of a group come before its blocks."""
    values = {
        True: lambda n: -np.log(n + k * vocabulary),
        False: lambda n: np.log(n + k),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, tables = None, {}, {}
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("group", "kind", "single")), strict=True)
            for r, (group, kind, single) in enumerate(cells):
                if group != of:
                    of, held, tables = group, {True: [], False: []}, {}
                if kind == 0:
                    held[single].append(tuple(_read(batch, c, r, t).copy() for c, t in (("hashes", "<u8"), ("counts", "<i8"))))
                    continue
                if not tables:
                    tables = {s: _Table(held[s], values[s]) for s in (True, False)}
                    held = {True: [], False: []}
                counts = _read(batch, "counts", r, "<u4").astype(np.int64)
                found = tables[single].of(_read(batch, "hashes", r, "<u8"))
                total = np.add.reduceat(found, np.cumsum(counts) - counts)
                bigrams = np.zeros(len(counts), np.int64) if single else counts
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[r].values, pa.array(bigrams), pa.array(total)], ["key", "bigrams", "total"]
                )

    return run


def _bodies(df: DataFrame, text: str, *others: Column) -> DataFrame:
    """Lower-cased words of a text, one space apart."""
    body = F.array_join(words(F.lower(text)), " ")
    return df.select(*others, body.alias("body")).filter("body IS NOT NULL")


def bigram_logs(
    train: DataFrame, df: DataFrame, key: str, text: str, k: float
) -> tuple[DataFrame, int]:
    """Rows (key, bigrams, total) whose sums per key are a text's number of bigrams and the logarithm
    of its probability under add-k bigrams of the training rows; and the size of the vocabulary.

    A bigram's logarithm is that of its count less that of its first word, so both are looked up
    apart, each by its own hash, and neither needs the other.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = train.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    parts = max(2 * cores, -(-size // PART_BYTES))
    counted = (
        _bodies(train, text)
        .mapInArrow(_count_blocks(parts), _COUNT_SHAPE)
        .repartition("part")
        .sortWithinPartitions("part", "single")
        .mapInArrow(_merged, _COUNT_SHAPE)
    )
    counted = stored(counted, "bigrams")
    items = F.octet_length("hashes").cast("long") / 8
    known = counted.agg(F.sum(items).alias("all"), F.sum(F.when(F.col("single"), items)).alias("v")).first()
    vocabulary = int(known["v"] or 0)
    groups = min(parts, max(2 * cores, -(-int(known["all"] or 0) // GROUP_ITEMS)))
    held = counted.withColumn("group", F.col("part") % groups).withColumn("kind", F.lit(0)).drop("part")
    kind = df.schema[key].dataType
    shape = T.StructType().add("group", "integer").add("single", "boolean").add("keys", T.ArrayType(kind))
    asked = _bodies(df, text, F.col(key).alias("key")).mapInArrow(
        _score_blocks(parts, groups), shape.add("counts", "binary").add("hashes", "binary")
    )
    both = asked.withColumn("kind", F.lit(1)).unionByName(held, allowMissingColumns=True)
    sums = (
        both.repartitionById(groups, F.col("group"))
        .sortWithinPartitions("group", "kind")
        .select("group", "kind", "single", "keys", "counts", "hashes")
        .mapInArrow(_sums(k, vocabulary), T.StructType().add("key", kind).add("bigrams", "long").add("total", "double"))
    )
    return sums, vocabulary
