"""Best-fit packing of token pieces into sequences of bounded length.

Every task packs the pieces of its own partition online: of a fixed number of open bins the
one with the least free space that suffices takes the piece; if none does, a new bin is
opened, and at the limit the fullest open bin closes first. Open bins are found in a bitset
keyed by free space. What is still in open bins when a partition ends is packed again, for
groups of partitions together, so that small partitions leave no half-filled sequences; there
are then as many bins as the partitions of a group had together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import own_columns, releasing, written
from folioflow.llm.token_ids import encoder

OPEN_BINS = 256
GROUP = 64
PIECE = "piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """A fixed number of open bins; a bit of ``free`` is set if some bin has that free space."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.free, self.open = 0, 0
        self.by_free: list[list] = [[] for _ in range(capacity + 1)]

    def place(self, item: object, length: int) -> tuple[list[tuple[object, int]], ...]:
        """Puts an item into a bin; gives the bins that closed, as lists of (item, offset)."""
        closed = []
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.open >= self.most:
                fullest = (self.free & -self.free).bit_length() - 1
                closed.append(self._take(fullest))
            space, chosen = self.capacity, []
        chosen.append((item, self.capacity - space))
        space -= length
        if space == 0:
            closed.append(chosen)
        else:
            self.by_free[space].append(chosen)
            self.free |= 1 << space
            self.open += 1
        return tuple(closed)

    def _take(self, space: int) -> list:
        bins = self.by_free[space]
        chosen = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return chosen

    def rest(self) -> Iterator[list[tuple[object, int]]]:
        for bins in self.by_free:
            yield from bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first piece may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [0] * (first > 0) + list(range(first, n, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


def _pieces(vocabulary: str, end_id: int, capacity: int) -> Callable[[Iterator], Iterator[pa.RecordBatch]]:
    """Pieces of every document of a task: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                row, number, start, length, crc = [], [], [], [], []
                for r, text in enumerate(batch.column("text")):
                    ids = coder.encode(text.as_py() or "") + end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        row.append(r)
                        number.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
                    + [pa.array(v, pa.int64()) for v in (start, length, crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        finally:
            coder.forget()

    return run


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, open_bins: int = OPEN_BINS
) -> DataFrame:
    """Places every piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null or empty text is one piece, the end id. A text of any length is cut into pieces of
    ``capacity`` ids. Null and repeated doc_ids keep one set of pieces for each row. An empty
    table gives no rows, extra columns are ignored. Sequences are gapless from offset 0.
    The first pass is written to the shared folder, so that a lost executor can't deal a
    piece to two sequences.
    """
    rows = own_columns(docs, "doc_id", "text")
    cut_up = _pieces(vocabulary, end_id, capacity)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, {PIECE}, sequence_id long, offset long, source int"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        bins, made = OpenBins(capacity, open_bins), 0
        held: dict[int, pa.RecordBatch] = {}  # batches with pieces in open bins
        waiting: dict[int, int] = {}
        for number, batch in enumerate(cut_up(batches)):
            held[number], waiting[number] = batch, batch.num_rows
            lengths = batch.column("length").to_numpy()
            out: list[tuple[int, int, int, int]] = []
            for r in np.argsort(-lengths, kind="stable").tolist():
                for full in bins.place((number, r), int(lengths[r])):
                    sequence = (here << 33) + made
                    made += 1
                    out += [(b, i, sequence, at) for (b, i), at in full]
            yield from _placed(out, held, waiting, here)
        left = [(b, i, None, None) for one in bins.rest() for (b, i), _ in one]
        yield from _placed(left, held, waiting, here)

    # Texts are cut and placed by one worker: a second mapInArrow would keep two workers for every task.
    done = written(rows.mapInArrow(releasing(first_pass), shape), "packed")

    names = done.columns

    def second_pass(left: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("source", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")]
        left = left.sort_by(order)
        # Ids of the second pass follow those of the group's first partition, above 2**32.
        first, made = (pc.min(left.column("source")).as_py() << 33) + (1 << 32), 0
        bins = OpenBins(capacity, GROUP * open_bins)
        sequence, offset = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)

        def close(one: list[tuple[int, int]]) -> None:
            nonlocal made
            for i, at in one:
                sequence[i], offset[i] = first + made, at
            made += 1

        for i, length in enumerate(left.column("length").to_pylist()):
            for one in bins.place(i, length):
                close(one)
        for one in bins.rest():
            close(one)
        made_columns = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
        return pa.table({name: made_columns.get(name, left.column(name)) for name in names})

    closed = done.filter("sequence_id IS NOT NULL")
    again = (
        done.filter("sequence_id IS NULL")
        .groupBy(F.floor(F.col("source") / GROUP).alias("_group"))
        .applyInArrow(second_pass, done.schema)
    )
    return closed.unionByName(again).drop("source")


def _placed(
    out: list[tuple], held: dict[int, pa.RecordBatch], waiting: dict[int, int], here: int
) -> Iterator[pa.RecordBatch]:
    """Rows of the placed pieces, batch by batch; batches with no piece left are let go."""
    by_batch: dict[int, list[tuple]] = {}
    for b, i, sequence, at in out:
        by_batch.setdefault(b, []).append((i, sequence, at))
    for b, rows in by_batch.items():
        index = pa.array([r[0] for r in rows], pa.int64())
        columns = [c.take(index) for c in held[b].columns]
        yield pa.RecordBatch.from_arrays(
            [
                *columns,
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([here] * len(rows), pa.int32()),
            ],
            [*held[b].schema.names, "sequence_id", "offset", "source"],
        )
        waiting[b] -= len(rows)
        if not waiting[b]:
            del held[b], waiting[b]
