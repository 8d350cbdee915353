"""Token files: ids of all documents in ascending doc_id order, bit-packed at a fixed width.

A file set is a table of blocks in the shared folder: ``shard`` (a range of doc_ids),
``block`` (order within the shard), ``first`` (ids before it in the shard), ``n_ids``,
``bits`` (of each id), ``doc_id`` and ``lengths`` of its documents, and ``packed``, the ids one
after the other in so many bits, least bit first. A block holds whole documents and closes at
``BLOCK_IDS`` ids. Block offsets give random access; unpacking is one numpy step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.order import range_of, range_starts
from folioflow.llm.tables import own_columns
from folioflow.llm.token_ids import encoder
from folioflow.session import scratch_path

BLOCK_IDS = 1 << 16
_STEP = 1 << 16  # ids packed or unpacked at a time; a multiple of 64, so steps begin on whole words
_PLAIN = {8: "<u1", 16: "<u2", 32: "<u4"}


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least bit first.

    Whole bytes are a plain view. Other widths go by rows of 64 ids, which fill ``bits`` words.
    """
    if bits in _PLAIN:
        return ids.astype(_PLAIN[bits]).tobytes()
    out = []
    for at in range(0, len(ids), _STEP):
        step = ids[at : at + _STEP].astype(np.uint64)
        rows = np.zeros((-(-len(step) // 64), 64), np.uint64)
        rows.ravel()[: len(step)] = step
        words = np.zeros((len(rows), bits), "<u8")
        for j in range(64):
            word, shift = divmod(j * bits, 64)
            words[:, word] |= rows[:, j] << np.uint64(shift)
            if shift + bits > 64:
                words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
        out.append(words.tobytes()[: -(-len(step) * bits // 8)])
    return b"".join(out)


def unpack_bits(packed: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block, reading only their bytes."""
    if bits in _PLAIN:
        return np.frombuffer(packed, _PLAIN[bits], count, start * bits // 8).astype("<u4")
    out = np.empty(count, "<u4")
    for at in range(0, count, _STEP):
        n = min(_STEP, count - at)
        bit = (start + at) * bits
        raw = np.frombuffer(packed, np.uint8, -(-(bit % 8 + n * bits) // 8), bit // 8)
        # An id of up to 32 bits lies within five bytes.
        raw = np.concatenate([raw, np.zeros(5, np.uint8)])
        place = bit % 8 + np.arange(n) * bits
        held = np.zeros(n, np.uint64)
        for k in range(5):
            held |= raw[(place >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        out[at : at + n] = (held >> (place & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return out


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the blocks to ``path``.

    Each row gives its ids and the end id; a null or empty text gives the end id alone. Rows
    are ordered by doc_id, then text, null doc_ids before all others. An empty table gives an
    empty file set. One shuffle of the texts by ranges of ids; a retried task writes the same
    blocks.
    """
    rows = own_columns(docs, "doc_id", "text")
    starts = range_starts(rows, "doc_id")
    id_type = rows.schema["doc_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        bits = bits_for(max(code.vocabulary, end_id + 1))
        shard = block = first = held = None
        ids: list[bytes] = []
        keys: list = []

        def close() -> pa.RecordBatch:
            nonlocal block, first, held
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = {
                "shard": [shard], "block": [block], "first": [first], "n_ids": [len(flat)], "bits": [bits],
                "doc_id": [list(keys)], "lengths": [[len(x) // 4 for x in ids]], "packed": [pack_bits(flat, bits)],
            }
            block, first, held = block + 1, first + len(flat), 0
            ids.clear()
            keys.clear()
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        arrow = None
        for batch in batches:
            arrow = arrow or _block_schema(batch.schema.field("doc_id").type)
            for of, key, text in zip(*(batch.column(c) for c in ("shard", "doc_id", "text")), strict=True):
                if (of := of.as_py()) != shard:
                    if ids:
                        yield close()
                    shard, block, first, held = of, 0, 0, 0
                one = code.encode(text.as_py() or "") + end
                if ids and held + len(one) // 4 > BLOCK_IDS:
                    yield close()
                ids.append(one)
                keys.append(key.as_py())
                held += len(one) // 4
        if ids:
            yield close()

    (
        rows.withColumn("shard", range_of(F.col("doc_id"), starts).cast("int"))
        .repartition(max(1, len(starts)), "shard")
        .sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
        .mapInArrow(encode, _block_shape(id_type.simpleString()))
        .write.option("compression", "none")
        .parquet(path)
    )


def _block_shape(id_type: str) -> str:
    return (
        "shard int, block int, first long, n_ids long, bits int, "
        f"doc_id array<{id_type}>, lengths array<long>, packed binary"
    )


def _block_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64())]
        + [("bits", pa.int32()), ("doc_id", pa.list_(id_type)), ("lengths", pa.list_(pa.int64()))]
        + [("packed", pa.binary())]
    )


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids of all blocks before.

    Only one number for each shard meets in one task; their count is bounded by the list of
    ranges that was built when writing.
    """
    table = spark.read.parquet(path)
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return table.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids_crc32, and on request ``ids``."""
    table = blocks(spark, path)
    id_type = table.schema["doc_id"].dataType.elementType.simpleString()
    shape = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    shape += ", ids array<long>" if with_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in ("start", "n_ids", "bits", "lengths", "packed")}
                lengths = np.array(one["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                packed = memoryview(one["packed"].as_buffer())
                ids = unpack_bits(packed, one["bits"].as_py(), 0, one["n_ids"].as_py())
                raw = memoryview(ids).cast("B")
                spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
                columns = [
                    batch.column("doc_id")[r].values,
                    pa.array(one["start"].as_py() + ends - lengths),
                    pa.array(lengths),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    picked = table.select("start", "n_ids", "bits", "doc_id", "lengths", "packed")
    return picked.mapInArrow(decode, shape)


def read_span(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of the whole file set, from the blocks that hold them."""
    found = blocks(spark, path).filter(
        (F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start)
    )
    out = np.zeros(count, np.uint32)
    for row in found.select("start", "n_ids", "bits", "packed").toLocalIterator():
        low, high = max(start, row["start"]), min(start + count, row["start"] + row["n_ids"])
        out[low - start : high - start] = unpack_bits(row["packed"], row["bits"], low - row["start"], high - low)
    return out


def scratch_files(spark: SparkSession) -> str:
    return scratch_path(spark, "llm-token-files")
