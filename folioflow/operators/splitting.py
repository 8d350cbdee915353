"""Splitting documents into chunks, numbering, bounds and checks on chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import strip, token_windows, words
from folioflow.operators.matching import BETWEEN, Patterns
from folioflow.operators.scale import broadcast_if_small, each
from folioflow.session import stored

SECTIONS_HELD = 65_536
SEARCH_BYTES = 1 << 20
# Sections times bytes up to which a plain search of each section is quicker than hashes.
PLAIN_SEARCH = 1 << 22
HELD_CHARS = 1 << 22

# Separators of the recursive split, tried in this order.
SEPARATORS = ("\n\n", "\n", " ", "")


Length = Callable[[str], int]


def _cut(part: str, size: int, length: Length) -> Iterator[str]:
    """Runs of characters no longer than ``size``; a single character is never cut."""
    if length is len:
        yield from (part[i : i + size] for i in range(0, len(part), size))
        return
    todo = [part]
    while todo:
        part = todo.pop()
        if length(part) <= size or len(part) == 1:
            yield part
        else:
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]


def _pieces(text: str, size: int, separators: Sequence[str], length: Length) -> Iterator[str]:
    """The text in order, cut into pieces no longer than ``size``."""
    todo = [(text, 0)]
    while todo:
        part, level = todo.pop()
        if length(part) <= size:
            yield part
            continue
        while separators[level] and separators[level] not in part:
            level += 1
        mark = separators[level]
        if not mark:
            yield from _cut(part, size, length)
            continue
        first, *rest = part.split(mark)
        cuts = [first, *(mark + r for r in rest)]
        todo.extend((c, level + 1) for c in reversed(cuts) if c)


def recursive_chunks(
    text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS,
    length: Length = len,
) -> Iterator[str]:
    """Pieces packed up to ``size``; at most ``overlap`` of it repeats in the next chunk.

    ``length`` measures a text, in characters unless it says otherwise; the length of a chunk
    is the sum of those of its pieces.
    """
    held: deque[tuple[str, int]] = deque()
    total = 0
    for piece in _pieces(text, size, separators, length):
        n = length(piece)
        if total + n > size:
            chunk = "".join(p for p, _ in held).strip()
            if chunk:
                yield chunk
            while held and (total > overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((piece, n))
        total += n
    chunk = "".join(p for p, _ in held).strip()
    if chunk:
        yield chunk


def count_words(text: str) -> int:
    """A length for ``recursive_chunks``: white-space separated words."""
    return len(text.split())


def split_recursive(
    df: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text", length: Length = len
) -> DataFrame:
    """Chunk rows by the recursive rule, measured by ``length``; other columns are copied."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")

    rest = [f for f in df.schema if f.name != text]
    names = [f.name for f in rest]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, number, found in _some_chunks(batch.column(text), size, overlap, length):
                rows = batch.select(names).take(pa.array(of, pa.int64()))
                made = [pa.array(number, pa.int32()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], [*names, "chunk_index", "chunk_text"])

    shape = T.StructType(rest).add("chunk_index", "integer").add("chunk_text", "string")
    return _with_chunk_id(df.select(*(f"`{n}`" for n in names), F.col(text)).mapInArrow(chunks, shape))


def _some_chunks(
    texts: pa.Array, size: int, overlap: int, length: Length
) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(row, number, chunk) lists of at most ``HELD_CHARS`` and one chunk; no text's chunks are held at once."""
    of: list[int] = []
    number: list[int] = []
    found: list[str] = []
    held = 0
    for i, value in enumerate(texts):
        for n, chunk in enumerate(recursive_chunks(value.as_py() or "", size, overlap, length=length)):
            of.append(i)
            number.append(n)
            found.append(chunk)
            held += len(chunk)
            if held >= HELD_CHARS:
                yield of, number, found
                of, number, found, held = [], [], [], 0
    if of:
        yield of, number, found


@F.udtf(returnType="chunk_index int, chunk_text string")
class RecursiveChunks:
    """Table function form of ``split_recursive``: chunks of a text one by one, as rows.

    Arguments: text, size, overlap, and the unit of both, ``chars`` (default) or ``words``.
    """

    def eval(self, text: str, size: int = 1000, overlap: int = 200, unit: str = "chars"):
        if not 0 <= overlap < size:
            raise ValueError("overlap must be at least 0 and smaller than size")
        length = {"chars": len, "words": count_words}[unit]
        yield from enumerate(recursive_chunks(text or "", size, overlap, length=length))


def register_functions(spark: SparkSession) -> None:
    """Makes ``recursive_chunks(text, size, overlap, unit)`` known to SQL, for LATERAL joins."""
    spark.udtf.register("recursive_chunks", RecursiveChunks)


def split_tokens(
    df: DataFrame, size: int = 256, overlap: int = 128, text: str = "text"
) -> DataFrame:
    """Chunk rows by overlapping token windows; other columns are copied."""
    toks = df.withColumn("_toks", words(text)).drop(text)
    return number_chunks(
        toks.withColumn("_chunks", token_windows(F.col("_toks"), size, overlap)).drop("_toks"),
        "_chunks",
    )


def split_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-empty sentence, cut at the full stop."""
    parts = F.transform(F.split(F.col(text), r"\."), lambda s: strip(s))
    full = F.filter(parts, lambda s: s != "")
    return number_chunks(df.withColumn("_chunks", full).drop(text), "_chunks")


def number_chunks(df: DataFrame, chunks: str, key: str = "doc_id") -> DataFrame:
    """Array of chunk texts to rows with ordinal and a chunk id unique in the table."""
    rest = [c for c in df.columns if c != chunks]
    return _with_chunk_id(each(df, rest, chunks, "chunk_text", "chunk_index"), key)


def _with_chunk_id(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.withColumn(
        "chunk_id", F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_index").cast("string"))
    )


def cap_chunks_per_document(chunks: DataFrame, n: int) -> DataFrame:
    """Ordinals are dense, so the cap is a filter."""
    return chunks.filter(F.col("chunk_index") < n)


def cap_chunks(chunks: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """First ``n`` chunks of the whole table in document order."""
    return chunks.orderBy(key, "chunk_index").limit(n)


def split_with_retry(
    df: DataFrame, size: int = 256, overlap: int = 128, max_chars: int = 2000, text: str = "text"
) -> DataFrame:
    """Token split; a document with an over-long window is split again with half the size.

    Floors are 100 tokens and 10 tokens of overlap. ``status`` tells ``ok``, ``retried``
    or ``failed``; a document that still fails keeps its chunks for the failure table.
    """
    half, half_overlap = max(100, size // 2), max(10, overlap // 2)
    def too_long(c):
        return F.exists(c, lambda w: F.length(w) > max_chars)

    first = df.withColumn("_toks", words(text)).drop(text)
    first = first.withColumn("_first", token_windows(F.col("_toks"), size, overlap))
    tried = first.withColumn("_bad", too_long(F.col("_first"))).withColumn(
        "_chunks",
        F.when(F.col("_bad"), token_windows(F.col("_toks"), half, half_overlap)).otherwise(
            F.col("_first")
        ),
    )
    status = (
        F.when(~F.col("_bad"), "ok").when(too_long(F.col("_chunks")), "failed").otherwise("retried")
    )
    return number_chunks(
        tried.withColumn("status", status).drop("_toks", "_first", "_bad"), "_chunks"
    )


def bound_chunks(chunks: DataFrame, low: int = 100, high: int = 2000) -> DataFrame:
    return chunks.filter(F.length("chunk_text").between(low, high))


def line_sections(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sections of a document: its distinct non-empty lines, white space made single."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda s: F.array_join(words(s), " "))
    full = F.array_distinct(F.filter(lines, lambda s: s != ""))
    return each(df, [key], full, "section")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections of a document, and whether they stand in its chunks, which stream past behind them."""
    of: tuple | None = None
    kind: pa.DataType | None = None
    sections: dict[bytes, int] = {}
    patterns: Patterns | None = None
    left: set[bytes] = set()
    held: list[bytes] = []
    size = 0
    out: tuple[list, ...] = ([], [], [], [])

    def search() -> None:
        nonlocal patterns, held, size
        data = BETWEEN.join(held)
        if len(left) * len(data) <= PLAIN_SEARCH:
            left.difference_update([s for s in left if s in data])
        else:
            if patterns is None:
                patterns = Patterns(list(sections))
            left.difference_update([patterns.patterns[p] for p in patterns.found(data).tolist()])
        held, size = [], 0

    def close() -> None:
        if held:
            search()
        out[0].extend([of[0]] * len(sections))
        out[1].extend(s.decode("utf-8") for s in sections)
        out[2].extend(sections.values())
        out[3].extend(s not in left for s in sections)

    def judged() -> pa.RecordBatch:
        kinds = (kind, pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["key", "section", "copies", "found"]
        )

    for batch in batches:
        kind = batch.schema.field("key").type
        for key, slot, chunk, body in zip(
            *(batch.column(c).to_pylist() for c in ("key", "slot", "chunk", "body")), strict=True
        ):
            if of != (key, slot):
                if sections:
                    close()
                of, sections, patterns, left, held, size = (key, slot), {}, None, set(), [], 0
            if not chunk:
                sections[body] = sections.get(body, 0) + 1
                left.add(body)
            elif left:
                held.append(body)
                size += len(body)
                if size >= SEARCH_BYTES:
                    search()
        yield judged()
        out = ([], [], [], [])
    if sections:
        close()
        yield judged()


def judged_sections(chunks: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct sections of each document, the number of their rows (``copies``) and whether they
    occur whole in some chunk of it (``found``).

    A task holds the sections of a document, at most ``SECTIONS_HELD``, and searches its chunks
    for all of them at once. Where a key has more, they are dealt into slots, and its chunks go
    to each. Rows without a key, empty sections and null sections find nothing; they are not made
    distinct. ``sections`` is read several times.
    """
    named = sections.select(F.col(key).alias("key"), "section")
    sought = F.coalesce(F.expr("key IS NOT NULL AND section <> ''"), F.lit(False))
    wanted, rest = named.filter(sought), named.filter(~sought)
    counts = wanted.groupBy("key").agg(F.ceil(F.count("*") / SECTIONS_HELD).cast("int").alias("slots"))
    many = broadcast_if_small(counts.filter("slots > 1"))
    slots = F.coalesce("slots", F.lit(1))
    left = wanted.join(many, "key", "left").select(
        "key", F.pmod(F.xxhash64("section"), slots).cast("int").alias("slot"), F.lit(False).alias("chunk"),
        F.col("section").cast("binary").alias("body"),
    )
    texts = chunks.select(F.col(key).alias("key"), F.col("chunk_text").cast("binary").alias("body"))
    right = texts.filter("key IS NOT NULL AND body IS NOT NULL").join(many, "key", "left").select(
        "key", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), F.lit(True).alias("chunk"), "body"
    )
    shape = T.StructType([T.StructField("key", named.schema["key"].dataType)])
    shape.add("section", "string").add("copies", "long").add("found", "boolean")
    judged = (
        left.unionByName(right)
        .repartition("key", "slot")
        .sortWithinPartitions("key", "slot", "chunk")
        .mapInArrow(_judged, shape)
    )
    unsought = rest.select("key", "section", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("found"))
    return judged.unionByName(unsought).withColumnRenamed("key", key)


def found_sections(chunks: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections that occur whole in some chunk of their document, one row each."""
    return judged_sections(chunks, sections, key).filter("found").select(key, "section")


def section_preservation(chunks: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Percentage of sections kept, per document."""
    judged = judged_sections(chunks, stored(sections.select(key, "section"), "sections"), key)
    kept, every = F.sum(F.when(F.col("found"), F.col("copies")).otherwise(0)), F.sum("copies")
    return judged.groupBy(key).agg(
        every.alias("sections"), kept.alias("preserved"), (kept / every * 100).alias("preservation_rate")
    )


def missing_sections(chunks: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of sections that no chunk of their document holds."""
    sections = stored(sections, "sections")
    if set(sections.columns) != {key, "section"}:
        return sections.join(found_sections(chunks, sections, key), [key, "section"], "left_anti")
    missing = judged_sections(chunks, sections, key).filter("NOT found")
    every = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return missing.select(key, "section", every.alias("_")).drop("_")


def chunk_overlap(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words shared by each chunk with the one after it (equi join on the ordinal)."""
    bags = chunks.select(key, "chunk_index", F.array_distinct(words("chunk_text")).alias("_bag"))
    after = bags.select(
        key, (F.col("chunk_index") - 1).alias("chunk_index"), F.col("_bag").alias("_next")
    )
    return bags.join(after, [key, "chunk_index"]).select(
        key,
        "chunk_index",
        F.size(F.array_intersect("_bag", "_next")).alias("shared_words"),
    )


