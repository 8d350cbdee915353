"""Token counts by heap-and-linked-list byte-pair merging, without ids.

A word starts as its byte symbols. A heap holds the ranks of adjacent pairs; the lowest rank
(leftmost of equals) is popped and merged, its neighbours are linked anew and their pairs
pushed. The count of a word is its symbols less its merges. Counts of words seen before come
from a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import own_columns

CACHE_ENTRIES = 300_000
CACHED_CHARS = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens of texts by the merges of a tokenizer file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.suffix = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        self.words = regex.compile(split["pattern"]["Regex"], regex.V0)
        specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.word_counts = _Cache(self.merge)
        self.chunk_counts = _Cache(self.count_chunk)

    def merge(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n = left = len(symbols)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # An entry is stale when either of its symbols has been merged since.
            if j >= n or symbols[i] is None or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def count_chunk(self, chunk: str) -> int:
        if not chunk:
            return 0
        marks, parts = 0, [chunk]
        if self.specials is not None:
            parts = self.specials.split(chunk)
            marks = len(parts) - 1
        count = self.word_counts.__getitem__
        return marks + sum(sum(map(count, self.words.findall(lowered(p)))) for p in parts)

    def count(self, text: str) -> int:
        """No word spans a space or line end, so what stands between them counts by itself."""
        total = sum(map(self.chunk_counts.__getitem__, text.replace("\n", " ").split(" ")))
        self.word_counts.trim()
        self.chunk_counts.trim()
        return total


def lowered(text: str) -> str:
    """Composed, then lower case letter by letter (no rule for a final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class _Cache(dict):
    """Values by key, computed when missing; long keys are not kept.

    A full cache becomes the older half, from which keys that are asked for come back; the
    half before it goes.
    """

    def __init__(self, compute) -> None:
        self.compute = compute
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CACHED_CHARS:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """One per Python worker, which serves many tasks."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    Whole texts are counted, whatever their length. A null text counts as empty (0 bytes, 0
    tokens); a null or repeated doc_id stays as it is, one result row per input row; extra
    columns are ignored; an empty table gives no rows. ``vocabulary`` is the path of the
    tokenizer file on every executor. One pass, no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = counter(vocabulary).count
        for batch in batches:
            texts = batch.column("text")
            tokens = [count_one(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = own_columns(docs, "doc_id", "text").withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
