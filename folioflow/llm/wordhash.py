"""Vectorised word and window hashes over Arrow text columns, used inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes. A word's hash is a Rabin-Karp sum of
its bytes modulo 2**64, mixed at the end; a window's hash is the same sum over the hashes of
its words. All steps run over whole blocks of documents with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = (~_SPACE).astype(np.uint8)
# Letters, digits and all of a multi-byte character; the other bytes end a word.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Base:
    """Powers of an odd multiplier and of its inverse modulo 2**64, kept up to a length."""

    def __init__(self, multiplier: int) -> None:
        self.up_by, self.down_by = U64(multiplier), U64(pow(multiplier, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, by, U64)]))
                for by in (self.up_by, self.down_by)
            )

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Weighted prefix sums; ``part`` turns two of them into the hash of a range."""
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def part(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


BYTES = Base(0x9E3779B97F4A7C15)
WINDOW = Base(0xD1342543DE82EF95)
SECOND = Base(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row that is longer."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


class Words:
    """Words of a range of rows: hash, byte range, and the first word of each row."""

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray = _WORD
    ) -> None:
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        self.rows = offsets - base
        inside = inside[self.data]
        cuts = np.unique(self.rows[(self.rows > 0) & (self.rows < len(self.data))])
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        if len(inside):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[cuts], after[cuts - 1] = 0, 0
        self.start = np.flatnonzero(inside > before)
        self.end = np.flatnonzero(inside > after) + 1
        self.first = np.searchsorted(self.start, self.rows)
        text = _LOWER[self.data] if lower else self.data
        self.hash = np.empty(len(self.start), U64)
        # Slices cut between words bound the memory of a very long text.
        at = 0
        while at < len(self.start):
            low = int(self.start[at])
            to = max(int(np.searchsorted(self.end, low + BLOCK_BYTES, side="right")), at + 1)
            sums = BYTES.sums(_BYTE[text[low : int(self.end[to - 1])]])
            self.hash[at:to] = mix(BYTES.part(sums, self.start[at:to] - low, self.end[at:to] - low))
            at = to

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, width: int, whole_if_shorter: bool = False, second: bool = False):
        """Windows of ``width`` words within a row: row, first word, hash (and a second hash).

        A row with fewer words has no window or, with ``whole_if_shorter``, its whole
        sequence as one, with a hash of its own kind.
        """
        n = self.counts()
        each = np.maximum(n - width + 1, 0)
        if whole_if_shorter:
            each = np.where((n > 0) & (n < width), 1, each)
        row = np.repeat(np.arange(len(n)), each)
        begin = np.cumsum(each) - each
        first = self.first[:-1][row] + np.arange(len(row)) - begin[row]
        size = np.minimum(n[row], width)
        sums = WINDOW.sums(self.hash)
        hashes = mix(WINDOW.part(sums, first, first + size) + size.astype(U64))
        if not second:
            return row, first, hashes
        sums = SECOND.sums(self.hash)
        return row, first, hashes, mix(SECOND.part(sums, first, first + size) ^ size.astype(U64))
