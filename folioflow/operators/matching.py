"""Many patterns in many texts at once, with work that grows with the texts, not their product.

Every pattern is known by a rolling hash of its whole length and by one of its first bytes, as
many as the largest power of two it holds. A text is hashed once for each such power; only
where the first bytes of a pattern stand are the lengths of the patterns that begin so tried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

U64 = np.uint64
# Separates texts that are searched together; no UTF-8 text holds it.
BETWEEN = b"\xff"

_BYTE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_UP, _DOWN = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[U64, np.ndarray] = {}


def _power(base: U64, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]))
        _powers[base] = held
    return held[:n]


def byte_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * _power(_UP, len(data)))])


def spread_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(29))


def range_hashes(sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hash of each range of bytes; ranges of different sizes differ."""
    raw = (sums[start + size] - sums[start]) * _power(_DOWN, len(sums))[start]
    return spread_bits(raw + np.asarray(size).astype(U64) * U64(0xD6E8FEB86659FD93))


class Patterns:
    """Distinct, non-empty byte strings to look for."""

    def __init__(self, patterns: Sequence[bytes]) -> None:
        self.patterns = patterns
        data = np.frombuffer(b"".join(patterns), np.uint8)
        size = np.array([len(p) for p in patterns], np.int64)
        start = np.cumsum(size) - size
        sums = byte_sums(data)
        whole = range_hashes(sums, start, size)
        self.order = np.argsort(whole)
        self.whole = whole[self.order]
        # For each power of two: hashes of first bytes, and the lengths of patterns behind each.
        self.levels = []
        level = np.int64(1) << np.int64(np.floor(np.log2(np.maximum(size, 1))))
        for first in np.unique(level):
            of = np.flatnonzero(level == first)
            head = range_hashes(sums, start[of], int(first))
            known = np.unique(np.stack([head, size[of].astype(U64)]), axis=1)
            heads, begins = np.unique(known[0], return_index=True)
            self.levels.append((int(first), heads, np.append(begins, known.shape[1]), known[1].astype(np.int64)))

    def found(self, data: bytes) -> np.ndarray:
        """Numbers of the patterns that stand somewhere in ``data``."""
        raw = np.frombuffer(data, np.uint8)
        sums = byte_sums(raw)
        hits = []
        for first, heads, begins, lengths in self.levels:
            n = len(raw) - first + 1
            if n <= 0:
                continue
            here = range_hashes(sums, np.arange(n), first)
            at = np.minimum(np.searchsorted(heads, here), len(heads) - 1)
            place = np.flatnonzero(heads[at] == here)
            fan = begins[at[place] + 1] - begins[at[place]]
            inside = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
            size = lengths[np.repeat(begins[at[place]], fan) + inside]
            place = np.repeat(place, fan)
            fits = place + size <= len(raw)
            place, size = place[fits], size[fits]
            h = range_hashes(sums, place, size)
            which = np.minimum(np.searchsorted(self.whole, h), len(self.whole) - 1)
            same = self.whole[which] == h
            number, one = np.unique(self.order[which[same]], return_index=True)
            for p, begin in zip(number.tolist(), place[same][one].tolist(), strict=True):
                pattern = self.patterns[p]
                # Equal hashes are looked at once; should they ever lie, a plain search decides.
                if data[begin : begin + len(pattern)] == pattern or pattern in data:
                    hits.append(p)
        return np.array(hits, np.int64)
