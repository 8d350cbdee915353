"""Quality rules on repetition within a text, by suffix arrays over its words.

The words of a block of texts are sorted by all that follows them in their text (prefix
doubling; only words that still tie are sorted again). Longest common prefixes of neighbours
come from window hashes. The intervals of that list are the repeated word sequences; those
that can't be extended to either side are maximal. The union of their spans, as a share of
the text, and the longest of them decide, together with plain counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.tables import own_columns
from folioflow.llm.wordhash import U64, WINDOW, Words, mix, row_blocks, text_bytes

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
LEAST_WORDS = 50
PHRASE = 3
REPEAT = 8  # words of a repeat that counts for the verdict
MOST_COVERED = 0.3  # share of a text's words in such repeats
LONGEST = 200  # words of a repeat that is never accepted


class Suffixes:
    """Suffix array and longest common prefixes over the words of all rows of a block.

    Words of different rows are different symbols, so no common prefix crosses rows. The
    order of symbols is that of their hashes: any fixed order gives the same repeats.
    """

    def __init__(self, words: Words) -> None:
        counts = words.counts()
        row = np.repeat(np.arange(1, len(counts) + 1, dtype=U64), counts)
        self.symbols = mix(words.hash + row * U64(0x9E3779B97F4A7C15))
        self.ends = np.repeat(words.first[1:], counts)
        self.begins = np.repeat(words.first[:-1], counts)
        self.array = self._sorted()
        self.lcp = self._common()

    def _sorted(self) -> np.ndarray:
        n = len(self.symbols)
        array = np.argsort(self.symbols)
        ordered = self.symbols[array]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        slots, step = np.arange(n), 1
        while True:
            # Slots of one group carry its first slot as their rank.
            group = slots[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(slots) else slots
            rank[array[slots]] = group
            alone = fresh & np.append(fresh[1:], True) if len(slots) else fresh
            slots, group = slots[~alone], group[~alone]
            if not len(slots):
                return array
            at = array[slots]
            then = at + step
            after = np.where(then < self.ends[at], rank[np.minimum(then, n - 1)] + 1, 0)
            key = group * (n + 1) + after
            order = np.argsort(key)
            array[slots], key = at[order], key[order]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            step *= 2

    def _common(self) -> np.ndarray:
        """Words that the suffix in a slot has in common with that in the next slot."""
        n = len(self.array)
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        pairs = np.flatnonzero(self.symbols[self.array[:-1]] == self.symbols[self.array[1:]])
        a, b = self.array[pairs], self.array[pairs + 1]
        sums = WINDOW.sums(self.symbols)
        length = np.zeros(len(pairs), np.int64)
        bound = np.minimum(self.ends[a] - a, self.ends[b] - b)
        missed = np.zeros(len(pairs), np.int64)

        def extend(live: np.ndarray, step: int) -> np.ndarray:
            """Lengthens the pairs that agree on so many more words; returns where."""
            live_to = length[live] + step
            fits = live_to <= bound[live]
            on = live[fits]
            x, y = a[on] + length[on], b[on] + length[on]
            same = WINDOW.part(sums, x, x + step) == WINDOW.part(sums, y, y + step)
            length[on[same]] += step
            missed[live[~fits]] = step
            missed[on[~same]] = step
            return on[same]

        live, step = np.arange(len(pairs)), 1
        while len(live):
            live = extend(live, step)
            step *= 2
        while step > 1:
            step //= 2
            extend(np.flatnonzero(missed > step), step)
        out[pairs] = length
        return out

    def longest(self) -> np.ndarray:
        """Length of the longest repeat that begins at each word."""
        out = np.zeros(len(self.array), np.int64)
        out[self.array] = np.maximum(self.lcp, np.concatenate([[0], self.lcp[:-1]])) if len(out) else 0
        return out

    def maximal_repeats(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Maximal repeats of at least so many words: row's first word and length of each, and spans.

        The intervals of neighbours with such common prefixes are walked with a stack. An
        interval is maximal if the words before its members differ. The spans (begin, length)
        give every member of an interval once, with the longest repeat it begins; their union
        is that of all occurrences, since what begins there more to the right lies inside.
        """
        n = len(self.array)
        before = np.where(
            self.array > self.begins[self.array], self.symbols[np.maximum(self.array - 1, 0)], U64(0)
        )
        # A change of the word before, or a text's beginning, between a slot and the next.
        differs = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] == 0))]) if n else before
        owner: list[int] = []
        length: list[int] = []
        deep = np.flatnonzero(self.lcp >= least)
        stack: list[tuple[int, int]] = []  # first slot and length of open intervals

        def close(upto: int, last: int) -> int:
            """Closes intervals longer than ``upto`` that end in slot ``last``; first slot of the widest."""
            first = last
            while stack and stack[-1][1] > upto:
                first, size = stack.pop()
                if differs[last] > differs[first]:
                    owner.append(first)
                    length.append(size)
            return first

        previous = -2
        for slot, size in zip(deep.tolist(), self.lcp[deep].tolist(), strict=True):
            if slot != previous + 1:
                close(0, previous + 1)
                stack.append((slot, size))
            elif size > stack[-1][1]:
                stack.append((slot, size))
            elif size < stack[-1][1]:
                first = close(size, slot)
                if not stack or stack[-1][1] < size:
                    stack.append((first, size))
            previous = slot
        close(0, previous + 1)
        longest = self.longest()
        spans = np.flatnonzero(longest >= least)
        firsts = self.begins[self.array[np.array(owner, np.int64)]]
        return firsts, np.array(length, np.int64), spans, longest[spans]


def _covered(begin: np.ndarray, size: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + size, -1)
    return np.cumsum(change[:-1]) > 0


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags)])
    return upto[edges[1:]] - upto[edges[:-1]]


def _duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    lines = [line for line in text.split(b"\n") if line.strip()]
    seen.update(lines)
    return len(lines) - len(seen)


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "longest_repeat", "covered_words",
)


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of each row of a block."""
    words = Words(data, offsets)
    n = len(words.start)
    suffixes = Suffixes(words)
    longest = suffixes.longest()
    phrases = np.flatnonzero(longest >= PHRASE)
    first, length, begin, size = suffixes.maximal_repeats(REPEAT)
    row = np.searchsorted(words.first, first, side="right") - 1
    rows = len(words.rows) - 1
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row, length)
    space = np.isin(words.data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    lines = [_duplicate_lines(words.data[a:z].tobytes()) for a, z in zip(words.rows[:-1], words.rows[1:], strict=True)]
    return {
        "n_words": words.counts(),
        "word_chars": _per_row(~space & ((words.data & 0xC0) != 0x80), words.rows),
        "n_symbols": _per_row(SYMBOLS[words.data], words.rows),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": _per_row(_covered(phrases, PHRASE, n), words.first),
        "n_repeats": np.bincount(row, minlength=rows),
        "longest_repeat": most,
        "covered_words": _per_row(_covered(begin, size, n), words.first),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in row_blocks(offsets):
            found = measures(data, offsets[low : high + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), *(pa.array(found[m], pa.int64()) for m in MEASURES)],
                ["doc_id", *MEASURES],
            )


def judge(
    docs: DataFrame, least_words: int = LEAST_WORDS, most_covered: float = MOST_COVERED, longest: int = LONGEST
) -> DataFrame:
    """Repetition of every row of ``docs`` (doc_id, text) and whether it is kept.

    Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, and n_repeats (maximal repeats of 8 words or more), longest_repeat (words of the
    longest of them), covered_words (words in any of them, first occurrences included).
    A text fails the base rules with fewer than ``least_words`` words or more than half of
    them in three-word phrases that come twice. One that passes is kept if at most
    ``most_covered`` of its words are covered and no repeat is longer than ``longest``.

    A null text is empty: no words, base_failed. Null doc_ids, repeated ids and repeated rows
    are judged row by row. Occurrences of a repeat may overlap. An empty table gives no rows;
    extra columns are ignored. One pass without a shuffle; blocks of 1 MB bound the memory, a
    longer text is a block of its own, with about 150 bytes a word.
    """
    rows = own_columns(docs, "doc_id", "text")
    shape = T.StructType([rows.schema["doc_id"]])
    for name in MEASURES:
        shape = shape.add(name, "long")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= F.lit(most_covered) * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return rows.mapInArrow(_measure, shape).select(
        "doc_id", *MEASURES[:5], failed.alias("base_failed"), (~failed & fine).alias("kept"), *MEASURES[5:]
    )
