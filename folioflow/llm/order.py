"""Documents in ascending order over many tasks: ranges of ids, one sorted task per range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20
MOST_RANGES = 100_000


def range_starts(docs: DataFrame, key: str, range_bytes: int = RANGE_BYTES) -> list:
    """First ids of ranges of about equal row counts; the first is the smallest id.

    One small aggregate over ids and text lengths. The list holds at most one id for each
    ``range_bytes`` of text, whatever the rows are, and equal ids share a range.
    """
    size = docs.agg(
        F.min(key).alias("low"), F.sum(F.octet_length("text").cast("long")).alias("bytes")
    ).first()
    if size["low"] is None:
        return []
    parts = int(min(MOST_RANGES, max(1, -(-(size["bytes"] or 0) // range_bytes))))
    if parts == 1:
        return [size["low"]]
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return sorted({size["low"], *cuts})


def range_of(key: Column, starts: list) -> Column:
    """Number of the range an id falls into, -1 for a null id, by halving the list of starts."""

    def pick(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(starts[middle]), pick(low, middle)).otherwise(pick(middle, high))

    if not starts:
        return F.lit(-1)
    if len(starts) <= 64:
        found = pick(0, len(starts))
    else:
        # Two steps keep the expression small: a block of starts, then the place inside it.
        bounds = F.array(*map(F.lit, starts))
        found = F.aggregate(
            F.sequence(F.lit(0), F.lit(len(starts).bit_length())),
            F.struct(F.lit(0).alias("low"), F.lit(len(starts)).alias("high")),
            lambda at, _: F.when(
                at["high"] - at["low"] > 1,
                F.when(
                    key < F.element_at(bounds, F.shiftright(at["low"] + at["high"], 1) + 1),
                    F.struct(at["low"].alias("low"), F.shiftright(at["low"] + at["high"], 1).alias("high")),
                ).otherwise(
                    F.struct(F.shiftright(at["low"] + at["high"], 1).alias("low"), at["high"].alias("high"))
                ),
            ).otherwise(at),
            lambda at: at["low"],
        )
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)
