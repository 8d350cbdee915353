"""Helpers that keep one hot key from landing in one task.

Window functions over a key put all rows of the key into one task. The helpers
here cut a key into ordered buckets first, aggregate the buckets, and carry the
bucket results back by an equi join. Buckets are plain expressions of the data,
so a recomputed task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

# Row limits under which a side may be broadcast or a block held by one task.
MAX_BROADCAST_ROWS = 200_000
HEAVY_SHARE = 1024
# Bits of the hashes that ``maybe_among`` sends to every task, 4 MB in all.
MARK_BITS = 1 << 25


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most so many rows; counts no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def each(df: DataFrame, keep: Sequence, array: Column | str, item: str, position: str | None = None) -> DataFrame:
    """One row per array item.

    A plain explode lets the optimizer filter on the array's size first, which computes
    a derived array a second time; the outer form followed by a filter does not.
    """
    at = position or "_at"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, item)).filter(F.col(at).isNotNull())
    return rows if position else rows.drop(at)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that is read in fewer partitions than cores.

    Only small tables are like that (one file of one row group); larger ones stay as
    they are read. For work that is heavy per row, on a table as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a frame for broadcast once its row count is known to be within the limit."""
    return F.broadcast(df) if at_most(df, rows) else df


def maybe_among(df: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows whose key may occur among the keys of ``others``, before they are shuffled for a join.

    Tells keys by a bit of their hash, so no row is lost that has a partner and a few others stay;
    the bits take the same room for any number of rows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MARK_BITS)) + 1
    marks = (
        others.select(place.alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    )
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_place", place)
        .join(F.broadcast(marks), F.bitmap_bucket_number("_place") == F.col("_bucket"))
        .filter(F.getbit(byte, (bit % 8).cast("int")) == 1)
        .drop("_place", "_bucket", "_bits")
    )


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which nulls meet as they do in a group, so no group is lost."""
    named = {k: f"_of_{k}" for k in keys}
    meets = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()))
    return left.join(right.withColumnsRenamed(named), meets, how).drop(*named.values())


def _cells(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Adds ``_cell``, the (key, bucket) of a row as one struct.

    A struct with null fields equals itself, so rows without a key or bucket stay; and
    the join and the window on ``_cell`` share one shuffle.
    """
    return df.withColumn("_cell", F.struct(F.struct(*keys).alias("k"), bucket.alias("b")))


def _earlier_cells() -> WindowSpec:
    return W.partitionBy("_cell.k").orderBy("_cell.b")


def bucketed_ordinal(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """Exact 0-based ordinal of each row in its key.

    ``bucket`` must not decrease along ``order``. Each (key, bucket) is numbered by
    itself; bucket sizes, summed before, give the offset.
    """
    cut = _cells(df, keys, bucket)
    before = _earlier_cells().rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_cell")
        .agg(F.count("*").alias("_n"))
        .select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inner = W.partitionBy("_cell").orderBy(*order)
    return (
        cut.join(offsets, "_cell")
        .withColumn(name, F.col("_offset") + F.row_number().over(inner) - 1)
        .drop("_cell", "_offset")
    )


def global_ordinal(df: DataFrame, bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Exact 0-based position of each row in the whole frame, without a global window.

    Buckets are numbered by themselves. Only bucket sizes meet in one task, so the
    number of buckets must be modest (thousands, not one per row).
    """
    cut = df.withColumn("_all", F.lit(1))
    return bucketed_ordinal(cut, ["_all"], bucket, order, name).drop("_all")


def bucketed_previous(
    df: DataFrame, keys: Sequence[str], value: str, bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """``lag(value)`` in each key, cut into buckets so that a hot key spreads out.

    ``value`` must not decrease along ``order``; then the last value of a bucket is its
    maximum, and the first row of a bucket takes that of the nearest bucket before.
    """
    cut = _cells(df, keys, bucket)
    carried = (
        cut.groupBy("_cell")
        .agg(F.max(value).alias("_last"))
        .select("_cell", F.lag("_last").over(_earlier_cells()).alias("_carried"))
    )
    inner = W.partitionBy("_cell").orderBy(*order)
    return (
        cut.join(carried, "_cell")
        .withColumn(name, F.coalesce(F.lag(value).over(inner), F.col("_carried")))
        .drop("_cell", "_carried")
    )


def heavy_light_join(
    facts: DataFrame, totals: DataFrame, keys: Sequence[str], weight: str, value: str,
    how: str = "inner", same_nulls: bool = False,
) -> DataFrame:
    """Join of many fact rows with one total per key, hot keys apart.

    ``totals`` holds one row per key with its weight. A key with more than a
    1/1024 share of the whole weight is heavy; there are at most 1024 of those, so
    their totals are broadcast and their fact rows spread over salts. All others meet
    in a plain shuffle join, in the same pass over the facts. Rows with a null key meet
    nothing and are spread too, unless ``same_nulls`` lets nulls meet as in a group.
    """
    keys = list(keys)
    bar = totals.agg((F.sum(weight) / HEAVY_SHARE).alias("bar")).scalar()
    heavy = totals.filter(F.col(weight) > bar).select(*keys, F.col(value).alias("_hot"))
    # 0 for every row, but not a literal: a literal key would be taken out of the shuffle.
    none = F.when(F.col(weight) < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    light = totals.filter(F.col(weight) <= bar).select(
        *keys, none.alias("_salt"), F.col(value).alias("_cold")
    )
    settled = F.col("_hot").isNotNull()
    if not same_nulls:
        settled = reduce(lambda a, k: a | F.col(k).isNull(), keys, settled)
    hashed = [f.name for f in facts.schema if "map<" not in f.dataType.simpleString()]
    spread_out = F.pmod(F.xxhash64(*hashed), F.lit(HEAVY_SHARE)) + 1

    def meet(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return join_same(a, b, on, "left") if same_nulls else a.join(b, on, "left")

    marked = meet(facts, F.broadcast(heavy), keys).withColumn(
        "_salt", F.when(settled, spread_out).otherwise(F.lit(0).cast("long"))
    )
    joined = (
        meet(marked, light, [*keys, "_salt"])
        .withColumn(value, F.coalesce("_hot", "_cold"))
        .drop("_hot", "_cold", "_salt")
    )
    return joined if how == "left" else joined.filter(F.col(value).isNotNull())


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key without gathering a key's values.

    A quantile sketch brackets the median (its rank error is far below the width of the
    bracket). Rows below the bracket are only counted. Values inside it, a few in a
    thousand, are merged when equal, cut into 256 ranges, and ordered range by range.
    """
    keys = list(keys)
    known = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    merged = known.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    span = known.groupBy(*keys).agg(
        F.percentile_approx("_v", [0.499, 0.501], 10_000).alias("_b"), F.count("*").alias("_total")
    )
    bracket = span.select(
        *keys, "_total",
        F.struct(F.col("_b")[0].alias("lo"), F.col("_b")[1].alias("hi"), F.col("_total").alias("n")).alias("_m"),
    )
    near = heavy_light_join(merged, bracket, keys, "_total", "_m", same_nulls=True).filter(
        F.col("_v") <= F.col("_m.hi")
    )
    width = F.col("_m.hi") - F.col("_m.lo")
    part = (
        F.when(F.col("_v") < F.col("_m.lo"), -1)
        .when(width > 0, F.floor((F.col("_v") - F.col("_m.lo")) / width * 255))
        .otherwise(0)
    )
    # Rows below the bracket share part -1 and lose their value.
    inside = F.when(F.col("_v") >= F.col("_m.lo"), F.col("_v"))
    counts = near.groupBy(*keys, part.cast("int").alias("_part"), inside.alias("_v")).agg(
        F.sum("_c").alias("_n"), F.first("_m.n").alias("_total")
    )
    upto = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        counts.groupBy(*keys, "_part")
        .agg(F.sum("_n").alias("_part_n"))
        .withColumn("_start", F.coalesce(F.sum("_part_n").over(upto), F.lit(0)))
        .drop("_part_n")
    )
    inner = W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        join_same(counts, starts, [*keys, "_part"])
        .withColumn("_end", F.col("_start") + F.sum("_n").over(inner))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )

    def at(rank) -> Column:
        return F.max(F.when((rank > F.col("_begin")) & (rank <= F.col("_end")), F.col("_v")))

    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))


def bucketed_running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Running sum of ``value`` in each key, this row included, cut into buckets.

    ``bucket`` must not decrease along ``order``.
    """
    cut = _cells(df, keys, bucket)
    before = _earlier_cells().rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_cell")
        .agg(F.sum(value).alias("_sum"))
        .select("_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inner = W.partitionBy("_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.join(offsets, "_cell")
        .withColumn(name, F.col("_offset") + F.sum(value).over(inner))
        .drop("_cell", "_offset")
    )


def range_bucket(df: DataFrame, column: str, parts: int = 4096) -> Column:
    """Cuts the value range of a numeric column into at most ``parts`` ordered buckets."""
    low = df.agg(F.min(column).alias("v")).scalar()
    high = df.agg(F.max(column).alias("v")).scalar()
    return F.floor((F.col(column) - low) * parts / (high - low + 1))
