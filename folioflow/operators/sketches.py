"""Daily summaries that are stored once and merged on read: counts, moments, distinct values, quantiles.

Each increment of a log adds one row for every (day, key) it has: exact sums, a HyperLogLog
sketch and a quantile sketch. Reports over any span of days merge these rows; the increments
themselves are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HLL_BITS = 14  # a standard error of 1.04 / sqrt(2 ** 14), 0.8 %
KLL_K = 800  # ranks within 0.4 % or so


def summarise(log: DataFrame, ts: str, keys: Sequence[str], value: str, distinct: str) -> DataFrame:
    """One row per (day, keys): n, known, total, squares, low, high and two sketches.

    Rows without a time have a null day. Null values count in ``n`` alone; null and repeated
    ``distinct`` values add nothing to its sketch.
    """
    x = F.col(value).cast("double")
    return log.groupBy(F.to_date(ts).alias("day"), *keys).agg(
        F.count("*").alias("n"), F.count(x).alias("known"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"),
        F.min(x).alias("low"), F.max(x).alias("high"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(HLL_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias("value_sketch"),
    )


def add_increment(
    log: DataFrame, path: str, number: int, ts: str, keys: Sequence[str], value: str, distinct: str
) -> None:
    """Stores the summaries of one increment; storing it again replaces it and changes nothing."""
    summarise(log, ts, keys, value, distinct).write.mode("overwrite").parquet(f"{path}/increment={number}")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(
    summaries: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5,), days: tuple | None = None
) -> DataFrame:
    """Report per key over the days between two, both included: rows, mean, std_dev, min, max,
    distinct_values (about), and quantiles (about), by merging the stored rows.
    """
    rows = summaries if days is None else summaries.filter(F.col("day").between(*days))
    n, mean = F.sum("known"), F.sum("total") / F.sum("known")
    spread = F.greatest(F.sum("squares") - F.sum("total") * F.sum("total") / n, F.lit(0.0))
    sketch: Column = F.kll_merge_agg_double("value_sketch")
    at = F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, quantiles)))
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum("n").alias("rows"), F.when(n > 0, mean).alias("mean"),
            F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(F.lit(0.0)).alias("std_dev"),
            F.min("low").alias("min"), F.max("high").alias("max"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
            n.alias("_n"), sketch.alias("_sketch"),
        )
        .withColumn("quantiles", F.when(F.col("_n") > 0, at))
        .drop("_n", "_sketch")
    )
