"""Set operations and table upkeep as plain transformations.

Each function returns the new state of a table; write it beside the old one, or
rewrite the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import content_hash, stable_doc_id, strip
from folioflow.operators.joins import new_only
from folioflow.operators.scale import (
    bucketed_ordinal,
    bucketed_running_sum,
    heavy_light_join,
    range_bucket,
)
from folioflow.session import stored


def union_corpora(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_queries(df: DataFrame, keys: Sequence[str], query: str = "query") -> DataFrame:
    """Distinct trimmed queries per key, blank ones removed."""
    return (
        df.select(*keys, strip(query).alias(query)).filter(F.col(query) != "").distinct()
    )


def drop_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per content hash, that of the smallest id; null texts are one content.

    An id with several contents keeps each that is its content's first; a row repeated
    with its id stays once. Only (hash, id) is aggregated and joined, and a text with very
    many copies is spread over tasks. Texts move only for rows whose (hash, id) repeats, or
    if the pairs to drop are too many to broadcast.
    """
    hashed = df.withColumn("doc_hash", content_hash(text))
    content = F.coalesce("doc_hash", F.lit("")).alias("_content")
    ids = hashed.select(content, key)
    copies = (
        ids.groupBy("_content")
        .agg(F.min(key).alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
    )
    extra = heavy_light_join(ids, copies, ["_content"], "_n", "_first").filter(
        ~F.col(key).eqNullSafe(F.col("_first"))
    )
    keyed = hashed.withColumn("_content", content)
    kept = _without(keyed, extra.select("_content", key), key)
    # The smallest (hash, id) may itself occur several times.
    repeated = ids.groupBy("_content", key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    once = _without(kept, repeated, key)
    again = _without(kept, repeated, key, "left_semi").dropDuplicates(["_content", key])
    return once.unionByName(again).drop("_content")


def _without(rows: DataFrame, pairs: DataFrame, key: str, how: str = "left_anti") -> DataFrame:
    """Rows whose (content, id) is not among the pairs, a null id like any other."""
    named = pairs.select(F.col("_content").alias("_c"), F.col(key).alias("_k"))
    return rows.join(named, (F.col("_content") == F.col("_c")) & F.col(key).eqNullSafe(F.col("_k")), how)


def idempotent_load(stored: DataFrame, src: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows a load adds: distinct contents that are not stored yet."""
    fresh = drop_duplicates(src, text, key).drop("doc_hash")
    return new_only(fresh, stored, text)


def insert_documents(df: DataFrame, ts: Column, text: str = "text", source: str = "source") -> DataFrame:
    """New ids, timestamps and size."""
    return df.withColumns(
        {
            "id": stable_doc_id(text, source),
            "created_at": ts,
            "updated_at": ts,
            "size": F.octet_length(text),
        }
    )


def annotate(df: DataFrame, topic: Column | None, lob: Column, ts: Column) -> DataFrame:
    """Topic override (the own topic, else "Unknown"), line of business, time of adding."""
    own = F.col("topic") if "topic" in df.columns else F.lit(None).cast("string")
    first = [topic] if topic is not None else []
    return df.withColumns(
        {"topic": F.coalesce(*first, own, F.lit("Unknown")), "lob": lob, "added_at": ts}
    )


def get_document(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def paginate(df: DataFrame, skip: int, limit: int, order: Sequence[str]) -> DataFrame:
    """One page with total and page count on every row."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return (
        df.orderBy(*order)
        .offset(skip)
        .limit(limit)
        .withColumn("total", total)
        .withColumn("total_pages", F.ceil(F.col("total") / limit).cast("long"))
    )


def update_documents(df: DataFrame, updates: DataFrame, key: str, ts: Column) -> DataFrame:
    """Values of ``updates`` replace the old ones where given; changed rows get the time."""
    fields = [c for c in updates.columns if c != key]
    new = updates.select(
        key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    out = df.join(new, key, "left")
    out = out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields if c in df.columns})
    out = out.withColumn(
        "updated_at", F.when(F.col("_changed"), ts).otherwise(F.col("updated_at"))
    )
    return out.select(*df.columns)


def delete_documents(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def drop_collection(df: DataFrame, name: str, collection: str = "collection") -> DataFrame:
    return df.filter(~F.col(collection).eqNullSafe(F.lit(name)))


def upsert_actions(stored: DataFrame, src: DataFrame, key: str, text: str = "text") -> DataFrame:
    """insert, update, skip or keep for every id of either side (ids are unique)."""
    old = stored.select(key, content_hash(text).alias("old_hash"))
    new = src.select(key, content_hash(text).alias("new_hash"))
    action = (
        F.when(F.col("old_hash").isNull(), "insert")
        .when(F.col("new_hash").isNull(), "keep")
        .when(F.col("old_hash") == F.col("new_hash"), "skip")
        .otherwise("update")
    )
    return old.join(new, key, "full_outer").withColumn("action", action)


def upsert(stored: DataFrame, src: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Table after the load: changed rows replaced, new ones added, all others as they were.

    A small load is broadcast against the stored rows, whose texts then stay where they
    are; only the stored ids are read a second time, to find the new rows.
    """
    fields = [c for c in stored.columns if c != key]
    new = src.select(key, F.struct(*fields).alias("_new"))
    changed = F.col("_new").isNotNull() & ~F.col(f"_new.{text}").eqNullSafe(F.col(text))
    kept = stored.join(new, key, "left").select(
        key, *[F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    )
    added = src.select(key, *fields).join(stored.select(key), key, "left_anti")
    return kept.unionByName(added).select(*stored.columns)


def split_failures(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with their reason)."""
    marked = df.withColumn("error", error)
    good = marked.filter(F.col("error").isNull()).drop("error")
    return good, marked.filter(F.col("error").isNotNull())


def retry_failures(failed: DataFrame, attempt, error: Column, max_retries: int = 3):
    """Apply ``attempt(frame, n)`` to failed rows a bounded number of times.

    Returns (recovered, still failed). The loop builds one lazy plan.
    """
    recovered = None
    for n in range(1, max_retries + 1):
        good, failed = split_failures(attempt(failed.drop("error"), n), error)
        recovered = good if recovered is None else recovered.unionByName(good)
    return recovered, failed


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """At most n rows in seeded hash order (top-n, no full sort)."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return df.orderBy(order, key).limit(n)


def hash_split(df: DataFrame, key: Column, train: int = 90) -> DataFrame:
    """Train / validation by hash of the key: no shuffle, stable under growth."""
    slot = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(slot < train, "train").otherwise("validation"))


def positional_split(
    df: DataFrame, group: str = "conv_id", order: str = "turn", share: float = 0.9
) -> DataFrame:
    """First ``int(share * n)`` rows by (group, order) are the training part.

    A row's position is the size of all groups before its own plus its place in the
    group; both sums are bucketed, so neither the table nor a long group meets in one task.
    """
    sizes = stored(df.groupBy(group).agg(F.count("*").alias("_size")), "group-sizes").withColumn(
        "_all", F.lit(1)
    )
    ends = bucketed_running_sum(
        sizes, ["_all"], range_bucket(sizes, group), [F.asc(group)], "_size", "_end"
    )
    starts = ends.select(group, "_size", (F.col("_end") - F.col("_size")).alias("_start"))
    placed = bucketed_ordinal(df, [group], F.floor(F.col(order) / 256), [F.asc(order)], "_place")
    total = sizes.agg(F.sum("_size").alias("n")).scalar()
    return (
        heavy_light_join(placed, starts, [group], "_size", "_start")
        .withColumn("ordinal", F.col("_start") + F.col("_place"))
        .withColumn(
            "split",
            F.when(F.col("ordinal") < F.floor(total * F.lit(share)), "train").otherwise("validation"),
        )
        .drop("_start", "_place")
    )
