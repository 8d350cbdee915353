"""Exact top-k search by an impact-ordered, score-at-a-time index.

Vectors become whole numbers, floor(256 x). Tasks hold slices of the vectors; in a slice each
component's postings are cut into segments of near-equal value. A query weighs every segment
with its greatest possible impact and takes segments in descending order of it, adding the
impacts up. What a vector can still gain is bounded by the next impact for each component
not seen yet. Work stops once that bound proves that few vectors can reach the k-th best
score found; those are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.tables import own_columns

SLICE_ROWS = 8192
BLOCK_QUERIES = 1024
LEVELS = 24
ROUNDS = (0.35, 0.55, 0.7, 0.8, 0.9, 1.0)
FEW = 0.03


class ImpactIndex:
    """Postings of a slice: for each component, vectors by value, cut into segments."""

    def __init__(self, vectors: np.ndarray) -> None:
        """vectors: whole numbers, one row each."""
        self.vectors = vectors
        n, width = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable").T
        values = np.take_along_axis(vectors.T, order, axis=1)
        low, high = values[:, :1], values[:, -1:]
        step = np.maximum((high - low) // LEVELS + 1, 1)
        level = (values - low) // step
        begins = np.ones_like(level, bool)
        begins[:, 1:] = level[:, 1:] != level[:, :-1]
        self.documents = order.ravel().astype(np.int32)
        flat = values.ravel()
        self.start = np.flatnonzero(begins.ravel())
        end = np.append(self.start[1:], n * width)
        self.size = end - self.start
        self.component = self.start // n if n else self.start
        self.least, self.most = flat[self.start], flat[end - 1]

    def search(self, query: np.ndarray, k: int, without: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all vectors that may be among the k best; ``without`` marks rows left out.

        The result holds every row whose score reaches the k-th best, ties included.
        """
        n = len(self.vectors)
        weight = query[self.component]
        impact = np.where(weight > 0, weight * self.most, weight * self.least)
        used = np.flatnonzero(weight != 0)
        order = used[np.argsort(-impact[used], kind="stable")]
        components = int(np.count_nonzero(query))
        gained, seen = np.zeros(n), np.zeros(n, np.int64)
        ends = np.cumsum(self.size[order])
        cuts = np.searchsorted(ends, np.array(ROUNDS) * (ends[-1] if len(ends) else 0)) + 1
        at, reached = 0, None
        possible = np.flatnonzero(~without)
        for cut in np.minimum(cuts, len(order)).tolist():
            if cut <= at or not len(possible):
                continue
            taken = order[at:cut]
            at = cut
            size = self.size[taken]
            total = int(size.sum())
            place = np.arange(total) + np.repeat(self.start[taken] - (np.cumsum(size) - size), size)
            found = self.documents[place]
            gained += np.bincount(found, np.repeat(impact[taken], size), n)
            seen += np.bincount(found, minlength=n)
            best = possible[np.argpartition(-gained[possible], min(k, len(possible)) - 1)[:k]]
            if len(best) == k:
                floor = int((self.vectors[best] @ query).min())
                reached = floor if reached is None else max(reached, floor)
                following = impact[order[at]] if at < len(order) else 0
                bound = gained + (components - seen) * float(following)
                # Sums of doubles may be off in the last bits for very large values.
                slack = 1e-9 * (np.abs(bound[possible]) + abs(reached))
                possible = possible[bound[possible] + slack >= reached]
                if len(possible) <= max(4 * k, FEW * n):
                    break
        scores = self.vectors[possible] @ query
        if reached is not None:
            possible, scores = possible[scores >= reached], scores[scores >= reached]
        return possible, scores


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of every component as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(slice_: pa.Table, queries: pa.Table) -> pa.Table:
        if not slice_.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        sides = []
        for side in (slice_, queries):
            ids = side.column("vec_id").combine_chunks().to_numpy()
            sides.append((ids, _matrix(side.column("numbers").combine_chunks())))
        (ids, vectors), (query_ids, asked) = sides
        # A shorter vector has no part in further components.
        width = min(vectors.shape[1], asked.shape[1])
        index = ImpactIndex(np.ascontiguousarray(vectors[:, :width]))
        found = []
        for query_id, query in zip(query_ids, asked[:, :width], strict=True):
            rows, scores = index.search(query, k, ids == query_id)
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((np.full(len(best), query_id), ids[rows][best], scores[best]))
        return pa.table(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The k rows of greatest inner product for each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding. Queries are the rows whose id is divisible by
    ``every``, candidates all rows with another id; ties go to the smaller id. Rows without an
    id, and vectors that are null or hold a null, NaN or infinite component, take no part. Of
    vectors of unequal length the common components count. Repeated rows are found as often
    as they occur; a repeated query id is asked once, with its greatest vector. Fewer than k
    candidates give fewer rows; an empty table gives none. Extra columns are ignored. Scores
    must fit 64 bits.

    Vectors are dealt into slices of about ``slice_rows``, queries into blocks of
    ``BLOCK_QUERIES``; each task searches one block in one slice, and the k best of each
    slice meet by query.
    """
    rows = own_columns(vectors, "vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("numbers"))
    size = rows.select("vec_id").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")
    ).first()
    slices = max(1, -(-size["n"] // slice_rows))
    blocks = max(1, -(-size["q"] // BLOCK_QUERIES))

    def dealt(parts: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "numbers"), F.lit(parts)).cast("int")

    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("numbers").alias("numbers"))
    candidates = rows.withColumn("slice", dealt(slices)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = queries.withColumn("block", dealt(blocks)).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    found = (
        candidates.groupBy("slice", "block")
        .cogroup(asked.groupBy("slice", "block"))
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
