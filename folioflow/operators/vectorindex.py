"""A written inverted-file index over vectors: one build, many searches.

Vectors lie in cells around centroids, one folder per (length, cell), with the angle of each
to its centroid. A search sends every question to the cells it asks for and reads no others.
``search`` asks for the nearest cells and is approximate. ``nearest`` and ``pairs`` are exact:
by the triangle inequality of angles no row of a cell can be nearer to a question than the
question's angle to the centroid allows, and cells that can't matter are left out.

Cells are cut into parts of bounded size. A task holds one part while the questions that ask
for it stream past, so neither side is copied into the driver or kept whole in a task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import scratch_path, stored

SAMPLE = 16_384  # vectors, about, that the centroids are fitted on
MOST_CELLS = 4_096  # of each vector length
ROUNDS = 8
PART_VALUES = 4_000_000  # numbers in the vectors of one part
SCORES_PER_SLICE = 1 << 20
SCORE_DIGITS = 10
# Rounding of angles and scores never decides that a cell is left out.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


def best_k(hits: DataFrame, k: int, id_col: str) -> DataFrame:
    """Rank hits per question by score, then id (nulls last), and keep k (pruned before the shuffle)."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last(id_col))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def finite(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and finite; ``vectorstore.vector_health`` reports the others."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vector).isNotNull() & ~odd)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of unit rows; a zero vector stays zero."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = m.reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each vector length in a column and the rows that have it."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def fit_centroids(unit: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means from distinct starting rows; cells that stay empty go."""
    rows = np.unique(unit, axis=0)
    start = np.random.default_rng(seed).permutation(len(rows))[:cells]
    centres = rows[start]
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-300)[:, None], centres)
    used = np.unique(np.argmax(unit @ centres.T, axis=1))
    return centres[used]


@dataclass(frozen=True)
class Cells:
    """Cells of one vector length."""

    centres: np.ndarray
    parts: np.ndarray
    rows: np.ndarray
    low: np.ndarray  # least and greatest angle of a row to its centroid
    high: np.ndarray

    def bounds(self, angles: np.ndarray) -> np.ndarray:
        """The best score a row of each cell can have, from a question's angles to the centroids."""
        nearest = np.maximum(np.maximum(angles - self.high, self.low - angles) - ANGLE_SLACK, 0)
        return np.where(self.rows > 0, np.cos(nearest) + SCORE_SLACK, -np.inf)


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def _assign(of: dict[int, Cells]):
    """dim, cell, part, angle of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = batch.column("salt").to_numpy()
            for dim, rows in by_length(batch.column("vec")):
                part = batch.take(pa.array(rows))
                cells = of[dim]
                step = max(1, SCORES_PER_SLICE // len(cells.centres))
                for at in range(0, len(rows), step):
                    piece = part.slice(at, step)
                    angles = _angles(unit_rows(piece.column("vec")), cells.centres)
                    cell = np.argmin(angles, axis=1)
                    angle = angles[np.arange(len(cell)), cell]
                    made = [
                        pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell.astype(np.int32)),
                        pa.array((salt[rows[at : at + step]] % cells.parts[cell]).astype(np.int32)), pa.array(angle),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [*made, piece.column("id"), piece.column("vec")], ["dim", "cell", "part", "angle", "id", "vec"]
                    )

    return run


def build(
    vectors: DataFrame, path: str | None = None, id_col: str = "vec_id", vector: str = "embedding",
    sample: int = SAMPLE, most_cells: int = MOST_CELLS,
) -> VectorIndex:
    """Write an index of the finite vectors of ``vectors`` to ``path`` (a scratch folder by default).

    Each length has its own cells, half the square root of its rows but at most
    ``most_cells``; their centroids are fitted on about ``sample`` rows, and every row is
    indexed. Rows without an id are indexed too and found with a null id; rows with equal ids
    are all kept. One scan to count, one to sample, one shuffle to write.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vector-index")
    rows = finite(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("vec")), "vec")
    counts = {r["n"]: r["rows"] for r in rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).collect()}
    total = sum(counts.values())
    drawn = rows.select("vec").sample(min(1.0, sample / max(total, 1)), 7).toArrow().column("vec").combine_chunks()
    found = dict(by_length(drawn))
    of: dict[int, Cells] = {}
    for dim, n in counts.items():
        unit = unit_rows(drawn.take(pa.array(found[dim]))) if dim in found and dim else np.zeros((1, dim))
        cells = min(most_cells, max(1, math.isqrt(n) // 2))
        centres = fit_centroids(unit, cells) if dim else unit
        share = np.bincount(np.argmax(unit @ centres.T, axis=1), minlength=len(centres)) / len(unit)
        parts = 1 + (share * n * max(dim, 1) // PART_VALUES).astype(np.int64)
        nothing = np.zeros(len(centres))
        of[dim] = Cells(centres, parts, nothing, nothing, nothing)
    kinds = {f.name: f.dataType for f in rows.schema}
    shape = T.StructType.fromDDL("dim int, cell int, part int, angle double")
    shape = shape.add("id", kinds["id"]).add("vec", kinds["vec"])
    salted = rows.withColumn("salt", F.shiftrightunsigned(F.xxhash64("id", "vec"), 1))
    (
        salted.mapInArrow(_assign(of), shape)
        .repartition("dim", "cell", "part")
        .write.partitionBy("dim", "cell")
        .parquet(f"{path}/rows")
    )
    stats = {}
    if total:
        grouped = spark.read.schema(shape).parquet(f"{path}/rows").groupBy("dim", "cell")
        measured = grouped.agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        # One row for each cell.
        stats = {(r["dim"], r["cell"]): (r["n"], r["low"], r["high"]) for r in measured.collect()}
    listed = [
        (dim, cell, centre.tolist(), int(cells.parts[cell]), *stats.get((dim, cell), (0, 0.0, 0.0)), None)
        for dim, cells in of.items()
        for cell, centre in enumerate(cells.centres)
    ]
    # The row without a cell tells the types of the indexed rows.
    listed.append((None, None, None, None, None, None, None, shape.json()))
    spark.createDataFrame(listed, _CELLS).coalesce(1).write.parquet(f"{path}/cells")
    return _index(spark, path, id_col, listed)


_CELLS = "dim int, cell int, centre array<double>, parts int, rows long, low double, high double, shape string"


def load(spark: SparkSession, path: str, id_col: str = "vec_id") -> VectorIndex:
    """An index that ``build`` wrote; hits name their rows in ``id_col``."""
    return _index(spark, path, id_col, spark.read.schema(_CELLS).parquet(f"{path}/cells").collect())


def _index(spark: SparkSession, path: str, id_col: str, listed: list[tuple]) -> VectorIndex:
    of: dict[int, list[tuple]] = {}
    for row in listed:
        if row[0] is not None:
            of.setdefault(row[0], []).append(row)
    cells = {}
    for dim, rows in of.items():
        _, _, centres, *numbers, _ = zip(*sorted(rows, key=lambda r: r[1]), strict=True)
        cells[dim] = Cells(np.array(centres, float).reshape(len(rows), dim), *map(np.array, numbers))
    shape = next(row[7] for row in listed if row[0] is None)
    return VectorIndex(spark, path, id_col, T.StructType.fromJson(json.loads(shape)), cells)


Choice = Callable[[Cells, np.ndarray, np.ndarray], np.ndarray]


def _first_cells(cells: Cells, angles: np.ndarray, enough: int) -> np.ndarray:
    """The nearest cells, as many as hold so many rows: one row of flags for each question."""
    order = np.argsort(angles, axis=1, kind="stable")
    before = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
    out = np.zeros(angles.shape, bool)
    np.put_along_axis(out, order, before < enough, axis=1)
    return out & (cells.rows > 0)


def _near(cells: Cells, angles: np.ndarray, _: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells that hold rows."""
    out = np.zeros(angles.shape, bool)
    held = np.where(cells.rows > 0, angles, np.inf)
    order = np.argsort(held, axis=1, kind="stable")[:, :probes]
    np.put_along_axis(out, order, True, axis=1)
    return out & (cells.rows > 0)


def _start(cells: Cells, angles: np.ndarray, _: np.ndarray, k: int) -> np.ndarray:
    return _first_cells(cells, angles, k)


def _rest(cells: Cells, angles: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Cells beyond the first that may hold a row as near as the k-th found there."""
    return (cells.bounds(angles) >= least[:, None]) & ~_first_cells(cells, angles, k)


def _within(cells: Cells, angles: np.ndarray, least: np.ndarray) -> np.ndarray:
    return cells.bounds(angles) >= least[:, None]


def _probe(of: dict[int, Cells], choose: Choice, names_only: bool):
    """Questions at the parts of the cells they ask for; or only the cells' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column("least").to_numpy()
            for dim, rows in by_length(batch.column("asked")):
                if dim not in of:
                    continue
                cells = of[dim]
                part = batch.take(pa.array(rows))
                step = max(1, SCORES_PER_SLICE // len(cells.centres))
                for at in range(0, len(rows), step):
                    piece = part.slice(at, step)
                    angles = _angles(unit_rows(piece.column("asked")), cells.centres)
                    q, cell = np.nonzero(choose(cells, angles, least[rows[at : at + step]]))
                    if names_only:
                        names = np.unique(cell).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(names), dim, np.int32)), pa.array(names)], ["dim", "cell"]
                        )
                        continue
                    many = cells.parts[cell]
                    q, own = np.repeat(q, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    cell = np.repeat(cell, many)
                    copies = piece.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(q), dim, np.int32)), pa.array(cell.astype(np.int32)),
                            pa.array(own.astype(np.int32)), copies.column("_q"), copies.column("query_id"), copies.column("asked"),
                        ],
                        ["dim", "cell", "part", "_q", "query_id", "asked"],
                    )

    return run


def best_in_order(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Question and row of the k best scores of each question; ties to the earlier row."""
    n = scores.shape[1]
    if n > k:
        bar = np.partition(scores, n - k, axis=1)[:, n - k]
        q, r = np.nonzero(scores >= bar[:, None])
    else:
        q, r = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((r, -scores[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k]


def _score(k: int | None, floor: float):
    """Streams the questions of each part past its rows, which come first and in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: tuple | None = None
        ids: list[pa.Array] = []
        units: list[np.ndarray] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "cell", "part", "kind")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                *here, kind = keys[:, low].tolist()
                piece = batch.slice(low, high - low)
                if part != here:
                    part, ids, units = here, [], []
                if kind == 0:
                    ids.append(piece.column("id"))
                    units.append(unit_rows(piece.column("vec")))
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, units = [pa.concat_arrays(ids)], [np.concatenate(units)]
                step = max(1, SCORES_PER_SLICE // len(units[0]))
                for at in range(0, piece.num_rows, step):
                    asked = piece.slice(at, step)
                    scores = np.round(unit_rows(asked.column("asked")) @ units[0].T, SCORE_DIGITS)
                    q, r = best_in_order(scores, k) if k else np.nonzero(scores >= floor)
                    of = asked.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays(
                        [of.column("_q"), of.column("query_id"), ids[0].take(pa.array(r)), pa.array(scores[q, r])],
                        ["_q", "query_id", "id", "score"],
                    )

    return run


@dataclass(frozen=True)
class VectorIndex:
    """A written index. Questions are rows with an id and a vector; unusable vectors find nothing."""

    spark: SparkSession
    path: str
    id_col: str
    shape: T.StructType
    cells: dict[int, Cells]

    def rows(self, wanted: list[tuple[int, int]]) -> DataFrame:
        """Indexed rows of the named cells; no other cell's files are read."""
        of = self.spark.read.schema(self.shape).parquet(f"{self.path}/rows")
        dims = sorted({d for d, _ in wanted})
        named = F.lit(False)
        for dim in dims:
            named = named | ((F.col("dim") == dim) & F.col("cell").isin([c for d, c in wanted if d == dim]))
        return of.filter(named)

    def _asked(self, questions: DataFrame, query_id: str, vector: str) -> DataFrame:
        rows = questions.select(
            F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{vector}`").cast("array<double>").alias("asked")
        )
        # Only an exact search numbers its questions, to give each a score to beat.
        return finite(rows, "asked").withColumn("_q", F.lit(None).cast("long"))

    def _hits(self, asked: DataFrame, choose: Choice, k: int | None, floor: float = -2.0) -> DataFrame:
        """(_q, query_id, id, score) of the chosen cells' rows."""
        id_type = self.shape["id"].dataType
        shape = T.StructType([asked.schema["_q"], asked.schema["query_id"]]).add("id", id_type).add("score", "double")
        asked = asked.select("_q", "query_id", "asked", "least")
        names = asked.select("asked", "least").mapInArrow(_probe(self.cells, choose, True), "dim int, cell int").distinct()
        # One row for each cell at most.
        wanted = [(r["dim"], r["cell"]) for r in names.collect()]
        if not wanted:
            return self.spark.createDataFrame([], shape)
        probe = T.StructType.fromDDL("dim int, cell int, part int")
        probe = probe.add(asked.schema["_q"]).add(asked.schema["query_id"]).add(asked.schema["asked"])
        probes = asked.mapInArrow(_probe(self.cells, choose, False), probe).withColumn("kind", F.lit(1))
        rows = self.rows(wanted).select("dim", "cell", "part", F.lit(0).alias("kind"), "id", "vec")
        return (
            rows.unionByName(probes, allowMissingColumns=True)
            .repartition("dim", "cell", "part")
            .sortWithinPartitions("dim", "cell", "part", "kind", F.asc_nulls_last("id"))
            .mapInArrow(_score(k, floor), shape)
        )

    def _named(self, hits: DataFrame) -> DataFrame:
        return hits.select("query_id", F.col("id").alias(self.id_col), "score")

    def search(
        self, questions: DataFrame, k: int = 10, probes: int = 16, query_id: str = "query_id", vector: str = "embedding"
    ) -> DataFrame:
        """About the k nearest rows by cosine, from the ``probes`` nearest cells: (query_id, id, score, rank)."""
        asked = self._asked(questions, query_id, vector).withColumn("least", F.lit(-2.0))
        return best_k(self._named(self._hits(asked, partial(_near, probes=probes), k)), k, self.id_col)

    def nearest(
        self, questions: DataFrame, k: int = 10, query_id: str = "query_id", vector: str = "embedding"
    ) -> DataFrame:
        """Exactly the k nearest rows by cosine: (query_id, id, score, rank).

        The nearest cells that hold k rows give each question a score to beat; then all
        cells that may beat it are asked.
        """
        numbered = self._asked(questions, query_id, vector).withColumn("_q", F.monotonically_increasing_id())
        asked = stored(numbered, "questions")
        first = stored(self._hits(asked.withColumn("least", F.lit(-2.0)), partial(_start, k=k), k), "first-hits")
        w = W.partitionBy("_q").orderBy(F.desc("score"))
        bars = (
            first.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k).select("_q", F.col("score").alias("least"))
        )
        again = asked.join(bars, "_q", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        rest = self._hits(again, partial(_rest, k=k), k)
        return best_k(self._named(first.unionByName(rest)), k, self.id_col)

    def pairs(
        self, questions: DataFrame, min_score: float, query_id: str = "query_id", vector: str = "embedding"
    ) -> DataFrame:
        """All (question, row) pairs with a cosine of at least ``min_score``: (query_id, id, score)."""
        least = F.lit(float(min_score))
        asked = self._asked(questions, query_id, vector).withColumn("least", least)
        return self._named(self._hits(asked, _within, None, min_score))
