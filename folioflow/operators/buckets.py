"""Tables in hash buckets whose changes rewrite only the buckets they touch.

A row lies in the bucket its key hashes to, one folder for each. An update, deletion or upsert
reads the buckets of the changed keys, writes their new rows to the shared folder, and then
overwrites those folders alone; the files of all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators import tables
from folioflow.session import stored

BUCKET, MARK = "_bucket", "_mark"


@dataclass(frozen=True)
class BucketTable:
    """A table of ``schema`` at ``path``, its rows dealt by the hash of ``key`` (any type, nulls too)."""

    spark: SparkSession
    path: str
    key: str
    schema: T.StructType
    buckets: int

    def rows(self) -> DataFrame:
        return self._held().filter(f"NOT {MARK}").select(*(f"`{c}`" for c in self.schema.names))

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys in a frame; no more numbers than there are buckets."""
        return sorted(r[0] for r in keys.select(self._bucket().alias(BUCKET)).distinct().collect())

    def update(self, updates: DataFrame, ts: Column) -> list[int]:
        """Values of ``updates`` replace the old ones where given, as in ``tables.update_documents``."""
        return self._change(updates, lambda rows: tables.update_documents(rows, updates, self.key, ts))

    def delete(self, ids: DataFrame) -> list[int]:
        return self._change(ids, lambda rows: tables.delete_documents(rows, ids, self.key))

    def upsert(self, src: DataFrame, text: str = "text") -> list[int]:
        """Changed rows replaced, new ones added, as in ``tables.upsert``."""
        return self._change(src, lambda rows: tables.upsert(rows, src, self.key, text))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def _held(self) -> DataFrame:
        shape = T.StructType([*self.schema.fields]).add(MARK, "boolean").add(BUCKET, "integer")
        return self.spark.read.schema(shape).parquet(self.path)

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets of ``keys``; returns their numbers.

        The new rows are written elsewhere first: a failed job leaves the table as it was, and
        the step that replaces folders only copies.
        """
        numbers = self.touched(keys)
        if not numbers:
            return []
        old = self._held().filter(F.col(BUCKET).isin(numbers) & ~F.col(MARK))
        new = change(old.select(*(f"`{c}`" for c in self.schema.names)))
        self._write(stored(self._marked(new, numbers), "buckets"), "overwrite")
        return numbers

    def _marked(self, rows: DataFrame, numbers: list[int]) -> DataFrame:
        """Rows with their bucket, and a mark in each bucket, so that one without rows is overwritten too."""
        dealt = rows.select(*(f"`{c}`" for c in self.schema.names), F.lit(False).alias(MARK), self._bucket().alias(BUCKET))
        marks = self.spark.createDataFrame([(n, True) for n in numbers], f"{BUCKET} int, {MARK} boolean")
        return dealt.unionByName(marks, allowMissingColumns=True)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> BucketTable:
    """Writes ``rows`` to ``path`` in so many buckets."""
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    made = BucketTable(rows.sparkSession, path, key, nullable, buckets)
    made._write(made._marked(rows, list(range(buckets))), "errorifexists")
    return made
