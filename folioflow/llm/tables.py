"""Small helpers of the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.session import stored

KEEP = "doc_id", "text"


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder: later steps start from its files, also on lost executors."""
    return stored(df, f"llm-{label}")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name can't clash with ours."""
    return df.select(*(f"`{n}`" for n in names))


def release_memory() -> None:
    """Gives memory that is free again back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A batch function that gives its memory back when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped
