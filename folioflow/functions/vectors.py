"""Vector columns. Sums run in double over arrays of float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import _col


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(a: Column | str) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    a = _col(a)
    norm = l2_norm(a)
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    size = l2_norm(a) * l2_norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
