"""Vectors of chunks: build, check, search approximately."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import words
from folioflow.functions.vectors import l2_norm, l2_normalize
from folioflow.operators import vectorindex
from folioflow.operators.vectorindex import VectorIndex


def normalize_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, l2_normalize(vector))


def embed_chunks(chunks: DataFrame, dim: int = 384, text: str = "chunk_text") -> DataFrame:
    """Unit-length hashed TF-IDF vectors. The fitted state is one number per dimension."""
    toks = chunks.withColumn("_toks", words(F.lower(text)))
    model = Pipeline(
        stages=[
            HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dim),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
    ).fit(toks)
    out = model.transform(toks).withColumn("embedding", vector_to_array("_unit", "float32"))
    return out.drop("_toks", "_tf", "_idf", "_unit")


def vector_health(df: DataFrame, dim: int, vector: str = "embedding", tolerance: float = 1e-3) -> DataFrame:
    """Counts of rows, missing vectors, wrong dimensions, wrong norms; norm range."""
    norm = F.when(F.size(vector) == dim, l2_norm(vector))
    return df.agg(
        F.count("*").alias("vectors"),
        F.count_if(F.col(vector).isNull()).alias("missing"),
        F.count_if(F.col(vector).isNotNull() & (F.size(vector) != dim)).alias("wrong_dimension"),
        F.count_if(F.abs(norm - 1.0) > tolerance).alias("not_normalised"),
        F.min(norm).alias("min_norm"),
        F.max(norm).alias("max_norm"),
    )


def ann(
    questions: DataFrame, vectors: DataFrame | VectorIndex, k: int = 10, probes: int = 16,
    query_id: str = "query_id", id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Approximate k nearest by cosine, from the ``probes`` nearest cells of an index.

    A table is indexed first; hand in an index to search again. More probes find more of the
    exact hits (``recall``); as many as there are cells find all.
    """
    index = vectors if isinstance(vectors, VectorIndex) else vectorindex.build(vectors, None, id_col, vector)
    return index.search(questions, k, probes, query_id, vector)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Share of the exact hits per question that the approximate search found."""
    hit = found.select("query_id", id_col, F.lit(1).alias("_hit"))
    return (
        exact.join(hit, ["query_id", id_col], "left")
        .groupBy("query_id")
        .agg((F.count("_hit") / F.count("*")).alias("recall"))
    )
