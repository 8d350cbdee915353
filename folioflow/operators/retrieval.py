"""Nearest chunks and vectors for many questions at once, and what follows from the hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import overlap_share, token_set
from folioflow.operators import termindex, vectorindex
from folioflow.operators.scale import maybe_among
from folioflow.operators.termindex import TermIndex
from folioflow.operators.vectorindex import SCORE_DIGITS, VectorIndex, unit_rows
from folioflow.session import stored


def _vector_index(vectors: DataFrame | VectorIndex, id_col: str, vector: str) -> VectorIndex:
    return vectors if isinstance(vectors, VectorIndex) else vectorindex.build(vectors, None, id_col, vector)


def knn(
    questions: DataFrame,
    vectors: DataFrame | VectorIndex,
    k: int = 10,
    query_id: str = "query_id",
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Exact k nearest rows by cosine: (query_id, id, score, rank).

    Finite vectors of the question's length are compared. A table is indexed first; hand in
    an index to search again.
    """
    return _vector_index(vectors, id_col, vector).nearest(questions, k, query_id, vector)


def score_pairs(
    questions: DataFrame,
    vectors: DataFrame | VectorIndex,
    min_score: float,
    query_id: str = "query_id",
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """All (question, row) pairs with a cosine of at least ``min_score``; others are never made."""
    return _vector_index(vectors, id_col, vector).pairs(questions, min_score, query_id, vector)


def nearest_by_terms(
    questions: DataFrame,
    chunks: DataFrame | TermIndex,
    k: int = 10,
    question: str = "question",
    id_col: str = "chunk_id",
    text: str = "chunk_text",
) -> DataFrame:
    """k best chunks per question by the share of question terms they hold.

    Equal questions are scored once. Chunks sharing no term are no hits. A table of chunks is
    inverted for this search alone; hand in an index to search again.
    """
    index = chunks if isinstance(chunks, TermIndex) else termindex.once(chunks, id_col, text)
    return index.search(questions, k, question)


def above_threshold(hits: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return hits.filter(F.col(score) >= threshold)


def term_relevance(question: str, text: str):
    return overlap_share(token_set(question), token_set(text))


def relevance_filter(pairs: DataFrame, question: str, text: str, threshold: float = 0.1) -> DataFrame:
    """Pairs whose text holds more than the threshold share of the question's terms."""
    return pairs.withColumn("relevance", term_relevance(question, text)).filter(
        F.col("relevance") > threshold
    )


def rerank(hits: DataFrame, question: str = "question", text: str = "chunk_text") -> DataFrame:
    """New order by term overlap; ties keep the prior rank."""
    scored = hits.withColumn("overlap", term_relevance(question, text))
    w = W.partitionBy("query_id").orderBy(F.desc("overlap"), F.asc("rank"))
    return scored.withColumn("new_rank", F.row_number().over(w))


def rerank_top_k(hits: DataFrame, k: int = 3) -> DataFrame:
    return rerank(hits).filter(F.col("new_rank") <= k)


def hydrate_hits(hits: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Left join of hits to the rows they name; chunks that no hit names stay where they are."""
    return hits.join(maybe_among(chunks, id_col, hits), id_col, "left")


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    hits: DataFrame | None = None,
    fetch: int = 10,
    keep: int = 5,
    min_overlap: float = 0.1,
    reorder: bool = False,
) -> DataFrame:
    """Fetch, optionally re-rank, drop weak overlaps, keep the best.

    Without ``hits`` of an earlier vector search the first stage is term overlap.
    """
    first = hits if hits is not None else stored(nearest_by_terms(questions, chunks, fetch), "term-hits")
    rows = hydrate_hits(
        first, chunks.select("chunk_id", "doc_id", "chunk_index", "chunk_text")
    ).join(questions.select("query_id", "question"), "query_id")
    scored = rerank(rows)
    order = "new_rank" if reorder else "rank"
    w = W.partitionBy("query_id").orderBy(order)
    return (
        scored.filter(F.col("overlap") > min_overlap)
        .withColumn("final_rank", F.row_number().over(w))
        .filter(F.col("final_rank") <= keep)
        .select(
            "query_id", "question", F.col("final_rank").alias("rank"), "doc_id", "chunk_index",
            "chunk_id", "overlap", "chunk_text",
        )
    )


def mmr(candidates: DataFrame, k: int = 5, lam: float = 0.7, id_col: str = "vec_id") -> DataFrame:
    """Diverse choice of k among the few candidates of each question.

    ``candidates`` holds (query_id, id, score, embedding), already cut to the top N, so
    a group has at most N rows. Ties go to the smaller id, null ids last.
    """
    types = {f.name: f for f in candidates.schema}
    shape = T.StructType([types["query_id"]]).add("rank", "integer")
    shape = shape.add(types[id_col]).add("mmr", "double")

    def pick(rows: pa.Table) -> pa.Table:
        order = [("score", "descending"), (id_col, "ascending")]
        rows = rows.sort_by(order).combine_chunks()
        m = unit_rows(rows.column("embedding").chunk(0))
        relevance = rows.column("score").to_numpy()
        closest = np.zeros(len(m))
        left = np.ones(len(m), dtype=bool)
        chosen, values = [], []
        for _ in range(min(k, len(m))):
            value = np.where(left, lam * relevance - (1 - lam) * closest, -np.inf)
            best = int(np.argmax(np.round(value, SCORE_DIGITS)))
            sims = m @ m[best]
            closest = sims if not chosen else np.maximum(closest, sims)
            left[best] = False
            chosen.append(best)
            values.append(float(value[best]))
        of = rows.take(pa.array(chosen))
        ranks = pa.array(np.arange(1, len(chosen) + 1, dtype=np.int32))
        return pa.table(
            [of.column("query_id"), ranks, of.column(id_col), pa.array(values)], names=["query_id", "rank", id_col, "mmr"]
        )

    return candidates.select("query_id", id_col, "score", "embedding").groupBy("query_id").applyInArrow(pick, shape)


def build_prompt(hits: DataFrame, questions: DataFrame, system_prompt: str) -> DataFrame:
    """Prompt from the ranked hits of each question (a handful, so the list is short)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))
    context = hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda h: h["chunk_text"]), "\n\n").alias("_context")
    )
    return questions.join(context, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit(f"System: {system_prompt}\n\n{PROMPT_LEAD}\n\n"),
            F.coalesce("_context", F.lit("")),
            F.lit("\n\nQuestion: "),
            F.col("question"),
            F.lit("\nHelpful Answer:"),
        ).alias("prompt"),
    )


# Wording of the prompt.
PROMPT_LEAD = (
    "Use the following pieces of context to answer the question at the end. "
    "If you don't know the answer, just say that you don't know, don't try to make up an answer."
)
SYSTEM_PROMPT = (
    "You are a helpful AI assistant that answers questions based on the provided context. "
    "Always be accurate, concise, and helpful."
)


def hits_relevant(hits: DataFrame, question: str = "question", text: str = "chunk_text") -> DataFrame:
    """Per question, whether every hit shares a term with it."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.bool_and(F.arrays_overlap(token_set(question), token_set(text))).alias("all_relevant"),
    )
