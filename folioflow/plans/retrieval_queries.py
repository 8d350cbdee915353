"""Nearest rows, retrieval for many questions, vectors, pages and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import vectors as vec
from folioflow.functions.text import strip
from folioflow.operators import retrieval, tables, termindex, training, vectorindex, vectorstore
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import centroids, chunks, documents, questions, r6
from folioflow.plans.registry import query
from folioflow.plans.window_queries import PAIRS
from folioflow.session import stored, table


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "embedding")


_TOP10 = f"""WITH {q.CENTROIDS} SELECT query_id, vec_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored QUALIFY rank <= 10"""


@query("knn", _TOP10)
def knn(spark, folder):
    return retrieval.knn(centroids(spark, folder), vectors(spark, folder), 10).withColumn("score", r6("score"))


@query(
    "retrieve",
    f"""WITH {q.RETRIEVAL} SELECT query_id, question, rank::INT AS rank, doc_id, chunk_index, chunk_id,
          round(overlap, 6) AS overlap, chunk_text FROM final""",
)
def retrieve(spark, folder):
    out = retrieval.retrieve(questions(spark, folder), chunks(spark, folder))
    return out.withColumn("overlap", r6("overlap"))


@query(
    "build_prompt",
    f"""WITH {q.RETRIEVAL}, c AS (SELECT query_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank) AS context FROM final GROUP BY 1)
        SELECT query_id, {q.quoted('System: ' + retrieval.SYSTEM_PROMPT)} || chr(10) || chr(10) || {q.quoted(retrieval.PROMPT_LEAD)}
          || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Helpful Answer:' AS prompt
        FROM questions LEFT JOIN c USING (query_id)""",
)
def build_prompt(spark, folder):
    asked = questions(spark, folder)
    hits = retrieval.retrieve(asked, chunks(spark, folder))
    return retrieval.build_prompt(hits, asked, retrieval.SYSTEM_PROMPT)


@query(
    "rerank_top_k",
    f"""WITH {q.RETRIEVAL} SELECT query_id, chunk_id, rank::INT AS new_rank FROM hits WHERE rank <= 3""",
)
def rerank_top_k(spark, folder):
    asked, parts = questions(spark, folder), chunks(spark, folder)
    hits = retrieval.nearest_by_terms(asked, parts)
    rows = retrieval.hydrate_hits(hits, parts.select("chunk_id", "chunk_text")).join(asked, "query_id")
    return retrieval.rerank_top_k(rows).select("query_id", "chunk_id", "new_rank")


_MANY = f"""
    questions AS (
      SELECT 'b' || item_id AS query_id, substring({q.strip("text")}, 1, 512) AS question FROM benchmark
      UNION ALL SELECT 'c' || conv_id || '-' || turn, substring({q.strip("text")}, 1, 512) FROM conversations WHERE role = 'user')
"""


@query(
    "retrieve_batch",
    f"""WITH {q.chunk_ctes()}, {_MANY}, {q.HITS} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank
        FROM hits WHERE rank <= 5""",
)
def retrieve_batch(spark, folder):
    """Benchmark items and all user turns as one batch of questions, over a written index."""
    turns = table(spark, folder, "conversations").filter(F.col("role") == "user")
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    asked = questions(spark, folder).select(
        F.concat(F.lit("b"), F.col("query_id").cast("string")).alias("query_id"), "question"
    ).unionByName(
        turns.select(key.alias("query_id"), F.substring(strip("text"), 1, 512).alias("question"))
    )
    out = termindex.build(chunks(spark, folder)).search(asked, 5)
    return out.withColumn("score", r6("score"))


@query(
    "hits_relevant",
    f"""WITH {q.RETRIEVAL} SELECT query_id, count(*) AS hits,
          bool_and(len(list_intersect({q.token_set('question')}, {q.token_set('chunk_text')})) > 0) AS all_relevant
        FROM final GROUP BY 1""",
)
def hits_relevant(spark, folder):
    return retrieval.hits_relevant(retrieval.retrieve(questions(spark, folder), chunks(spark, folder)))


def _mmr_sql(k: int, lam: float) -> str:
    """One step per choice: the candidate with the best mix of score and distance to the chosen."""
    steps = [f"""
      near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 20),
      cand AS (SELECT near.*, embedding::DOUBLE[] AS e FROM near JOIN embeddings USING (vec_id)),
      sims AS (SELECT a.query_id, a.vec_id, b.vec_id AS other, list_cosine_similarity(a.e, b.e) AS s FROM cand a JOIN cand b USING (query_id)),
      done1 AS (SELECT query_id, vec_id, 1 AS rank, {lam}::DOUBLE * score AS mmr FROM cand WHERE rank = 1)"""]
    for n in range(2, k + 1):
        steps.append(f"""
      done{n} AS (SELECT * FROM done{n - 1} UNION ALL (
        SELECT query_id, vec_id, {n} AS rank, mmr FROM (
          SELECT c.query_id, c.vec_id, any_value(c.rank) AS place,
            any_value({lam}::DOUBLE * c.score) - {1 - lam:.6f}::DOUBLE * max(s.s) AS mmr
          FROM cand c JOIN sims s USING (query_id, vec_id) JOIN done{n - 1} d ON d.query_id = c.query_id AND d.vec_id = s.other
          WHERE NOT EXISTS (FROM done{n - 1} x WHERE x.query_id = c.query_id AND x.vec_id = c.vec_id)
          GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(mmr, 10) DESC, place) = 1))""")
    return f"WITH {q.CENTROIDS}, {','.join(steps)} SELECT query_id, vec_id, rank, round(mmr, 6) AS mmr FROM done{k}"


@query("mmr", _mmr_sql(5, 0.7))
def mmr(spark, folder):
    rows = vectors(spark, folder)
    near = retrieval.knn(centroids(spark, folder), rows, 20)
    return retrieval.mmr(near.join(rows, "vec_id"), 5, 0.7).withColumn("mmr", r6("mmr"))


@query(
    "l2_normalize",
    """SELECT vec_id, (i - 1)::INT AS i, round(x::DOUBLE * 3 / sqrt(s) / 3, 6) AS x FROM (
         SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i,
           list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)) AS s FROM embeddings)""",
)
def l2_normalize(spark, folder):
    tripled = vectors(spark, folder).withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * 3)
    )
    unit = vectorstore.normalize_vectors(tripled)
    return unit.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", r6("x"))


@query(
    "cosine",
    f"""WITH {q.CENTROIDS} SELECT s.vec_id, round(score, 6) AS similarity, round(1 - score, 6) AS distance
        FROM scored s JOIN embeddings e ON e.vec_id = s.vec_id AND e.label = s.query_id""",
)
def cosine(spark, folder):
    """Similarity of each vector with the mean of its label."""
    means = centroids(spark, folder).select(F.col("query_id").alias("label"), F.col("embedding").alias("mean"))
    rows = table(spark, folder, "embeddings").join(means, "label")
    both = rows.select("vec_id", vec.cosine("embedding", "mean").alias("s"))
    return both.select("vec_id", r6("s").alias("similarity"), r6(1 - F.col("s")).alias("distance"))


@query("embed_chunks")
def embed_chunks(spark, folder):
    parts = chunks(spark, folder).select("chunk_id", "chunk_text")
    return vectorstore.embed_chunks(parts, 384).select("chunk_id", "embedding")


@query("ann")
def ann(spark, folder):
    """One index, searched twice: approximately, and exactly for the recall."""
    asked, index = centroids(spark, folder), vectorindex.build(vectors(spark, folder))
    found = stored(vectorstore.ann(asked, index, 10), "approximate-hits")
    share = vectorstore.recall(found, retrieval.knn(asked, index, 10))
    return found.join(share, "query_id").select("query_id", "vec_id", "rank", r6("score").alias("score"), "recall")


@query(
    "vector_health",
    """SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS missing,
         count(*) FILTER (len(embedding) <> 64) AS wrong_dimension, count(*) FILTER (abs(n - 1) > 1e-3::DOUBLE) AS not_normalised,
         round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm
       FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS n FROM embeddings)""",
)
def vector_health(spark, folder):
    out = vectorstore.vector_health(vectors(spark, folder), 64)
    return out.withColumns({"min_norm": r6("min_norm"), "max_norm": r6("max_norm")})


@query(
    "paginate",
    """SELECT doc_id, source, (SELECT count(*) FROM documents) AS total,
         ceil((SELECT count(*) FROM documents) / 10.0)::BIGINT AS total_pages
       FROM documents ORDER BY doc_id LIMIT 10 OFFSET 20""",
)
def paginate(spark, folder):
    return tables.paginate(documents(spark, folder).select("doc_id", "source"), 20, 10, ["doc_id"])


@query("sample_n", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 100")
def sample_n(spark, folder):
    return tables.sample_n(documents(spark, folder).select("doc_id"), 100, 42, "doc_id")


@query(
    "train_val_split",
    f"""WITH {PAIRS}, o AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ordinal FROM paired)
        SELECT conv_id, turn, ordinal, CASE WHEN ordinal < floor(0.9::DOUBLE * (SELECT count(*) FROM paired)) THEN 'train'
          ELSE 'validation' END AS split FROM o""",
)
def train_val_split(spark, folder):
    rows = training.to_prompt_pairs(table(spark, folder, "conversations")).select("conv_id", "turn")
    return tables.positional_split(rows, "conv_id", "turn")


@query(
    "hash_split",
    f"""WITH {PAIRS} SELECT conv_id, turn, CASE WHEN ('0x' || substring(md5(conv_id::VARCHAR), 1, 8))::BIGINT % 100 < 90
          THEN 'train' ELSE 'validation' END AS split FROM paired""",
)
def hash_split(spark, folder):
    rows = training.to_prompt_pairs(table(spark, folder, "conversations")).select("conv_id", "turn")
    return tables.hash_split(rows, F.col("conv_id"))
