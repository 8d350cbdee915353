"""Joins: pairs, look-ups, scopes, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions.text import content_hash
from folioflow.operators import evaluation, joins, retrieval
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import answers, centroids, chunks, documents, questions, r6
from folioflow.plans.registry import query
from folioflow.session import table


@query(
    "score_pairs",
    f"WITH {q.CENTROIDS} SELECT query_id, vec_id, round(score, 6) AS score FROM scored WHERE score >= 0.3",
)
def score_pairs(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = retrieval.score_pairs(centroids(spark, folder), vectors, 0.3)
    return found.withColumn("score", r6("score"))


@query(
    "new_only",
    """SELECT doc_id FROM documents
       WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source IN ('src0', 'src1', 'src2'))""",
)
def new_only(spark, folder):
    docs = documents(spark, folder).select("doc_id", "source", "text")
    stored = docs.filter(F.col("source").isin("src0", "src1", "src2"))
    return joins.new_only(docs, stored.select(content_hash("text").alias("doc_hash"))).select("doc_id")


_LOB = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'en' WHEN 'BUILDING' THEN 'fr' WHEN 'FURNITURE' THEN 'de'
          ELSE 'general' END"""


@query(
    "scoped_chunks",
    f"""WITH claims AS (SELECT DISTINCT {_LOB} AS claim_lob,
            CASE WHEN c_nationkey < 20 THEN 'src' || c_nationkey ELSE 'all' END AS claim_state FROM customer),
          d AS (SELECT doc_id, CASE WHEN lang = 'es' THEN 'general' ELSE lang END AS lob,
            CASE WHEN source = 'src0' THEN 'all' ELSE source END AS state FROM documents)
        SELECT doc_id, claim_lob, claim_state FROM claims JOIN d
          ON (claim_lob = lob OR claim_lob = 'general' OR lob = 'general')
         AND (claim_state = state OR claim_state = 'all' OR state = 'all')""",
)
def scoped_chunks(spark, folder):
    segment = F.col("c_mktsegment")
    lob = (
        F.when(segment == "AUTOMOBILE", "en").when(segment == "BUILDING", "fr")
        .when(segment == "FURNITURE", "de").otherwise("general")
    )
    nation = F.col("c_nationkey")
    state = F.when(nation < 20, F.concat(F.lit("src"), nation.cast("string"))).otherwise("all")
    claims = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("sub"), lob.alias("lob"), state.alias("state")
    )
    docs = documents(spark, folder).select(
        "doc_id",
        F.when(F.col("lang") == "es", "general").otherwise(F.col("lang")).alias("lob"),
        F.when(F.col("source") == "src0", "all").otherwise(F.col("source")).alias("state"),
    )
    return joins.scoped_chunks(claims, docs).select("doc_id", "claim_lob", "claim_state")


@query(
    "hydrate_hits",
    f"""WITH {q.RETRIEVAL} SELECT query_id, hits.rank, chunk_id, doc_id, source, chunk_text
        FROM hits LEFT JOIN chunks USING (chunk_id)""",
)
def hydrate_hits(spark, folder):
    parts = chunks(spark, folder)
    hits = retrieval.nearest_by_terms(questions(spark, folder), parts)
    out = retrieval.hydrate_hits(hits, parts.select("chunk_id", "doc_id", "source", "chunk_text"))
    return out.select("query_id", "rank", "chunk_id", "doc_id", "source", "chunk_text")


@query("eval_pairs", f"WITH {q.ANSWERS} SELECT query_id, answer, question AS reference FROM answers")
def eval_pairs(spark, folder):
    turns = table(spark, folder, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    reference = turns.filter(F.col("role") == "user").select(
        key.alias("query_id"), F.col("text").alias("reference")
    )
    before = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    generated = turns.filter(F.col("role") == "assistant").select(
        before.alias("query_id"), F.col("text").alias("answer")
    )
    return joins.eval_pairs(generated, reference)


# Answers get two citation marks, taken from their length and position.
MARKED = """
    marked AS (SELECT role, conv_id, turn, text || ' [' || (length(text) % 15 + 1) || '] (' || (turn % 3 + 1) || ')' AS answer
               FROM conversations),
    cited AS (SELECT role, conv_id, turn, list_sort(list_distinct([length(text) % 15 + 1, turn % 3 + 1])) AS c
              FROM conversations)
"""


def marked_answers(spark, folder):
    return table(spark, folder, "conversations").select(
        "role", "conv_id", "turn",
        F.concat(
            "text", F.lit(" ["), (F.length("text") % 15 + 1).cast("string"), F.lit("] ("),
            (F.col("turn") % 3 + 1).cast("string"), F.lit(")"),
        ).alias("answer"),
    )


def cited_sets(spark, folder):
    """Citations of each answer per role."""
    marks = evaluation.citation_numbers("answer")
    cited = marked_answers(spark, folder).withColumn("citations", marks)
    return joins.citation_sets(cited, "role", "citations")


@query(
    "set_pairs",
    f"""WITH {MARKED}, numbered AS (SELECT role, c, row_number() OVER (ORDER BY conv_id, turn) AS i FROM cited)
        SELECT a.role, least(array_to_string(a.c, ','), array_to_string(b.c, ',')) AS set_a,
          greatest(array_to_string(a.c, ','), array_to_string(b.c, ',')) AS set_b, count(*) AS pairs,
          round(any_value(len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c)))), 6) AS jaccard
        FROM numbered a JOIN numbered b ON a.role = b.role AND a.i < b.i
        WHERE len(list_intersect(a.c, b.c)) > 0 GROUP BY ALL""",
)
def set_pairs(spark, folder):
    out = joins.set_pairs(cited_sets(spark, folder), "role")

    a, b = (F.array_join(F.col(c).cast("array<string>"), ",") for c in ("citation_set", "other_set"))
    return out.select(
        "role", F.least(a, b).alias("set_a"), F.greatest(a, b).alias("set_b"), "pairs", r6("jaccard").alias("jaccard")
    )


@query(
    "similar_sets",
    f"""WITH {MARKED}, sets AS (SELECT DISTINCT role, c FROM cited),
          j AS (SELECT a.role, array_to_string(a.c, ',') AS x, array_to_string(b.c, ',') AS y,
                  len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c))) AS m
                FROM sets a JOIN sets b ON a.role = b.role AND array_to_string(a.c, ',') < array_to_string(b.c, ','))
        SELECT role, x AS set_a, y AS set_b, round(m, 6) AS jaccard FROM j WHERE m >= 0.5""",
)
def similar_sets(spark, folder):
    """Pairs of distinct citation sets that are at least half alike."""
    out = joins.similar_sets(cited_sets(spark, folder), "role", 0.5)
    a, b = (F.array_join(F.col(c).cast("array<string>"), ",") for c in ("citation_set", "other_set"))
    return out.select("role", F.least(a, b).alias("set_a"), F.greatest(a, b).alias("set_b"), r6("jaccard").alias("jaccard"))


@query(
    "citation_integrity",
    f"""WITH {q.chunk_ctes()} SELECT c.chunk_id, true AS source_exists,
          contains(lower(d.text), lower(substring(c.chunk_text, 1, 50))) AS content_matches
        FROM chunks c JOIN documents d USING (doc_id)""",
)
def citation_integrity(spark, folder):
    hits = chunks(spark, folder).select("chunk_id", "doc_id", "chunk_text")
    out = joins.citation_integrity(hits, documents(spark, folder))
    return out.select("chunk_id", "source_exists", "content_matches")


def answer_hits(spark, folder):
    """Best chunks for every answer's question, with their sources."""
    parts = chunks(spark, folder)
    asked = answers(spark, folder).select("query_id", "question")
    hits = retrieval.nearest_by_terms(asked, parts, 5)
    return retrieval.hydrate_hits(hits, parts.select("chunk_id", "doc_id", "source", "chunk_text"))
