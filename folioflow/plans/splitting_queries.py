"""Splitting documents into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import splitting
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import chunks, documents, r6, texts
from folioflow.plans.registry import query


@query("split_recursive")
def split_recursive(spark, folder):
    return splitting.split_recursive(texts(spark, folder).select("doc_id", "text"))


@query("split_table_function")
def split_table_function(spark, folder):
    """The recursive rule as a table function in SQL, in characters and in words."""
    splitting.register_functions(spark)
    return spark.sql(
        """SELECT doc_id, unit, chunk_index, chunk_text
           FROM {docs} CROSS JOIN (VALUES ('chars', 1000, 200), ('words', 200, 40)) AS u(unit, size, overlap),
             LATERAL recursive_chunks(text, size, overlap, unit)""",
        docs=texts(spark, folder).select("doc_id", "text"),
    )


@query(
    "split_tokens",
    f"WITH {q.chunk_ctes()} SELECT doc_id, chunk_index, md5(chunk_text) AS chunk_hash FROM chunks",
)
def split_tokens(spark, folder):
    return chunks(spark, folder).select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk_hash"))


@query(
    "split_sentences",
    f"""SELECT doc_id, source, (i - 1)::INT AS chunk_index, p[i] AS chunk_text FROM (
          SELECT doc_id, source, p, unnest(range(1, len(p) + 1)) AS i FROM (
            SELECT doc_id, source, list_filter(list_transform(string_split(text, '.'), lambda s: {q.strip('s')}),
              lambda s: s <> '') AS p FROM documents))""",
)
def split_sentences(spark, folder):
    out = splitting.split_sentences(texts(spark, folder).select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "chunk_index", "chunk_text")


@query(
    "number_chunks",
    """SELECT doc_id, (i - 1)::INT AS chunk_index, doc_id || '-' || (i - 1) AS chunk_id, p[i] AS chunk_text
       FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
             FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))""",
)
def number_chunks(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.split("text", "\n").alias("parts"))
    return splitting.number_chunks(docs, "parts")


@query(
    "cap_chunks_per_document",
    f"WITH {q.chunk_ctes()} SELECT doc_id, chunk_index, chunk_text FROM chunks WHERE chunk_index < 3",
)
def cap_chunks_per_document(spark, folder):
    capped = splitting.cap_chunks_per_document(chunks(spark, folder), 3)
    return capped.select("doc_id", "chunk_index", "chunk_text")


@query(
    "cap_chunks",
    f"""WITH {q.chunk_ctes()} SELECT doc_id, chunk_index, chunk_text FROM chunks
        ORDER BY doc_id, chunk_index LIMIT 100""",
)
def cap_chunks(spark, folder):
    return splitting.cap_chunks(chunks(spark, folder), 100).select("doc_id", "chunk_index", "chunk_text")


_RETRY = f"""
    w AS (SELECT doc_id, {q.words('text')} AS t FROM documents),
    first AS (SELECT doc_id, t, list_transform(range(0, greatest(ceil((len(t) - 256) / 128.0)::BIGINT, 0) + 1),
                lambda i: array_to_string(t[i * 128 + 1 : i * 128 + 256], ' ')) AS c FROM w WHERE len(t) > 0),
    again AS (SELECT doc_id, t, c, list_transform(range(0, greatest(ceil((len(t) - 128) / 64.0)::BIGINT, 0) + 1),
                lambda i: array_to_string(t[i * 64 + 1 : i * 64 + 128], ' ')) AS h FROM first),
    marked AS (SELECT doc_id, c, h, list_max(list_transform(c, lambda x: length(x))) > 1800 AS bad,
                 list_max(list_transform(h, lambda x: length(x))) > 1800 AS worse FROM again),
    kept AS (SELECT doc_id, CASE WHEN bad THEN h ELSE c END AS p,
               CASE WHEN NOT bad THEN 'ok' WHEN worse THEN 'failed' ELSE 'retried' END AS status FROM marked)
"""


@query(
    "split_with_retry",
    f"""WITH {_RETRY} SELECT doc_id, status, (i - 1)::INT AS chunk_index, md5(p[i]) AS chunk_hash
        FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM kept)""",
)
def split_with_retry(spark, folder):
    out = splitting.split_with_retry(texts(spark, folder).select("doc_id", "text"), max_chars=1800)
    return out.select("doc_id", "status", "chunk_index", F.md5("chunk_text").alias("chunk_hash"))


@query(
    "bound_chunks",
    f"""WITH {q.chunk_ctes()} SELECT doc_id, chunk_index, length(chunk_text)::INT AS size FROM chunks
        WHERE length(chunk_text) BETWEEN 100 AND 2000""",
)
def bound_chunks(spark, folder):
    kept = splitting.bound_chunks(chunks(spark, folder))
    return kept.select("doc_id", "chunk_index", F.length("chunk_text").alias("size"))


SECTIONS = f"""
    sections AS (SELECT DISTINCT doc_id, section FROM (
        SELECT doc_id, array_to_string({q.words('l')}, ' ') AS section
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE section <> ''),
    found AS (SELECT DISTINCT s.doc_id, s.section FROM sections s JOIN chunks c
              ON c.doc_id = s.doc_id AND contains(c.chunk_text, s.section))
"""


@query(
    "section_preservation",
    f"""WITH {q.chunk_ctes()}, {SECTIONS}
        SELECT doc_id, count(*) AS sections, count(f.section) AS preserved,
          round(count(f.section)::DOUBLE / count(*) * 100, 6) AS preservation_rate
        FROM sections s LEFT JOIN found f USING (doc_id, section) GROUP BY 1""",
)
def section_preservation(spark, folder):
    sections = splitting.line_sections(documents(spark, folder))
    out = splitting.section_preservation(chunks(spark, folder), sections)
    return out.withColumn("preservation_rate", r6("preservation_rate"))


@query(
    "missing_sections",
    f"""WITH {q.chunk_ctes()}, {SECTIONS} SELECT doc_id, section FROM sections s
        WHERE NOT EXISTS (FROM found f WHERE f.doc_id = s.doc_id AND f.section = s.section)""",
)
def missing_sections(spark, folder):
    sections = splitting.line_sections(documents(spark, folder))
    return splitting.missing_sections(chunks(spark, folder), sections)


@query(
    "chunk_overlap",
    f"""WITH {q.chunk_ctes()}, bags AS (SELECT doc_id, chunk_index, list_distinct({q.words('chunk_text')}) AS b FROM chunks)
        SELECT a.doc_id, a.chunk_index, len(list_intersect(a.b, n.b))::INT AS shared_words
        FROM bags a JOIN bags n ON n.doc_id = a.doc_id AND n.chunk_index = a.chunk_index + 1""",
)
def chunk_overlap(spark, folder):
    return splitting.chunk_overlap(chunks(spark, folder))
