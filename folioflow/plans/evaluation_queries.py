"""Scores, grounding, citations and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import evaluation as ev
from folioflow.operators import retrieval
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import answers, chunks, pairs, questions, r6, texts
from folioflow.plans.join_queries import MARKED, answer_hits, cited_sets, marked_answers
from folioflow.plans.registry import query

_ROUGE_T = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _gram_sql(tokens: str, orders) -> str:
    parts = []
    for n in orders:
        glue = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
        for side, r, c in (("question", 1, 0), ("answer", 0, 1)):
            parts.append(
                f"SELECT query_id, {n} AS n, {r} AS r, {c} AS c, {glue} AS g FROM (SELECT query_id, t, "
                f"unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT query_id, {tokens.format(side)} AS t FROM answers))"
            )
    return f"""grams AS ({' UNION ALL '.join(parts)}),
      counts AS (SELECT query_id, n, g, sum(r) AS r, sum(c) AS c FROM grams GROUP BY ALL),
      totals AS (SELECT query_id, n, sum(least(r, c)) AS m, sum(r) AS r, sum(c) AS c FROM counts GROUP BY ALL)"""


def _f_sql(n: int) -> str:
    return f"round(coalesce(max(CASE WHEN n = {n} AND m > 0 THEN 2.0::DOUBLE * m / (r + c) END), 0), 6)"


@query(
    "rouge_n",
    f"""WITH {q.ANSWERS}, {_gram_sql(_ROUGE_T, (1, 2))}
        SELECT a.query_id AS pair_id, {_f_sql(1)} AS rouge1, {_f_sql(2)} AS rouge2
        FROM answers a LEFT JOIN totals t USING (query_id) GROUP BY 1""",
)
def rouge_n(spark, folder):
    out = ev.rouge_n(pairs(spark, folder))
    return out.select("pair_id", r6("rouge1").alias("rouge1"), r6("rouge2").alias("rouge2"))


@query("rouge_l")
def rouge_l(spark, folder):
    return ev.rouge_l(pairs(spark, folder))


def _bleu_tokens_sql(x: str) -> str:
    for old, new in (("<skipped>", ""), ("-\n", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("\n", " ")):
        x = f"replace({x}, {q.quoted(old)}, {q.quoted(new)})"
    x = f"(' ' || {x} || ' ')"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return q.words(x)


_BLEU_GRAMS = _gram_sql("<T>({})", (1, 2, 3, 4))
for _side in ("question", "answer"):
    _BLEU_GRAMS = _BLEU_GRAMS.replace(f"<T>({_side})", _bleu_tokens_sql(_side))


@query(
    "bleu",
    f"""WITH {q.ANSWERS}, {_BLEU_GRAMS},
          s AS (SELECT n, sum(m) AS m, sum(r) AS r, sum(c) AS c FROM totals GROUP BY 1),
          w AS (SELECT {", ".join(f"(max(m) FILTER (n = {n}) / max(c) FILTER (n = {n}))::DOUBLE AS p{n}" for n in (1, 2, 3, 4))},
                  max(c) FILTER (n = 1)::BIGINT AS len, max(r) FILTER (n = 1)::BIGINT AS ref FROM s),
          b AS (SELECT *, CASE WHEN len > ref THEN 1.0::DOUBLE ELSE exp(1 - ref::DOUBLE / len) END AS bp FROM w)
        SELECT round(p1, 6) AS precision1, round(p2, 6) AS precision2, round(p3, 6) AS precision3, round(p4, 6) AS precision4,
          len AS candidate_length, ref AS reference_length, round(bp, 6) AS brevity_penalty,
          round(CASE WHEN least(p1, p2, p3, p4) > 0 THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 6) AS bleu FROM b""",
)
def bleu(spark, folder):
    out = ev.bleu(pairs(spark, folder))
    rounded = [c for c in out.columns if not c.endswith("length")]
    return out.withColumns({c: r6(c) for c in rounded})


def _spots_sql(name: str, side: str) -> str:
    """Words of one side with their position and their number from the end per word."""
    return f"""{name} AS (SELECT query_id, i, t[i] AS w, row_number() OVER (PARTITION BY query_id, t[i] ORDER BY i DESC) AS k
      FROM (SELECT query_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT query_id, {q.words(f"lower({side})")} AS t FROM answers)))"""


@query(
    "meteor",
    f"""WITH {q.ANSWERS}, {_spots_sql("ref", "question")}, {_spots_sql("cand", "answer")},
          met AS (SELECT c.query_id, c.i AS ci, r.i AS ri FROM cand c JOIN ref r USING (query_id, w, k)),
          cut AS (SELECT query_id, CASE WHEN ci - lag(ci) OVER o = 1 AND ri - lag(ri) OVER o = 1 THEN 0 ELSE 1 END AS fresh
                  FROM met WINDOW o AS (PARTITION BY query_id ORDER BY ci)),
          n AS (SELECT query_id, count(*)::DOUBLE AS m, sum(fresh)::DOUBLE AS chunks FROM cut GROUP BY 1),
          pr AS (SELECT query_id, m, chunks, m / (SELECT count(*) FROM cand c WHERE c.query_id = n.query_id) AS p,
                   m / (SELECT count(*) FROM ref r WHERE r.query_id = n.query_id) AS r FROM n)
        SELECT a.query_id AS pair_id,
          round(coalesce(p * r / (0.9::DOUBLE * p + 0.1::DOUBLE * r) * (1 - 0.5::DOUBLE * pow(chunks / m, 3)), 0), 6) AS meteor
        FROM answers a LEFT JOIN pr USING (query_id)""",
)
def meteor(spark, folder):
    return ev.meteor(pairs(spark, folder)).withColumn("meteor", r6("meteor"))


@query("wer")
def wer(spark, folder):
    return ev.wer(pairs(spark, folder))


@query(
    "ngram_perplexity",
    f"""WITH t AS (SELECT doc_id, {q.words('lower(text)')} AS t FROM documents),
          b AS (SELECT doc_id, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t)),
          c12 AS (SELECT w1, w2, count(*) AS n12 FROM b GROUP BY ALL),
          c1 AS (SELECT w1, sum(n12)::BIGINT AS n1 FROM c12 GROUP BY 1),
          v AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(t) AS w FROM t))
        SELECT doc_id, count(*) AS bigrams, round(exp(-avg(ln((n12 + 1.0::DOUBLE) / (n1 + v)))), 4) AS perplexity
        FROM b JOIN c12 USING (w1, w2) JOIN c1 USING (w1), v GROUP BY 1""",
)
def ngram_perplexity(spark, folder):
    docs = texts(spark, folder).select("doc_id", "text")
    return ev.ngram_perplexity(docs, docs).withColumn("perplexity", F.round("perplexity", 4))


@query("evaluate")
def evaluate(spark, folder):
    return ev.evaluate(pairs(spark, folder), texts(spark, folder).select("doc_id", "text"))


@query("evaluate_batch")
def evaluate_batch(spark, folder):
    return ev.evaluate_batch(pairs(spark, folder), texts(spark, folder).select("doc_id", "text"))


_ANSWER_HITS = f"""{q.ANSWERS}, {q.chunk_ctes()},
    questions AS (SELECT query_id, question FROM answers), {q.HITS},
    top AS (SELECT query_id, rank, chunk_id, source, chunk_text FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 5),
    aw AS (SELECT query_id, {q.token_set('answer')} AS a FROM answers)"""

_GROUNDED = f"""{_ANSWER_HITS},
    docw AS (SELECT query_id, list_distinct(flatten(list({q.token_set('chunk_text')}))) AS d FROM top GROUP BY 1),
    grounded AS (SELECT query_id, {q.overlap('a', "coalesce(d, [])")} AS doc_overlap FROM aw LEFT JOIN docw USING (query_id))"""


@query(
    "doc_overlap",
    f"WITH {_GROUNDED} SELECT query_id, round(doc_overlap, 6) AS doc_overlap FROM grounded",
)
def doc_overlap(spark, folder):
    out = ev.doc_overlap(answers(spark, folder), answer_hits(spark, folder))
    return out.withColumn("doc_overlap", r6("doc_overlap"))


@query(
    "source_coverage",
    f"""WITH {_ANSWER_HITS}, s AS (SELECT query_id, source, rank, {q.token_set('chunk_text')} AS d, a FROM top JOIN aw USING (query_id))
        SELECT query_id, source, round(arg_max({q.overlap('d', 'a')}, rank), 6) AS coverage FROM s GROUP BY 1, 2""",
)
def source_coverage(spark, folder):
    out = ev.source_coverage(answers(spark, folder), answer_hits(spark, folder))
    return out.withColumn("coverage", r6("coverage"))


@query(
    "validate_response",
    rf"""WITH {_GROUNDED}, v AS (SELECT query_id, doc_overlap, concat_ws('; ',
            CASE WHEN length(answer) < 10 THEN 'Response too short' END,
            CASE WHEN doc_overlap < 0.3 THEN 'Response not grounded in source documents' END,
            CASE WHEN NOT regexp_matches(answer, '\[\d+\]|\(\d+\)') THEN 'No source citations found' END) AS issues
          FROM grounded JOIN answers USING (query_id))
        SELECT query_id, round(doc_overlap, 6) AS doc_overlap, issues, issues = '' AS is_valid FROM v""",
)
def validate_response(spark, folder):
    out = ev.validate_response(answers(spark, folder), answer_hits(spark, folder))
    return out.select(
        "query_id", r6("doc_overlap").alias("doc_overlap"), F.array_join("issues", "; ").alias("issues"), "is_valid"
    )


@query(
    "validate_response_similarity",
    rf"""WITH {_GROUNDED}, w AS (SELECT query_id, answer, doc_overlap, {q.token_set('question')} AS x, {q.token_set('answer')} AS y
            FROM grounded JOIN answers USING (query_id)),
          s AS (SELECT *, CASE WHEN len(x) * len(y) > 0 THEN len(list_intersect(x, y)) / sqrt(len(x)::DOUBLE * len(y))
            ELSE 0.0::DOUBLE END AS similarity FROM w),
          v AS (SELECT query_id, similarity, concat_ws('; ',
            CASE WHEN length(answer) < 10 THEN 'Response too short' END,
            CASE WHEN similarity < 0.5 THEN 'Response not relevant to query' END,
            CASE WHEN doc_overlap < 0.3 THEN 'Response not grounded in source documents' END,
            CASE WHEN NOT regexp_matches(answer, '\[\d+\]|\(\d+\)') THEN 'No source citations found' END) AS issues FROM s)
        SELECT query_id, round(similarity, 6) AS similarity, issues, issues = '' AS is_valid FROM v""",
)
def validate_response_similarity(spark, folder):
    """The verdict with its similarity issue: question and answer as vectors of terms."""
    asked = answers(spark, folder).withColumn("similarity", ev.term_similarity("question", "answer"))
    out = ev.validate_response(asked, answer_hits(spark, folder), "similarity")
    return out.select(
        "query_id", r6("similarity").alias("similarity"), F.array_join("issues", "; ").alias("issues"), "is_valid"
    )


@query(
    "extract_citations",
    rf"""WITH {MARKED}, m AS (SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '\[Document\s+\d+\]|\[\d+\]|\(\d+\)'),
            lambda x: regexp_extract(x, '(\d+)', 1)::BIGINT) AS c FROM marked)
        SELECT conv_id, turn, array_to_string(c, ',') AS citations,
          len(c) > 0 AND len(list_filter(c, lambda n: n NOT BETWEEN 1 AND 10)) = 0 AS citations_valid FROM m""",
)
def extract_citations(spark, folder):
    out = ev.extract_citations(marked_answers(spark, folder))
    listed = F.array_join(F.col("citations").cast("array<string>"), ",")
    return out.select("conv_id", "turn", listed.alias("citations"), "citations_valid")


@query(
    "citation_consistency",
    f"""WITH {MARKED}, numbered AS (SELECT role, c, row_number() OVER (ORDER BY conv_id, turn) AS i FROM cited),
          n AS (SELECT role, count(*) AS answers FROM cited GROUP BY 1),
          j AS (SELECT a.role, avg(len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c)))) AS m
                FROM numbered a JOIN numbered b ON a.role = b.role AND a.i < b.i GROUP BY 1)
        SELECT role, answers, round(coalesce(m, 0), 6) AS consistency FROM n LEFT JOIN j USING (role)""",
)
def citation_consistency(spark, folder):
    out = ev.citation_consistency(cited_sets(spark, folder), "role")
    return out.withColumn("consistency", r6("consistency"))


_LEAD = f"array_to_string(({q.words('lower(chunk_text)')})[1:3], ' ')"


@query(
    "generate_citations",
    f"""WITH {q.RETRIEVAL}, h AS (SELECT query_id, question, hits.rank AS rank, source, chunk_text, {_LEAD} AS lead
            FROM hits JOIN chunks USING (chunk_id) JOIN questions USING (query_id)),
          one AS (SELECT * FROM h WHERE chunk_text <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lead ORDER BY rank) = 1),
          n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS no FROM one)
        SELECT query_id, question AS query, no::INT AS citation_no, '[' || no || ']' AS citation, chunk_text AS text, source FROM n WHERE no <= 5""",
)
def generate_citations(spark, folder):
    asked, parts = questions(spark, folder), chunks(spark, folder)
    hits = retrieval.nearest_by_terms(asked, parts)
    rows = retrieval.hydrate_hits(hits, parts.select("chunk_id", "source", "chunk_text")).join(asked, "query_id")
    return ev.generate_citations(rows, limit=5, merge_similar=True).drop("metadata")
