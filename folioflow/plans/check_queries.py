"""Filters, predicates and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import security
from folioflow.functions.text import count_tokens, file_extension, file_name
from folioflow.operators import filters, retrieval, training
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import answers, centroids, documents, log, r6, texts
from folioflow.plans.registry import query
from folioflow.session import table


@query("filter_metadata", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def filter_metadata(spark, folder):
    return filters.filter_metadata(documents(spark, folder), {"lang": "en", "source": "src1"}).select("doc_id")


@query(
    "keyword_search",
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS extract
       FROM documents WHERE contains(lower(text), 'token')""",
)
def keyword_search(spark, folder):
    return filters.keyword_search(documents(spark, folder), "Token").select("doc_id", "extract")


@query(
    "above_threshold",
    f"""WITH {q.CENTROIDS} SELECT query_id, vec_id, round(score, 6) AS score FROM scored WHERE score >= 0.3""",
)
def above_threshold(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    hits = retrieval.score_pairs(centroids(spark, folder), vectors, 0.3)
    return retrieval.above_threshold(hits, 0.3).select("query_id", "vec_id", r6("score").alias("score"))


_REL = q.overlap(q.token_set("question"), q.token_set("answer"))


@query(
    "relevance_filter",
    f"""WITH {q.ANSWERS} SELECT query_id, round({_REL}, 6) AS relevance FROM answers WHERE {_REL} > 0.1""",
)
def relevance_filter(spark, folder):
    out = retrieval.relevance_filter(answers(spark, folder), "question", "answer")
    return out.select("query_id", r6("relevance").alias("relevance"))


@query(
    "validate_input",
    f"""SELECT doc_id, reason IS NULL AS is_valid, reason FROM (SELECT doc_id,
          CASE WHEN text IS NULL OR text = '' THEN 'Input cannot be empty'
               WHEN length(text) > 1000 THEN 'Input exceeds maximum length of 1000 characters'
               WHEN regexp_matches(text, '{security.CARD_PATTERN}') OR regexp_matches(text, '{security.EMAIL_PATTERN}')
               THEN 'Input contains sensitive information' END AS reason FROM documents)""",
)
def validate_input(spark, folder):
    return filters.validate_input(texts(spark, folder)).select("doc_id", "is_valid", "reason")


_FILE_EXT = r"lower(regexp_extract(string_split(url, '/')[-1], '^\.*[^.].*(\.[^.]*)$', 1))"


@query(
    "validate_file",
    f"""SELECT page_id, reason IS NULL AS is_valid, reason FROM (SELECT page_id,
          CASE WHEN strlen(html) > 2000 THEN 'File size exceeds maximum of 2000 bytes'
               WHEN e NOT IN ('pdf', 'txt', 'doc', 'docx') THEN 'File type ' || e || ' not allowed' END AS reason
          FROM (SELECT *, regexp_replace({_FILE_EXT}, '^\\.+', '') AS e FROM pages))""",
)
def validate_file(spark, folder):
    pages = table(spark, folder, "pages").select(
        "page_id", F.octet_length("html").alias("size"), file_extension(file_name("url")).alias("ext")
    )
    return filters.validate_file(pages, "size", "ext", 2000).select("page_id", "is_valid", "reason")


_SCAN = " ".join(
    f"WHEN contains(html, {q.quoted(p)}) THEN {q.quoted('File contains potentially malicious content: ' + p)}"
    for p in security.MALICIOUS_PATTERNS
)


@query(
    "scan_content",
    f"""SELECT page_id, reason IS NULL AS is_valid, reason FROM
          (SELECT page_id, CASE WHEN contains(html, chr(0)) THEN 'File contains binary content' {_SCAN} END AS reason
           FROM pages)""",
)
def scan_content(spark, folder):
    return filters.scan_content(table(spark, folder, "pages"), "html").select("page_id", "is_valid", "reason")


@query(
    "validate_url",
    f"""SELECT page_id, reason IS NULL AS is_valid, reason FROM (SELECT page_id,
          CASE WHEN NOT regexp_matches(u, '{security.URL_SCHEME}') THEN 'URL must start with http:// or https://'
               WHEN regexp_matches(u, '{security.PRIVATE_HOST}') THEN 'URL cannot point to localhost or private IP'
               WHEN length(u) > 2000 THEN 'URL exceeds maximum length' END AS reason
          FROM (SELECT page_id, replace(replace(url, 'https://m.', 'https://10.'), 'http://blog.', 'ftp://') AS u
                FROM pages))""",
)
def validate_url(spark, folder):
    made = F.replace(
        F.replace("url", F.lit("https://m."), F.lit("https://10.")), F.lit("http://blog."), F.lit("ftp://")
    )
    pages = table(spark, folder, "pages").select("page_id", made.alias("url"))
    return filters.validate_url(pages).select("page_id", "is_valid", "reason")


@query(
    "validate_sharegpt",
    """SELECT conv_id, count(*) AS turns, bool_and(role IN ('user', 'assistant')) AS structure_valid
       FROM conversations GROUP BY 1""",
)
def validate_sharegpt(spark, folder):
    turns = table(spark, folder, "conversations")
    out = filters.validate_turns(turns, roles=("user", "assistant"))
    return out.select("conv_id", "turns", "structure_valid")


@query(
    "validate_conversation",
    """SELECT conv_id, count(*) BETWEEN 2 AND 10 AND bool_and(length(text) BETWEEN 50 AND 2000) AS size_valid
       FROM conversations GROUP BY 1""",
)
def validate_conversation(spark, folder):
    return filters.validate_turns(table(spark, folder, "conversations")).select("conv_id", "size_valid")


_CAPS = (
    f"list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), "
    f"lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{{5,}}'))"
)


@query(
    "apply_rules",
    f"""SELECT conv_id, concat_ws(',', CASE WHEN NOT n BETWEEN 2 AND 10 THEN 'length_check' END,
          CASE WHEN shortest < 10 THEN 'content_check' END,
          CASE WHEN entities < 1 THEN 'entity_check' END) AS failed_rules
        FROM (SELECT conv_id, count(*) AS n, min(len({q.words('text')})) AS shortest,
                sum(len({_CAPS})) AS entities FROM conversations GROUP BY 1)""",
)
def apply_rules(spark, folder):
    per_conversation = (
        table(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("n"),
            F.min(count_tokens("text")).alias("shortest"),
            F.sum(F.size(training.capitalised_words("text"))).alias("entities"),
        )
    )
    rules = {
        "length_check": F.col("n").between(2, 10),
        "content_check": F.col("shortest") >= 10,
        "entity_check": F.col("entities") >= 1,
    }
    out = filters.apply_rules(per_conversation, rules)
    return out.select("conv_id", F.array_join("failed_rules", ",").alias("failed_rules"))


def exchanges(spark, folder):
    """Each turn with the one after it, as an array of (from, value), and what a conversation file adds."""
    turns = table(spark, folder, "conversations")
    names = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    said = turns.select("conv_id", "turn", F.struct(names.alias("from"), F.col("text").alias("value")).alias("said"))
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("said").alias("reply"))
    both = F.filter(F.array("said", "reply"), lambda t: t.isNotNull())
    return said.join(after, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", both.alias("conversations"), "reply",
        F.lit("conversations").alias("source"), F.when(F.col("conv_id") % 7 > 0, F.col("turn")).alias("timestamp"),
        F.col("said.from").alias("metadata"),
    )


_EXCHANGES = """e AS (
    SELECT a.conv_id, a.turn, a.role, a.text, b.role AS role2, b.text AS text2,
      CASE WHEN a.conv_id % 7 > 0 THEN a.turn END AS timestamp
    FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query(
    "validate_sharegpt_arrays",
    f"""WITH {_EXCHANGES} SELECT conv_id, turn,
          role IN ('user', 'assistant') AND (role2 IS NULL OR role2 IN ('user', 'assistant')) AS is_valid FROM e""",
)
def validate_sharegpt_arrays(spark, folder):
    """The structure check on arrays of (from, value), as conversation files hold them."""
    return filters.validate_sharegpt(exchanges(spark, folder)).select("conv_id", "turn", "is_valid")


@query(
    "validate_conversation_arrays",
    f"""WITH {_EXCHANGES} SELECT conv_id, turn, timestamp IS NOT NULL AND text2 IS NOT NULL
          AND length(text) BETWEEN 50 AND 2000 AND length(text2) BETWEEN 50 AND 2000 AS is_valid FROM e""",
)
def validate_conversation_arrays(spark, folder):
    """Required fields, turns and text lengths of arrays of (from, value)."""
    return filters.validate_conversation(exchanges(spark, folder)).select("conv_id", "turn", "is_valid")


_CAPS2 = _CAPS.replace("text", "coalesce(text2, '')")


@query(
    "apply_declared_rules",
    f"""WITH {_EXCHANGES} SELECT conv_id, turn, concat_ws(',', CASE WHEN timestamp IS NULL THEN 'field_check' END,
          CASE WHEN text2 IS NULL THEN 'length_check' END,
          CASE WHEN len({q.words('text')}) < 10 OR len({q.words("coalesce(text2, text)")}) < 10 THEN 'content_check' END,
          CASE WHEN role2 IS NULL THEN 'sentiment_check' END,
          CASE WHEN len({_CAPS2}) < 1 THEN 'entity_check' END) AS failed_rules FROM e""",
)
def apply_declared_rules(spark, folder):
    """All declared rules; the reply gives sentiment and entities."""
    rows = exchanges(spark, folder)
    scored = training.sentiment(
        rows.filter("reply IS NOT NULL").select(
            F.struct("conv_id", "turn").alias("doc_id"), F.col("reply.value").alias("text")
        ),
        training.default_lexicon(spark),
    ).select("doc_id.*", "sentiment")
    entities = training.capitalised_words(F.coalesce("reply.value", F.lit("")))
    whole = rows.join(scored, ["conv_id", "turn"], "left").withColumn("entities", entities)
    rules = filters.declared_rules(fields=("source", "conversations", "timestamp", "metadata"))
    out = filters.apply_rules(whole, rules)
    return out.select("conv_id", "turn", F.array_join("failed_rules", ",").alias("failed_rules"))


_TRIMMED = f"list_transform(string_split(text, chr(10)), lambda t: {q.strip('t')})"


@query(
    "filter_questions",
    f"""SELECT doc_id, array_to_string((list_filter({_TRIMMED}, lambda t: length(t) BETWEEN 10 AND 200))[1:5], '|')
          AS questions FROM documents""",
)
def filter_questions(spark, folder):
    docs = texts(spark, folder).select("doc_id", F.split("text", "\n").alias("questions"))
    out = filters.filter_questions(docs, "questions", cap=5)
    return out.select("doc_id", F.array_join("questions", "|").alias("questions"))


@query(
    "validate_requests",
    """SELECT event_id, NOT (t > 1 OR m < 1) AS is_valid,
         concat_ws(',', CASE WHEN t > 1 THEN 'temperature' END, CASE WHEN m < 1 THEN 'max_tokens' END) AS failed_fields
       FROM (SELECT event_id, value / 100 AS t, json_extract(props, '$.k')::BIGINT - 10 AS m FROM events)""",
)
def validate_requests(spark, folder):
    requests = log(spark, folder).select(
        "event_id",
        F.col("event_type").alias("question"),
        (F.col("value") / 100).alias("temperature"),
        (F.get_json_object("props", "$.k").cast("long") - 10).alias("max_tokens"),
    )
    out = filters.validate_requests(requests)
    return out.select("event_id", "is_valid", F.array_join("failed_fields", ",").alias("failed_fields"))


@query("eval_steps", "SELECT event_id AS step FROM events WHERE event_id % 100 = 0 OR event_id = 1")
def eval_steps(spark, folder):
    return filters.eval_steps(log(spark, folder).select(F.col("event_id").alias("step")), 100)


@query(
    "eval_ready",
    """SELECT u.conv_id, u.turn FROM conversations u JOIN conversations a
         ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
)
def eval_ready(spark, folder):
    turns = table(spark, folder, "conversations")
    after = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference_answer")
    )
    samples = turns.join(after, ["conv_id", "turn"], "left").withColumn(
        "query", F.when(F.col("role") == "user", F.col("text"))
    )
    return filters.eval_ready(samples).select("conv_id", "turn")
