"""Projections and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import security, text
from folioflow.operators import filters, tables, training
from folioflow.operators.evaluation import answer_issues
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import answers, documents, r6, texts
from folioflow.plans.registry import query
from folioflow.session import table


@query(
    "preprocess_query",
    f"SELECT item_id, substring({q.strip('text')}, 1, 512) AS question FROM benchmark",
)
def preprocess_query(spark, folder):
    return table(spark, folder, "benchmark").select(
        "item_id", text.preprocess_query("text").alias("question")
    )


@query(
    "token_set",
    f"""SELECT doc_id, len({q.token_set('text')})::INT AS terms,
          md5(array_to_string(list_sort({q.token_set('text')}), ' ')) AS term_hash FROM documents""",
)
def token_set(spark, folder):
    terms = text.token_set("text")
    return texts(spark, folder).select(
        "doc_id", F.size(terms).alias("terms"),
        F.md5(F.array_join(F.sort_array(terms), " ")).alias("term_hash"),
    )


@query("count_tokens", f"SELECT doc_id, len({q.words('text')})::INT AS tokens FROM documents")
def count_tokens(spark, folder):
    return texts(spark, folder).select("doc_id", text.count_tokens("text").alias("tokens"))


@query(
    "truncate_context",
    f"""SELECT doc_id, substring(text, 1, 400) AS by_chars,
          CASE WHEN len({q.words('text')}) <= 100 THEN text
               ELSE array_to_string(({q.words('text')})[1:100], ' ') END AS by_words FROM documents""",
)
def truncate_context(spark, folder):
    return texts(spark, folder).select(
        "doc_id",
        text.truncate_words("text", 100).alias("by_words"),
        text.truncate_chars("text", 100).alias("by_chars"),
    )


_PLAIN = (
    f"regexp_replace(regexp_replace(text, '{q.URL_PATTERN}', '', 'g'), "
    f"'[^{q.WORD_CHARS}{q.SPACE_CHARS}]', '', 'g')"
)
_STOPS = q.string_list(text.STOP_WORDS)


@query(
    "process_text",
    f"""SELECT doc_id, array_to_string(list_filter({q.words(_PLAIN)},
          lambda t: NOT list_contains({_STOPS}, lower(t))), ' ') AS text FROM documents""",
)
def process_text(spark, folder):
    return texts(spark, folder).select("doc_id", text.clean_text("text").alias("text"))


@query(
    "filter_word_length",
    f"""SELECT doc_id, array_to_string(list_filter({q.words('text')},
          lambda t: length(t) BETWEEN 3 AND 20), ' ') AS text FROM documents""",
)
def filter_word_length(spark, folder):
    return texts(spark, folder).select("doc_id", text.keep_word_lengths("text").alias("text"))


@query(
    "path_metadata",
    """SELECT page_id, url AS source,
         CASE WHEN len(p) >= 4 AND lower(p[-3]) NOT IN ('raw', 'data') THEN lower(p[-3]) ELSE 'general' END AS lob,
         CASE WHEN len(p) >= 4 AND length(p[-2]) = 2 THEN upper(p[-2]) ELSE 'all' END AS state
       FROM (SELECT *, string_split(url, '/') AS p FROM pages)""",
)
def path_metadata(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", F.col("url").alias("source"),
        text.path_lob("url").alias("lob"), text.path_state("url").alias("state"),
    )


_NAME = "string_split(url, '/')[-1]"
_EXT = r"regexp_extract({}, '^\.*[^.].*(\.[^.]*)$', 1)"


@query(
    "topic_ext",
    f"""SELECT page_id, lower(e) AS extension, substring(n, 1, length(n) - length(e)) AS topic
        FROM (SELECT page_id, {_NAME} AS n, {_EXT.format(_NAME)} AS e FROM pages)""",
)
def topic_ext(spark, folder):
    name = text.file_name("url")
    return table(spark, folder, "pages").select(
        "page_id", text.file_stem(name).alias("topic"), text.file_extension(name).alias("extension")
    )


@query("content_hash", "SELECT doc_id, md5(text) AS doc_hash FROM documents")
def content_hash(spark, folder):
    return documents(spark, folder).select("doc_id", text.content_hash("text").alias("doc_hash"))


@query("stable_doc_id", "SELECT doc_id, 'doc-' || md5(text || source) AS id FROM documents")
def stable_doc_id(spark, folder):
    return documents(spark, folder).select("doc_id", text.stable_doc_id("text", "source").alias("id"))


@query(
    "annotate",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE source END AS topic, lang AS lob,
         '2024-01-01 00:00:00' AS added_at FROM documents""",
)
def annotate(spark, folder):
    docs = documents(spark, folder).withColumn("topic", F.col("source"))
    override = F.when(F.col("lang") == "en", "english")
    out = tables.annotate(docs, override, F.col("lang"), F.lit("2024-01-01 00:00:00"))
    return out.select("doc_id", "topic", "lob", "added_at")


@query(
    "merge_metadata",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'none' ELSE json_extract_string(props, '$.k') END AS k,
         event_type AS type, CASE WHEN event_type = 'error' THEN 2 ELSE 2 END AS entries FROM events""",
)
def merge_metadata(spark, folder):
    left = F.from_json("props", "map<string,string>")
    right = F.when(
        F.col("event_type") == "error", F.create_map(F.lit("type"), "event_type", F.lit("k"), F.lit("none"))
    ).otherwise(F.create_map(F.lit("type"), "event_type"))
    merged = table(spark, folder, "events").select(
        "event_id", left.alias("a"), right.alias("b")
    ).select("event_id", text.merge_maps("a", "b").alias("m"))
    return merged.select(
        "event_id", F.col("m")["k"].alias("k"), F.col("m")["type"].alias("type"), F.size("m").alias("entries")
    )


@query(
    "clean_answer",
    "SELECT conv_id, turn, text AS answer FROM conversations",
)
def clean_answer(spark, folder):
    lead = (
        F.when(F.col("role") == "assistant", "System: be brief. Assistant: ")
        .when(F.col("role") == "user", "Based on the provided context, ")
        .otherwise("")
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", text.clean_answer(F.concat(lead, "text")).alias("answer")
    )


@query(
    "render_prompt",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN '<|system|>' || chr(10) || 'Be brief.' || chr(10) ELSE '' END
         || '<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10) AS prompt
       FROM conversations""",
)
def render_prompt(spark, folder):
    system = F.when(F.col("role") == "user", "Be brief.")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", training.render_prompt(system, "text").alias("prompt")
    )


_MASKED = "text"
for _p in security.MASK_PATTERNS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{security.MASK}', 'g')"


@query("redact", f"SELECT doc_id, {_MASKED} AS text FROM documents")
def redact(spark, folder):
    return texts(spark, folder).select("doc_id", security.mask_sensitive("text").alias("text"))


@query(
    "sanitize_filename",
    f"""SELECT page_id, CASE WHEN lower({_EXT.format("s")}) IN ('.pdf', '.txt', '.doc', '.docx')
          THEN s ELSE s || '.txt' END AS file_name
        FROM (SELECT page_id, regexp_replace({_NAME}, '[^a-zA-Z0-9._-]', '', 'g') AS s FROM pages)""",
)
def sanitize_filename(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", security.sanitize_filename("url").alias("file_name")
    )


@query(
    "encrypt_column",
    "SELECT c_custkey, c_name AS decrypted, true AS hidden FROM customer",
)
def encrypt_column(spark, folder):
    key = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"))
    sealed = table(spark, folder, "customer").withColumn("sealed", security.encrypt("c_name", key))
    return sealed.select(
        "c_custkey", security.decrypt("sealed", key).alias("decrypted"),
        (~F.contains("sealed", F.col("c_name"))).alias("hidden"),
    )


@query("hash_column", "SELECT c_custkey, sha256(c_name) AS pseudonym FROM customer")
def hash_column(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", security.pseudonym("c_name").alias("pseudonym")
    )


@query(
    "prompt_adjustments",
    r"""SELECT conv_id, turn, concat_ws(' ',
          CASE WHEN length(text) < 100 THEN 'Provide a more detailed response.' END,
          CASE WHEN NOT regexp_matches(text, '\[\d+\]|\(\d+\)')
               THEN 'Include specific references to the provided sources.' END) AS adjustments
        FROM (SELECT conv_id, turn, text || CASE WHEN turn = 1 THEN ' [1]' ELSE '' END AS text FROM conversations)""",
)
def prompt_adjustments(spark, folder):
    marked = F.concat("text", F.when(F.col("turn") == 1, " [1]").otherwise(""))
    issues = answer_issues(F.col("answer"), F.lit(1.0), min_chars=100)
    rows = table(spark, folder, "conversations").withColumn("answer", marked)
    out = filters.prompt_adjustments(rows.withColumn("issues", issues))
    return out.select("conv_id", "turn", F.array_join("adjustments", " ").alias("adjustments"))


@query(
    "jaccard",
    f"""SELECT query_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0
          THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS jaccard
        FROM (WITH {q.ANSWERS} SELECT query_id, {q.token_set('question')} AS a, {q.token_set('answer')} AS b FROM answers)""",
)
def jaccard(spark, folder):
    sets = answers(spark, folder).select(
        "query_id", text.token_set("question").alias("a"), text.token_set("answer").alias("b")
    )
    return sets.select("query_id", r6(text.jaccard("a", "b")).alias("jaccard"))
