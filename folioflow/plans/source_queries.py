"""Sources and sinks. Files are derived from the tables by Spark, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions.text import preview
from folioflow.operators.scale import spread
from folioflow.plans.inputs import documents
from folioflow.plans.registry import query
from folioflow.session import scratch_path, table
from folioflow.sources import readers, writers


@query(
    "list_documents",
    """SELECT doc_id, source, 'Unknown' AS topic, 'Unknown' AS lob, 'Unknown' AS state,
         'Unknown' AS added_at,
         CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS content_preview
       FROM documents ORDER BY doc_id LIMIT 1000""",
)
def list_documents(spark, folder):
    return readers.list_documents(documents(spark, folder), 1000)


@query(
    "read_text_dir",
    """SELECT lang, source, '.txt' AS file_type, sum(length(text) + 1)::BIGINT AS characters
       FROM documents GROUP BY ALL""",
)
def read_text_dir(spark, folder):
    path = scratch_path(spark, "text-tree")
    documents(spark, folder).select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    files = readers.read_text_dir(spark, path)
    return files.groupBy(
        F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"),
        F.regexp_extract("path", "source=([^/]*)", 1).alias("source"),
        "file_type",
    ).agg(F.sum(F.length("text")).alias("characters"))


@query(
    "read_csv_docs",
    """SELECT 'doc_id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source
         || chr(10) || 'n_chars: ' || n_chars AS text FROM documents""",
)
def read_csv_docs(spark, folder):
    path = scratch_path(spark, "csv")
    documents(spark, folder).select("doc_id", "lang", "source", "n_chars").write.csv(path, header=True)
    return readers.read_csv_docs(spark, path).select("text")


@query(
    "read_json_docs",
    """SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN text
         ELSE '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' END AS text FROM documents""",
)
def read_json_docs(spark, folder):
    body = F.col("text")
    raw = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(body.alias("content"))))
        .when(F.col("lang") == "fr", F.to_json(F.struct(body.alias("text"))))
        .when(F.col("lang") == "de", F.to_json(F.struct(body.alias("body"))))
        .otherwise(F.to_json(F.struct("doc_id", "lang")))
    )
    docs = documents(spark, folder).select("doc_id", raw.alias("raw"))
    return readers.read_json_docs(docs).select("doc_id", "text")


@query(
    "flatten_json_list",
    """SELECT doc_id, CASE WHEN lang = 'es' THEN '{"doc_id":' || doc_id || '}' ELSE text END AS text
       FROM documents""",
)
def flatten_json_list(spark, folder):
    raw = F.when(F.col("lang") == "es", F.to_json(F.struct("doc_id"))).otherwise(
        F.to_json(F.split("text", "\n"))
    )
    docs = documents(spark, folder).select("doc_id", raw.alias("raw"))
    return readers.flatten_json_list(docs).select("doc_id", "text")


_BARE = "html"
for _pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?s)<[a-zA-Z/!][^>]*>"):
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', '', 'g')"
for _mark, _plain in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_mark}', '{_plain}')"


@query(
    "html_to_text",
    f"""SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, {_BARE} AS text
        FROM pages""",
)
def html_to_text(spark, folder):
    return readers.html_to_text(spread(table(spark, folder, "pages"))).select("page_id", "url", "title", "text")


def _conversation_rows(spark, folder):
    """One file row per turn pair, so a long conversation never becomes one value."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit("conversations").alias("source"),
        F.array(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))).alias("conversations"),
    )


@query(
    "read_conversations",
    """SELECT conv_id || '-' || turn AS id, role, text FROM conversations""",
)
def read_conversations(spark, folder):
    path = scratch_path(spark, "conversations")
    writers.write_conversations(_conversation_rows(spark, folder), path)
    good, _bad = readers.read_conversations(spark, path, multi_line=False)
    return good.select("id", F.explode("conversations").alias("t")).select(
        "id", F.col("t.from").alias("role"), F.col("t.value").alias("text")
    )


@query(
    "flatten_payload",
    """SELECT source AS payload_key, lang AS title, text, doc_id AS score, n_chars AS num_comments
       FROM documents""",
)
def flatten_payload(spark, folder):
    post = F.struct(
        F.col("lang").alias("title"), "text", F.col("doc_id").alias("score"),
        F.col("n_chars").alias("num_comments"),
    )
    raw = documents(spark, folder).select(F.to_json(F.create_map("source", F.array(post))).alias("raw"))
    return readers.flatten_payload(raw, "reddit").select(
        "payload_key", "title", "text", "score", "num_comments"
    )


@query(
    "write_collection",
    """SELECT source AS collection, (count(*) + count(*) FILTER (lang = 'fr')) AS documents,
         (sum(length(text)) + coalesce(sum(length(text)) FILTER (lang = 'fr'), 0))::BIGINT AS characters
       FROM documents GROUP BY 1""",
)
def write_collection(spark, folder):
    path = scratch_path(spark, "collections")
    rows = documents(spark, folder).withColumnRenamed("source", "collection")
    writers.write_collection(rows, path, "rebuild")
    writers.write_collection(rows.filter(F.col("lang") == "fr"), path, "append")
    return (
        spark.read.parquet(path)
        .groupBy("collection")
        .agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
    )


@query("write_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def write_conversations(spark, folder):
    path = scratch_path(spark, "jsonl")
    turns = table(spark, folder, "conversations")
    writers.write_conversations(turns, path)
    return spark.read.schema(turns.schema).json(path)


@query(
    "save_data",
    """SELECT CASE WHEN n_chars > 1000 THEN 'raw' ELSE 'processed' END AS data_type, lang AS category,
         count(*) AS items, sum(length(text))::BIGINT AS characters FROM documents GROUP BY ALL""",
)
def save_data(spark, folder):
    path = scratch_path(spark, "saved")
    rows = documents(spark, folder).select(
        "doc_id", "text",
        F.when(F.col("n_chars") > 1000, "raw").otherwise("processed").alias("data_type"),
        F.col("lang").alias("category"),
    )
    writers.save_data(rows, path)
    return (
        spark.read.schema("doc_id long, text string, data_type string, category string")
        .json(path)
        .groupBy("data_type", "category")
        .agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("characters"))
    )


@query(
    "export_citations",
    "SELECT '<li>' || text || ' (' || source || ')</li>' AS value FROM documents",
)
def export_citations(spark, folder):
    return writers.export_citations(documents(spark, folder), "html")


@query(
    "preview",
    """SELECT doc_id, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END
         AS extract FROM documents""",
)
def preview_query(spark, folder):
    return documents(spark, folder).select("doc_id", preview("text", 300).alias("extract"))
