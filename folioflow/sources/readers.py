"""Sources: stored documents, text trees, CSV, JSON, web pages, conversation files, payloads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import file_extension, file_name, preview

# JSON fields looked at for the text of a document, in this order.
TEXT_FIELDS = ("content", "text", "body", "data")
# File types that hold plain text; PDF and DOCX are not decoded here.
TEXT_TYPES = (".txt", ".md")
# Fields a listing shows with a default.
LISTING_FIELDS = ("source", "topic", "lob", "state", "added_at")

CONVERSATION_SCHEMA = (
    "id string, source string, topic string, system string, "
    "conversations array<struct<`from`:string,`value`:string>>"
)


def list_documents(df: DataFrame, limit: int = 1000, key: str = "doc_id") -> DataFrame:
    """Listing with "Unknown" for missing fields and a 100-character preview."""
    fields = [
        F.coalesce(F.col(f).cast("string"), F.lit("Unknown")).alias(f)
        if f in df.columns
        else F.lit("Unknown").alias(f)
        for f in LISTING_FIELDS
    ]
    return df.select(key, *fields, preview("text").alias("content_preview")).orderBy(key).limit(limit)


def read_text_dir(spark: SparkSession, path: str, exts: Sequence[str] = TEXT_TYPES) -> DataFrame:
    """One row per allowed file below a folder."""
    raw = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("value").alias("text"),
        )
    )
    name = file_name("path")
    return raw.withColumn("file_type", file_extension(name)).filter(
        F.col("file_type").isin([e.lower() for e in exts])
    )


def rows_as_documents(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Each row as ``column: value`` lines."""
    lines = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
        for c in (columns or df.columns)
    ]
    return F.concat_ws("\n", *lines)


def read_csv_docs(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV row becomes a document; ``source`` names the file."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(
        F.col("_metadata.file_path").alias("source"), rows_as_documents(rows).alias("text")
    )


def json_text(raw: Column | str) -> Column:
    """The first text field a JSON object has, else the object itself."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    found = [F.get_json_object(raw, f"$.{f}") for f in TEXT_FIELDS]
    return F.coalesce(*found, raw)


def read_json_docs(df: DataFrame, raw: str = "raw") -> DataFrame:
    return df.withColumn("text", json_text(raw))


def flatten_json_list(df: DataFrame, raw: str = "raw") -> DataFrame:
    """A JSON list becomes its items, one per line; an object is kept whole."""
    is_list = F.col(raw).rlike(r"^\s*\[")
    items = F.from_json(F.col(raw), T.ArrayType(T.StringType()))
    return df.withColumn("text", F.when(is_list, F.array_join(items, "\n")).otherwise(F.col(raw)))


class _VisibleText(HTMLParser):
    """Text outside script and style; if classes are wanted, only inside those elements."""

    HIDDEN = {"script", "style"}
    VOID = {
        "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "source", "track", "wbr",
    }

    def __init__(self, classes: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.classes = classes
        self.open: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        _, shown, hidden = self.open[-1] if self.open else ("", not self.classes, False)
        names = set((dict(attrs).get("class") or "").split())
        self.open.append((tag, shown or bool(names & self.classes), hidden or tag in self.HIDDEN))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        _, shown, hidden = self.open[-1] if self.open else ("", not self.classes, False)
        if shown and not hidden:
            self.parts.append(data)


def _page_text(html: str, classes: frozenset[str]) -> str:
    parser = _VisibleText(classes)
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def html_to_text(
    pages: DataFrame, html: str = "html", classes: Sequence[str] = ()
) -> DataFrame:
    """Adds ``title`` and ``text``; ``classes`` keeps only elements of those classes."""
    wanted = frozenset(classes)

    @F.pandas_udf("string")
    def visible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: None if h is None else _page_text(h, wanted))

    title = F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.withColumn("title", title).withColumn("text", visible(F.col(html)))


def read_conversations(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Conversation files holding a JSON array or one object: (rows, parts that do not parse).

    ``multi_line=False`` reads files of one object or array per line, which Spark can split.
    """
    schema = T.StructType.fromDDL(CONVERSATION_SCHEMA + ", _bad string")
    raw = (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    good = raw.filter(F.col("_bad").isNull()).drop("_bad")
    # The reader wants a real column next to the one for bad records.
    parsed = F.coalesce(F.size("conversations"), F.lit(-1)) >= -1
    bad = raw.filter(F.col("_bad").isNotNull() & parsed).select("path", F.col("_bad").alias("raw"))
    return good, bad


# Fields of the collected payloads.
PAYLOAD_FIELDS = {
    "reddit": "title string, text string, score long, created_utc double, "
    "num_comments long, url string, author string, category array<string>",
    "twitter": "text string, created_at string, user string, retweet_count long, "
    "favorite_count long",
    "news": "title string, description string, content string, published_at string, "
    "source string",
    "policy": "content string, categories array<string>",
}


def flatten_payload(df: DataFrame, kind: str, raw: str = "raw") -> DataFrame:
    """Keyed JSON payload to rows: the key, then the fields of each item.

    Posts come as lists under their forum; tweets, articles and policies as one object
    under their id, URL or name.
    """
    fields = PAYLOAD_FIELDS[kind]
    if kind == "reddit":
        parsed = F.from_json(F.col(raw), f"map<string,array<struct<{_as_struct(fields)}>>>")
        keyed = df.select(F.explode(parsed).alias("payload_key", "posts"))
        rows = keyed.select("payload_key", F.explode("posts").alias("item"))
    else:
        parsed = F.from_json(F.col(raw), f"map<string,struct<{_as_struct(fields)}>>")
        rows = df.select(F.explode(parsed).alias("payload_key", "item"))
    return rows.select("payload_key", "item.*")


def _as_struct(fields: str) -> str:
    return ",".join("`{}`:{}".format(*f.strip().split(" ", 1)) for f in fields.split(", "))
