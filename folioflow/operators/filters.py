"""Filters and checks. A check adds a verdict and a reason; it drops no row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import security
from folioflow.functions.text import preview, strip, words

# Roles a conversation file may use.
ALLOWED_ROLES = ("human", "gpt", "assistant")
# Fields and bounds of a conversation.
REQUIRED_FIELDS = ("source", "conversations", "timestamp", "metadata")
TURN_BOUNDS = (2, 10)
TEXT_BOUNDS = (50, 2000)
# Adjustments of the prompt per issue, in this order.
PROMPT_ADJUSTMENTS = (
    ("Response too short", "Provide a more detailed response."),
    ("No source citations found", "Include specific references to the provided sources."),
    ("Low query term coverage", "Ensure the response directly addresses the query terms."),
    ("Response contains", "Provide a direct and confident response."),
)


def filter_metadata(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Rows equal to every wanted value; a key the rows do not have matches nothing."""

    def matches(key: str, value) -> Column:
        if key in df.columns:
            return F.col(key) == F.lit(value)
        if "metadata" in df.columns:
            return F.col("metadata")[key] == F.lit(value)
        return F.lit(False)

    return df.filter(reduce(lambda a, b: a & b, (matches(*kv) for kv in wanted.items()), F.lit(True)))


def keyword_search(df: DataFrame, keyword: str, text: str = "text") -> DataFrame:
    hit = F.contains(F.lower(text), F.lower(F.lit(keyword)))
    return df.filter(hit).withColumn("extract", preview(text, 300))


def _with_reason(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def validate_input(df: DataFrame, text: str = "text", max_chars: int = 1000) -> DataFrame:
    return _with_reason(df, security.input_problem(text, max_chars))


def validate_file(df: DataFrame, size: str, extension: str, max_bytes: int = 10485760) -> DataFrame:
    return _with_reason(df, security.file_problem(size, extension, max_bytes))


def scan_content(df: DataFrame, text: str, is_text_file: Column | bool = True) -> DataFrame:
    return _with_reason(df, security.content_problem(text, is_text_file))


def validate_url(df: DataFrame, url: str = "url") -> DataFrame:
    return _with_reason(df, security.url_problem(url))


def validate_sharegpt(
    df: DataFrame, turns: str = "conversations", roles: Sequence[str] = ALLOWED_ROLES
) -> DataFrame:
    """Structure check on ``array<struct<from,value>>``."""
    ok = F.forall(
        turns,
        lambda t: t["from"].isNotNull()
        & t["value"].isNotNull()
        & F.coalesce(t["from"].isin(*roles), F.lit(False)),
    )
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def validate_conversation(
    df: DataFrame,
    turns: str = "conversations",
    required: Sequence[str] = REQUIRED_FIELDS,
    turn_bounds: tuple[int, int] = TURN_BOUNDS,
    text_bounds: tuple[int, int] = TEXT_BOUNDS,
) -> DataFrame:
    """Required fields present, 2 to 10 turns, each of 50 to 2000 characters."""
    present = F.lit(True)
    for field in required:
        present = present & (F.col(field).isNotNull() if field in df.columns else F.lit(False))
    sized = F.forall(turns, lambda t: F.length(t["value"]).between(*text_bounds))
    ok = present & F.size(turns).between(*turn_bounds) & sized
    return df.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def apply_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One boolean column per named rule and the list of rules that failed."""
    checked = df.withColumns({name: F.coalesce(c, F.lit(False)) for name, c in rules.items()})
    failed = F.array(*[F.when(~F.col(name), F.lit(name)) for name in rules])
    return checked.withColumn("failed_rules", F.filter(failed, lambda r: r.isNotNull()))


def declared_rules(
    turns: str = "conversations", sentiment: str = "sentiment", entities: str = "entities",
    fields: Sequence[str] = (),
) -> dict[str, Column]:
    """The declared rule set: turn count, words per turn, sentiment present, entities present.

    With ``fields`` also that these columns are there and not null.
    """
    present = {"field_check": reduce(lambda a, f: a & F.col(f).isNotNull(), fields, F.lit(True))} if fields else {}
    return present | {
        "length_check": F.size(turns).between(2, 10),
        "content_check": F.forall(turns, lambda t: F.size(words(t["value"])) >= 10),
        "sentiment_check": F.col(sentiment).isNotNull(),
        "entity_check": F.size(entities) >= 1,
    }


def trimmed_questions(questions: Column, low: int = 10, high: int = 200) -> Column:
    """Trimmed questions whose length is within bounds."""
    return F.filter(F.transform(questions, lambda q: strip(q)), lambda q: F.length(q).between(low, high))


def filter_questions(
    df: DataFrame, questions: str, cap: int, low: int = 10, high: int = 200
) -> DataFrame:
    return df.withColumn(questions, F.slice(trimmed_questions(F.col(questions), low, high), 1, cap))


def validate_requests(df: DataFrame) -> DataFrame:
    """Range checks of a request log; ``failed_fields`` names the fields out of range."""
    checks = {
        "question": F.length("question") >= 1,
        "temperature": F.col("temperature").isNull() | F.col("temperature").between(0.0, 1.0),
        "top_p": F.col("top_p").isNull() | F.col("top_p").between(0.0, 1.0),
        "max_tokens": F.col("max_tokens").isNull() | (F.col("max_tokens") >= 1),
        "context_window": F.col("context_window").isNull() | (F.col("context_window") >= 1),
    }
    used = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items() if k in df.columns}
    failed = F.array(*[F.when(~ok, F.lit(k)) for k, ok in used.items()])
    out = df.withColumn("failed_fields", F.filter(failed, lambda f: f.isNotNull()))
    return out.withColumn("is_valid", F.size("failed_fields") == 0)


def eval_steps(df: DataFrame, every: int, step: str = "step") -> DataFrame:
    return df.filter((F.col(step) % every == 0) | (F.col(step) == 1))


def eval_ready(df: DataFrame, query: str = "query", reference: str = "reference_answer") -> DataFrame:
    return df.filter(F.col(query).isNotNull() & F.col(reference).isNotNull())


def prompt_adjustments(df: DataFrame, issues: str = "issues") -> DataFrame:
    """Extra prompt lines for the issues of an answer."""
    lines = []
    for issue, line in PROMPT_ADJUSTMENTS:
        if issue == "Response contains":
            present = F.exists(issues, lambda i: i.contains("Response contains"))
        else:
            present = F.array_contains(issues, issue)
        lines.append(F.when(present, F.lit(line)))
    return df.withColumn("adjustments", F.filter(F.array(*lines), lambda x: x.isNotNull()))


# --- conversations in long form (one row per turn) -----------------------------------


def validate_turns(
    turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text",
    roles: Sequence[str] = ALLOWED_ROLES,
    turn_bounds: tuple[int, int] = TURN_BOUNDS, text_bounds: tuple[int, int] = TEXT_BOUNDS,
) -> DataFrame:
    """Structure and size check per conversation, aggregated before the shuffle."""
    known = F.coalesce(F.col(role).isin(*roles), F.lit(False)) & F.col(text).isNotNull()
    sized = F.coalesce(F.length(text).between(*text_bounds), F.lit(False))
    return turns.groupBy(conv).agg(
        F.count("*").alias("turns"),
        F.bool_and(known).alias("structure_valid"),
        (F.count("*").between(*turn_bounds) & F.bool_and(sized)).alias("size_valid"),
    )
