"""From text to training rows: entities, sentiment, questions, conversations, prompts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import (
    SPACE,
    SPACE_CHARS,
    UNICODE,
    WORD_CHARS,
    clean_text,
    count_tokens,
    strip,
    words,
)
from folioflow.operators.filters import validate_conversation
from folioflow.operators.scale import broadcast_if_small, each
from folioflow.operators.windows import pair_turns
from folioflow.session import stored

# Expansions per question word, in this order.
QUESTION_WORDS = {
    "what": ("how", "why", "when", "where", "which", "what is the process"),
    "how": ("what is the process", "what are the steps", "what is the method", "explain the process"),
    "why": ("what is the reason", "what is the cause", "what is the purpose", "explain why"),
    "when": ("at what time", "during what period", "what is the timing", "when did it happen"),
    "where": ("in what location", "at what place", "what is the position", "where can I find"),
    "which": ("what is the best", "what are the options", "what are the choices", "what should I choose"),
}
# Query forms per entity, and reformulations of a question.
ENTITY_FORMS = (
    "What is %s", "Tell me about %s", "Explain %s", "Describe %s", "Can you elaborate on %s",
)
REFORMULATIONS = (
    "Explain %s", "Describe %s", "Tell me about %s", "Can you elaborate on %s",
    "Provide information about %s", "Give me details about %s",
)

# Rule-based question wording.
ENTITY_QUESTION = "What is %s and why is it important?"
GENERIC_QUESTIONS = (
    "What are the main points discussed in this document?",
    "How does this information relate to industry best practices?",
    "What are the key takeaways from this content?",
    "Can you summarize the most important information in this document?",
    "What practical applications does this information have?",
    "How would you explain this information to someone new to the topic?",
)
TOPIC_QUESTION = "What specific information does this document provide about %s?"
SUBJECT_QUESTIONS = (
    "What are the requirements for %s?",
    "How does %s work in practice?",
    "What challenges might arise with %s?",
    "How can %s be improved?",
    "What are the benefits of %s?",
)
FILLER_QUESTION = "What are the implications of this information for the industry?"
QUESTION_SOURCE_CHARS = 4000

# System text of collected conversations.
EXPERT_PROMPT = (
    "You are an insurance expert assistant. Provide accurate, helpful information about "
    "insurance policies, coverages, and claims."
)

# Entity rules: label and pattern. They stand in for a tagger model.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ENTITY_RULES = (
    ("ORG", r"\b[A-Z][a-zA-Z]{5,}\b"),
    ("MONEY", r"\$\d[\d,]*(?:\.\d+)?"),
    ("PERCENT", r"\b\d+(?:\.\d+)?%"),
    ("DATE", rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|(?:{MONTHS}) \d{{1,2}}, \d{{4}})\b"),
    ("TIME", r"\b\d{1,2}:\d{2}(?::\d{2})?\b"),
)
KEY_LABELS = ("PERSON", "ORG", "GPE")

# A small default lexicon; any table (word, polarity) takes its place.
LEXICON = {
    "good": 0.7, "great": 0.8, "excellent": 1.0, "best": 1.0, "happy": 0.8, "helpful": 0.5,
    "clear": 0.1, "easy": 0.4, "fair": 0.7, "safe": 0.5, "bad": -0.7, "terrible": -1.0,
    "worst": -1.0, "poor": -0.4, "unfair": -0.5, "wrong": -0.5, "difficult": -0.5,
    "denied": -0.4, "expensive": -0.5, "unhappy": -0.6,
}
# Words of a lexicon that are written into an expression.
LEXICON_HELD = 1_000


# --- entities and sentiment ----------------------------------------------------------


def capitalised_words(c: Column | str) -> Column:
    """Words of six or more ASCII letters that start with a capital, in order."""
    found = F.regexp_extract_all(c, F.lit(f"[{WORD_CHARS}]+"), F.lit(0))
    return F.filter(found, lambda w: w.rlike(r"^[A-Z][a-zA-Z]{5,}$"))


def entity_texts(c: Column | str) -> Column:
    """Distinct entity texts by rule, rule after rule."""
    others = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for label, p in ENTITY_RULES if label != "ORG"]
    return F.array_distinct(F.concat(capitalised_words(c), *others))


def extract_entities(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per entity with its span; other columns but the text are copied."""
    rules = [(label, re.compile(p)) for label, p in ENTITY_RULES]
    kind = "array<struct<entity:string,label:string,start:int,`end`:int>>"

    @F.pandas_udf(kind)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda t: sorted(
                    (
                        {"entity": m.group(), "label": label, "start": m.start(), "end": m.end()}
                        for label, rule in rules
                        for m in rule.finditer(t or "")
                    ),
                    key=lambda e: (e["start"], e["end"]),
                )
            )

    rest = [c for c in df.columns if c != text]
    tagged = df.withColumn("_e", tag(F.col(text)))
    return each(tagged, rest, "_e", "_row").select(*rest, "_row.*")


def entity_confidence(entity: Column | str, label: Column | str) -> Column:
    """Longer entities and key labels count more; at most 1."""
    by_length = F.least(F.lit(1.0), 0.5 + F.length(entity) / 20)
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label.isin(*KEY_LABELS), F.least(F.lit(1.0), by_length + 0.2)).otherwise(by_length)


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "word string, polarity double")


def learn_lexicon(
    labelled: DataFrame, text: str = "text", label: str = "label", least: int = 3, sure: float = 1.96
) -> DataFrame:
    """A lexicon (word, polarity, texts) from texts with a label above 0 (good) or not.

    A word's evidence is the logarithm of its odds to stand in a good text against those of
    all words, smoothed by half a text. Words in fewer than ``least`` texts, and those whose
    evidence is within ``sure`` standard errors of none, teach nothing. ``polarity`` is the
    evidence brought to -1 to 1. Null texts and labels are left out.

    Texts count a word once; counts are added up in the tasks first, so a word in every text
    is no hot key.
    """
    known = labelled.select(F.col(text).alias("_t"), F.col(label).alias("_l")).filter("_t IS NOT NULL AND _l IS NOT NULL")
    seen = each(known, [(F.col("_l") > 0).cast("int").alias("_good")], F.array_distinct(words(F.lower("_t"))), "word")
    counts = seen.groupBy("word").agg(F.sum("_good").alias("good"), F.count("*").alias("texts"))
    whole = counts.agg(F.sum("good").alias("g"), F.sum("texts").alias("n")).first()
    good, bad = float(whole["g"] or 0), float((whole["n"] or 0) - (whole["g"] or 0))
    up, down = F.col("good") + 0.5, F.col("texts") - F.col("good") + 0.5
    evidence = F.log(up / down) - F.lit(log((good + 0.5) / (bad + 0.5)))
    error = F.sqrt(1 / up + 1 / down)
    return (
        counts.filter(F.col("texts") >= least)
        .withColumn("_e", evidence)
        .filter(F.abs("_e") > sure * error)
        .select("word", F.tanh(F.col("_e") / 2).alias("polarity"), "texts")
    )


def lexicon_accuracy(scored: DataFrame, label: str = "label") -> DataFrame:
    """How well polarities (``polarity``) tell labels: texts, accuracy, and the share of the larger class."""
    right = (F.col("polarity") >= 0) == (F.col(label) > 0)
    good = F.avg((F.col(label) > 0).cast("double"))
    return scored.filter(F.col(label).isNotNull()).agg(
        F.count("*").alias("texts"), F.avg(right.cast("double")).alias("accuracy"),
        F.greatest(good, 1 - good).alias("larger_class"),
    )


def sentiment(
    df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", bound: float = 0.6
) -> DataFrame:
    """Mean polarity of the words a lexicon knows (0 if none) and its label."""
    toks = each(df, [key], words(F.lower(text)), "word")
    mean = toks.join(broadcast_if_small(lexicon), "word").groupBy(key).agg(
        F.avg("polarity").alias("_mean")
    )
    polarity = F.coalesce("_mean", F.lit(0.0))
    return (
        df.select(key)
        .join(mean, key, "left")
        .select(key, polarity.alias("polarity"), _mood(polarity, bound).alias("sentiment"))
    )


def _mood(polarity: Column, bound: float = 0.6) -> Column:
    return F.when(polarity > bound, "positive").when(polarity < -bound, "negative").otherwise("neutral")


def _moods(df: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``df`` with polarity and sentiment of its text.

    A lexicon of at most ``LEXICON_HELD`` words is part of the expression, so that no text is
    shuffled or made twice. A larger one meets the words in a join, and the texts are written first.
    """
    known = lexicon.filter("word IS NOT NULL").select("word", F.col("polarity").cast("double").alias("p"))
    held = known.limit(LEXICON_HELD + 1).collect()
    if len(held) > LEXICON_HELD:
        # Rows get a number of their own, so that those without a key or with equal keys stay apart.
        df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "moods")
        return df.join(sentiment(df, lexicon, "_row"), "_row").drop("_row")
    scores: dict[str, list[float]] = {}
    for word, p in held:
        # As in a mean, a word without a polarity is left out.
        if p is not None:
            scores.setdefault(word, []).append(p)
    polarity = F.lit(0.0)
    if scores:
        table = F.create_map(*(F.lit(x) for w, ps in scores.items() for x in (w, ps)))
        hits = F.filter(words(F.lower("text")), lambda w: w.isin(list(scores)))
        found = F.flatten(F.transform(hits, lambda w: F.element_at(table, w)))
        df = df.withColumn("_found", found)
        total = F.aggregate("_found", F.lit(0.0), lambda a, x: a + x)
        polarity = F.when(F.size("_found") > 0, total / F.size("_found")).otherwise(0.0)
    return df.withColumn("polarity", polarity).withColumn("sentiment", _mood(F.col("polarity"))).drop("_found")


# --- questions -----------------------------------------------------------------------


def _forms(forms: Sequence[str], of: Column) -> Column:
    return F.array(*[F.replace(F.lit(f), F.lit("%s"), of) for f in forms])


def expand_query(
    df: DataFrame, query: str = "question", key: str = "query_id", expand: bool = True
) -> DataFrame:
    """Rows (key, position, expanded) of distinct forms, in order of first occurrence."""
    q = F.col(query)
    if not expand:
        return df.select(key, F.lit(0).alias("position"), q.alias("expanded"))
    none = F.array().cast("array<string>")
    lowered = F.lower(q)
    parts = [F.array(q), F.when(q.contains("?"), F.array(F.replace(q, F.lit("?"), F.lit("")))).otherwise(none)]
    parts.append(F.flatten(F.transform(entity_texts(q), lambda e: _forms(ENTITY_FORMS, e))))
    for word, expansions in QUESTION_WORDS.items():
        plain = [F.lit(e) for e in expansions]
        replaced = [F.replace(lowered, F.lit(word), F.lit(e)) for e in expansions]
        parts.append(F.when(lowered.contains(word), F.array(*plain, *replaced)).otherwise(none))
    base = strip(F.substring(q, F.lit(1), F.length(q) - 1))
    parts.append(F.when(q.endswith("?"), _forms(REFORMULATIONS, base)).otherwise(none))
    trimmed = F.transform(F.array_distinct(F.concat(*parts)), lambda e: strip(e))
    full = F.array_distinct(F.filter(trimmed, lambda e: e != ""))
    return each(df, [key], full, "expanded", "position")


def rule_questions(text: Column | str, n: int = 3) -> Column:
    """Exactly n questions on a text, from entities, general ones, topic, subjects, filler."""
    content = F.substring(text, 1, QUESTION_SOURCE_CHARS)
    lowered = F.lower(content)
    none = F.array().cast("array<string>")
    entities = F.slice(F.array_distinct(capitalised_words(content)), 1, 5)
    by_entity = F.transform(entities, lambda e: F.replace(F.lit(ENTITY_QUESTION), F.lit("%s"), e))
    general = F.array(*[F.lit(g) for g in GENERIC_QUESTIONS])
    phrase = (
        f"{UNICODE}(?:^|[^{WORD_CHARS}])(?:regarding|about|on|for){SPACE}+([a-zA-Z{SPACE_CHARS}]+)"
    )
    has_topic = lowered.contains("topic") & lowered.rlike(phrase)
    topic = strip(F.regexp_extract(lowered, phrase, 1))
    by_topic = F.when(has_topic, _forms([TOPIC_QUESTION], topic)).otherwise(none)
    subject = rf"{UNICODE}(?:the|a|an){SPACE}+([a-zA-Z]{{5,}}(?:{SPACE}+[a-zA-Z]+){{0,2}})"
    found = F.regexp_extract_all(lowered, F.lit(subject), F.lit(1))
    subjects = F.slice(
        F.array_distinct(F.transform(F.filter(found, lambda s: F.length(s) > 5), lambda s: strip(s))),
        1, len(SUBJECT_QUESTIONS),
    )
    templates = F.array(*[F.lit(s) for s in SUBJECT_QUESTIONS])
    by_subject = F.transform(
        subjects, lambda s, i: F.replace(F.element_at(templates, i + 1), F.lit("%s"), s)
    )
    filler = F.array_repeat(F.lit(FILLER_QUESTION), n)
    return F.slice(F.concat(by_entity, general, by_topic, by_subject, filler), 1, n)


def parse_questions(text: Column | str, fmt: str = "newline") -> Column:
    """Generated text as an array of questions."""
    if fmt == "newline":
        return F.split(text, "\n")
    if fmt == "json":
        listed = F.from_json(F.get_json_object(text, "$.questions"), "array<string>")
        return F.coalesce(listed, F.array().cast("array<string>"))
    if fmt == "raw":
        return F.array(text)
    raise ValueError("fmt must be newline, json or raw")


# --- conversations and prompts -------------------------------------------------------


def to_sharegpt(
    chunks: DataFrame, questions: str = "questions", system_prompt: str | None = None, text: str = "chunk_text"
) -> DataFrame:
    """One conversation per chunk and question; the chunk is the answer."""

    def turn(who: str, value: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), value.alias("value"))

    rows = each(chunks.filter(strip(text) != ""), chunks.columns, questions, "_q")
    turns = [turn("human", F.col("_q")), turn("gpt", F.col(text))]
    if system_prompt:
        turns.insert(0, turn("system", F.lit(system_prompt)))
    return rows.select(
        F.concat_ws("_", F.lit("chunk"), "chunk_id", F.lit("q"), F.md5("_q")).alias("id"),
        "chunk_id",
        *[c for c in ("source", "topic") if c in chunks.columns],
        F.array(*turns).alias("conversations"),
    )


def payload_to_conversation(
    posts: DataFrame, lexicon: DataFrame, key: str, title: str, text: str, source: Column, ts: Column,
    text_bounds: tuple[int, int] = (50, 2000),
) -> DataFrame:
    """Cleaned post as system, human and assistant turns, with sentiment, entities, check."""
    cleaned = posts.select(
        key, clean_text(title).alias("title"), clean_text(text).alias("text"),
        source.alias("source"), ts.alias("timestamp"),
    )

    def turn(who: str, value: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), value.alias("value"))

    rows = _moods(cleaned, lexicon).select(
        key, "source", "timestamp",
        F.struct("polarity", "sentiment", entity_texts("text").alias("entities")).alias("metadata"),
        F.array(
            turn("system", F.lit(EXPERT_PROMPT)),
            turn("human", F.col("title")),
            turn("assistant", F.col("text")),
        ).alias("conversations"),
    )
    return validate_conversation(rows, text_bounds=text_bounds)


def render_prompt(system: Column | str, user: Column | str) -> Column:
    """Role-tagged prompt; the system part only if there is one."""
    system = F.col(system) if isinstance(system, str) else system
    head = F.when(
        F.coalesce(system, F.lit("")) != "", F.concat(F.lit("<|system|>\n"), system, F.lit("\n"))
    ).otherwise(F.lit(""))
    return F.concat(head, F.lit("<|user|>\n"), user, F.lit("\n<|assistant|>\n"))


def to_prompt_pairs(turns: DataFrame) -> DataFrame:
    return pair_turns(turns).select(
        "conv_id", "turn",
        render_prompt("system_text", "user_text").alias("prompt"),
        F.col("assistant_text").alias("completion"),
    )


def length_accounting(df: DataFrame, max_len: int = 2048) -> DataFrame:
    """Word counts of a training row: prompt, whole, cut off, masked, trained on."""
    prompt = count_tokens("prompt")
    whole = count_tokens(F.concat("prompt", "completion"))
    kept = F.least(whole, F.lit(max_len))
    masked = F.least(prompt, F.lit(max_len))
    return df.withColumns(
        {
            "prompt_len": prompt,
            "total_len": whole,
            "truncated": F.greatest(whole - max_len, F.lit(0)),
            "masked": masked,
            "trained": F.greatest(kept - masked, F.lit(0)),
        }
    )
