"""Query expansion, entities, sentiment, questions, conversations, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions.text import WORD_CHARS
from folioflow.operators import training as tr
from folioflow.operators.filters import trimmed_questions
from folioflow.operators.scale import each
from folioflow.operators.tables import hash_split
from folioflow.plans import sqltext as q
from folioflow.plans.inputs import chunks, questions, r6, texts
from folioflow.plans.registry import query
from folioflow.plans.text_queries import _PLAIN, _STOPS
from folioflow.plans.window_queries import PAIRS
from folioflow.session import stored, table


def caps(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all({x}, '[{WORD_CHARS}]+'), "
        f"lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{{5,}}'))"
    )


def _forms(forms, x: str) -> str:
    return "[" + ", ".join(f"replace({q.quoted(f)}, '%s', {x})" for f in forms) + "]"


_OTHERS = [f"regexp_extract_all(question, '{p}')" for label, p in tr.ENTITY_RULES if label != "ORG"]


def _word_sql() -> str:
    parts = []
    for word, expansions in tr.QUESTION_WORDS.items():
        plain = ", ".join(q.quoted(e) for e in expansions)
        swapped = ", ".join(f"replace(lower(question), '{word}', {q.quoted(e)})" for e in expansions)
        parts.append(f"CASE WHEN contains(lower(question), '{word}') THEN [{plain}, {swapped}] ELSE [] END")
    return " || ".join(parts)


@query(
    "expand_query",
    f"""WITH {q.QUESTIONS}, asked AS (SELECT query_id, question || '?' AS question FROM questions),
          ents AS (SELECT query_id, question, {caps('question')} || {" || ".join(_OTHERS)} AS e0 FROM asked),
          ent AS (SELECT query_id, question, {q.first_seen('e0')} AS e FROM ents),
          p AS (SELECT query_id, [question] || [replace(question, '?', '')]
                  || flatten(list_transform(e, lambda x: {_forms(tr.ENTITY_FORMS, 'x')}))
                  || {_word_sql()}
                  || {_forms(tr.REFORMULATIONS, q.strip("substring(question, 1, length(question) - 1)"))} AS p FROM ent),
          t AS (SELECT query_id, list_filter(list_transform(p, lambda x: {q.strip('x')}), lambda x: x <> '') AS t FROM p),
          u AS (SELECT query_id, {q.first_seen('t')} AS u FROM t)
        SELECT query_id, (i - 1)::INT AS position, u[i] AS expanded FROM (SELECT query_id, u, unnest(range(1, len(u) + 1)) AS i FROM u)""",
)
def expand_query(spark, folder):
    asked = questions(spark, folder).withColumn("question", F.concat("question", F.lit("?")))
    return tr.expand_query(asked)


_ENTITY_LISTS = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest("
    + (caps("text") if label == "ORG" else f"regexp_extract_all(text, '{p}')")
    + ") AS entity FROM documents"
    for label, p in tr.ENTITY_RULES
)


@query(
    "extract_entities",
    f"""WITH e AS ({_ENTITY_LISTS})
        SELECT doc_id, label, entity, count(*) AS mentions FROM e GROUP BY ALL""",
)
def extract_entities(spark, folder):
    rows = tr.extract_entities(texts(spark, folder).select("doc_id", "text"))
    return rows.groupBy("doc_id", "label", "entity").agg(F.count("*").alias("mentions"))


@query(
    "entity_confidence",
    f"""WITH e AS (SELECT doc_id, unnest({q.first_seen('c')}) AS entity FROM (SELECT doc_id, {caps('text')} AS c FROM documents))
        SELECT doc_id, entity, round(least(1.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + length(entity) / 20.0::DOUBLE) + 0.2::DOUBLE), 6) AS confidence
        FROM e WHERE least(1.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + length(entity) / 20.0::DOUBLE) + 0.2::DOUBLE) >= 0.8""",
)
def entity_confidence(spark, folder):
    found = F.array_distinct(tr.capitalised_words("text"))
    rows = each(texts(spark, folder), ["doc_id"], found, "entity")
    scored = rows.withColumn("confidence", r6(tr.entity_confidence("entity", F.lit("ORG"))))
    return scored.filter(F.col("confidence") >= 0.8)


# A lexicon of words the invented prose has.
_LEXICON = {
    "the": 0.9, "and": 0.8, "is": 0.7, "of": -0.2, "was": -0.9, "der": 0.9, "die": 0.7,
    "und": 0.8, "de": -0.8, "la": -0.9, "que": -0.7, "en": -0.75, "le": 0.75, "des": 0.95,
}
_LEXICON_SQL = "(VALUES " + ", ".join(f"('{w}', {p}::DOUBLE)" for w, p in _LEXICON.items()) + ") lex(word, polarity)"


def lexicon(spark):
    return spark.createDataFrame(list(_LEXICON.items()), "word string, polarity double")


def _sentiment_sql(rows: str, words: str) -> str:
    return f"""tok AS (SELECT doc_id, unnest({words}) AS word FROM {rows}),
      mean AS (SELECT doc_id, avg(polarity) AS m FROM tok JOIN {_LEXICON_SQL} USING (word) GROUP BY 1)"""


@query(
    "sentiment",
    f"""WITH {_sentiment_sql('documents', q.words('lower(text)'))}
        SELECT doc_id, round(coalesce(m, 0), 6) AS polarity,
          CASE WHEN m > 0.6 THEN 'positive' WHEN m < -0.6 THEN 'negative' ELSE 'neutral' END AS sentiment
        FROM documents LEFT JOIN mean USING (doc_id)""",
)
def sentiment(spark, folder):
    out = tr.sentiment(texts(spark, folder).select("doc_id", "text"), lexicon(spark))
    return out.withColumn("polarity", r6("polarity"))


def judged_texts(spark, folder):
    """Documents with their quality label."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return texts(spark, folder).select("doc_id", "text").join(labels, "doc_id")


@query(
    "learn_lexicon",
    f"""WITH s AS (SELECT quality > 0 AS g, unnest(list_distinct({q.words('lower(text)')})) AS word
            FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL),
          c AS (SELECT word, count(*) FILTER (g) AS good, count(*) AS texts FROM s GROUP BY 1),
          w AS (SELECT sum(good)::DOUBLE AS g, sum(texts)::DOUBLE AS n FROM c),
          e AS (SELECT word, texts, ln((good + 0.5::DOUBLE) / (texts - good + 0.5::DOUBLE)) - ln((g + 0.5::DOUBLE) / (n - g + 0.5::DOUBLE)) AS e,
                  sqrt(1 / (good + 0.5::DOUBLE) + 1 / (texts - good + 0.5::DOUBLE)) AS error FROM c, w WHERE texts >= 3)
        SELECT word, round((exp(e) - 1) / (exp(e) + 1), 6) AS polarity, texts FROM e WHERE abs(e) > 1.96::DOUBLE * error""",
)
def learn_lexicon(spark, folder):
    """Words that tell good documents from others, with their polarity."""
    return tr.learn_lexicon(judged_texts(spark, folder)).withColumn("polarity", r6("polarity"))


@query("lexicon_accuracy")
def lexicon_accuracy(spark, folder):
    """A lexicon learnt on the training documents, tried on the held-out ones."""
    split = hash_split(judged_texts(spark, folder), F.col("doc_id"), 70)
    learnt = stored(tr.learn_lexicon(split.filter("split = 'train'")), "lexicon")
    held_out = split.filter("split = 'validation'").select("doc_id", "text", "label")
    scored = tr.sentiment(held_out, learnt).join(held_out.select("doc_id", "label"), "doc_id")
    return tr.lexicon_accuracy(scored)


_N = 12
_PHRASE = f"(?:^|[^{WORD_CHARS}])(?:regarding|about|on|for){q.SPACE}+([a-zA-Z{q.SPACE_CHARS}]+)"
_SUBJECT = rf"(?:the|a|an){q.SPACE}+([a-zA-Z]{{5,}}(?:{q.SPACE}+[a-zA-Z]+){{0,2}})"


def questions_sql(rows: str, key: str, text: str, n: int) -> str:
    subjects = "[" + ", ".join(q.quoted(s) for s in tr.SUBJECT_QUESTIONS) + "]"
    filler = "[" + ", ".join([q.quoted(tr.FILLER_QUESTION)] * n) + "]"
    return f"""
      cut AS (SELECT {key}, substring({text}, 1, 4000) AS c, lower(substring({text}, 1, 4000)) AS l FROM {rows}),
      got AS (SELECT {key}, l, {caps('c')} AS e0,
        list_transform(list_filter(regexp_extract_all(l, '{_SUBJECT}', 1), lambda s: length(s) > 5), lambda s: {q.strip('s')}) AS s0 FROM cut),
      uni AS (SELECT {key}, l, ({q.first_seen('e0')})[1:5] AS e, ({q.first_seen('s0')})[1:5] AS s FROM got),
      asked AS (SELECT {key}, (list_transform(e, lambda x: replace({q.quoted(tr.ENTITY_QUESTION)}, '%s', x))
        || {q.string_list(tr.GENERIC_QUESTIONS)}
        || CASE WHEN contains(l, 'topic') AND regexp_matches(l, '{_PHRASE}')
             THEN [replace({q.quoted(tr.TOPIC_QUESTION)}, '%s', {q.strip(f"regexp_extract(l, '{_PHRASE}', 1)")})] ELSE [] END
        || list_transform(s, lambda x, i: replace({subjects}[i], '%s', x))
        || {filler})[1:{n}] AS questions FROM uni)"""


@query(
    "rule_questions",
    f"""WITH {q.chunk_ctes()}, marked AS (SELECT chunk_id, chunk_text || ' topic' AS t FROM chunks), {questions_sql('marked', 'chunk_id', 't', _N)}
        SELECT chunk_id, array_to_string(questions, '|') AS questions FROM asked""",
)
def rule_questions(spark, folder):
    marked = chunks(spark, folder).select("chunk_id", F.concat("chunk_text", F.lit(" topic")).alias("t"))
    return marked.select("chunk_id", F.array_join(tr.rule_questions("t", _N), "|").alias("questions"))


@query(
    "parse_questions",
    f"""SELECT conv_id, turn, (i - 1)::INT AS position, p[i] AS question FROM (
          SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM (
            SELECT conv_id, turn, list_filter(list_transform(CASE role WHEN 'user' THEN string_split(text, chr(10)) ELSE [text] END,
              lambda x: {q.strip('x')}), lambda x: length(x) BETWEEN 10 AND 200) AS p FROM conversations))""",
)
def parse_questions(spark, folder):
    """User turns come as lines, assistant turns as JSON, system turns raw."""
    as_json = F.to_json(F.struct(F.array("text").alias("questions")))
    parsed = (
        F.when(F.col("role") == "user", tr.parse_questions("text", "newline"))
        .when(F.col("role") == "assistant", tr.parse_questions(as_json, "json"))
        .otherwise(tr.parse_questions("text", "raw"))
    )
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", trimmed_questions(parsed).alias("questions")
    )
    return each(rows, ["conv_id", "turn"], "questions", "question", "position")


@query(
    "to_sharegpt",
    f"""WITH {q.chunk_ctes()}, {questions_sql('chunks', 'chunk_id', 'chunk_text', 2)},
          x AS (SELECT chunk_id, unnest(questions) AS question FROM asked)
        SELECT 'chunk_' || chunk_id || '_q_' || md5(question) AS id, 'system' AS first_role, question, md5(chunk_text) AS answer_hash, 3 AS turns
        FROM x JOIN chunks USING (chunk_id)""",
)
def to_sharegpt(spark, folder):
    parts = chunks(spark, folder).withColumn("questions", tr.rule_questions("chunk_text", 2))
    rows = tr.to_sharegpt(parts, system_prompt="Answer from the text.")
    turn = F.col("conversations")
    return rows.select(
        "id", turn[0]["from"].alias("first_role"), turn[1]["value"].alias("question"),
        F.md5(turn[2]["value"]).alias("answer_hash"), F.size(turn).alias("turns"),
    )


_CLEAN = f"array_to_string(list_filter({q.words(_PLAIN)}, lambda t: NOT list_contains({_STOPS}, lower(t))), ' ')"


@query(
    "payload_to_conversation",
    f"""WITH c AS (SELECT doc_id, source, {_CLEAN} AS b FROM documents),
          ti AS (SELECT doc_id, {_CLEAN} AS t FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents)),
          {_sentiment_sql('c', q.words('lower(b)'))}
        SELECT doc_id, 'reddit/r/' || source AS source, round(coalesce(m, 0), 6) AS polarity, md5(t) AS title_hash, md5(b) AS answer_hash,
          length(t) BETWEEN 50 AND 2000 AND length(b) BETWEEN 50 AND 2000 AS is_valid
        FROM c JOIN ti USING (doc_id) LEFT JOIN mean USING (doc_id)""",
)
def payload_to_conversation(spark, folder):
    posts = texts(spark, folder).withColumn("title", F.split("text", "\n")[0])
    rows = tr.payload_to_conversation(
        posts, lexicon(spark), "doc_id", "title", "text",
        F.concat(F.lit("reddit/r/"), "source"), F.lit("2024-01-01T00:00:00"),
    )
    turn = F.col("conversations")
    return rows.select(
        "doc_id", "source", r6("metadata.polarity").alias("polarity"),
        F.md5(turn[1]["value"]).alias("title_hash"), F.md5(turn[2]["value"]).alias("answer_hash"), "is_valid",
    )


_PROMPTS = f"""{PAIRS}, prompts AS (SELECT conv_id, turn,
    CASE WHEN system_text <> '' THEN '<|system|>' || chr(10) || system_text || chr(10) ELSE '' END
      || '<|user|>' || chr(10) || user_text || chr(10) || '<|assistant|>' || chr(10) AS prompt, assistant_text AS completion FROM paired)"""


@query("to_prompt_pairs", f"WITH {_PROMPTS} SELECT * FROM prompts")
def to_prompt_pairs(spark, folder):
    return tr.to_prompt_pairs(table(spark, folder, "conversations"))


@query(
    "length_accounting",
    f"""WITH {_PROMPTS}, l AS (SELECT conv_id, turn, len({q.words('prompt')})::INT AS p, len({q.words('prompt || completion')})::INT AS t FROM prompts)
        SELECT conv_id, turn, p AS prompt_len, t AS total_len, greatest(t - 100, 0) AS truncated, least(p, 100) AS masked,
          greatest(least(t, 100) - least(p, 100), 0) AS trained FROM l""",
)
def length_accounting(spark, folder):
    rows = tr.to_prompt_pairs(table(spark, folder, "conversations"))
    return tr.length_accounting(rows, 100).drop("prompt", "completion")
