import re

import pytest
from pyspark.sql import functions as F

from folioflow.operators import filters
from folioflow.operators import training as tr


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_entity_spans(spark):
    text = "Premium of $1,200.50 rose 4.5% on 2024-03-01 at 10:30; Müller paid Insurers on March 3, 2024."
    rows = tr.extract_entities(docs(spark, text, "", "nothing")).collect()
    assert all(text[r.start : r.end] == r.entity for r in rows)
    found = [(r.label, r.entity) for r in rows]
    assert found == [
        ("ORG", "Premium"), ("MONEY", "$1,200.50"), ("PERCENT", "4.5%"), ("DATE", "2024-03-01"),
        ("TIME", "10:30"), ("ORG", "Insurers"), ("DATE", "March 3, 2024"),
    ]


def test_entity_confidence(spark):
    rows = spark.createDataFrame([("ab", "DATE"), ("x" * 20, "DATE"), ("abcd", "ORG")], "e string, l string")
    got = [round(r.c, 6) for r in rows.select(tr.entity_confidence("e", "l").alias("c")).collect()]
    assert got == [0.6, 1.0, 0.9]


def test_sentiment_labels(spark):
    out = {r.doc_id: (r.polarity, r.sentiment) for r in tr.sentiment(
        docs(spark, "excellent best", "terrible worst day", "good bad", "plain words"), tr.default_lexicon(spark)
    ).collect()}
    assert out == {0: (1.0, "positive"), 1: (-1.0, "negative"), 2: (0.0, "neutral"), 3: (0.0, "neutral")}


def expansions(spark, question, **kw):
    df = spark.createDataFrame([(1, question)], "query_id int, question string")
    return [r.expanded for r in tr.expand_query(df, **kw).orderBy("position").collect()]


def test_query_expansion(spark):
    got = expansions(spark, "What does Geneva cover?")
    assert got[:3] == ["What does Geneva cover?", "What does Geneva cover", "What is Geneva"]
    assert "how does geneva cover?" in got and "what is the process" in got
    assert got[-6:-5] == ["Explain What does Geneva cover"]
    assert len(got) == len(set(got)) and all(e == e.strip() and e for e in got)
    assert expansions(spark, "What?", expand=False) == ["What?"]
    assert expansions(spark, "plain text") == ["plain text"]


def test_rule_questions(spark):
    def made(text, n):
        return docs(spark, text).select(tr.rule_questions("text", n).alias("q")).first().q

    assert made("", 3) == list(tr.GENERIC_QUESTIONS[:3])
    assert made("Premium and Premium", 2) == [
        "What is Premium and why is it important?", tr.GENERIC_QUESTIONS[0],
    ]
    text = "the topic is about home cover 7 and the policy holder pays a premium"
    got = made(text, 12)
    assert got[6] == "What specific information does this document provide about home cover?"
    assert got[7] == "What are the requirements for topic is about?"
    assert got[8] == "How does policy holder pays work in practice?"
    assert got[9] == "What challenges might arise with premium?"
    assert got[10:] == [tr.FILLER_QUESTION] * 2
    assert all(len(made(t, 5)) == 5 for t in ("x", "Entity Another Names", "the policy"))


def test_parse_and_filter_questions(spark):
    row = docs(spark, " What is covered here? \nshort\n\nWhy is that so, really?")
    parsed = row.select("doc_id", tr.parse_questions("text").alias("q"))
    kept = filters.filter_questions(parsed, "q", cap=1).first().q
    assert kept == ["What is covered here?"]
    as_json = docs(spark, '{"questions": ["a", "b"]}', "{}").select(tr.parse_questions("text", "json").alias("q"))
    assert [r.q for r in as_json.collect()] == [["a", "b"], []]
    with pytest.raises(ValueError):
        tr.parse_questions("text", "xml")


def test_sharegpt_rows(spark):
    df = spark.createDataFrame(
        [("1-0", "some text", ["q1", "q2"]), ("2-0", "  ", ["q"])], "chunk_id string, chunk_text string, questions array<string>"
    )
    rows = tr.to_sharegpt(df, system_prompt="Sys").collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 2
    assert [(t["from"], t["value"]) for t in rows[0].conversations] == [
        ("system", "Sys"), ("human", "q1"), ("gpt", "some text"),
    ]
    assert re.fullmatch(r"chunk_1-0_q_[0-9a-f]{32}", rows[0].id)
    assert tr.to_sharegpt(df).first().conversations[0]["from"] == "human"


def test_payload_conversation(spark):
    long = "good words about claims and coverage for every single policy holder " * 2
    posts = spark.createDataFrame([(1, long, long), (2, "short", long)], "id long, title string, text string")
    out = {r.id: r for r in tr.payload_to_conversation(
        posts, tr.default_lexicon(spark), "id", "title", "text", F.lit("reddit/r/x"), F.lit("t")
    ).collect()}
    assert (out[1].is_valid, out[2].is_valid) == (True, False)
    assert [t["from"] for t in out[1].conversations] == ["system", "human", "assistant"]
    assert out[1].metadata.sentiment == "positive"


def test_length_accounting(spark):
    df = spark.createDataFrame([("a b c ", "d e"), ("a " * 12, "x")], "prompt string, completion string")
    got = [tuple(r)[2:] for r in tr.length_accounting(df, 10).collect()]
    assert got == [(3, 5, 0, 3, 2), (12, 13, 3, 10, 0)]


@pytest.mark.parametrize("held", [0, 1000])
def test_a_conversation_for_every_post(spark, monkeypatch, held):
    """Posts without an id or with the same one stay apart; no text is shuffled for a small lexicon."""
    monkeypatch.setattr(tr, "LEXICON_HELD", held)
    texts = ["good bad  great trip", "terrible", "plain words", None, "great"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4])]
    posts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("title", F.col("text"))
    lexicon = spark.createDataFrame([("good", 0.5), ("great", 1.0), ("bad", -0.5), ("good", 0.7), ("trip", None)], "word string, polarity double")
    out = tr.payload_to_conversation(posts, lexicon, "doc_id", "title", "text", F.lit("s"), F.lit("t"))
    assert held == 0 or "Join" not in out._jdf.queryExecution().toString()
    want = [(1, (0.5 + 0.7 - 0.5 + 1.0) / 4, "neutral"), (1, 0.0, "neutral"), (2, 0.0, "neutral"), (None, 0.0, "neutral"), (None, 1.0, "positive")]
    got = [(r.doc_id, round(r.metadata.polarity, 9), r.metadata.sentiment) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
