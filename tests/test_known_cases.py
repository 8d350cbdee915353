"""Known cases: questions and their documents, path rules, sections and time bounds."""

import time

import pytest
from pyspark.sql import functions as F

from folioflow import session
from folioflow.functions import text
from folioflow.operators import evaluation, retrieval, splitting
from folioflow.sources import readers

QUESTIONS = [
    "Which harbours accept vessels above forty metres?",
    "When does the night ferry to Lerwick sail?",
    "Who signs the log after a change of watch?",
    "Where are spare flares stowed aboard?",
    "Why was the eastern channel dredged twice?",
    "Can pilots refuse to board during gales?",
    "How deep must an anchor chain reach?",
    "Should cargo manifests list ballast water?",
    "What tonnage triggers an escort tug?",
    "Does fog suspend berth reservations?",
]


def documents(spark, n):
    rows = [(i, f"Test document {i}", f"test{i}.txt", "test") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, topic string")


def test_policy_tree(spark, tmp_path):
    for lob in ("auto", "home", "life"):
        for state in ("CA", "NY", "TX"):
            folder = tmp_path / "raw" / lob / state
            folder.mkdir(parents=True)
            (folder / "policy.txt").write_text(f"{lob} policy for {state}")
    rows = readers.read_text_dir(spark, str(tmp_path)).select(
        "text", text.path_lob("path").alias("lob"), text.path_state("path").alias("state")
    )
    got = {(r.lob, r.state, r.text) for r in rows.collect()}
    assert len(got) == 9
    assert all(t == f"{lob} policy for {state}" for lob, state, t in got)


def test_metadata_is_copied_to_every_chunk(spark):
    df = documents(spark, 3).withColumn("text", F.lit("One. Two. Three"))
    for split in (splitting.split_sentences, splitting.split_tokens, splitting.split_recursive):
        assert all(r.topic == "test" and r.source == f"test{r.doc_id}.txt" for r in split(df).collect())


def test_neighbouring_windows_share_words(spark):
    df = documents(spark, 1).withColumn(
        "text", F.lit("Seven grey herons waited by the lock while barges passed slowly toward the old mill.")
    )
    shared = splitting.chunk_overlap(splitting.split_tokens(df, 6, 2)).collect()
    assert shared and all(r.shared_words > 0 for r in shared)


def test_hundred_documents_split_and_cite_within_five_seconds(spark):
    df = documents(spark, 100).cache()
    start = time.time()
    assert splitting.split_tokens(df).count() == 100
    assert time.time() - start < 5
    hits = df.select(
        F.lit(1).alias("query_id"), F.lit("test query").alias("question"), F.col("doc_id").alias("rank"),
        "source", F.col("text").alias("chunk_text"),
    )
    start = time.time()
    assert evaluation.generate_citations(hits, limit=None).count() == 100
    assert time.time() - start < 5
    assert evaluation.generate_citations(hits).count() == 5


def test_questions_find_their_documents(spark):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string")
    store = spark.createDataFrame(
        [(i, 0, f"{i}-0", f"answer part {i}: {q.rstrip('?').lower()}", "s") for i, q in enumerate(QUESTIONS)],
        "doc_id long, chunk_index int, chunk_id string, chunk_text string, source string",
    )
    top = retrieval.retrieve(asked, store).filter("rank = 1").collect()
    assert {r.query_id: r.doc_id for r in top} == {i: i for i in range(len(QUESTIONS))}


def test_section_rate(spark):
    content = """
        PART 1: Tides
        High water comes twice a day along this coast.

        PART 2: Moorings
        Buoys are numbered from the pier outward.

        PART 3: Signals
        Two short blasts announce a turn to port.
        """
    df = spark.createDataFrame([(1, content)], "doc_id long, text string")
    sections = spark.createDataFrame([(1, f"PART {i}") for i in (1, 2, 3)], "doc_id long, section string")
    chunks = splitting.split_sentences(df)
    assert splitting.section_preservation(chunks, sections).first().preservation_rate >= 80
    assert splitting.missing_sections(chunks, sections).count() == 0


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, value, master):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master})

    assert session.shared_folder(Session("s3://bucket/x/", "yarn")) == "s3://bucket/x"
    with pytest.raises(RuntimeError):
        session.shared_folder(Session(None, "yarn"))
    assert session.shared_folder(Session(None, "local[2]"))
