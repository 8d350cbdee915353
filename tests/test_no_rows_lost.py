"""Awkward rows stay in the results they belong to, and leave other rows alone."""

import json

from folioflow.operators import evaluation, joins, retrieval, tables, vectorstore
from folioflow.session import scratch_path
from folioflow.sources import readers
from folioflow.streaming import jobs


def test_bad_vectors_hide_no_neighbours(spark):
    nan = float("nan")
    rows = [(i, [1.0, float(i)]) for i in range(5)]
    rows += [(10, [nan, 1.0]), (11, None), (12, [1.0]), (13, [1.0, None]), (14, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [nan, 0.0])], "query_id long, embedding array<double>")
    found = retrieval.knn(asked, vectors, k=3).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(0, 0), (0, 1), (0, 2), (1, 4), (1, 3), (1, 2)}
    pairs = retrieval.score_pairs(asked, vectors, 0.7).collect()
    assert {(r.query_id, r.vec_id) for r in pairs} >= {(0, 0), (0, 1), (1, 4)}
    assert {r.vec_id for r in vectorstore.ann(asked, vectors, k=3).collect()} <= {0, 1, 2, 3, 4}


def test_questions_of_a_rarer_length_have_neighbours(spark):
    rows = [(i, [1.0, float(i)]) for i in range(4)] + [(20 + i, [1.0, float(i), 0.0]) for i in range(4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0])]
    asked = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in retrieval.knn(asked, vectors, k=2).collect()}
    assert found == {(0, 0), (0, 1), (1, 3), (1, 2), (2, 23), (2, 22)}
    pairs = {(r.query_id, r.vec_id) for r in retrieval.score_pairs(asked, vectors, 0.9).collect()}
    assert pairs == {(0, 0), (1, 3), (2, 23)}
    near = {(r.query_id, r.vec_id) for r in vectorstore.ann(asked, vectors, k=2).collect()}
    assert (2, 23) in near and all((v >= 20) == (q == 2) for q, v in near)


def test_citations_above_ten_count(spark):
    rows = [("g", [1, 11]), ("g", [1, 12]), ("h", [40]), ("n", [])]
    sets = joins.citation_sets(spark.createDataFrame(rows, "g string, citations array<int>"), "g", "citations")
    got = {r.g: (r.answers, round(r.consistency, 9)) for r in evaluation.citation_consistency(sets, "g").collect()}
    assert got == {"g": (2, round(1 / 3, 9)), "h": (1, 0.0)}


def test_broken_conversations_are_set_aside(spark, tmp_path):
    good = {"id": "a", "conversations": [{"from": "human", "value": "hi"}]}
    (tmp_path / "a.json").write_text(json.dumps(good) + '\n{"id": "b", "conversations": [{"from": "human", "value": "hi"}], "topic"')
    ok, bad = readers.read_conversations(spark, str(tmp_path), multi_line=False)
    assert [r.id for r in ok.collect()] == ["a"] and bad.count() == 1


def test_duplicates_with_repeated_ids_and_null_texts(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (1, "a"), (3, None), (4, None), (None, "c"), (None, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = tables.drop_duplicates(frame)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, "a"), (2, "b"), (3, None), (None, "c")], key=repr
    )
    again = tables.idempotent_load(kept, frame)
    assert again.count() == 0


def test_stream_upsert_keeps_null_texts_once(spark):
    path = scratch_path(spark, "test-null-upsert")
    frame = spark.createDataFrame([(1, None), (2, None), (3, "x")], "doc_id long, text string")
    write = jobs.stream_upsert(frame, path)
    write(frame, 0)
    write(frame, 1)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_empty_questions_are_refused(spark):
    hits = spark.createDataFrame([(1, " ", 1, "s", "t"), (2, "why", 1, "s", "t"), (3, None, 1, "s", "t")],
        "query_id long, question string, rank int, source string, chunk_text string")
    assert sorted(r.query_id for r in evaluation.refused_questions(hits).collect()) == [1, 3]
    assert [r.query_id for r in evaluation.generate_citations(hits).collect()] == [2]
