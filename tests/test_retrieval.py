import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import retrieval, vectorindex, vectorstore

QUESTIONS = [
    (1, "What does comprehensive auto insurance cover?"),
    (2, "What is the deductible for collision coverage?"),
    (3, "???"),
]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(400, 16))
    m[100:200] = m[0]  # a quarter of the rows are copies of one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).cache()


@pytest.fixture(scope="module")
def asked(spark, vectors):
    m, _ = vectors
    rows = [(q, [float(x) for x in m[q]]) for q in (0, 5, 150, 399)]
    return spark.createDataFrame(rows, "query_id long, embedding array<float>")


def brute(m, q, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit.astype(np.float32).astype(float) @ unit[q], 5)
    return sorted(range(len(m)), key=lambda i: (-s[i], i))[:k]


def test_knn_is_exact_with_many_copies(vectors, asked):
    m, df = vectors
    got = retrieval.knn(asked, df, 7).orderBy("query_id", "rank").collect()
    for q in (0, 5, 150, 399):
        assert [r.vec_id for r in got if r.query_id == q] == brute(m, q, 7)


def test_small_parts_give_the_same(vectors, asked, monkeypatch):
    _, df = vectors
    want = retrieval.knn(asked, df, 7).drop("score").collect()
    pairs = retrieval.score_pairs(asked, df, 0.2).select("query_id", "vec_id").collect()
    monkeypatch.setattr(vectorindex, "PART_VALUES", 90 * 16)
    got = retrieval.knn(asked, df, 7).drop("score").collect()
    assert sorted(got) == sorted(want)
    again = retrieval.score_pairs(asked, df, 0.2).select("query_id", "vec_id").collect()
    assert sorted(again) == sorted(pairs)


def test_approximate_search_ranks_by_cosine_and_recalls(vectors, asked):
    _, df = vectors
    index = vectorindex.build(df)
    exact = retrieval.knn(asked, index, 10)
    found = vectorstore.ann(asked, index, 10)
    recall = vectorstore.recall(found, exact).agg(F.avg("recall").alias("r")).first().r
    assert recall >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in retrieval.score_pairs(asked, index, -1.0).collect()}
    assert all(scores[(r.query_id, r.vec_id)] == pytest.approx(r.score) for r in found.collect())


def test_mmr_against_plain_loops(vectors, asked):
    m, df = vectors
    near = retrieval.knn(asked, df, 12).join(df, "vec_id")
    got = retrieval.mmr(near, 5, 0.7).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 5, 399):
        left = sorted(((r.vec_id, r.score) for r in near.collect() if r.query_id == q), key=lambda x: (-x[1], x[0]))
        chosen = []
        while left and len(chosen) < 5:
            value = lambda c: round(
                0.7 * c[1] - 0.3 * max((float(unit[c[0]] @ unit[j]) for j in chosen), default=0.0), 6
            )
            best = max(left, key=lambda c: (value(c), -left.index(c)))
            chosen.append(best[0])
            left.remove(best)
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == chosen


def chunks(spark, *texts):
    rows = [(i, 0, f"{i}-0", t, f"s{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, chunk_index int, chunk_id string, chunk_text string, source string"
    )


def test_retrieve_filters_ranks_and_keeps_five(spark):
    asked = spark.createDataFrame(QUESTIONS, "query_id int, question string")
    texts = [f"what does auto insurance cover? part {i}" for i in range(12)]
    store = chunks(spark, *texts, "nothing shared here", "the deductible is 500 for collision")
    out = retrieval.retrieve(asked, store).collect()
    first = sorted(r.rank for r in out if r.query_id == 1)
    assert first == [1, 2, 3, 4, 5]
    assert all(r.overlap > 0.1 for r in out)
    assert not [r for r in out if r.query_id == 3]
    top = [r for r in out if r.query_id == 2 and r.rank == 1][0]
    assert top.chunk_text.startswith("the deductible")
    assert retrieval.hits_relevant(retrieval.retrieve(asked, store)).filter("not all_relevant").count() == 0
    again = retrieval.retrieve(asked, store).collect()
    assert sorted(again) == sorted(out)


def test_equal_questions_are_scored_once_and_all_answered(spark):
    asked = spark.createDataFrame([(i, "auto cover") for i in range(4)], "query_id int, question string")
    hits = retrieval.nearest_by_terms(asked, chunks(spark, "auto cover", "auto", "none"), 2).collect()
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in hits) == sorted(
        (q, c, n) for q in range(4) for c, n in (("0-0", 1), ("1-0", 2))
    )


def test_rerank_ties_keep_prior_rank(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a b", "x"), (1, 2, "a b", "a"), (1, 3, "a b", "b"), (1, 4, "a b", "a b")],
        "query_id int, rank int, question string, chunk_text string",
    )
    order = [r.rank for r in retrieval.rerank(hits).orderBy("new_rank").collect()]
    assert order == [4, 2, 3, 1]
    assert [r.rank for r in retrieval.rerank_top_k(hits, 2).orderBy("new_rank").collect()] == [4, 2]


def test_prompt(spark):
    asked = spark.createDataFrame([(1, "Why?"), (2, "How?")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 2, "two"), (1, 1, "one")], "query_id int, rank int, chunk_text string")
    out = {r.query_id: r.prompt for r in retrieval.build_prompt(hits, asked, "Be brief.").collect()}
    assert out[1].startswith("System: Be brief.\n\nUse the following") and "\n\none\n\ntwo\n\nQuestion: Why?\n" in out[1]
    assert out[2].endswith("\n\n\n\nQuestion: How?\nHelpful Answer:")


def test_chunk_vectors_are_unit_length(spark):
    made = vectorstore.embed_chunks(chunks(spark, "a b c", "a d", "e"), 64)
    health = vectorstore.vector_health(made, 64).first()
    assert (health.vectors, health.wrong_dimension, health.not_normalised) == (3, 0, 0)


def test_health_counts_faults(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0],), ([2.0, 0.0],), ([1.0],), (None,)], "embedding array<float>"
    )
    row = vectorstore.vector_health(df, 2).first()
    assert (row.vectors, row.missing, row.wrong_dimension, row.not_normalised) == (4, 1, 1, 1)
