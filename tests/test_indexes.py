"""Written indexes over vectors and terms, pattern matching and set counts, against plain loops."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import joins, matching, retrieval, splitting, termindex, vectorindex, vectorstore
from folioflow.plans.inputs import centroids
from folioflow.session import table

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 40 centres, a third of them copies of one, and some rows of another length."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 12))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * 0.3
    m[:1000] = m[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    odd = [(10_000 + i, [float(x) for x in rng.normal(size=3)]) for i in range(20)]
    odd += [(20_000, None), (20_001, [float("nan")] * 12), (20_002, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    return m, frame


def asked(spark, m, picks):
    rows = [(q, [float(x) for x in m[q] + 0.01]) for q in picks]
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


def plain_scores(m, q):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    v = m[q] + 0.01
    return np.round(unit @ (v / np.linalg.norm(v)), 10)


@pytest.mark.parametrize("part_values", [1_200, 4_000_000])
def test_index_is_exact_with_copies_and_parts(spark, clustered, monkeypatch, part_values):
    monkeypatch.setattr(vectorindex, "PART_VALUES", part_values)
    m, frame = clustered
    index = vectorindex.load(spark, vectorindex.build(frame, most_cells=30).path)
    assert sum(int(c.rows.sum()) for c in index.cells.values()) == 3021
    assert part_values > 1_200 or index.cells[12].parts.max() > 8
    picks = [0, 5, 1500, 2999]
    got = index.nearest(asked(spark, m, picks), 9).collect()
    pairs = {(r.query_id, r.vec_id) for r in index.pairs(asked(spark, m, picks), 0.9).collect()}
    want_pairs = set()
    for q in picks:
        s = plain_scores(m, q)
        want = sorted(range(3000), key=lambda i: (-s[i], i))[:9]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
        want_pairs |= {(q, int(i)) for i in np.flatnonzero(s >= 0.9)}
    assert pairs == want_pairs
    few = index.nearest(spark.createDataFrame([(1, [1.0, 0.0, 0.5])], "query_id long, embedding array<double>"), 50)
    assert sorted(r.vec_id for r in few.collect()) == list(range(10_000, 10_020))


def test_only_probed_cells_are_read_and_recall_holds(spark, clustered):
    m, frame = clustered
    index = vectorindex.build(frame)
    questions = asked(spark, m, range(7, 3000, 60))
    found = vectorstore.ann(questions, index, 10, probes=6)
    exact = retrieval.knn(questions, index, 10)
    assert vectorstore.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert len(index.cells[12].centres) > 12
    plan = index.rows([(12, 3)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
    files = {r.f for r in index.rows([(12, 3)]).select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all("dim=12/cell=3/" in f for f in files)


def test_recall_on_the_given_table(spark, small):
    vectors = table(spark, small, "embeddings").select("vec_id", "embedding")
    index = vectorindex.build(vectors)
    rows = vectors.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id").unionByName(centroids(spark, small))
    exact = index.nearest(rows, 10)
    recall = vectorstore.recall(vectorstore.ann(rows, index, 10), exact).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def test_rows_without_an_id_leave_other_ids_alone(spark):
    rows = [(None, [1.0, 0.0]), (BIG, [1.0, 0.1]), (BIG + 1, [1.0, 0.2]), (2**62 + 1, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    questions = spark.createDataFrame([(BIG, [1.0, 0.05]), (None, [0.0, 1.0])], "query_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id, r.rank) for r in retrieval.knn(questions, vectors, 2).collect()}
    assert got == {(BIG, BIG, 1), (BIG, None, 2), (None, 2**62 + 1, 1), (None, BIG + 1, 2)}
    assert {r.vec_id for r in retrieval.score_pairs(questions, vectors, 0.9).collect()} == {None, BIG, BIG + 1, 2**62 + 1}
    assert {r.vec_id for r in vectorstore.ann(questions, vectors, 4).collect()} == {None, BIG, BIG + 1, 2**62 + 1}
    near = retrieval.knn(questions, vectors, 4).filter("query_id IS NOT NULL").join(vectors.filter("vec_id IS NOT NULL"), "vec_id")
    near = near.unionByName(spark.createDataFrame([(None, BIG, 0.1, 9, [1.0, 1.0])], near.schema))
    assert {r.vec_id for r in retrieval.mmr(near, 4).collect()} == {None, BIG, BIG + 1, 2**62 + 1}


def test_no_rows(spark, clustered):
    m, frame = clustered
    none = frame.limit(0)
    assert retrieval.knn(asked(spark, m, [1]), none).count() == 0
    assert retrieval.knn(asked(spark, m, [1]).limit(0), frame.limit(10)).count() == 0
    assert retrieval.score_pairs(asked(spark, m, [1]), none, 0.1).count() == 0


def chunk_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"c{i}", " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 25)))) for i in range(n)]
    return [*rows, ("c-null", None), (None, "w1 w2 w3 w40"), ("c-copy", rows[3][1]), ("c-copy", rows[3][1])]


def plain_hits(chunks, questions, k):
    out = set()
    for q, text in questions:
        terms = set((text or "").lower().split())
        scored = []
        for c, body in chunks:
            shared = len(terms & set((body or "").lower().split()))
            if shared:
                scored.append((-shared / len(terms), c is None, c or "", c))
        for i, (s, _, _, c) in enumerate(sorted(scored)[:k]):
            out.add((q, c, round(-s, 9), i + 1))
    return out


@pytest.mark.parametrize("block", [7, 50, 4096])
def test_term_index_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(termindex, "BLOCK_CHUNKS", block)
    rows = chunk_rows(5, 300)
    rng = random.Random(9)
    questions = [(i, " ".join(rng.choices([f"w{j}" for j in range(70)], k=rng.randint(1, 9)))) for i in range(40)]
    questions += [(100, "W1 w1 W2"), (101, "W1 w1 W2"), (102, ""), (103, None), (104, "nowhere"), (None, "w5 w6")]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_text string").repartition(4)
    frame = spark.createDataFrame(questions, "query_id int, question string")
    want = plain_hits(rows, questions, 4)
    once = retrieval.nearest_by_terms(frame, chunks, 4).collect()
    assert {(r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in once} == want
    index = termindex.load(spark, termindex.build(chunks, buckets=8).path)
    for k in (4, 1):
        got = index.search(frame, k).collect()
        assert {(r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in got} == {w for w in want if w[3] <= k}


def test_stored_terms_are_read_by_bucket(spark):
    chunks = spark.createDataFrame(chunk_rows(6, 50), "chunk_id string, chunk_text string")
    index = termindex.build(chunks, buckets=16)
    one = spark.createDataFrame([("w3",)], "term string")
    held = index.asked_postings(one)
    assert {r.term for r in held.collect()} == {"w3", None}
    empty = index.search(spark.createDataFrame([(1, "zzz")], "query_id int, question string"))
    assert empty.count() == 0
    assert termindex.build(chunks.limit(0)).search(spark.createDataFrame([(1, "w1")], "query_id int, question string")).count() == 0


def test_patterns_against_plain_search():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("ab é") for _ in range(rng.randint(0, 80))).encode()
        patterns = list({"".join(rng.choice("ab é") for _ in range(rng.randint(1, 12))).encode() for _ in range(30)})
        patterns += [p for p in {text[a : a + n] for a in (0, 3, 9) for n in (1, 20, 40)} if p and p not in patterns]
        found = set(matching.Patterns(patterns).found(text).tolist())
        assert found == {i for i, p in enumerate(patterns) if p in text}


@pytest.mark.parametrize("held", [3, 65_536])
def test_found_sections(spark, monkeypatch, held):
    monkeypatch.setattr(splitting, "SECTIONS_HELD", held)
    monkeypatch.setattr(splitting, "SEARCH_BYTES", 40)
    rng = random.Random(8)
    docs = {k: [" ".join(rng.choices(["ab", "cd", "é"], k=rng.randint(1, 4))) for _ in range(12)] for k in range(5)}
    chunks = [(k, " ".join(lines[i : i + 3])) for k, lines in docs.items() for i in range(0, 10, 4)] + [(None, "ab"), (1, None)]
    sections = [(k, s) for k, lines in docs.items() for s in {*lines, "x" + lines[0], ""}] + [(None, "ab"), (9, "ab")]
    want = {(k, s) for k, s in sections if k is not None and s and any(s in (t or "") for of, t in chunks if of == k)}
    got = splitting.found_sections(
        spark.createDataFrame(chunks, "doc_id long, chunk_text string").repartition(3),
        spark.createDataFrame(sections, "doc_id long, section string").repartition(2),
    )
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_sections_of_a_ten_megabyte_document(spark):
    """Work grows with the text: 220,000 lines are looked for in 27,000 chunks."""
    text = "\n".join(f"line {i} of the long report says {i * 7919 % 100_003} and {i % 13}" for i in range(220_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = splitting.split_tokens(docs, 256, 128)
    row = splitting.section_preservation(chunks, splitting.line_sections(docs)).first()
    assert len(text) > 9_000_000 and row.sections == row.preserved == 220_000


def cited(seed, n, most):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", None]), rng.sample(range(12), rng.randint(0, min(most, 12)))) for _ in range(n)]


@pytest.mark.parametrize("most", [3, 8, 12])
def test_jaccard_sums_without_pairs(spark, most):
    rows = cited(most, 90, most) + [("x", [1, 2])] * 30
    sets = joins.citation_sets(spark.createDataFrame(rows, "role string, c array<int>"), "role", "c")
    want = Counter()
    for role in ("x", "y", None):
        own = [set(c) for r, c in rows if r == role and c]
        want[role] = sum(len(a & b) / len(a | b) for a, b in itertools.combinations(own, 2))
    got = {r.role: r.jaccard_sum for r in joins.jaccard_sums(sets, "role").collect()}
    assert got == pytest.approx(dict(want), rel=1e-9)


def test_a_hot_citation_makes_no_pair_rows(spark):
    """20,000 answers cite one source: the counted rows stay below one for each subset and size."""
    rows = spark.range(20_000).select(F.lit("x").alias("role"), F.array(F.lit(0), 1 + F.col("id") % 5000).alias("c"))
    sets = joins.citation_sets(rows, "role", "c")
    got = joins.jaccard_sums(sets, "role").first().jaccard_sum
    pairs, equal = 20_000 * 19_999 // 2, 5000 * 6
    assert got == pytest.approx(equal + (pairs - equal) / 3, rel=1e-9)


@pytest.mark.parametrize("at_least", [0.2, 0.5, 0.75, 1.0])
def test_similar_sets(spark, at_least):
    rows = cited(3, 80, 6)
    sets = joins.citation_sets(spark.createDataFrame(rows, "role string, c array<int>"), "role", "c")
    want = set()
    for role in ("x", "y", None):
        own = sorted({tuple(sorted(c)) for r, c in rows if r == role and c})
        for a, b in itertools.combinations(own, 2):
            if len(set(a) & set(b)) / len(set(a) | set(b)) >= at_least:
                want.add((role, a, b))
    got = [(r.role, tuple(r.citation_set), tuple(r.other_set)) for r in joins.similar_sets(sets, "role", at_least).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("dense", [0, 3, 1_024])
def test_block_counts_terms_as_rows_or_places(spark, monkeypatch, dense):
    """Frequent terms, rare ones, and more terms than a byte counts."""
    monkeypatch.setattr(termindex, "DENSE_TERMS", dense)
    rng = random.Random(4)
    sets = [{t for t in range(400) if rng.random() < (0.95 if t < 300 else 0.05)} for _ in range(90)]
    places = [[i for i, s in enumerate(sets) if t in s] for t in range(400)]
    held = [(pa.array(range(0, 150)), pa.array(places[:150], pa.list_(pa.int32()))),
            (pa.array(range(150, 400)), pa.array(places[150:], pa.list_(pa.int32())))]
    block = termindex._Block(pa.array([str(i) for i in range(90)]), held)
    for asked in (list(range(400)), [1, 2, 305, 306, 307, 9_999], [399], [9_999]):
        terms = block.terms(np.array(asked))
        want = sorted((-len(s & set(asked)), i) for i, s in enumerate(sets) if s & set(asked))[:7]
        got, shared = block.best(terms[terms >= 0], 7)
        assert list(zip([-n for n in shared], got)) == want


def test_group_finds_every_chunk_that_reaches_a_level(monkeypatch):
    """Rows of bits, rare places and both together, in blocks of a bad fit, against plain sets."""
    rng = random.Random(11)
    sets = [{f"t{t}" for t in range(120) if rng.random() < (0.6 if t < 20 else 0.15 if t < 60 else 0.01)} for _ in range(700)]
    sets[650] |= {f"t{t}" for t in range(100, 120)}
    names = [f"id{i:03d}" for i in range(700)]
    for share, most in ((128, 4_096), (4, 4_096), (4, 7), (10**6, 4_096), (1, 0)):
        monkeypatch.setattr(termindex, "BIT_SHARE", share)
        monkeypatch.setattr(termindex, "BIT_TERMS", most)
        ids, held = {}, []
        for block, (low, high) in enumerate([(0, 130), (130, 131), (131, 520), (520, 700)]):
            own = pa.array([sorted(s) for s in sets[low:high]], pa.list_(pa.string()))
            rows = termindex._inverted(pa.array(names[low:high][::-1]), own.take(pa.array(range(high - low)[::-1])), block, 3, None)
            ids[block] = rows.column("ids")[0].values
            for i in range(1, rows.num_rows):
                sizes = rows.column("sizes")[i].values.to_numpy()
                held.append((block, rows.column("terms")[i].values, sizes, rows.column("places")[i].as_py()))
        group = termindex._Group(ids, held)
        questions = [rng.sample(range(125), rng.randint(1, 40)) for _ in range(60)] + [list(range(120)), list(range(100, 120)), [124]]
        known = pa.array([f"t{t}" for t in range(125)])
        asked = termindex._Asked(known, np.array([t for q in questions for t in q]), np.array([len(q) for q in questions]))
        levels = np.array([rng.randint(1, 12) for _ in questions])
        numbers, counts, found = group.hits(asked, levels, 6)
        got, want = iter(zip(found.to_pylist(), counts.tolist(), strict=True)), []
        for q, level, n in zip(questions, levels, numbers, strict=True):
            shared = [(-len(s & {f"t{t}" for t in q}), i) for i, s in zip(names, sets, strict=True)]
            want = [(i, -c) for c, i in sorted(shared)[:6] if -c >= level]
            assert [next(got) for _ in range(n)] == want
        assert next(got, None) is None


def test_search_in_rounds_copies_no_question_for_each_block(spark, monkeypatch, tmp_path):
    """Many blocks in few groups: the same hits, and packs are dealt by group."""
    rows = chunk_rows(8, 400)
    rng = random.Random(3)
    questions = [(i, " ".join(rng.choices([f"w{j}" for j in range(70)], k=rng.randint(1, 12)))) for i in range(90)]
    frame = spark.createDataFrame(questions, "query_id int, question string")
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_text string").repartition(30)
    dealt = []
    inner = termindex.TermIndex._round
    monkeypatch.setattr(termindex.TermIndex, "_round", lambda *a: dealt.append(a[3]) or inner(*a))
    monkeypatch.setattr(termindex, "GROUP_CHUNKS", 60)
    monkeypatch.setattr(termindex, "BLOCK_CHUNKS", 20)
    monkeypatch.setattr(termindex, "MAX_BROADCAST_ROWS", 5)
    index = termindex.build(chunks, str(tmp_path / "index"), buckets=3)
    assert {(r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in index.search(frame, 4).collect()} == plain_hits(rows, questions, 4)
    assert sum(len(of) for of in dealt[0]) == 1 and len(dealt) > 2
    blocks = [b for groups in dealt[1:] for of in groups for b in of]
    assert len(blocks) == len(set(blocks)) >= 20 and sum(map(len, dealt[1:])) < len(blocks)
    assert {(r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in retrieval.nearest_by_terms(frame, chunks, 4).collect()} == plain_hits(rows, questions, 4)
