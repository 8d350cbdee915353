"""Top-k search and near-duplicates against plain Python."""

import math
import random

import llm_cases
import numpy as np
import pytest

from folioflow.llm import minhash, topk, wordhash
from folioflow.llm.components import components
from folioflow.session import table


def plain_top_k(rows, k, every):
    """(vec_id, vector) -> (query_id, rank, vec_id, score), straight from the rule."""
    good = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = max(queries.get(i, v), v)
    out = []
    for q, asked in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [37, 8192])
def test_top_k_on_a_table(spark, small, slice_rows):
    vectors = table(spark, small, "embeddings")
    got = topk.top_k(vectors, k=5, every=50, slice_rows=slice_rows).collect()
    want = plain_top_k([(r.vec_id, r.embedding) for r in vectors.collect()], 5, 50)
    assert sorted(map(tuple, got)) == want


def test_top_k_awkward(spark):
    rng = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [nan, 1.0, 1.0, 1.0]), (203, [inf] * 4), (None, [1.0] * 4)]
    rows += [(250, []), (300, [0.0] * 4), (7, [2.0, 2.0, 2.0, 2.0]), (50, [3.0] * 4), (301, [1.0, 1.0]), (302, [-1.0] * 9)]
    rows += [rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS slice", "2 AS rank", "3 AS block")
    got = topk.top_k(frame, k=5, every=50, slice_rows=30).collect()
    assert sorted(map(tuple, got)) == plain_top_k(rows, 5, 50)
    assert topk.top_k(frame.filter("vec_id = 50"), k=5).count() == 0  # no partner but rows of its own id
    assert topk.top_k(frame.limit(0)).count() == 0


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    vectors = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.int64)
    index = topk.ImpactIndex(vectors)
    for q in range(0, 4000, 400):
        without = np.arange(4000) == q
        rows, scores = index.search(vectors[q], 5, without)
        true = np.where(without, np.iinfo(np.int64).min, vectors @ vectors[q])
        assert sorted(scores)[-5:] == sorted(true)[-5:]
        assert len(rows) < 200


def plain_components(rows, width, percent):
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept), comparing all pairs."""
    sets = []
    for k, text in rows:
        words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        if a is None or not sets[i]:
            continue
        for j in range(i):
            b = rows[j][0]
            if b is None or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if a == b or 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    out = []
    for (k, _), s in zip(rows, sets):
        c = None if k is None else top(k) if s else k
        out.append((k, len(s), c, k is not None and k == c))
    return out


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.random():.9f}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_awkward(spark, width):
    rows = [(r[0], r[1]) for r in llm_cases.rows()]
    base = llm_cases.prose(50, 300)
    rows += [(100 + i, edited(base, 0.002 * i, i)) for i in range(30)]
    chain = base
    for i in range(12):  # neighbours are alike, the ends are not
        chain = edited(chain, 0.02, 1000 + i)
        rows.append((150 + i, chain.upper() if i % 2 else chain))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rep", "2 AS band", "3 AS component")
    got = minhash.near_duplicates(frame, width).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_components(rows, width, 80)))
    assert minhash.near_duplicates(llm_cases.empty(spark)).count() == 0


def test_near_duplicates_on_a_table(spark, small):
    docs = table(spark, small, "documents")
    got = minhash.near_duplicates(docs, 2).collect()
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < sum(not r.kept for r in got)


def test_keep_one(spark):
    docs = llm_cases.awkward(spark)
    kept = minhash.keep_one(docs, 5)
    assert kept.schema == docs.schema
    want = plain_components([(r[0], r[1]) for r in llm_cases.rows()], 5, 80)
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr)
    stays = {k for k, n, c, kept_ in want if kept_ and n}
    free = [k for k, n, *_ in want if k is None or not n]
    assert ids == sorted([*stays, *free], key=repr)


def test_keep_one_of_a_reused_id(spark):
    a, b, c = (llm_cases.prose(seed, 80) for seed in (71, 72, 73))
    rows = [(1, a), (2, a), (2, b), (3, ""), (3, c), (3, c), (4, None), (4, a)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    want = [(1, a), (2, b), (3, ""), (3, c), (4, None)]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_estimate_follows_similarity():
    text = llm_cases.prose(9, 4000).encode()
    words = text.split()
    for share in (0.0, 0.01, 0.03, 0.1):
        other = edited(text.decode(), share, 5).encode()
        packed = []
        sets = []
        for raw in (text, other):
            made = wordhash.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True)
            sets += minhash.shingle_sets(made, 5)
            packed.append(minhash.signatures(sets[-1:])[0][0].view(np.uint64))
        x = packed[0] ^ packed[1]
        differing = sum(bin(int(v)).count("1") for v in (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
        true = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
        assert abs(minhash.estimate(differing) - true) < 0.12
    assert words


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    links += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in got} == {(x, top(x)) for x in nodes}
    assert len(got) == len(nodes)
