"""Toxicity, quality and mixing: held-out accuracy, plain Python, awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import llm_cases
import numpy as np
import pytest

from folioflow.llm import mixing, quality, toxicity
from folioflow.session import table


def labels_of(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def marked_corpus(spark):
    """Ordinary prose and, every fourth document, some of three rude words strewn in."""
    rows, labels = [], []
    for i in range(600):
        words = llm_cases.prose(i, 60 + i % 90).split()
        if i % 4 == 0:
            for k in range(3):
                words.insert((7 * k + i) % len(words), ("grumbo", "Fizzle,", "snork")[k])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, labels, "toxic")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = marked_corpus(spark)
    got = toxicity.score(docs, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.98


def test_toxicity_ignores_labels_of_the_held_out_fold(spark):
    docs, labels = marked_corpus(spark)
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    one, other = ({r.doc_id: r.score for r in toxicity.score(docs, y).collect()} for y in (labels, changed))
    assert one == other


def test_toxicity_awkward(spark):
    docs = llm_cases.awkward(spark)
    for rows in ([], [(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (8, 0), (99, 1), (10, 0), (4, 1), (13, 0)]):
        got = toxicity.score(docs, labels_of(spark, rows, "toxic")).collect()
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(r[0]) for r in llm_cases.rows())
        assert all(0 <= r.score <= 1 for r in got)
        same = {r.score for r in got if r.doc_id in (3, 4, 5)}
        assert len(same) == 1
    assert toxicity.score(llm_cases.empty(spark), labels_of(spark, [], "toxic")).count() == 0


def test_shares_add_up(spark):
    docs, labels = marked_corpus(spark)
    model = toxicity.train_counts(docs.join(labels, "doc_id"))
    assert np.allclose(model.share.sum(axis=1), 1, atol=0.2)
    assert (model.share > 0).all() and (model.fallback > 0).all()
    assert (np.diff(model.bigrams) > 0).all()


def test_toxicity_tables_have_no_fixed_size(spark, monkeypatch):
    docs, labels = marked_corpus(spark)
    whole = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for hot in (0, 40):
        monkeypatch.setattr(toxicity, "HOT", hot)
        got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
        assert got.keys() == whole.keys()
        assert all(abs(got[k] - whole[k]) < 1e-6 for k in whole)


def test_words_and_bigrams_are_told_apart(spark):
    """More words than 2^18: each has its own share, and each frequent bigram its own weight."""
    frame = spark.createDataFrame(
        [(" ".join(f"v{i}" for i in range(at, at + 1000)), int(at % 2000 == 0)) for at in range(0, 300_000, 1000)],
        "text string, toxic int",
    ).repartition(8)
    model = toxicity.train_counts(frame.unionAll(frame).unionAll(frame).unionAll(frame))
    assert model.share.shape == (2, 300_000)
    assert len(model.bigrams) == 300_000


def test_expressions_of_either_training_fold_are_learnt(spark):
    """Only one training fold has the rude word that held-out documents use."""
    for taught in (0, 2):
        rows, labels = [], []
        for i in range(900):
            toxic, of = i % 4 == 0, zlib.crc32(str(i).encode()) % 3
            words = llm_cases.prose(i, 60 + i % 90).split()
            rude = ["snork"] if of == 1 else ["grumbo", "snork"] if of == taught else ["grumbo"]
            for k in range(4 * toxic):
                words[(7 * k + i) % len(words)] = rude[k % len(rude)]
            rows.append((i, " ".join(words)))
            labels.append((i, int(toxic)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = toxicity.score(docs, labels_of(spark, labels, "toxic")).collect()
        held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out]
        assert sum(p == y for p, y in held) / len(held) > 0.95


def test_quality_on_labelled_documents(spark, small):
    folder = small.replace("0.001", "0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    teaching = labels.filter("crc32(cast(doc_id AS string)) % 2 = 0")
    got = {r.doc_id: r.accepted for r in quality.classify(docs, teaching).collect()}
    rest = labels.filter("crc32(cast(doc_id AS string)) % 2 = 1").collect()
    good = [got[r.doc_id] for r in rest if r.quality == 1]
    bad = [got[r.doc_id] for r in rest if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_quality_awkward(spark):
    docs = llm_cases.awkward(spark)
    for rows in ([], [(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (8, 1), (99, 1), (10, 1), (13, 0), (14, 0)]):
        got = quality.classify(docs, labels_of(spark, rows, "quality")).collect()
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(r[0]) for r in llm_cases.rows())
        assert all(0 < r.quality < 1 and r.accepted == (r.quality >= 0.5) for r in got)
        kept = quality.accepted(docs, labels_of(spark, rows, "quality"))
        assert kept.schema == docs.schema and kept.count() == sum(r.accepted for r in got)
    assert quality.classify(llm_cases.empty(spark), labels_of(spark, [], "quality")).count() == 0


def test_sites_beyond_the_bound_give_the_same(spark, small, monkeypatch):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    one = sorted(map(tuple, quality.classify(docs, labels).collect()))
    monkeypatch.setattr(quality, "SITES_BROADCAST", 3)
    assert sorted(map(tuple, quality.classify(docs, labels).collect())) == one


def test_site_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "a", 1.0)] * 300 + [("big", "b", 0.0)] * 100 + [("tiny", "a", 0.0)] + [(None, None, 1.0)] * 3
    rows += [(f"h{i}", "a", float(i % 2)) for i in range(40) for _ in range(50)]
    frame = spark.createDataFrame(rows, "host string, path string, made double")
    got = {(r.host, r.path): r for r in quality.site_posteriors(frame).collect()}
    share = got["big", "a"].global_share
    assert abs(share - (sum(r[2] for r in rows) + 0.5) / (len(rows) + 1)) < 1e-12
    assert got["big", "a"].path_share > 0.9 > 0.2 > got["big", "b"].path_share
    assert 0.0 < got["tiny", "a"].path_share < share
    assert share < got[None, None].path_share < 1


def words(text):
    return len((text or "").encode().split())


def plain_mix(rows, budget_share, exponent, seed="mix"):
    """(doc_id, text, source) -> uses, straight from the rule (one block per source)."""
    per = defaultdict(list)
    for k, t, s in rows:
        parts = [seed] + ([str(k)] if k is not None else []) + ([str(zlib.crc32(t.encode()))] if t is not None else [])
        per[s].append((hashlib.md5("/".join(parts).encode()).hexdigest(), k, words(t)))
    tokens = {s: sum(d[2] for d in docs) for s, docs in per.items()}
    whole = sum(tokens.values())
    raw = {s: (t / whole) ** exponent if t else 0.0 for s, t in tokens.items()}
    out = []
    for s, docs in per.items():
        budget = round(raw[s] / sum(raw.values()) * int(budget_share * whole))
        for epoch in range(math.ceil(budget / max(tokens[s], 1))):
            at = epoch * tokens[s]
            ordered = sorted(docs, key=lambda d: (hashlib.md5(f"{seed}/{epoch}/{d[0]}".encode()).hexdigest(), d[0]))
            for _, k, n in ordered:
                if at < budget:
                    out.append((k, s, n, epoch, 0, at))
                at += n
    return out


@pytest.mark.parametrize("aim", [{"repetition": 2.0}, {"repetition": 1.0}, {"entropy": 1.0}])
@pytest.mark.parametrize("share", [0.5, 1.0])
def test_mix(spark, aim, share):
    if aim.get("repetition", 9) < share:
        return
    docs = llm_cases.awkward(spark)
    rows = [(r[0], r[1], r[3]) for r in llm_cases.rows()]
    counted = docs.select("source", mixing.tokens_of(docs["text"]).alias("tokens"))
    sources = mixing.source_tokens(counted)
    whole = sources.groupBy().sum("tokens").first()[0]
    exponent = mixing.find_exponent(sources.selectExpr("*", f"{whole} AS all_tokens"), int(share * whole), **aim)
    got = mixing.mix(docs, budget_share=share, **aim).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_mix(rows, share, exponent)))
    if "repetition" in aim:
        per = Counter()
        for r in got:
            per[r.source] += r.tokens
        longest = max(words(r[1]) for r in rows)
        tokens = {r.source: r.tokens for r in sources.collect()}
        assert all(n <= aim["repetition"] * tokens[s] + longest for s, n in per.items())


def test_exponent_meets_entropy(spark):
    tokens = [10, 100, 1000, 5000]
    frame = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)] + [("none", 0)], "source string, tokens long")
    frame = frame.selectExpr("*", "6110 AS all_tokens")
    for target in (0.4, 1.0, 1.3):
        e = mixing.find_exponent(frame, 6110, entropy=target)
        p = np.array([t**e for t in tokens]) / sum(t**e for t in tokens)
        assert abs(-(p * np.log(p)).sum() - target) < 1e-6
    assert mixing.find_exponent(frame, 6110, entropy=9.0) == 0.0
    with pytest.raises(ValueError):
        mixing.find_exponent(frame, 6110)


def test_mixed_blocks_cover_every_epoch(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    docs = table(spark, small, "documents")
    got = mixing.mix(docs, budget_share=1.0, repetition=2.5).collect()
    streams = defaultdict(list)
    for r in got:
        streams[r.source].append((r.position, r.tokens))
    for spans in streams.values():
        at = 0
        for position, n in sorted(spans):
            assert position == at or n == 0
            at = max(at, position + n)
    uses = Counter((r.doc_id, r.epoch) for r in got)
    assert max(uses.values()) == 1 and len({r.block for r in got}) > 3


def test_mixed_documents(spark):
    docs = llm_cases.awkward(spark)
    kept = mixing.mixed_documents(docs, budget_share=0.9, repetition=1.0)
    assert kept.schema == docs.schema
    assert kept.count() == mixing.mix(docs, budget_share=0.9, repetition=1.0).count()
    assert mixing.mix(llm_cases.empty(spark), repetition=1.0).count() == 0
