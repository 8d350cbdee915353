"""Kneser-Ney tables, site posteriors and chunk digests against plain Python."""

import math
import random
from collections import Counter, defaultdict

import llm_cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import fingerprints, quality, toxicity

BOTH = ("ordinary", "toxic")


def labelled(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        toxic, half = rng.randint(0, 1), rng.randint(0, 1)
        pool = words[: 25 + 15 * toxic]
        rows.append((" ".join(rng.choices(pool, k=rng.randint(0, 30))), toxic, half))
    return rows


def plain_tables(rows):
    """words -> kinds of bigrams by class, and in any; contexts -> occurrences by class; bigram counts."""
    grams = {c: Counter() for c in (0, 1)}
    for text, toxic, _ in rows:
        before = None
        for word in text.split():
            grams[toxic][before, word] += 1
            before = word
    return grams


@pytest.mark.parametrize("halves", [(0,), (1,), (0, 1)])
@pytest.mark.parametrize("flush", [50, 2_000_000])
def test_models_equal_plain_counting(spark, monkeypatch, halves, flush):
    monkeypatch.setattr(toxicity, "FLUSH", flush)
    rows = labelled(4, 120)
    frame = spark.createDataFrame(rows, "text string, toxic int, half int").repartition(3)
    model = toxicity.fitted(toxicity.count_bigrams(frame), *halves)
    grams = plain_tables([r for r in rows if r[2] in halves])
    everything = set(grams[0]) | set(grams[1])
    kinds, both, occurs = {0: Counter(), 1: Counter()}, Counter(), Counter()
    own, kept = {0: Counter(), 1: Counter()}, defaultdict(float)
    d = toxicity.DISCOUNT
    for before, word in everything:
        both[word] += 1
        for c in (0, 1):
            n = grams[c][before, word]
            kinds[c][word] += n > 0
            occurs[word] += n
            own[c][before] += n
            kept[before] += max(n - d, 0)
    pooled, beyond = sum(both.values()), sum(max(n - d, 0) for n in both.values())
    held_back = max(1 - beyond / pooled, 1e-6)
    share = {}
    for w in both:
        lowest = (both[w] + 0.5) / (pooled + 0.5 * (len(both) + 1))
        share[w] = [max(kinds[c][w] - d, 0) / max(sum(kinds[c].values()), 1) + held_back * lowest for c in (0, 1)]
    got = model.words.collect()
    assert len(got) == len(both)
    want = sorted((occurs[w], both[w], kinds[0][w], kinds[1][w], round(share[w][0], 12), round(share[w][1], 12)) for w in both)
    assert sorted((r.occurs, r.both, r.ordinary, r.toxic, round(r.share0, 12), round(r.share1, 12)) for r in got) == want
    fallback = {b: max(1 - kept[b] / max(own[0][b] + own[1][b], 1), 1e-3) for b in own[0] | own[1]}
    want = sorted((own[0][b], own[1][b], round(fallback[b], 12)) for b in fallback)
    assert sorted((r.own_ordinary, r.own_toxic, round(r.fallback, 12)) for r in model.contexts.collect()) == want
    weights = []
    for before, word in everything:
        if max(grams[c][before, word] for c in (0, 1)) > d:
            p = [
                fallback[before] * share[word][c] + max(grams[c][before, word] - d, 0) / max(own[c][before], 1) for c in (0, 1)
            ]
            weights.append(round(math.log(p[1] / p[0]) - math.log(share[word][1] / share[word][0]), 9))
    assert sorted(round(r.p0, 9) for r in model.weights.filter("is_bigram").collect()) == sorted(weights)


def test_site_posteriors_equal_plain_shrinking(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.random()) for _ in range(300)]
    rows += [("rare", "z", 0.99), ("rare", "q", 0.01)]
    got = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, made double")).collect()

    def strength(sites):
        n, excess, within = 0, 0.0, 0.0
        for count, good, parent in sites:
            n += count
            excess += count * (good / count - parent) ** 2
            within += parent * (1 - parent)
        mean = within / len(sites)
        between = max((excess - len(sites) * mean) / n, 1e-6)
        return min(max(mean / between - 1, 1.0), 10_000.0)

    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for host, path, made in rows:
        for site in (hosts[host], paths[host, path]):
            site[0] += 1
            site[1] += made
    share = (sum(g for _, g in hosts.values()) + 0.5) / (len(rows) + 1.0)
    s = strength([(n, g, share) for n, g in hosts.values()])
    of_host = {h: (g + s * share) / (n + s) for h, (n, g) in hosts.items()}
    own = strength([(n, g, of_host[h]) for (h, _), (n, g) in paths.items()])
    want = {(h, p): (g + own * of_host[h]) / (n + own) for (h, p), (n, g) in paths.items()}
    assert {(r.host, r.path): r.path_share for r in got} == pytest.approx(want)
    assert all(r.global_share == pytest.approx(share) for r in got)


def test_chunk_sets_and_containment_equal_plain_loops():
    for seed in range(4):
        text = llm_cases.prose(seed, 700).encode() * (1 + seed % 2)
        data = np.frombuffer(text, np.uint8)
        ends = fingerprints.boundaries(data)
        chunks = Counter(text[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True))
        made = fingerprints.chunk_set(text)
        # Equal chunks share a digest, others don't; weights are the bytes a chunk stands for.
        assert len(made) == len(chunks)
        assert sorted(made.values()) == sorted(len(c) * n for c, n in chunks.items())
        other = text[: len(text) // 3] + llm_cases.prose(seed + 50, 300).encode()
        far = np.frombuffer(other, np.uint8)
        cut = fingerprints.boundaries(far)
        others = Counter(other[a:z] for a, z in zip([0, *cut[:-1]], cut, strict=True))
        common = sum(min(n * len(c), others[c] * len(c)) for c, n in chunks.items())
        want = common / min(len(text), len(other))
        assert fingerprints.likeness(made, fingerprints.chunk_set(other)) == pytest.approx(want)


def test_a_large_group_links_across_tiles(spark, monkeypatch):
    """Near copies of one text, dealt into many small tiles, are still one component."""
    from folioflow.llm import minhash

    monkeypatch.setattr(minhash, "TILE", 4)
    rng = random.Random(6)
    base = llm_cases.prose(61, 150).split()
    rows = []
    for k in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, llm_cases.prose(200 + k, 80)) for k in range(5)]
    from test_llm_search import plain_components

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 2, 80).collect()}
    assert got == {k: c for k, _, c, _ in plain_components(rows, 2, 80)}
    assert frame.filter(F.col("doc_id") < 40).count() == 40
