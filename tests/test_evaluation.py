import itertools
import math
import random
import tracemalloc
from collections import Counter

import pytest

from folioflow.operators import evaluation as ev
from folioflow.operators import joins


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def table_positions(a, b):
    """The way back through the whole table: up while nothing is lost, else to the left."""
    rows = [[lcs(a[:i], b[:j]) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    i, j, on = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            on.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i][j - 1] > rows[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return on[::-1]


def test_long_pairs_need_little_memory():
    rng = random.Random(1)
    a = [rng.choice("abcdefgh") for _ in range(20_000)]
    b = [t if rng.random() < 0.9 else "z" for t in a if rng.random() < 0.95]
    tracemalloc.start()
    distance, on = ev.word_edits(a, b), ev.lcs_positions(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert len(on) == ev.lcs_length(a, b) and len(a) - len(b) <= distance <= len(a)


def test_row_scores_against_plain_loops():
    rng = random.Random(5)
    for _ in range(150):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        assert ev.lcs_length(a, b) == lcs(a, b)
        assert ev.word_edits(a, b) == edits(a, b)
        if a and b:
            positions = ev.lcs_positions(a, b)
            assert len(positions) == lcs(a, b)
            assert sorted(positions) == table_positions(a, b)
        # With one sentence on each side the union LCS is the LCS.
        assert ev.rouge_lsum_hits([a], [b]) == lcs(a, b)


def test_meteor_known_values():
    assert ev.meteor_score("the cat sat".split(), "the cat sat".split()) == pytest.approx(1 - 0.5 / 27)
    assert ev.meteor_score(["a"], ["b"]) == 0.0
    got = ev.meteor_score("the cat sat on the mat".split(), "on the mat sat the cat".split())
    assert got == pytest.approx(0.5)  # six matches in six chunks


def pairs(spark):
    rows = [
        ("1", "The cat sat on the mat.", "the cat is on the mat"),
        ("2", "Nothing in common", "zzz yyy"),
        ("3", "same text here now", "same text here now"),
        ("4", "", ""),
    ]
    return spark.createDataFrame(rows, "pair_id string, reference string, candidate string")


def test_rouge_and_bleu(spark):
    out = {r.pair_id: r for r in ev.rouge_n(pairs(spark)).collect()}
    assert out["1"].rouge1 == pytest.approx(2 * 5 / 12)
    assert out["1"].rouge2 == pytest.approx(2 * 3 / 10)
    assert (out["2"].rouge1, out["3"].rouge2, out["4"].rouge1) == (0.0, 1.0, 0.0)
    long = {r.pair_id: r for r in ev.rouge_l(pairs(spark)).collect()}
    assert long["1"].rougeL == pytest.approx(2 * 5 / 12)
    same = pairs(spark).filter("pair_id = '3'")
    assert ev.bleu(same).first().bleu == pytest.approx(1.0)
    none = pairs(spark).filter("pair_id = '2'")
    assert ev.bleu(none).first().bleu == 0.0


def test_wer(spark):
    only = pairs(spark).filter("pair_id in ('2', '3')")
    assert ev.wer(only).first().wer == pytest.approx(3 / 7)


def test_evaluate_has_all_scores(spark):
    train = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "same text")], "doc_id long, text string")
    rows = ev.evaluate(pairs(spark), train)
    assert set(rows.columns) == {"pair_id", *ev.ROW_SCORES}
    assert rows.count() == 4
    batch = ev.evaluate_batch(pairs(spark), train).first()
    assert 0 < batch.rouge1 < 1 and 0 <= batch.bleu <= 1 and batch.perplexity > 0


def test_perplexity_prefers_known_text(spark):
    train = spark.createDataFrame([(1, "a b a b a b c d")], "doc_id long, text string")
    df = spark.createDataFrame([(1, "a b a b"), (2, "d a d a"), (3, "new words here")], "doc_id long, text string")
    out = {r.doc_id: r.perplexity for r in ev.ngram_perplexity(train, df).collect()}
    assert out[1] < out[2] and out[1] < out[3]
    assert out[3] == pytest.approx(4.0)


def answers(spark, *texts):
    return spark.createDataFrame([(i, "q", t) for i, t in enumerate(texts)], "query_id int, question string, answer string")


def test_issues_in_order(spark):
    a = answers(spark, "short", "words from the source [1]", "totally foreign sentence (2)", "words from the source")
    hits = spark.createDataFrame(
        [(i, 1, "s", "words from the source text") for i in range(4)], "query_id int, rank int, source string, chunk_text string"
    )
    out = {r.query_id: r.issues for r in ev.validate_response(a, hits).collect()}
    assert out[0] == [ev.ISSUES[0], ev.ISSUES[2], ev.ISSUES[3]]
    assert out[1] == [] and out[2] == [ev.ISSUES[2]] and out[3] == [ev.ISSUES[3]]


def test_citation_marks(spark):
    a = answers(spark, "x [Document 3] y (2) z [11]", "none", "[1][2]")
    out = {r.query_id: (r.citations, r.citations_valid) for r in ev.extract_citations(a).collect()}
    assert out == {0: ([3, 2, 11], False), 1: ([], False), 2: ([1, 2], True)}


def test_consistency_equals_all_pairs(spark):
    rng = random.Random(9)
    sets = [rng.sample(range(1, 11), rng.randrange(0, 4)) for _ in range(120)]
    df = spark.createDataFrame([("g", s) for s in sets], "g string, citations array<int>")
    grouped = joins.citation_sets(df, "g", "citations")
    full = [set(s) for s in sets if s]
    scores = [len(a & b) / len(a | b) for a, b in itertools.combinations(full, 2)]
    got = ev.citation_consistency(grouped, "g").first()
    assert got.consistency == pytest.approx(sum(scores) / len(scores))
    rows = joins.set_pairs(grouped, "g").collect()
    assert sum(r.pairs for r in rows) == sum(1 for s in scores if s > 0)
    assert sum(r.pairs * r.jaccard for r in rows) == pytest.approx(sum(scores))
    one = joins.citation_sets(df.limit(1), "g", "citations")
    assert all(r.consistency == 0.0 for r in ev.citation_consistency(one, "g").collect())


def test_generate_citations(spark):
    rows = [
        (1, "insurance coverage", 1, "test1.txt", "Insurance coverage details part 1"),
        (1, "insurance coverage", 2, "test2.txt", "Insurance coverage details part 2"),
        (1, "insurance coverage", 3, "test3.txt", ""),
        *((2, "many", i, f"s{i}", f"unique text {i} x") for i in range(1, 9)),
    ]
    hits = spark.createDataFrame(rows, "query_id int, question string, rank int, source string, chunk_text string")
    plain = Counter(r.query_id for r in ev.generate_citations(hits).collect())
    assert plain == {1: 2, 2: 5}
    merged = ev.generate_citations(hits, merge_similar=True).filter("query_id = 1").collect()
    assert [(r.source, r.citation) for r in merged] == [("test1.txt", "[1]")]
    assert ev.generate_citations(hits, limit=2).filter("query_id = 2").count() == 2
    with pytest.raises(ValueError):
        ev.generate_citations(hits, limit=-1)


def test_grams_are_counted_without_a_shuffle_of_grams(spark):
    rows = [(1, "a b a b c", "a b a x"), (2, None, "a b"), (3, "a", ""), (4, None, None)]
    pairs = spark.createDataFrame(rows, "pair_id int, reference string, candidate string")
    counts = ev._ngram_counts(pairs, ev.rouge_tokens, (1, 2))
    got = {tuple(r) for r in counts.collect()}
    assert got == {(1, 1, 3, 5, 4), (1, 2, 2, 4, 3), (2, 1, 0, 0, 2), (2, 2, 0, 0, 1), (3, 1, 0, 1, 0)}
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [1.0, 0.25])
def test_perplexity_by_hand(spark, k):
    """Unknown words, final words, odd spaces, nulls, repeated ids; and no row of a bigram meets a join."""
    taught = ["a b a b c", "C  d\u2003a\tb", None, "", "e", "\u00e9t\u00e9 b a"]
    asked = [("x", "a b c d"), ("y", "b e a"), ("x", "q a b"), ("z", "a"), ("n", None), (None, "A z"), ("long", "a b " * 9000)]
    train = spark.createDataFrame(list(enumerate(taught)), "doc_id long, text string")
    df = spark.createDataFrame(asked, "doc_id string, text string")
    out = ev.ngram_perplexity(train, df, k=k)
    assert "Join" not in out._jdf.queryExecution().toString()
    pairs, firsts, vocabulary = Counter(), Counter(), set()
    for t in taught:
        w = (t or "").lower().split()
        vocabulary.update(w)
        pairs.update(zip(w, w[1:], strict=False))
        firsts.update(w[:-1])
    want = {}
    for key, t in asked:
        w = (t or "").lower().split()
        logs = [
            math.log((pairs[g] + k) / (firsts[g[0]] + k * len(vocabulary))) for g in zip(w, w[1:], strict=False)
        ]
        if logs:
            want[key] = want.get(key, []) + logs
    got = {r.doc_id: (r.bigrams, r.perplexity) for r in out.collect()}
    assert got.keys() == want.keys()
    for key, logs in want.items():
        assert got[key] == (len(logs), pytest.approx(math.exp(-sum(logs) / len(logs))))
    nothing = ev.ngram_perplexity(train.filter("false"), df).collect()
    assert {r.doc_id for r in nothing} == want.keys() and all(r.perplexity is None for r in nothing)
