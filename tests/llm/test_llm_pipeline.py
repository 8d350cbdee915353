"""The pipeline: each stage on what its predecessor kept."""

import corpus_pipeline
import pytest
from test_llm_search import plain_components
from test_llm_texts import plain_removal
from test_llm_tokens import BYTE, check_packing, library

from folioflow.session import stored, table


@pytest.fixture(scope="module")
def frames(spark, small):
    docs = table(spark, small, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), "test-pipeline")
        out.append(docs)
    return out


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(frames):
    for frame in frames[1:5]:
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in frames[0].schema]


def test_quality_keeps_clean_documents(frames, spark, small):
    kept = {k for k, _ in pairs(frames[1])}
    labels = table(spark, small, "labels").collect()
    assert all(r.doc_id in kept for r in labels if r.quality == 1)
    assert not [r for r in labels if r.quality == 0 and r.doc_id in kept]


def test_near_dedup_keeps_one_of_each_group(frames):
    want = {k for k, _, _, kept in plain_components(pairs(frames[1]), 5, 80) if kept}
    assert {k for k, _ in pairs(frames[2])} == want


def test_substring_dedup(frames):
    before, after = pairs(frames[2]), dict(pairs(frames[3]))
    want = {k: (n, gone) for k, n, gone, _ in plain_removal(before, 50)}
    for k, text in before:
        n, gone = want[k]
        assert len(after[k].split()) == n - gone
        assert gone or after[k] == text
    assert all(r.n_chars == len(r.text) for r in frames[3].collect())


def test_mixing_repeats_nothing(frames):
    before, after = dict(pairs(frames[3])), pairs(frames[4])
    assert len(after) == len({k for k, _ in after}) and all(before[k] == t for k, t in after)
    sizes = [len(t.split()) for t in before.values()]
    used = sum(len(t.split()) for _, t in after)
    # Each of the 20 sources may exceed its budget by less than a document.
    assert 0.9 * sum(sizes) - 20 <= used <= 0.9 * sum(sizes) + sum(sorted(sizes)[-20:])
    assert len(after) < len(before)


def test_packing(frames, spark, small):
    ids = library(BYTE)
    encoded = [(k, ids(t) + [2]) for k, t in pairs(frames[4])]
    check_packing(frames[5].collect(), encoded, 1024)


def test_run_applies_all_stages(frames, spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == frames[5].columns
    assert got.select("doc_id", "piece", "length").exceptAll(frames[5].select("doc_id", "piece", "length")).count() == 0
