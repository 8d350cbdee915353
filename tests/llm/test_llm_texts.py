"""Substring removal and fingerprints against plain Python."""

import hashlib
import random
import tracemalloc

import llm_cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import fingerprints, order, substrings, wordhash
from folioflow.session import table


def plain_removal(rows, width):
    """(doc_id, text) -> kept words, straight from the rule."""
    first = {}
    split = [(k, (t or "").encode().split()) for k, t in rows]
    for k, words in split:
        if k is not None:
            for i in range(len(words) - width + 1):
                w = tuple(words[i : i + width])
                first[w] = min(first.get(w, k), k)
    out = []
    for k, words in split:
        gone = set()
        if k is not None:
            for i in range(len(words) - width + 1):
                if first[tuple(words[i : i + width])] < k:
                    gone.update(range(i, i + width))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((k, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [1, 5, 13])
def test_dedup_substrings(spark, width, monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK_BYTES", 4096)
    got = substrings.dedup_substrings(llm_cases.awkward(spark), width)
    want = plain_removal([(r[0], r[1]) for r in llm_cases.rows()], width)
    result = got.collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in result))) == sorted(map(repr, want))
    for r in result:
        if r.kept_text is not None:
            assert hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest() == r.kept_sha256
    assert substrings.dedup_substrings(llm_cases.empty(spark)).count() == 0


def test_dedup_substrings_on_a_table(spark, small):
    docs = table(spark, small, "documents")
    got = substrings.dedup_substrings(docs).drop("kept_text").collect()
    want = plain_removal([tuple(r) for r in docs.select("doc_id", "text").collect()], 13)
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r.n_removed for r in got)


def test_windows_are_settled_in_little_memory():
    """A batch of windows takes no more than a few times its own 24 MB."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 50_000, 1_600_000)
    texts = [" ".join(map(str, words[i : i + 4000].tolist())) for i in range(0, len(words), 4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    spread = substrings._spread_windows(50, 101)
    list(spread(iter([batch.slice(0, 20)])))
    tracemalloc.start()
    try:
        sizes = [sum(len(h.as_py()) // 8 for h in b.column("hashes")) for b in spread(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == sum(len(t.split()) - 49 for t in texts)
    assert peak < 120 << 20


def test_without_substrings_keeps_columns_and_clean_texts(spark):
    docs = llm_cases.awkward(spark)
    got = substrings.without_substrings(docs, 13)
    assert got.schema == docs.schema
    texts = {r.doc_id: r.text for r in got.filter("doc_id IN (1, 2, 7, 9)").collect()}
    assert texts[7] == dict((r[0], r[1]) for r in llm_cases.rows())[7]
    assert texts[9] == ""


def test_windows_of_short_rows():
    data = b"a b c" + b"" + b"a" + b"a b"
    words = wordhash.Words(np.frombuffer(data, np.uint8), np.array([0, 5, 5, 6, 9]))
    assert words.counts().tolist() == [3, 0, 1, 2]
    row, first, hashes = words.windows(2, whole_if_shorter=True)
    assert row.tolist() == [0, 0, 2, 3] and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3


def plain_boundaries(data: bytes) -> list[int]:
    ends, begin = [], 0
    while begin < len(data):
        h, end = 0, None
        for i in range(begin, min(len(data), begin + fingerprints.LARGEST)):
            h = ((h << 1) + int(fingerprints._GEAR[data[i]])) & 0xFFFFFFFF
            size = i + 1 - begin
            mask = int(fingerprints.HARD if size <= fingerprints.NORMAL else fingerprints.EASY)
            if size == fingerprints.NORMAL and h & mask:
                mask = int(fingerprints.EASY)
            if size >= fingerprints.SMALLEST and not h & mask:
                end = i + 1
                break
        end = end or min(len(data), begin + fingerprints.LARGEST)
        ends.append(end)
        begin = end
    return ends


@pytest.mark.parametrize("size", [0, 1, 31, 32, 33, 64, 256, 5000])
def test_boundaries_by_rolling_hash(size, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE", 700)
    data = bytes(random.Random(size).choices(b"abcdef ", k=size))
    assert fingerprints.boundaries(np.frombuffer(data, np.uint8)) == plain_boundaries(data)


def test_likeness():
    text = llm_cases.prose(3, 900).encode()
    one = fingerprints.chunk_set(text)
    assert fingerprints.likeness(one, one) == 1.0 and fingerprints.likeness({}, {}) == 1.0
    assert fingerprints.likeness(one, {}) == 0.0
    shifted = fingerprints.chunk_set(b"some words put in front of it all " + text)
    assert fingerprints.likeness(one, shifted) > 0.9
    other = fingerprints.chunk_set(llm_cases.prose(4, 900).encode())
    assert fingerprints.likeness(one, other) < 0.1
    assert fingerprints.from_string(fingerprints.as_string(one)) == one


@pytest.mark.parametrize("range_bytes", [200, 1 << 24])
def test_fingerprint_edits(spark, range_bytes, monkeypatch):
    monkeypatch.setattr(order.range_starts, "__defaults__", (range_bytes,))
    ordered = sorted(
        ((r[0], r[1] or "") for r in llm_cases.rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())
    )
    want = []
    for i, (k, text) in enumerate(ordered):
        follower = ordered[(i + 1) % len(ordered)][1]
        n = len(text)
        edited = text[: n - n // 4] + follower[: n // 4]
        a, b, c = (fingerprints.chunk_set(t.encode()) for t in (text, edited, follower))
        want.append((
            k, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprints.as_string(a), fingerprints.as_string(b),
            fingerprints.likeness(a, b), fingerprints.likeness(a, c),
        ))
    got = fingerprints.fingerprint_edits(llm_cases.awkward(spark)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fingerprints.fingerprint_edits(llm_cases.empty(spark)).count() == 0
    single = fingerprints.fingerprint_edits(llm_cases.awkward(spark).filter("doc_id = 10")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_a_contained_text_is_near(spark):
    short = llm_cases.prose(81, 500)
    long = short + " " + llm_cases.prose(82, 5000)
    docs = spark.createDataFrame([(1, short), (2, long)], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fingerprints.fingerprint_edits(docs).collect()}
    assert 0.85 < got[1] <= 1 and got[1] == got[2]
    assert fingerprints.likeness(fingerprints.chunk_set(short.encode()), {}) == 0.0


def test_range_of_many_starts(spark):
    starts = list(range(-50, 1000, 7))
    frame = spark.range(-50, 1100).select("id", order.range_of(F.col("id"), starts).alias("r"))
    for r in frame.collect():
        assert starts[r.r] <= r.id and (r.r + 1 == len(starts) or r.id < starts[r.r + 1])
