"""Token counts, packing and token files against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import llm_cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioflow.llm import packing, tables, token_counts, token_files, token_ids
from folioflow.session import scratch_path, table

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", "the", " ", "  ", "\n", " \n", "\n\n", "\t", "\x1c", "\x85", "\xa0", " ", "É", "é", "Σ", "ΟΔΟΣ", "İ",
    "ß", "ﬁ", "’s", "'s", "'ll", "'T", "12", "٣", "!!", "***", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
    "日本", "😀", "́", "\r\n", "ǅ", "\x00", "﻿", "Å", "한", "_", "ª", "Ⅷ", "thndor", "worthless,",
]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark, small):
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    return made + [r[0] for r in table(spark, small, "documents").select("text").collect()]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_library(texts, path):
    ids, code = library(path), token_ids.Encoder(path)
    for text in texts:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == ids(text)


def test_merge_counts_are_those_of_the_library(texts):
    ids, counter = library(WORD), token_counts.MergeCounter(WORD)
    for text in texts:
        assert counter.count(text) == len(ids(text))
    run = "ab" * 20_000
    assert counter.count(run) == len(ids(run))


def test_count_tokens(spark):
    ids = library(WORD)
    got = token_counts.count_tokens(llm_cases.awkward(spark), WORD, limit=100).collect()
    want = [
        (k, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for k, t, *_ in llm_cases.rows()
    ]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(llm_cases.empty(spark), WORD).count() == 0


def test_open_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place("a", 6) == () and bins.place("b", 8) == ()
    assert bins.place("c", 2) == ([("b", 0), ("c", 8)],)  # least free space that suffices
    assert bins.place("d", 7) == ()
    assert bins.place("e", 5) == ([("d", 0)],)  # no room, two bins open: the fullest closes
    assert sorted(bins.rest()) == [[("a", 0)], [("e", 0)]]


@pytest.mark.parametrize("open_bins", [1, 4, 256])
def test_pack(spark, open_bins):
    ids, size = library(BYTE), 64
    docs = llm_cases.awkward(spark)
    got = packing.pack(docs, BYTE, end_id=2, capacity=size, open_bins=open_bins).collect()
    check_packing(got, [(k, ids(t) + [2]) for k, t, *_ in llm_cases.rows()], size)
    assert packing.pack(llm_cases.empty(spark), BYTE).count() == 0


def test_large_ids_beside_a_missing_one_stay_whole(spark):
    keys = [None, 2**53 + 1, 2**53 + 3, 2**62 + 1]
    docs = spark.createDataFrame([(k, llm_cases.prose(i, 30)) for i, k in enumerate(keys)], "doc_id long, text string")
    got = packing.pack(docs.coalesce(1), BYTE).collect()
    assert {r.doc_id for r in got} == set(keys) and len(got) == 4


def check_packing(got, encoded, size):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.piece, r.length, r.ids_crc32))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    want = defaultdict(list)
    for k, row in encoded:
        first = len(row) % size or size
        starts = [0, *range(first, len(row), size)] if len(row) > size else [0]
        for p, s in enumerate(starts):
            e = starts[p + 1] if p + 1 < len(starts) else len(row)
            want[k].append((s, p, e - s, zlib.crc32(np.array(row[s:e], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_sequence)


def test_packing_is_tight(spark, small):
    ids, docs = library(BYTE), table(spark, small, "documents").repartition(8)
    got = packing.pack(docs, BYTE).collect()
    encoded = [(r.doc_id, ids(r.text) + [2]) for r in docs.select("doc_id", "text").collect()]
    sequences = check_packing(got, encoded, 1024)
    assert sequences <= 1.01 * -(-sum(len(e) for _, e in encoded) // 1024) + 1


def test_one_python_worker_cuts_and_places_the_texts_of_a_task(spark, monkeypatch):
    plans = []

    def written(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.written(df, label)

    monkeypatch.setattr(packing, "written", written)
    assert packing.pack(llm_cases.awkward(spark), BYTE).count() >= len(llm_cases.rows())
    assert [p.count("MapInArrow") for p in plans] == [1]


def test_workers_hold_no_words_after_packing(spark, small):
    packing.pack(table(spark, small, "documents"), BYTE).count()

    def held(batches):
        for batch in batches:
            code = token_ids.encoder(BYTE)
            n = sum(len(c) + len(c.older) for c in (code.word_ids, code.chunk_ids))
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    # Workers that packed serve these tasks too.
    rows = spark.range(64).repartition(16).mapInArrow(held, "n long").collect()
    assert rows and {r.n for r in rows} == {0}


def test_a_coder_that_forgot_gives_the_same_ids(texts):
    code = token_ids.Encoder(BYTE)
    before = [code.encode(t) for t in texts]
    code.forget()
    assert not any((code.word_ids, code.word_ids.older, code.chunk_ids, code.chunk_ids.older))
    assert [code.encode(t) for t in texts] == before


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 200_003).astype("<u4")
    packed = token_files.pack_bits(ids, bits)
    assert len(packed) <= -(-len(ids) * bits // 8) + 1
    assert (token_files.unpack_bits(packed, bits, 0, len(ids)) == ids).all()
    for start, count in ((0, 0), (5, 1), (65_533, 70_000), (199_999, 4)):
        assert (token_files.unpack_bits(packed, bits, start, count) == ids[start : start + count]).all()


def test_bits_for():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    ids, path = library(WORD), scratch_path(spark, "test-token-files")
    monkeypatch.setattr("folioflow.llm.order.RANGE_BYTES", 1000)
    token_files.write_token_files(llm_cases.awkward(spark), path, WORD)
    ordered = sorted(llm_cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    flat, want = [], []
    for k, t, *_ in ordered:
        one = ids(t) + [2]
        want.append((k, len(flat), len(one), zlib.crc32(np.array(one, "<u4").tobytes()), one))
        flat += one
    got = sorted((tuple(r) for r in token_files.read_documents(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    assert got == want
    for start, count in ((0, 5), (17, 3000), (len(flat) - 3, 3)):
        assert token_files.read_span(spark, path, start, count).tolist() == flat[start : start + count]
    empty_path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(llm_cases.empty(spark), empty_path, WORD)
    assert token_files.read_documents(spark, empty_path).count() == 0


def test_words_after_a_space_are_kept_once():
    import public_tokenizers

    from folioflow.llm.token_ids import Encoder

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("x alpha beta, gamma1 beta", "é ünder\nline a, b", " a  b ", "it's 5. Ok"):
        assert encoder.encode(text) == encoder.encode_whole(text)
    assert "beta" in encoder.chunk_ids and " beta" not in encoder.word_ids
