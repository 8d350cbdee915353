import pytest
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.operators import splitting
from folioflow.operators.splitting import recursive_chunks


@settings(max_examples=200, deadline=None)
@given(
    st.text(alphabet="ab \n", max_size=400),
    st.integers(min_value=2, max_value=60),
    st.integers(min_value=0, max_value=59),
)
def test_recursive_chunks_keep_size_order_and_words(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = list(recursive_chunks(text, size, overlap))
    assert all(0 < len(c) <= size for c in chunks)
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - overlap - size))
        assert found >= 0
        at = found + len(c)


def test_long_words_and_paragraphs():
    text = "aaa bbb\n\nccc " + "d" * 25
    chunks = list(recursive_chunks(text, 10, 0))
    assert chunks[:2] == ["aaa bbb", "ccc"]
    assert "".join(chunks[2:]) == "d" * 25
    assert all(len(c) <= 10 for c in recursive_chunks(text, 10, 3))
    assert list(recursive_chunks("one two", 100, 20)) == ["one two"]


def test_overlap_repeats_whole_pieces():
    chunks = list(recursive_chunks("w1 w2 w3 w4 w5 w6", 8, 3))
    assert chunks[0] == "w1 w2 w3"
    assert chunks[1].startswith("w3")


def docs(spark, *texts):
    return spark.createDataFrame(
        [(i, t, f"src{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string"
    )


def test_empty_symbols_unicode_and_large(spark):
    df = docs(spark, "", "!@#$%", "Ünïcödé 世界 🌍", "Test content " * 10000)
    for split in (splitting.split_recursive, splitting.split_tokens, splitting.split_sentences):
        rows = split(df).collect()
        per_doc = {i: [r.chunk_text for r in rows if r.doc_id == i] for i in range(4)}
        assert per_doc[0] == []
        assert per_doc[1] == ["!@#$%"]
        assert per_doc[2] == ["Ünïcödé 世界 🌍"]
        assert per_doc[3]
        assert all(r.source == f"src{r.doc_id}" for r in rows)
    sizes = [len(r.chunk_text) for r in splitting.split_recursive(df).collect()]
    assert max(sizes) <= 1000


def test_token_windows(spark):
    df = docs(spark, " ".join(map(str, range(10))))
    got = [r.chunk_text for r in splitting.split_tokens(df, 4, 2).orderBy("chunk_index").collect()]
    assert got == ["0 1 2 3", "2 3 4 5", "4 5 6 7", "6 7 8 9"]
    with pytest.raises(ValueError):
        splitting.split_tokens(df, 4, 4)
    with pytest.raises(ValueError):
        splitting.split_recursive(df, 4, 9)


def test_sections_are_kept(spark):
    text = "SECTION 1: Introduction\nfirst part\n\nSECTION 2: Main\nsecond\n\nSECTION 3: End\nlast"
    df = docs(spark, text)
    chunks = splitting.split_tokens(df, 8, 4)
    rate = splitting.section_preservation(chunks, splitting.line_sections(df)).first()
    assert rate.preservation_rate >= 80


def test_retry_halves_the_window(spark):
    df = docs(spark, " ".join(["x" * 9] * 300), "short text")
    rows = splitting.split_with_retry(df, 256, 128, max_chars=1500).collect()
    assert {(r.doc_id, r.status) for r in rows} == {(0, "retried"), (1, "ok")}
    assert max(len(r.chunk_text.split()) for r in rows) == 128


def test_table_function_gives_what_the_splitter_gives(spark):
    rows = ["", None, "Test content. " * 300, "a\n\nb c\n" * 200, "x" * 2500, "Ünïcödé 世界 🌍 " * 90]
    df = docs(spark, *rows)
    splitting.register_functions(spark)
    for unit, size, overlap, length in (("chars", 1000, 200, len), ("words", 50, 10, splitting.count_words)):
        made = spark.sql(
            "SELECT doc_id, chunk_index, chunk_text FROM {docs}, LATERAL recursive_chunks(text, {size}, {overlap}, {unit})",
            docs=df, size=size, overlap=overlap, unit=unit,
        )
        want = splitting.split_recursive(df, size, overlap, length=length)
        assert sorted(map(tuple, made.collect())) == sorted(
            (r.doc_id, r.chunk_index, r.chunk_text) for r in want.collect()
        )


def test_length_function_bounds_every_chunk():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (5, 80, 3, 41, 200))
    chunks = list(splitting.recursive_chunks(text, 40, 8, length=splitting.count_words))
    assert max(map(splitting.count_words, chunks)) <= 40
    assert set(text.split()) == {w for c in chunks for w in c.split()}
    assert "".join(splitting.recursive_chunks("é" * 50, 7, 0, length=lambda t: len(t.encode()))) == "é" * 50


def test_recursive_chunks_leave_a_task_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(splitting, "HELD_CHARS", 50)
    texts = ["ab cd " * 200, None, "", "one"]
    parts = list(splitting._some_chunks(pa.array(texts), 40, 10, len))
    assert len(parts) > 5 and max(sum(map(len, found)) for _, _, found in parts) < 50 + 40
    want = [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(splitting.recursive_chunks(t or "", 40, 10))]
    assert [row for part in parts for row in zip(*part)] == want


@pytest.mark.parametrize("plain", [0, 1 << 22])
def test_sections_are_judged_where_they_are_searched(spark, monkeypatch, plain):
    """Copies, nulls and empty sections keep their rows; sections meet no second join."""
    monkeypatch.setattr(splitting, "PLAIN_SEARCH", plain)
    chunks = [(1, "a b c"), (1, "c d"), (2, "x é y"), (None, "a"), (3, None)]
    sections = [
        (1, "a b"), (1, "a b"), (1, "b c d"), (1, "b c d"), (1, ""), (1, None), (2, "é"), (3, "q"), (None, "a"), (4, "z"),
    ]
    chunks = spark.createDataFrame(chunks, "doc_id long, chunk_text string")
    frame = spark.createDataFrame(sections, "doc_id long, section string")
    found = {(1, "a b"), (2, "é")}
    missing = splitting.missing_sections(chunks, frame)
    assert "LeftAnti" not in missing._jdf.queryExecution().toString()
    lost = sorted((s for s in sections if s not in found), key=repr)
    assert sorted(map(tuple, missing.collect()), key=repr) == lost
    wide = splitting.missing_sections(chunks, frame.withColumn("place", F.lit(7)))
    assert sorted(((r.doc_id, r.section) for r in wide.collect()), key=repr) == lost and "place" in wide.columns
    rates = {r.doc_id: (r.sections, r.preserved) for r in splitting.section_preservation(chunks, frame).collect()}
    assert rates == {1: (6, 2), 2: (1, 1), 3: (1, 0), None: (1, 0), 4: (1, 0)}
