import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import tables
from folioflow.sources import readers, writers


def test_text_tree_by_extension(spark, tmp_path):
    for lob in ("auto", "home"):
        folder = tmp_path / lob / "CA"
        folder.mkdir(parents=True)
        (folder / "file.txt").write_text(f"{lob} line 1\nline 2")
        (folder / "image.png").write_text("no")
    rows = readers.read_text_dir(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in rows) == ["auto line 1\nline 2", "home line 1\nline 2"]
    assert {r.file_type for r in rows} == {".txt"}


def test_csv_rows_become_documents(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nAnn,"x, y"\nBob,\n')
    rows = readers.read_csv_docs(spark, str(tmp_path / "a.csv")).collect()
    assert [r.text for r in rows] == ["name: Ann\nnote: x, y", "name: Bob\nnote: "]
    assert rows[0].source.endswith("a.csv")


def test_json_documents(spark):
    raws = ['{"body":"b","data":"d"}', '{"x":1}', '{"content":"c","text":"t"}']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    assert [r.text for r in readers.read_json_docs(df).collect()] == ["b", '{"x":1}', "c"]
    lists = spark.createDataFrame([('["a", "b"]',), ('{"k": 1}',), ('[{"k": 1}, 2]',)], "raw string")
    assert [r.text for r in readers.flatten_json_list(lists).collect()] == ["a\nb", '{"k": 1}', '{"k":1}\n2']


def test_html_text_and_class_filter(spark):
    html = (
        "<html><head><title>T &amp; U</title><style>p{}</style><script>var x='</p>';</script></head>"
        "<body><p class='post-content wide'>Hello <b>&eacute;</b><br>there</p><p>out</p></body></html>"
    )
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    rows = {r.page_id: r for r in readers.html_to_text(df).collect()}
    assert rows[1].text == "T & UHello éthereout" and rows[2].text is None
    only = readers.html_to_text(df, classes=["post-content"]).first()
    assert only.text == "Hello éthere"


def test_conversation_files(spark, tmp_path):
    conv = {"id": "a", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}
    (tmp_path / "list.json").write_text(json.dumps([conv, {**conv, "id": "b"}], indent=1))
    (tmp_path / "one.json").write_text(json.dumps({**conv, "id": "c"}, indent=1))
    (tmp_path / "bad.json").write_text("{ not json")
    (tmp_path / "other.txt").write_text("skip")
    good, bad = readers.read_conversations(spark, str(tmp_path))
    assert sorted(r.id for r in good.collect()) == ["a", "b", "c"]
    assert good.first().conversations[1].value == "r"
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]


@pytest.mark.parametrize(
    "kind,payload,key,field,value",
    [
        ("twitter", {"17": {"text": "hi", "retweet_count": 2}}, "17", "retweet_count", 2),
        ("news", {"http://a": {"title": "t", "source": "s"}}, "http://a", "title", "t"),
        ("policy", {"NAIC": {"content": "c", "categories": ["auto"]}}, "NAIC", "categories", ["auto"]),
        ("reddit", {"ins": [{"title": "t", "score": 3}, {"title": "u"}]}, "ins", "score", 3),
    ],
)
def test_payloads(spark, kind, payload, key, field, value):
    df = spark.createDataFrame([(json.dumps(payload),)], "raw string")
    rows = readers.flatten_payload(df, kind).collect()
    assert len(rows) == (2 if kind == "reddit" else 1)
    assert (rows[0].payload_key, rows[0][field]) == (key, value)


def test_listing_defaults(spark):
    df = spark.createDataFrame([(2, "x" * 101, None), (1, "short", "s")], "doc_id int, text string, source string")
    rows = readers.list_documents(df).collect()
    assert [(r.doc_id, r.source, r.topic) for r in rows] == [(1, "s", "Unknown"), (2, "Unknown", "Unknown")]
    assert rows[1].content_preview == "x" * 100 + "..."


def test_collections_append_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "collection string, id int")
    writers.write_collection(df, path, "rebuild")
    writers.write_collection(df, path)
    assert spark.read.parquet(path).count() == 4
    writers.write_collection(df, path, "rebuild")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        writers.write_collection(df, path, "other")


def test_citation_exports(spark):
    df = spark.createDataFrame(
        [("q", "[1]", 'say "x", y', "s", {"source": "s"})],
        "query string, citation string, text string, source string, metadata map<string,string>",
    )
    assert json.loads(writers.export_citations(df, "json").first().value)["metadata"] == {"source": "s"}
    assert writers.export_citations(df, "csv").first().value == '"say ""x"", y",s,"{""source"":""s""}"'
    assert writers.export_citations(df, "html").first().value == '<li>say "x", y (s)</li>'
    with pytest.raises(ValueError):
        writers.export_citations(df, "xml")


def test_load_twice_adds_nothing(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_hash string")
    first = tables.idempotent_load(empty, src)
    assert sorted(r.doc_id for r in first.collect()) == [1, 2]
    assert tables.idempotent_load(first.select("doc_hash"), src).count() == 0


def test_upsert_touches_only_new_and_changed(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "doc_id long, text string")
    src = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "doc_id long, text string")
    actions = {r.doc_id: r.action for r in tables.upsert_actions(stored, src, "doc_id").collect()}
    assert actions == {1: "skip", 2: "update", 3: "insert", 9: "keep"}
    after = tables.upsert(stored, src, "doc_id")
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "B"), (3, "c"), (9, "z")]
    assert sorted(map(tuple, tables.upsert(after, src, "doc_id").collect())) == sorted(map(tuple, after.collect()))


def test_hash_split_is_stable_and_near_its_share(spark):
    df = spark.range(5000)
    split = tables.hash_split(df, F.col("id"))
    share = split.filter("split = 'train'").count() / 5000
    assert 0.87 < share < 0.93
    more = tables.hash_split(spark.range(6000), F.col("id")).filter("id < 5000")
    assert sorted(more.collect()) == sorted(split.collect())
