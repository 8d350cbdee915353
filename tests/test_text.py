from pyspark.sql import functions as F

from folioflow.functions import security, text
from folioflow.operators import filters


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_words_follow_unicode_space(spark):
    value = "  Éa Straße\tb \x1cc \n"
    assert one(spark, value, text.words) == value.split()
    assert one(spark, "", text.words) == []


def test_strip_and_preprocess(spark):
    value = "  \x1d hi there 　\n"
    assert one(spark, value, text.strip) == value.strip()
    assert one(spark, "?" * 1000, text.preprocess_query) == "?" * 512


def test_truncation(spark):
    long = "Test text " * 1000
    cut = one(spark, long, lambda c: text.truncate_words(c, 100))
    assert len(cut) < len(long) and len(cut.split()) == 100
    assert one(spark, long, lambda c: text.truncate_chars(c, 100)) == long[:400]
    assert one(spark, "a b", lambda c: text.truncate_words(c, 100)) == "a b"


def test_clean_text(spark):
    value = "See https://x.org/a?b The  Größe, of www.foo.com it's  GOOD!"
    assert one(spark, value, text.clean_text) == "See Größe GOOD"


def test_path_metadata(spark):
    cases = {
        "data/raw/auto/CA/file.txt": ("auto", "CA"),
        "data/raw/ca/file.txt": ("general", "CA"),
        "some/random/path/file.txt": ("random", "all"),
        "a/file.txt": ("general", "all"),
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select(
        "p", text.path_lob("p").alias("lob"), text.path_state("p").alias("state")
    )
    assert {r.p: (r.lob, r.state) for r in rows.collect()} == cases


def test_file_names(spark):
    cases = {
        "/a/b/../Report 1.PDF": "Report1.PDF",
        "/x/evil;name.exe": "evilname.exe.txt",
        "../../etc/passwd": "passwd.txt",
        ".txt": ".txt.txt",
    }
    rows = spark.createDataFrame([(p,) for p in cases], "p string")
    got = rows.select("p", security.sanitize_filename("p").alias("n")).collect()
    assert {r.p: r.n for r in got} == cases
    assert one(spark, "a.tar.GZ", text.file_extension) == ".gz"
    assert one(spark, "a.tar.GZ", text.file_stem) == "a.tar"


def test_mask_covers_card_mail_and_social_security(spark):
    value = "card 1234567890123456 mail a.b@c.org ssn 123-45-6789 short 12345"
    want = "card [REDACTED] mail [REDACTED] ssn [REDACTED] short 12345"
    assert one(spark, value, security.mask_sensitive) == want


def test_input_screen_order(spark):
    assert one(spark, "", security.input_problem) == "Input cannot be empty"
    assert one(spark, None, security.input_problem) == "Input cannot be empty"
    assert "maximum length" in one(spark, "1234567890123456 " * 100, security.input_problem)
    assert "sensitive" in one(spark, "pay 1234567890123456", security.input_problem)
    assert one(spark, "What is covered?", security.input_problem) is None


def test_url_screen(spark):
    assert "start with" in one(spark, "ftp://a.b", security.url_problem)
    for host in ("localhost", "127.0.0.1", "192.168.0.1", "10.1.1.1", "172.20.0.1"):
        assert "private" in one(spark, f"http://{host}/x", security.url_problem)
    assert "maximum length" in one(spark, "http://a.b/" + "x" * 2000, security.url_problem)
    assert one(spark, "https://172.32.0.1/", security.url_problem) is None


def test_content_scan_first_pattern_wins(spark):
    assert one(spark, "a eval( <script", security.content_problem).endswith("<script")
    assert one(spark, "a\x00b", security.content_problem) == "File contains binary content"
    assert one(spark, "plain", security.content_problem) is None


def test_merge_maps_right_wins(spark):
    row = spark.sql("select map('a', '1', 'b', '2') as l, map('b', '9', 'c', '3') as r")
    assert row.select(text.merge_maps("l", "r").alias("m")).first().m == {"a": "1", "b": "9", "c": "3"}


def test_clean_answer(spark):
    assert one(spark, "System: x\nAssistant: a\nAssistant:  done ", text.clean_answer) == "done"
    assert one(spark, "Based on the provided context, yes", text.clean_answer) == "yes"


def test_metadata_filters(spark):
    docs = spark.createDataFrame(
        [("Content 1", "A", "high"), ("Content 2", "B", "low"), ("Content 3", "A", "medium")],
        "text string, category string, priority string",
    )
    assert filters.filter_metadata(docs, {"category": "A"}).count() == 2
    assert filters.filter_metadata(docs, {"category": "A", "priority": "high"}).count() == 1
    assert filters.filter_metadata(docs, {"nonexistent": "value"}).count() == 0


def test_conversation_checks_on_nested_rows(spark):
    def conv(*turns):
        return [{"from": f, "value": v} for f, v in turns]

    long = "x" * 60
    rows = spark.createDataFrame(
        [
            (1, conv(("human", long), ("gpt", long)), "s", "t", "m"),
            (2, conv(("system", long), ("gpt", long)), "s", "t", "m"),
            (3, conv(("human", "short"), ("gpt", long)), "s", "t", "m"),
            (4, conv(("human", long)), "s", "t", "m"),
            (5, conv(("human", long), ("gpt", long)), None, "t", "m"),
        ],
        "id int, conversations array<struct<`from`:string,value:string>>, source string, "
        "timestamp string, metadata string",
    )
    shaped = {r.id for r in filters.validate_sharegpt(rows).filter("is_valid").collect()}
    sized = {r.id for r in filters.validate_conversation(rows).filter("is_valid").collect()}
    assert shaped == {1, 3, 4, 5}
    assert sized == {1, 2}


def test_declared_rules(spark):
    words = " ".join(["word"] * 12)
    rows = spark.createDataFrame(
        [(1, [(words,), (words,)], 0.1, ["A"]), (2, [(words,), ("few words",)], None, [])],
        "id int, conversations array<struct<value:string>>, sentiment double, entities array<string>",
    )
    out = {r.id: r.failed_rules for r in filters.apply_rules(rows, filters.declared_rules()).collect()}
    assert out == {1: [], 2: ["content_check", "sentiment_check", "entity_check"]}


def test_request_ranges(spark):
    rows = spark.createDataFrame(
        [("q", 0.5, 1.0, 5), ("", 1.5, None, 0)],
        "question string, temperature double, top_p double, max_tokens int",
    )
    got = [r.failed_fields for r in filters.validate_requests(rows).collect()]
    assert got == [[], ["question", "temperature", "max_tokens"]]


def test_prompt_adjustments_in_order(spark):
    rows = spark.createDataFrame(
        [(["No source citations found", "Response contains doubt", "Response too short"],)],
        "issues array<string>",
    )
    assert filters.prompt_adjustments(rows).first().adjustments == [
        "Provide a more detailed response.",
        "Include specific references to the provided sources.",
        "Provide a direct and confident response.",
    ]
