"""Bucketed tables: equal to the whole-table operators, and only touched buckets are rewritten."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from folioflow.operators import buckets, tables, training
from folioflow.plans import QUERIES
from folioflow.session import scratch_path, table

SHAPE = "doc_id long, text string, source string, updated_at long"


def rows(spark):
    made = [(i, f"text {i}", f"s{i % 3}", 0) for i in range(200)]
    return spark.createDataFrame([*made, (2**53 + 1, "big", "s", 0)], SHAPE)


def stamps(path):
    return {p.parent.name: (p.name, os.stat(p).st_mtime_ns) for p in sorted(Path(path).glob("*/*.parquet"))}


def same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


def test_changes_equal_the_whole_table_and_touch_few_buckets(spark):
    path = scratch_path(spark, "bucket-test")
    whole = rows(spark)
    made = buckets.create(whole, path, "doc_id", 32)
    assert same(made.rows(), whole) and made.rows().columns == whole.columns

    updates = spark.createDataFrame([(3, "new text"), (2**53 + 1, None), (999, "nobody")], "doc_id long, text string")
    before = stamps(path)
    changed = made.update(updates, F.lit(7).cast("long"))
    whole = tables.update_documents(whole, updates, "doc_id", F.lit(7).cast("long"))
    assert same(made.rows(), whole)
    after = stamps(path)
    assert 1 <= len(changed) <= 3
    assert {b for b in before if before[b] != after.get(b)} == {f"_bucket={n}" for n in changed}

    load = spark.createDataFrame([(5, "text 5", "s2", 0), (6, "other", "s9", 0), (5000, "fresh", "s", 1)], SHAPE)
    made.upsert(load)
    whole = tables.upsert(whole, load, "doc_id")
    assert same(made.rows(), whole)


def test_an_emptied_bucket_stays_empty(spark):
    path = scratch_path(spark, "bucket-test")
    made = buckets.create(rows(spark), path, "doc_id", 4)
    first = made.rows().filter(made._bucket() == 1).select("doc_id")
    kept = 201 - first.count()
    ids = spark.createDataFrame([tuple(r) for r in first.collect()], "doc_id long")
    assert made.delete(ids) == [1]
    assert made.rows().count() == kept and made.rows().filter(made._bucket() == 1).count() == 0
    assert made.delete(ids.limit(0)) == []
    plan = made._held().filter("_bucket IN (2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_learned_lexicon_tells_held_out_documents(spark, small):
    texts = [("good fine text", 1), ("fine words here", 1), ("fine day", 1), ("bad text", 0), ("bad words", 0), ("bad day", 0)]
    frame = spark.createDataFrame([*texts, (None, 1), ("bad", None)], "text string, label int")
    learnt = {r.word: r.polarity for r in training.learn_lexicon(frame, sure=1.0).collect()}
    assert set(learnt) == {"fine", "bad"} and learnt["fine"] > 0 > learnt["bad"]
    row = QUERIES["lexicon_accuracy"](spark, "/root/testdata/sf0.01").first()
    print("held-out:", row)
    assert row.texts > 50 and row.accuracy > row.larger_class


def test_bucket_query(spark, small):
    out = QUERIES["bucket_upsert"](spark, small)
    docs = table(spark, small, "documents")
    assert out.count() == docs.count() - docs.filter("source = 'src3'").count()


def test_the_changed_rows_of_a_load_need_no_join(spark, small):
    from folioflow.plans import table_queries

    changed = table_queries.load(spark, small, table_queries.documents(spark, small).filter("lang = 'fr'"))
    assert changed.count() and changed.filter("NOT endswith(text, ' v2')").count() == 0
    assert "Join" not in changed._jdf.queryExecution().executedPlan().toString()
