"""The hot-key helpers give what a plain window or join gives, on skewed rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.operators import retrieval, scale


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot", "hot", None, *(f"k{j}" for j in range(4))]), rng.randrange(5000), i, rng.randrange(9))
        for i in range(4000)
    ]
    return spark.createDataFrame(rows, "k string, at int, id int, v int").cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_ordinals(skewed):
    w = W.partitionBy("k").orderBy("at", "id")
    want = skewed.withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    bucket, order = F.floor(F.col("at") / 100), [F.asc("at"), F.asc("id")]
    got = scale.bucketed_ordinal(skewed, ["k"], bucket, order, "n")
    assert rows(got, "id", "n") == rows(want, "id", "n")
    whole = scale.global_ordinal(skewed, scale.range_bucket(skewed, "at", 50), order, "n")
    everything = skewed.withColumn("n", (F.row_number().over(W.orderBy("at", "id")) - 1).cast("long"))
    assert rows(whole, "id", "n") == rows(everything, "id", "n")


def test_previous_and_running_sum(skewed):
    w = W.partitionBy("k").orderBy("at", "id")
    bucket, order = F.floor(F.col("at") / 70), [F.asc("at"), F.asc("id")]
    want = skewed.withColumn("p", F.lag("at").over(w))
    got = scale.bucketed_previous(skewed, ["k"], "at", bucket, order, "p")
    assert rows(got, "id", "p") == rows(want, "id", "p")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    want = skewed.withColumn("s", F.sum("v").over(run))
    got = scale.bucketed_running_sum(skewed, ["k"], bucket, order, "v", "s")
    assert rows(got, "id", "s") == rows(want, "id", "s")


def test_heavy_light_join(spark, skewed, monkeypatch):
    monkeypatch.setattr(scale, "HEAVY_SHARE", 8)
    totals = skewed.filter("k <> 'k3' or k is null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    facts = skewed.select("k", "id").unionByName(
        spark.createDataFrame([(None, -1), ("none", -2)], "k string, id int")
    )
    want = facts.join(totals.select("k", "top"), "k", "left")
    got = scale.heavy_light_join(facts, totals, ["k"], "n", "top", "left")
    assert rows(got, "id", "k", "top") == rows(want, "id", "k", "top")
    both = scale.heavy_light_join(facts, totals, ["k"], "n", "top", "left", same_nulls=True)
    nulls = {r.top for r in both.filter("k is null").collect()}
    assert nulls == {r.top for r in totals.filter("k is null").collect()}
    inner = scale.heavy_light_join(facts, totals, ["k"], "n", "top")
    assert rows(inner, "id", "top") == rows(want.filter("top is not null"), "id", "top")


def test_salt_stays_in_the_shuffle(skewed, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        totals = skewed.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
        plan = scale.heavy_light_join(skewed, totals, ["k"], "n", "top")
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(k#" in text and "_salt#" in text.split("SortMergeJoin")[1].split("\n")[0]


def test_exact_median(skewed):
    odd = skewed.withColumn("x", F.col("v") * 1.5 + F.col("at") / 7)
    want = odd.groupBy("k").agg(F.median("x").alias("m")).collect()
    got = scale.exact_median(odd, ["k"], "x", "m").collect()
    assert {r.k: pytest.approx(r.m) for r in want} == {r.k: r.m for r in got}
    # Mostly one value, and a far outlier.
    flat = skewed.withColumn("x", F.when(F.col("id") == 0, 1e12).otherwise(F.when(F.col("v") < 7, 1.0).otherwise(F.col("at"))))
    want = flat.groupBy("k").agg(F.median("x").alias("m")).collect()
    assert {r.k: r.m for r in scale.exact_median(flat, ["k"], "x", "m").collect()} == {r.k: r.m for r in want}


def test_each_keeps_nulls_and_drops_empty(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "id int, a array<string>")
    assert rows(scale.each(df, ["id"], "a", "x", "at"), "id", "at", "x") == [(1, 0, "a"), (1, 1, None)]


def test_at_most(spark):
    assert scale.at_most(spark.range(10), 10)
    assert not scale.at_most(spark.range(11), 10)


def test_maybe_among_keeps_every_partner_and_leaves_most_others(spark, monkeypatch):
    """Rows of a key that others hold all stay, repeated and null ones too; few of the others do."""
    rows = [(f"k{i % 5_000}", i) for i in range(6_000)] + [(None, -1)]
    wanted = [(f"k{i}",) for i in range(0, 5_000, 100)] + [("absent",), (None,), ("k0",)]
    df = spark.createDataFrame(rows, "id string, n int")
    others = spark.createDataFrame(wanted, "id string")
    named = {k for (k,) in wanted}
    for bits in (1 << 25, 1 << 15):
        monkeypatch.setattr(scale, "MARK_BITS", bits)
        kept = scale.maybe_among(df, "id", others)
        got = [tuple(r) for r in kept.collect()]
        assert kept.columns == df.columns and len(got) == len(set(got))
        assert {r for r in rows if r[0] in named} <= set(got) <= set(rows) and len(got) < 200
    assert scale.maybe_among(df, "id", others.limit(0)).count() == 0


def test_hits_keep_their_rows_when_chunks_are_left_out(spark):
    chunks = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), (None, "w")], "chunk_id string, chunk_text string")
    hits = spark.createDataFrame([(1, "a"), (2, "a"), (3, "gone"), (4, None)], "query_id int, chunk_id string")
    got = {(r.query_id, r.chunk_id, r.chunk_text) for r in retrieval.hydrate_hits(hits, chunks).collect()}
    assert got == {(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (2, "a", "y"), (3, "gone", None), (4, None, None)}
