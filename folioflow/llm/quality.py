"""Quality of documents: a classifier's evidence with hierarchical empirical Bayes over sites.

A logistic classifier on shape features of a text gives each document a probability. Sites
are hosts and paths under them; here a document's host is its source and the path its
language under it. Grouped sums give every host a posterior share of good documents, drawn to
the global share, and every path one drawn to its host's; how strongly is read from how much
sites differ. Sparse sites so stay near their parents. The posterior odds of a document are
its own odds, shifted by those of its path against the global ones, within a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.logistic import Logistic
from folioflow.llm.tables import release_memory, written
from folioflow.llm.wordhash import Words, row_blocks, text_bytes

SAMPLE = 20_000  # labelled documents, at most, that the classifier is fitted on
SITES_BROADCAST = 100_000
SALTS = 64
BLOCK = 1 << 18  # bytes of text whose features are made at a time
SHIFT = 1.0  # a site moves a document's log-odds by at most this
ACCEPT = 0.5

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        1 if _c in "abcdefghijklmnopqrstuvwxyz" or _b >= 0x80 else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit()
        else 4 if _c.isspace() else 0 if _c in ".,;:'\"-()" else 5
    )
FEATURES = 13


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of each row: shares of letter kinds, length of words and lines, repetition."""
    words = Words(data, offsets, lower=True)
    rows, n = words.rows, len(words.rows) - 1
    size = np.maximum(np.diff(rows), 1).astype(float)
    kinds = _KIND[words.data]
    out = np.zeros((n, FEATURES))
    for k in range(1, 6):
        upto = np.concatenate([[0], np.cumsum(kinds == k)])
        out[:, k - 1] = (upto[rows[1:]] - upto[rows[:-1]]) / size
    count = words.counts()
    many = np.maximum(count, 1).astype(float)
    length = np.concatenate([[0], np.cumsum(words.end - words.start)])
    out[:, 5] = (length[words.first[1:]] - length[words.first[:-1]]) / many
    out[:, 6] = np.log1p(count)
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    out[:, 7] = (lines[rows[1:]] - lines[rows[:-1]]) / many
    marks = kinds == 5
    ends = np.concatenate([[0], np.cumsum(marks[words.end - 1])])
    out[:, 8] = (ends[words.first[1:]] - ends[words.first[:-1]]) / many
    _, _, triples = words.windows(3)
    each = np.maximum(count - 2, 0)
    at = np.concatenate([[0], np.cumsum(each)])
    for r in range(n):
        own = words.hash[words.first[r] : words.first[r + 1]]
        if len(own):
            seen = np.unique(own, return_counts=True)[1]
            out[r, 9] = len(seen) / len(own) ** 0.8
            out[r, 10] = seen.max() / len(own)
            phrases = triples[at[r] : at[r + 1]]
            out[r, 11] = 1 - len(np.unique(phrases)) / len(phrases) if len(phrases) else 0.0
    out[:, 12] = count == 0
    return out


def _labelled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label and features of each row."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for low, high in row_blocks(offsets, BLOCK):
            made = pa.array(list(features(data, offsets[low : high + 1])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("good").slice(low, high - low), made], ["good", "made"])


def _evidence(model: Logistic, text: Column) -> Column:
    """The classifier's probability. Only texts go to the Python workers, and one number comes back."""

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        data, offsets = text_bytes(column)
        found = [model.probability(features(data, offsets[a : z + 1])) for a, z in row_blocks(offsets, BLOCK)]
        release_memory()
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return probability(text)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Logistic:
    """The classifier, fitted on at most ``sample`` labelled documents, those of least hash.

    A document labelled both ways counts as bad; null labels and doc_ids teach nothing.
    """
    known = (
        labels.select("doc_id", "quality")
        .filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample)
    )
    # At most ``sample`` label rows are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))
    seen = (
        rows.select("text", "good")
        .mapInArrow(_labelled_features, "good int, made array<double>")
        .limit(sample)
        .collect()
    )
    x = np.array([r["made"] for r in seen], float).reshape(-1, FEATURES)
    return Logistic(x, np.array([r["good"] for r in seen], float))


def _strength(n: Column, p: Column, parent: Column) -> Column:
    """How many documents' worth of weight the parent share has, by how sites differ.

    The spread of site shares beyond what their size explains gives the strength of a beta
    prior by moments; it is kept between 1 and 10,000.
    """
    within = parent * (1 - parent)
    excess = F.sum(n * F.pow(p / n - parent, 2)) - F.count("*") * F.avg(within)
    between = F.greatest(excess / F.sum(n), F.lit(1e-6))
    return F.least(F.greatest(F.avg(within) / between - 1, F.lit(1.0)), F.lit(10_000.0))


def site_posteriors(judged: DataFrame) -> DataFrame:
    """host, path, path_share, global_share from ``judged`` (host, path, made).

    Three grouped sums: paths from documents, hosts from paths, the whole from hosts. Null
    hosts and paths are sites like others.
    """
    paths = written(
        judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("made").alias("good")), "paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    whole = hosts.agg((F.sum("host_good") + 0.5).alias("g"), (F.sum("host_n") + 1.0).alias("m")).first()
    share = (whole["g"] or 0.5) / (whole["m"] or 1.0)
    parent = F.lit(share)
    strength = hosts.agg(_strength(F.col("host_n"), F.col("host_good"), parent).alias("s")).first()["s"] or 1.0
    hosts = hosts.withColumn(
        "host_share", (F.col("host_good") + strength * parent) / (F.col("host_n") + strength)
    ).withColumnRenamed("host", "of")
    both = written(
        paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).select("host", "path", "n", "good", "host_share"),
        "hosts",
    )
    own = both.agg(_strength(F.col("n"), F.col("good"), F.col("host_share")).alias("s")).first()["s"] or 1.0
    return both.select(
        "host", "path",
        ((F.col("good") + own * F.col("host_share")) / (F.col("n") + own)).alias("path_share"),
        F.lit(share).alias("global_share"),
    )


def _judge(docs: DataFrame, labels: DataFrame, sample: int, carried: list[str]) -> DataFrame:
    """host, path, made (probability), row (struct of the carried columns), quality."""
    model = fit(docs, labels, sample)
    host, path = (
        F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")
    )
    rows = docs.select(
        host.alias("host"), path.alias("path"), F.struct(*(f"`{c}`" for c in carried)).alias("row"),
        _evidence(model, F.col("text")).alias("made"),
    )
    sites = written(site_posteriors(rows.select("host", "path", "made")), "sites")
    named = sites.select(F.col("host").alias("h"), F.col("path").alias("p"), "path_share", "global_share")
    meets = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    if sites.limit(SITES_BROADCAST + 1).count() <= SITES_BROADCAST:
        met = rows.join(F.broadcast(named), meets)
    else:
        # Beyond the bound sites are copied to salts, so that a hot site spreads over tasks.
        salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("slot", F.pmod(F.xxhash64("row", "made"), F.lit(SALTS)).cast("int"))
        met = dealt.join(salted, meets & (F.col("slot") == F.col("salt")))

    def odds(p: Column) -> Column:
        sure = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.log(sure / (1 - sure))

    shift = odds(F.col("path_share")) - odds(F.col("global_share"))
    bounded = F.least(F.greatest(shift, F.lit(-SHIFT)), F.lit(SHIFT))
    return met.withColumn("quality", 1 / (1 + F.exp(-(odds(F.col("made")) + bounded))))


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """Quality of every row of ``docs``: doc_id, evidence, path_share, quality, accepted.

    ``docs`` has doc_id and text, and source and lang where known; ``labels`` has doc_id and
    quality (0 or 1). One row per input row: ``evidence`` is the classifier's probability,
    ``quality`` the posterior, ``accepted`` whether it reaches ``accept``.

    Null and empty texts are judged by their emptiness. Null sources and languages are sites
    like others; null doc_ids are kept. Without labels of both classes the evidence is the
    share of good labels. An empty table gives no rows; extra columns are ignored.
    """
    judged = _judge(docs, labels, sample, ["doc_id"])
    return judged.select(
        "row.doc_id", F.col("made").alias("evidence"), "path_share", "quality",
        (F.col("quality") >= accept).alias("accepted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, with all their columns."""
    judged = _judge(docs, labels, sample, docs.columns).filter(F.col("quality") >= accept)
    return judged.select(*(f"row.`{c}`" for c in docs.columns))
