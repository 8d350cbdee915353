"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, are counted in Spark over all labelled
documents of the training folds. A document's evidence is the difference of its log-likelihoods
under the two, by its length. Rare expressions fall back on the share of distinct words a word
follows: per class, and below that in both classes together, so that an expression seen too
rarely to tell the classes apart says little. How much the evidence weighs is learnt crosswise:
documents of either training fold are judged by the counts of the other.

Words and bigrams go by 64-bit hashes. All that is counted stays in written tables that grow
with the input. Only the most frequent expressions are sent to the tasks, to save the shuffle;
the others meet the documents in a join, so that every expression has its own weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.logistic import Logistic
from folioflow.llm.tables import own_columns, release_memory, releasing, written
from folioflow.llm.wordhash import LETTERS, Words, mix, row_blocks, text_bytes
from folioflow.operators.scale import broadcast_if_small

FOLDS = 3
HELD_OUT = 1  # fold that never trains
HALVES = 0, 2  # the training folds; both are counted
CLASSES = "ordinary", "toxic"
HALF_CLASSES = [f"{c}{h}" for h in range(len(HALVES)) for c in CLASSES]
BEGIN = np.int64(0)  # the word before the first of a row
HOT = 1 << 19  # expressions, at most, that are sent to the tasks: the most frequent; others are joined
SIEVE = 1 << 18  # longs of the sieve that keeps most expressions without weight out of the join
SAMPLE = 20_000  # labelled documents, at most, that the weighing of evidence is fitted on
DISCOUNT = 3.0  # seen no more often than this in a class, an expression is left to what both classes share
FLUSH = 2_000_000
PART_BYTES = 16 << 20
LABELS_BROADCAST = 500_000  # labels up to which they are sent to the texts; beyond, both are shuffled
PARTS = 5  # additive parts of the evidence: in context, by word, the strong of each, the ordinary
FEATURES = 6


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a range of rows and the first of each row; words are runs of letters."""
    words = Words(data, offsets, lower=True, inside=LETTERS)
    return words.hash.view(np.int64), words.first


def _bigrams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, previous word (BEGIN at the beginning of a row) and bigram hash of every word."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][np.diff(first) > 0]] = BEGIN
    return row, before, _gram_hash(before, words)


# What travels between tasks: packed arrays of keys and of their counts in every half and class.
GRAM, WORD, CONTEXT, KINDS = range(4)
_BLOCK = "part int, kind int, keys binary, words binary, counts binary"
_STATS = "kind int, key long, before long, word long, " + ", ".join(f"c{i} long" for i in range(9))


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the summed rows of ``counts``."""
    known, at, which = np.unique(keys, return_index=True, return_inverse=True)
    return known, at, np.stack([np.bincount(which, c, len(known)).astype(np.int64) for c in counts])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _gram_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    pair = mix(before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + words.view(np.uint64)
    return mix(pair).view(np.int64)


def _count(parts: int):
    """Bigrams of labelled texts, counted per half and class within a task, as blocks for the parts of their hashes.

    What words and contexts occur in all is counted beside them.
    """

    def blocks(
        kind: int, keys: np.ndarray, words: np.ndarray | None, counts: np.ndarray, part: np.ndarray
    ) -> Iterator[tuple]:
        order = np.lexsort((keys, part))
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[p] : edges[p + 1]]
            second = b"" if words is None else words[own].tobytes()
            yield p, kind, keys[own].tobytes(), second, counts[:, own].astype("<u4").tobytes()

    def flush(held: list[tuple]) -> pa.RecordBatch:
        before, word, kind = (np.concatenate(x) for x in zip(*held, strict=True))
        one = np.stack([kind == k for k in range(len(HALF_CLASSES))])
        grams, at, counts = _grouped(_gram_hash(before, word), one)
        rows = list(blocks(GRAM, before[at], word[at], counts, _part(grams, parts)))
        for what, values in ((WORD, word), (CONTEXT, before)):
            keys, _, counts = _grouped(values, one)
            rows += blocks(what, keys, None, counts, _part(keys, parts))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["part", "kind", "keys", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            half, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("half", "toxic"))
            kind = half * len(CLASSES) + toxic
            for low, high in row_blocks(offsets):
                words, first = _tokens(data, offsets[low : high + 1])
                row, before, _ = _bigrams(words, first)
                held.append((before, words, kind[low + row]))
                size += len(row)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one part: bigrams seen often, totals of words and contexts, and how many bigrams end in a word."""

    def rows(kind: int, key: np.ndarray, columns: np.ndarray, before=None, word=None) -> pa.RecordBatch:
        n = len(key)
        full = np.zeros((9, n), np.int64)
        full[: len(columns)] = columns
        named = [pa.array(np.full(n, kind, np.int32)), pa.array(key)]
        named += [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (before, word)]
        return pa.RecordBatch.from_arrays(
            [*named, *map(pa.array, full)], ["kind", "key", "before", "word", *(f"c{i}" for i in range(9))]
        )

    def summed(held: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        for kind in (WORD, CONTEXT):
            if held.get(kind):
                keys, _, counts = zip(*held[kind], strict=True)
                known, _, total = _grouped(np.concatenate(keys), np.concatenate(counts, axis=1))
                yield rows(kind, known, total)
        if not held.get(GRAM):
            return
        before, word, counts = zip(*held[GRAM], strict=True)
        before, word, counts = np.concatenate(before), np.concatenate(word), np.concatenate(counts, axis=1)
        grams, at, total = _grouped(_gram_hash(before, word), counts)
        before, word = before[at], word[at]
        # For either half and both: is the bigram seen in a class, and in any?
        n = len(CLASSES)
        seen = []
        for chosen in (total[:n], total[n:], total[:n] + total[n:]):
            seen += [chosen[0] > 0, chosen[1] > 0, chosen.sum(axis=0) > 0]
        words, _, kinds = _grouped(word, np.stack(seen))
        yield rows(KINDS, words, kinds)
        often = np.flatnonzero((total[:n] + total[n:]).max(axis=0) > DISCOUNT)
        yield rows(GRAM, grams[often], total[:, often], before[often], word[often])

    part, held = None, {}
    for batch in batches:
        for r, (p, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "kind")), strict=True)):
            if p != part:
                yield from summed(held)
                part, held = p, {}
            keys, words = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("keys", "words"))
            counts = np.frombuffer(batch.column("counts")[r].as_buffer(), "<u4").reshape(len(HALF_CLASSES), -1)
            held.setdefault(kind, []).append((keys, words, counts))
    yield from summed(held)


@dataclass
class KneserNey:
    """Written tables of the models; nothing in them has a fixed size.

    ``words`` has the shares of every word seen, ``contexts`` the weight of the fall-back, and
    ``weights`` what each word and each bigram that tells the classes apart adds to the parts
    of the evidence. Class 0 is ordinary, 1 toxic. The weight of what is held back for the
    fall-back comes from both classes together: an expression that neither has seen often then
    weighs the same in both.
    """

    words: DataFrame
    contexts: DataFrame
    weights: DataFrame

    @property
    def share(self) -> np.ndarray:
        return self.words.select("share0", "share1").toPandas().to_numpy(float).T

    @property
    def fallback(self) -> np.ndarray:
        return self.contexts.select("fallback").toPandas().to_numpy(float).ravel()

    @property
    def bigrams(self) -> np.ndarray:
        found = self.weights.filter("is_bigram").select("key").orderBy("key")
        return found.toPandas()["key"].to_numpy(np.int64)


def train_counts(labelled: DataFrame) -> KneserNey:
    """Models of ``labelled`` (text, toxic 0 or 1). All counting is done by Spark."""
    return fitted(count_bigrams(labelled.select("text", "toxic", F.lit(0).alias("half"))), 0)


def count_bigrams(labelled: DataFrame) -> DataFrame:
    """What the models need of the bigrams of ``labelled`` (text, toxic, half 0 or 1), by half and class."""
    rows = labelled.select("text", "toxic", "half")
    size = labelled.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * partitions, size // PART_BYTES, 1)
    blocks = rows.mapInArrow(releasing(_count(parts)), _BLOCK).repartition(parts, "part").sortWithinPartitions("part")
    return written(blocks.mapInArrow(releasing(_add_up), _STATS), "bigrams")


def fitted(stats: DataFrame, *halves: int) -> KneserNey:
    """Models of the counts of the given halves."""
    classes = CLASSES
    size = len(classes)
    of = {c: sum((F.col(f"c{size * h + i}") for h in halves[1:]), F.col(f"c{size * halves[0] + i}")) for i, c in enumerate(classes)}
    chosen = 3 * (halves[0] if len(halves) == 1 else 2)
    kind, none_seen = F.col("kind"), F.lit(0).cast("long")
    grams = stats.filter(kind == GRAM).select(F.col("key").alias("bigram"), "before", "word", *(x.alias(c) for c, x in of.items()))

    def beyond(c: str) -> Column:
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))

    def total(what: int, value: Column) -> Column:
        return F.sum(F.when(kind == what, value).otherwise(none_seen))

    counted = written(
        stats.filter(kind.isin(WORD, KINDS)).groupBy(F.col("key").alias("word")).agg(
            *(total(KINDS, F.col(f"c{chosen + i}")).alias(c) for i, c in enumerate((*classes, "both"))),
            total(WORD, of["ordinary"] + of["toxic"]).alias("occurs"),
        ).filter("both > 0"),
        "words",
    )
    sums = counted.agg(
        F.count("*").alias("kinds"), F.sum("both").alias("all"), F.sum(beyond("both")).alias("beyond"),
        *(F.sum(c).alias(c) for c in classes),
    ).first()
    pooled = float(sums["all"] or 0)
    held_back = max(1.0 - (sums["beyond"] or 0.0) / max(pooled, 1.0), 1e-6)
    # All words never seen count as one more.
    lowest = (F.col("both") + 0.5) / F.lit(pooled + 0.5 * (sums["kinds"] + 1))
    words = counted.select(
        "*",
        *(
            (beyond(c) / F.lit(max(float(sums[c] or 0), 1.0)) + F.lit(held_back) * lowest).alias(f"share{i}")
            for i, c in enumerate(classes)
        ),
    ).withColumn("ratio", F.log(F.col("share1") / F.col("share0")))
    context = F.when(kind == GRAM, F.col("before")).otherwise(F.col("key")).alias("before")
    beyond_both = sum(F.greatest(of[c] - DISCOUNT, F.lit(0.0)) for c in classes)
    contexts = (
        stats.filter(kind.isin(GRAM, CONTEXT)).groupBy(context)
        .agg(*(total(CONTEXT, of[c]).alias(f"own_{c}") for c in classes), F.sum(F.when(kind == GRAM, beyond_both).otherwise(0.0)).alias("kept"))
        .filter("own_ordinary + own_toxic > 0")
    )
    all_own = F.greatest(F.col("own_ordinary") + F.col("own_toxic"), F.lit(1))
    contexts = written(
        contexts.withColumn("fallback", F.greatest(1.0 - F.col("kept") / all_own, F.lit(1e-3))), "contexts"
    )

    # A word or bigram that neither class has seen often weighs the same in both, and adds nothing:
    # without one of its own, a bigram's evidence is that of its word.
    often = (F.col("ordinary") > DISCOUNT) | (F.col("toxic") > DISCOUNT)
    strong = F.greatest(F.col("ratio") - 2.0, F.lit(0.0))
    none = F.lit(0.0)
    by_word = words.filter(often).select(
        F.col("word").alias("key"), F.col("occurs").alias("n"), F.lit(False).alias("is_bigram"),
        F.col("ratio").alias("p0"), F.col("ratio").alias("p1"), strong.alias("p2"), strong.alias("p3"),
        F.greatest(-1.0 - F.col("ratio"), none).alias("p4"),
    )
    mixed = [
        F.col("fallback") * F.col(f"share{i}") + beyond(c) / F.greatest(F.col(f"own_{c}"), F.lit(1))
        for i, c in enumerate(classes)
    ]
    in_context = F.log(mixed[1] / mixed[0])
    by_bigram = (
        grams.filter(often)
        .join(words.select("word", "share0", "share1", "ratio"), "word")
        .join(contexts, "before")
        .select(
            F.col("bigram").alias("key"), (F.col("ordinary") + F.col("toxic")).alias("n"),
            F.lit(True).alias("is_bigram"), (in_context - F.col("ratio")).alias("p0"), none.alias("p1"),
            (F.greatest(in_context - 2.0, none) - strong).alias("p2"), none.alias("p3"), none.alias("p4"),
        )
    )
    return KneserNey(words, contexts, written(by_word.unionByName(by_bigram), "weights"))


@dataclass
class Frequent:
    """The most frequent expressions, by key, and a sieve that all others pass."""

    keys: np.ndarray
    parts: np.ndarray
    sieve: np.ndarray

    def look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words and summed parts of each row; row, key and count of what is left to the join."""
        words, first = _tokens(data, offsets)
        row, _, bigrams = _bigrams(words, first)
        n = np.diff(first)
        row, keys = np.concatenate([row, row]), np.concatenate([words, bigrams])
        parts = np.zeros((len(n), PARTS))
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            for i in range(PARTS):
                parts[:, i] = np.bincount(row[hit], self.parts[i][place[hit]], len(n))
            row, keys = row[~hit], keys[~hit]
        bits = keys.view(np.uint64)
        slot = (bits >> np.uint64(6)).astype(np.int64) & (SIEVE - 1)
        maybe = (self.sieve[slot] >> (bits & np.uint64(63))) & np.uint64(1) == 1
        row, keys = row[maybe], keys[maybe]
        order = np.lexsort((keys, row))
        row, keys = row[order], keys[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
        at = np.flatnonzero(new)
        return n, parts, row[at], keys[at], np.diff([*at, len(row)])


def _frequent(weights: DataFrame) -> tuple[Frequent, DataFrame]:
    """At most HOT of the weights, the most frequent, and all the others as a table."""
    names = [f"p{i}" for i in range(PARTS)]
    levelled = weights.withColumn("level", F.floor(F.log2("n") * 16))
    least, kept = 1 << 30, 0
    for row in sorted(levelled.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if kept + row["count"] > HOT:
            break
        least, kept = row["level"], kept + row["count"]
    hot = levelled.filter(F.col("level") >= least).select("key", *names).toArrow()
    keys = hot.column("key").to_numpy()
    order = np.argsort(keys)
    rest = levelled.filter(F.col("level") < least).select("key", *names)
    sieve = np.zeros(SIEVE, np.uint64)
    slots = (
        rest.groupBy(F.expr(f"shiftrightunsigned(key, 6) & {SIEVE - 1}L").alias("slot"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(key & 63L AS int)))").alias("bits"))
        .toPandas()
    )
    sieve[slots["slot"].to_numpy(np.int64)] = slots["bits"].to_numpy(np.int64).view(np.uint64)
    parts = np.stack([hot.column(n).to_numpy()[order] for n in names])
    return Frequent(keys[order], parts, sieve), rest


def evidence(rows: DataFrame, model: KneserNey) -> DataFrame:
    """``rows`` with ``text`` replaced by the features x0, x1, ... of every text.

    Log-likelihood ratios by the length, in context and by word; strong parts apart.
    """
    frequent, rest = _frequent(model.weights)
    sent = rows.sparkSession.sparkContext.broadcast(frequent)
    carried = [f for f in rows.schema.fields if f.name != "text"]
    names = [f"s{i}" for i in range(PARTS)]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    shape += ", uid long, n_words long, " + ", ".join(f"{c} double" for c in names)
    shape += ", keys array<long>, counts array<long>"
    labels = [*(f.name for f in carried), "uid", "n_words", *names, "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in row_blocks(offsets):
                n, parts, row, keys, counts = sent.value.look_up(data, offsets[low : high + 1])
                begins = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
                own = [batch.column(f.name).slice(low, high - low) for f in carried]
                own += [pa.array(np.arange(uid, uid + len(n))), pa.array(n)]
                lists = [pa.ListArray.from_arrays(begins, pa.array(v, pa.int64())) for v in (keys, counts)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, parts.T), *lists], labels)
                uid += len(n)

    looked = written(rows.mapInArrow(releasing(run), shape), "looked-up")
    # What follows starts from that table: the driver and the executors may let the weights go.
    sent.destroy()
    del frequent
    release_memory()
    left = looked.filter("size(keys) > 0").select(
        "uid", F.explode(F.arrays_zip("keys", "counts")).alias("of")
    ).select("uid", F.col("of.keys").alias("key"), F.col("of.counts").alias("n"))
    joined = (
        left.join(rest, "key")
        .groupBy(F.col("uid").alias("_uid"))
        .agg(*(F.sum(F.col("n") * F.col(f"p{i}")).alias(f"_s{i}") for i in range(PARTS)))
    )
    s = [F.col(f"s{i}") + F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(PARTS)]
    length = F.greatest(F.col("n_words"), F.lit(1))
    # Differences of sums may leave a trace below zero where the sum is zero.
    of = [s[0] / length, s[1] / length, s[2] / length, s[3] / length]
    of += [F.log1p(F.greatest(s[3], F.lit(0.0))), F.log1p(F.greatest(s[4], F.lit(0.0)))]
    return looked.join(joined, F.col("uid") == F.col("_uid"), "left").select(
        *(f"`{f.name}`" for f in carried), *(c.alias(f"x{i}") for i, c in enumerate(of))
    )


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) teach only where crc32(doc_id as text) modulo 3 is not 1
    (``held_out``). All of folds 0 and 2 is counted; the weighing of the evidence is fitted on
    at most ``sample`` documents of both, those of least hash, each by the counts of the other
    fold. A document labelled both ways counts as toxic; null labels and doc_ids teach nothing.
    A score depends on the text alone.

    Null and empty texts get the score of a text without evidence. A null doc_id is not held
    out. Without labels of both classes every score is the share of toxic labels. An empty
    table gives no rows; extra columns are ignored; repeated rows are scored each.
    """
    known = (
        own_columns(labels, "doc_id", "toxic")
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    )
    rows = own_columns(docs, "doc_id", "text")
    of_fold = fold(F.col("doc_id"))

    def labelled(some: DataFrame) -> DataFrame:
        chosen = rows.filter(of_fold.isin(*HALVES) & F.col("text").isNotNull())
        half = F.when(of_fold == HALVES[0], 0).otherwise(1).alias("half")
        return chosen.join(some, F.col("doc_id") == F.col("labelled")).select("text", "toxic", half)

    teaching = known.filter(fold(F.col("labelled")) != HELD_OUT)
    counts = count_bigrams(labelled(broadcast_if_small(teaching, LABELS_BROADCAST)))
    few = teaching.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    names = [f"x{i}" for i in range(FEATURES)]
    # At most ``sample`` label rows are broadcast.
    weighing = written(labelled(F.broadcast(few)).limit(sample), "weighing")
    seen = pd.concat(
        evidence(weighing.filter(F.col("half") == half).select("text", "toxic"), fitted(counts, 1 - half))
        .select("toxic", *names)
        .toPandas()
        for half in range(len(HALVES))
    ).sort_values([*names, "toxic"])
    judge = Logistic(seen[names].to_numpy(float).reshape(-1, FEATURES), seen["toxic"].to_numpy(float))

    marked = rows.withColumn("held_out", F.coalesce(of_fold == HELD_OUT, F.lit(False)))
    found = evidence(marked, fitted(counts, *range(len(HALVES))))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            own = [batch.column(c) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(judge.probability(x))], ["doc_id", "held_out", "score"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(judged, f"doc_id {id_type}, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )
