"""Scores of generated answers against references, sources and citations.

``pairs`` frames hold (pair_id, reference, candidate). N-gram scores count each pair's
own n-grams in its row; only the counts travel on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import overlap_share, strip, token_set, words
from folioflow.operators.aggregates import mean_scores
from folioflow.operators.bigrams import bigram_logs
from folioflow.operators.joins import jaccard_sums
from folioflow.operators.scale import each

ROUGE_TOKEN = r"[a-z0-9]+"
# Limits of the answer check and its issue texts, in this order.
MIN_ANSWER_CHARS = 10
MIN_SIMILARITY = 0.5
MIN_DOC_OVERLAP = 0.3
ISSUES = (
    "Response too short",
    "Response not relevant to query",
    "Response not grounded in source documents",
    "No source citations found",
)
# Citation marks.
CITATION_MARK = r"\[\d+\]|\(\d+\)"
CITATION_NUMBER = r"(?:\[(?:Document\s+)?(\d+)\]|\((\d+)\))"
CITATION_RANGE = (1, 10)


# --- n-gram scores -------------------------------------------------------------------


def rouge_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(ROUGE_TOKEN), F.lit(0))


def bleu_tokens(c: Column | str) -> Column:
    """Tokens of the usual BLEU tokeniser: punctuation apart, numbers kept together."""
    c = F.regexp_replace(F.regexp_replace(c, "<skipped>", ""), "-\n", "")
    for mark, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.regexp_replace(c, mark, plain)
    c = F.concat(F.lit(" "), F.regexp_replace(c, "\n", " "), F.lit(" "))
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return words(c)


def gram_overlap(reference: Sequence[str], candidate: Sequence[str], n: int) -> tuple[int, int, int]:
    """Clipped matches of the n-grams of two token lists, and the number of n-grams of each."""
    r, c = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (reference, candidate))
    matched = sum(min(k, c[g]) for g, k in r.items() if g in c)
    return matched, max(len(reference) - n + 1, 0), max(len(candidate) - n + 1, 0)


def _ngram_counts(pairs: DataFrame, tokens, orders: Sequence[int]) -> DataFrame:
    """Rows (pair_id, n, matched, in_reference, in_candidate) with clipped matches.

    A pair's n-grams are counted where it lies; null texts have none.
    """

    @F.pandas_udf("array<struct<n:int,matched:long,in_reference:long,in_candidate:long>>")
    def counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ref, cand in batches:
            rows = []
            for r, c in zip(ref, cand, strict=True):
                r, c = (() if t is None else t.tolist() for t in (r, c))
                rows.append([(n, *gram_overlap(r, c, n)) for n in orders])
            yield pd.Series(rows)

    rows = pairs.select("pair_id", counted(tokens("reference"), tokens("candidate")).alias("_n"))
    return each(rows, ["pair_id"], "_n", "g").select("pair_id", "g.*").filter("in_reference + in_candidate > 0")


def f_measure(matched: Column, reference: Column, candidate: Column) -> Column:
    """2PR / (P + R) in one division; 0 when nothing matches."""
    return F.when(matched > 0, 2.0 * matched / (reference + candidate)).otherwise(F.lit(0.0))


def rouge_n(pairs: DataFrame, orders: Sequence[int] = (1, 2)) -> DataFrame:
    counts = _ngram_counts(pairs, rouge_tokens, orders)
    score = f_measure(F.col("matched"), F.col("in_reference"), F.col("in_candidate"))
    wide = counts.groupBy("pair_id").agg(
        *[F.max(F.when(F.col("n") == n, score)).alias(f"rouge{n}") for n in orders]
    )
    return pairs.select("pair_id").join(wide, "pair_id", "left").na.fill(0.0)


def bleu(pairs: DataFrame, max_order: int = 4) -> DataFrame:
    """Corpus BLEU: one row with precisions, lengths, brevity penalty and score."""
    orders = range(1, max_order + 1)
    counts = _ngram_counts(pairs, bleu_tokens, orders)

    def total(column: str, n: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(column))), F.lit(0))

    sums = counts.agg(
        *[total("matched", n).alias(f"m{n}") for n in orders],
        *[total("in_candidate", n).alias(f"t{n}") for n in orders],
        total("in_reference", 1).alias("reference_length"),
    )
    precision = [
        F.when(F.col(f"t{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(F.lit(0.0))
        for n in orders
    ]
    logs = sum((F.ln(p) for p in precision[1:]), F.ln(precision[0])) / max_order
    length, reference = F.col("t1"), F.col("reference_length")
    penalty = (
        F.when(length == 0, 0.0).when(length > reference, 1.0).otherwise(F.exp(1 - reference / length))
    )
    found_all = F.least(*precision, F.lit(1.0)) > 0
    return sums.select(
        *[p.alias(f"precision{n}") for n, p in zip(orders, precision, strict=True)],
        length.alias("candidate_length"),
        "reference_length",
        penalty.alias("brevity_penalty"),
        F.when(found_all, penalty * F.exp(logs)).otherwise(F.lit(0.0)).alias("bleu"),
    )


# --- row scores in Arrow batches -----------------------------------------------------


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence; a bit per position of ``a``."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for t in b:
        hit = free & where.get(t, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def lcs_positions(a: Sequence[object], b: Sequence[object]) -> set[int]:
    """Positions of ``a`` on one longest common subsequence with ``b``, the last ones that fit.

    A bit per position of ``a`` tells where a column of the table grows. Only every so many
    columns are kept, about the square root of their number; those between are made again
    when the way back comes to them.
    """
    where: dict[object, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1

    def after(free: int, t: object) -> int:
        hit = free & where.get(t, 0)
        return ((free + hit) | (free - hit)) & full

    step = max(1, isqrt(len(b)))
    kept, free = [full], full
    for j, t in enumerate(b, 1):
        free = after(free, t)
        if j % step == 0:
            kept.append(free)
    i, j, on = len(a), len(b), set()
    columns: list[int] = []
    first = None
    while i and j:
        if j // step != first:
            first = j // step
            columns = [kept[first]]
            for t in b[first * step : (first + 1) * step - 1]:
                columns.append(after(columns[-1], t))
        if a[i - 1] == b[j - 1]:
            on.add(i - 1)
            i, j = i - 1, j - 1
        elif (columns[j - first * step] >> (i - 1)) & 1:
            i -= 1
        else:
            j -= 1
    return on


def rouge_lsum_hits(reference: Sequence[Sequence[str]], candidate: Sequence[Sequence[str]]) -> int:
    """Matched tokens of the union LCS of every reference sentence, each token used once."""
    have = Counter(t for s in candidate for t in s)
    left = Counter(t for s in reference for t in s)
    known = {t: i for i, t in enumerate(have.keys() | left.keys())}
    others = [(set(s), [known[t] for t in s]) for s in candidate if len(s)]
    hits = 0
    for sentence in reference:
        if not len(sentence):
            continue
        bag, codes = set(sentence), [known[t] for t in sentence]
        on: set[int] = set()
        for other_bag, other in others:
            if not bag.isdisjoint(other_bag):
                on |= lcs_positions(codes, other)
        for i in sorted(on):
            t = sentence[i]
            if have[t] > 0 and left[t] > 0:
                hits += 1
                have[t] -= 1
                left[t] -= 1
    return hits


def word_edits(a: Sequence[str], b: Sequence[str]) -> int:
    """Word insertions, deletions and substitutions between two word lists.

    A bit per word of ``a`` holds the steps up and down of a column of the table, so a
    column costs a few operations on long integers and no table is kept.
    """
    if not len(a) or not len(b):
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, len(a) - 1
    up, down, edits = full, 0, len(a)
    for t in b:
        same = where.get(t, 0)
        level = same | down
        along = ((((same & up) + up) ^ up) | same) & full
        more, fewer = down | (full & ~(along | up)), up & along
        edits += (more >> last & 1) - (fewer >> last & 1)
        more, fewer = (more << 1 | 1) & full, fewer << 1 & full
        up, down = fewer | (full & ~(level | more)), more & level
    return edits


def meteor_score(reference: Sequence[str], candidate: Sequence[str]) -> float:
    """Exact matches only; weights 0.9, 3 and 0.5 for recall, fragmentation, penalty."""
    spots: dict[str, list[int]] = {}
    for i, t in enumerate(reference):
        spots.setdefault(t, []).append(i)
    aligned = []
    for i in range(len(candidate) - 1, -1, -1):
        if spots.get(candidate[i]):
            aligned.append((i, spots[candidate[i]].pop()))
    if not aligned:
        return 0.0
    aligned.reverse()
    m = len(aligned)
    chunks = 1 + sum(
        (i2 - i1, j2 - j1) != (1, 1)
        for (i1, j1), (i2, j2) in zip(aligned, aligned[1:], strict=False)
    )
    precision, recall = m / len(candidate), m / len(reference)
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    return mean * (1 - 0.5 * (chunks / m) ** 3)


def _f(hits: int, reference: int, candidate: int) -> float:
    return 2.0 * hits / (reference + candidate) if hits else 0.0


def rouge_l(pairs: DataFrame) -> DataFrame:
    """ROUGE-L and, with sentences at line breaks, ROUGE-Lsum."""

    def sentences(c: str) -> Column:
        lines = F.filter(F.split(F.lower(c), "\n"), lambda s: s != "")
        return F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(ROUGE_TOKEN), F.lit(0)))

    @F.pandas_udf("rougeL double, rougeLsum double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ref, cand in batches:
            whole, summed = [], []
            for r, c in zip(ref, cand, strict=True):
                r_all, c_all = [t for s in r for t in s], [t for s in c for t in s]
                sizes = len(r_all), len(c_all)
                whole.append(_f(lcs_length(r_all, c_all), *sizes))
                summed.append(_f(rouge_lsum_hits(r, c), *sizes))
            yield pd.DataFrame({"rougeL": whole, "rougeLsum": summed})

    scored = pairs.select("pair_id", score(sentences("reference"), sentences("candidate")).alias("s"))
    return scored.select("pair_id", "s.*")


def meteor(pairs: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ref, cand in batches:
            yield pd.Series([meteor_score(list(r), list(c)) for r, c in zip(ref, cand, strict=True)])

    return pairs.select(
        "pair_id",
        score(words(F.lower("reference")), words(F.lower("candidate"))).alias("meteor"),
    )


def wer_rows(pairs: DataFrame) -> DataFrame:
    """Word edits and reference length per pair."""

    @F.pandas_udf("long")
    def edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ref, cand in batches:
            yield pd.Series([word_edits(list(r), list(c)) for r, c in zip(ref, cand, strict=True)])

    ref, cand = words("reference"), words("candidate")
    return pairs.select("pair_id", edits(ref, cand).alias("edits"), F.size(ref).alias("ref_words"))


def wer(pairs: DataFrame) -> DataFrame:
    """Corpus word error rate: edits over reference words."""
    total = F.sum("ref_words")
    return wer_rows(pairs).agg(
        F.when(total > 0, F.sum("edits") / total).otherwise(F.lit(0.0)).alias("wer")
    )


# --- language model by counts --------------------------------------------------------


def ngram_perplexity(
    train: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text", k: float = 1.0
) -> DataFrame:
    """Perplexity per row under add-k bigrams of the training rows.

    Last words are counted too, so the words are the whole vocabulary. A bigram the training
    rows lack counts 0; a first word that they lack leaves a flat distribution. Words and bigrams
    are told apart by 64-bit hashes. Rows with fewer than two words are left out.
    """
    sums, vocabulary = bigram_logs(train, df, key, text, k)
    bigrams, total = F.sum("bigrams"), F.sum("total")
    # Without a vocabulary there is no distribution.
    perplexity = F.when(F.lit(vocabulary > 0), F.exp(-total / bigrams))
    return sums.groupBy(F.col("key").alias(key)).agg(bigrams.alias("bigrams"), perplexity.alias("perplexity"))


# --- grounding, citations, verdicts --------------------------------------------------


def doc_overlap(answers: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Share of an answer's words found in the texts retrieved for it.

    Only the words an answer shares with a hit travel on; hits per answer are few.
    """
    bag = answers.select(key, token_set("answer").alias("_answer"))
    shared = F.array_distinct(F.flatten(F.collect_list(F.array_intersect("_answer", token_set("chunk_text")))))
    found = (
        hits.select(key, "chunk_text").join(bag, key).groupBy(key).agg(F.size(shared).alias("_shared"))
    )
    size = F.size("_answer")
    return bag.join(found, key, "left").select(
        key,
        F.when(size > 0, F.coalesce("_shared", F.lit(0)) / size).otherwise(F.lit(0.0)).alias("doc_overlap"),
    )


def source_coverage(answers: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Per source of an answer, the share of the source's words the answer uses.

    Of several hits of one source the last one counts.
    """
    bag = answers.select(key, token_set("answer").alias("_answer"))
    # Texts travel, not their words; the function of a single item makes the words once.
    rows = hits.select(
        key, "rank", F.coalesce("source", F.lit("unknown")).alias("source"), "chunk_text"
    ).join(bag, key)
    share = F.transform(F.array(token_set("chunk_text")), lambda doc: overlap_share(doc, F.col("_answer")))[0]
    return rows.groupBy(key, "source").agg(F.max_by(share, F.col("rank")).alias("coverage"))


def has_citation(c: Column | str) -> Column:
    return F.rlike(c, F.lit(CITATION_MARK))


def citation_numbers(c: Column | str) -> Column:
    """Numbers of all citation marks, in order."""
    marks = F.regexp_extract_all(c, F.lit(r"\[Document\s+\d+\]|\[\d+\]|\(\d+\)"), F.lit(0))
    return F.transform(marks, lambda m: F.regexp_extract(m, r"(\d+)", 1).try_cast("int"))


def extract_citations(df: DataFrame, text: str = "answer") -> DataFrame:
    """Citation numbers and whether all lie within 1 to 10."""
    in_range = F.forall("citations", lambda n: F.coalesce(n.between(*CITATION_RANGE), F.lit(False)))
    return df.withColumn("citations", citation_numbers(text)).withColumn(
        "citations_valid", (F.size("citations") > 0) & in_range
    )


def answer_issues(
    answer: Column, overlap: Column, similarity: Column | None = None,
    min_chars: int = MIN_ANSWER_CHARS, min_similarity: float = MIN_SIMILARITY,
    min_overlap: float = MIN_DOC_OVERLAP,
) -> Column:
    """Issue texts of an answer in fixed order; similarity is judged only where it exists."""
    tests = (
        F.length(answer) < min_chars,
        similarity < min_similarity if similarity is not None else F.lit(False),
        overlap < min_overlap,
        ~has_citation(answer),
    )
    found = F.array(*[F.when(t, F.lit(issue)) for t, issue in zip(tests, ISSUES, strict=True)])
    return F.filter(found, lambda i: i.isNotNull())


def term_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two texts as 0/1 vectors of their terms; 0 if either has none."""
    a, b = token_set(a), token_set(b)
    norm = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(norm > 0, F.size(F.array_intersect(a, b)) / norm).otherwise(F.lit(0.0))


def validate_response(answers: DataFrame, hits: DataFrame, similarity: str | None = None) -> DataFrame:
    """Verdict, issues and grounding of each answer."""
    scored = answers.join(doc_overlap(answers, hits), "query_id")
    issues = answer_issues(
        F.col("answer"), F.col("doc_overlap"), F.col(similarity) if similarity else None
    )
    return scored.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def citation_consistency(sets: DataFrame, group: str) -> DataFrame:
    """Mean Jaccard over all answer pairs of a group that both cite something.

    ``sets`` comes from ``citation_sets``. ``jaccard_sums`` adds up the pairs without making
    them; pairs that share no citation count 0. A group without a pair gives 0.
    """
    rows = sets.groupBy(group).agg(F.sum("answers").alias("answers"))
    summed = jaccard_sums(sets, group).select(F.col(group).alias("_of"), F.col("jaccard_sum").alias("_sum"))
    pairs = F.col("answers") * (F.col("answers") - 1) / 2
    mean = F.when(pairs > 0, F.coalesce("_sum", F.lit(0.0)) / pairs).otherwise(F.lit(0.0))
    return rows.join(summed, F.col(group).eqNullSafe(F.col("_of")), "left").select(
        group, "answers", mean.alias("consistency")
    )


def refused_questions(hits: DataFrame) -> DataFrame:
    """Questions that ``generate_citations`` refuses: query_id and error, one row each."""
    blank = F.col("question").isNull() | (strip("question") == "")
    return hits.filter(blank).select("query_id").distinct().withColumn("error", F.lit("Query cannot be empty"))


def generate_citations(
    hits: DataFrame, limit: int | None = 5, merge_similar: bool = False, lead_words: int = 3
) -> DataFrame:
    """Citation rows per question: skip empty texts, merge equal openings, keep the first.

    ``hits`` holds (query_id, question, rank, source, chunk_text). Empty questions get no
    citations; ``refused_questions`` lists them.
    """
    if limit is not None and limit < 0:
        raise ValueError("Limit must be a non-negative integer")
    rows = hits.filter((strip("question") != "") & (F.col("chunk_text") != ""))
    if merge_similar:
        lead = F.array_join(F.slice(words(F.lower("chunk_text")), 1, lead_words), " ")
        first = W.partitionBy("query_id", "_lead").orderBy("rank")
        rows = (
            rows.withColumn("_lead", lead)
            .withColumn("_n", F.row_number().over(first))
            .filter(F.col("_n") == 1)
            .drop("_lead", "_n")
        )
    order = W.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("citation_no", F.row_number().over(order))
    if limit is not None:
        rows = rows.filter(F.col("citation_no") <= limit)
    return rows.select(
        "query_id", F.col("question").alias("query"), "citation_no",
        F.format_string("[%d]", "citation_no").alias("citation"),
        F.col("chunk_text").alias("text"), "source",
        F.create_map(F.lit("source"), "source").alias("metadata"),
    )


# --- everything at once --------------------------------------------------------------

ROW_SCORES = ("rouge1", "rouge2", "rougeL", "rougeLsum", "meteor", "wer", "perplexity")


def evaluate(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """All row scores per pair; the language model comes from ``train`` (doc_id, text).

    An answer of fewer than two words has no bigram, so its perplexity is null.
    """
    edits = wer_rows(pairs).select(
        "pair_id",
        F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")).otherwise(F.lit(0.0)).alias("wer"),
    )
    named = pairs.select(F.col("pair_id").alias("doc_id"), F.col("candidate").alias("text"))
    fluency = ngram_perplexity(train, named).select(F.col("doc_id").alias("pair_id"), "perplexity")
    return (
        rouge_n(pairs)
        .join(rouge_l(pairs), "pair_id")
        .join(meteor(pairs), "pair_id")
        .join(edits, "pair_id")
        .join(fluency, "pair_id", "left")
    )


def evaluate_batch(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """Means of all row scores and corpus BLEU, in one row."""
    means = mean_scores(evaluate(pairs, train), ROW_SCORES)
    return means.withColumn("bleu", bleu(pairs).select("bleu").scalar())
