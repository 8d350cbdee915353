"""Joins hidden in the loops of a document pipeline."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import content_hash
from folioflow.operators.scale import each, join_same

SUBSET_SIZE = 8  # citations of a set that is counted by its subsets


def new_only(src: DataFrame, stored: DataFrame, text: str = "text", doc_hash: str = "doc_hash") -> DataFrame:
    """Source rows whose content hash is not stored yet; ``stored`` has a hash column.

    A null text has a null hash; one that is stored already is not new either.
    """
    known = stored.select(F.col(doc_hash).alias("_known"))
    return src.withColumn(doc_hash, content_hash(text)).join(
        known, F.col(doc_hash).eqNullSafe(F.col("_known")), "left_anti"
    )


def visible_scopes(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Which (lob, state) of the chunks each distinct claim scope may see.

    "general" and "all" match everything, on either side. Both inputs shrink to their
    distinct scopes first; wildcards become join keys, so the match is an equi join and
    a pair of scopes meets only if it fits.
    """

    def keys(field: str, wildcard: str, of_claim: bool) -> Column:
        c, every, open_scope = F.col(field), F.lit("<any>"), F.lit("<wild>")
        if of_claim:
            return F.when(c == wildcard, F.array(every)).otherwise(F.array(c, open_scope))
        return F.when(c == wildcard, F.array(open_scope, every)).otherwise(F.array(c, every))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        scopes = df.select(
            F.coalesce("lob", F.lit("general")).alias("lob"),
            F.coalesce("state", F.lit("all")).alias("state"),
        ).distinct()
        claim = side == "claim"
        return (
            scopes.withColumn("_lob", F.explode(keys("lob", "general", claim)))
            .withColumn("_state", F.explode(keys("state", "all", claim)))
            .withColumnsRenamed({"lob": f"{side}_lob", "state": f"{side}_state"})
        )

    return (
        keyed(claims, "claim")
        .join(keyed(chunks, "chunk"), ["_lob", "_state"])
        .select("claim_lob", "claim_state", "chunk_lob", "chunk_state")
    )


def scoped_chunks(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks each claim scope may retrieve from; one row per chunk and claim scope.

    Callers of one scope share its rows, so the result grows with the scopes in use and
    not with the callers.
    """
    scopes = visible_scopes(claims, chunks)
    own = chunks.withColumn("chunk_lob", F.coalesce("lob", F.lit("general"))).withColumn(
        "chunk_state", F.coalesce("state", F.lit("all"))
    )
    return own.join(scopes, ["chunk_lob", "chunk_state"]).drop("chunk_lob", "chunk_state")


def eval_pairs(generated: DataFrame, reference: DataFrame, key: str = "query_id") -> DataFrame:
    return generated.join(reference, key)


def citation_integrity(
    hits: DataFrame, docs: DataFrame, key: str = "doc_id", snippet: str = "chunk_text", text: str = "text"
) -> DataFrame:
    """Whether the first 50 characters of a hit occur in the document it names."""
    source = docs.select(key, F.lower(text).alias("_source"))
    found = F.contains(F.col("_source"), F.lower(F.substring(snippet, 1, 50)))
    return (
        hits.join(source, key, "left")
        .withColumn("source_exists", F.col("_source").isNotNull())
        .withColumn("content_matches", F.coalesce(found, F.lit(False)))
        .drop("_source")
    )


def citation_sets(df: DataFrame, group: str, citations: str) -> DataFrame:
    """Distinct citation sets per group with the number of answers that have them.

    A set is the sorted array of an answer's distinct citations, of any number; answers
    that cite nothing have none.
    """
    cited = F.array_sort(F.array_distinct(F.array_compact(F.col(citations))))
    return (
        df.withColumn("citation_set", cited)
        .filter(F.size("citation_set") > 0)
        .groupBy(group, "citation_set")
        .agg(F.count("*").alias("answers"))
    )


def set_pairs(sets: DataFrame, group: str) -> DataFrame:
    """Jaccard of citation sets in a group, per pair of distinct sets that share a citation.

    ``pairs`` counts the answer pairs behind a row; equal sets pair with themselves.
    Pairs of answers sharing no citation have Jaccard 0 and make no row. Sets meet on
    (group, lowest shared citation), so a pair is made once.
    """
    keyed = sets.select(group, "citation_set", "answers", F.explode("citation_set").alias("_cited"))
    right = keyed.select(
        F.col(group).alias("_of"), F.col("_cited").alias("_other_cited"),
        F.col("citation_set").alias("other_set"), F.col("answers").alias("other_answers"),
    )
    # Arrays are ordered item by item, so each two sets meet in one direction only.
    met = keyed.join(
        right, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_cited") == F.col("_other_cited"))
    ).filter(F.col("citation_set") <= F.col("other_set"))
    return _jaccard_pairs(met, group)


def _jaccard_pairs(met: DataFrame, group: str) -> DataFrame:
    """Pairs that met under each citation they share, once, with the answer pairs behind them."""
    shared = F.array_intersect("citation_set", "other_set")
    once = met.filter(F.array_min(shared) == F.col("_cited"))
    pairs = F.when(
        F.col("citation_set") == F.col("other_set"),
        F.expr("answers * (answers - 1) div 2"),
    ).otherwise(F.col("answers") * F.col("other_answers"))
    union = F.size("citation_set") + F.size("other_set") - F.size(shared)
    return once.withColumn("pairs", pairs).filter(F.col("pairs") > 0).select(
        group, "citation_set", "other_set", "pairs", (F.size(shared) / union).alias("jaccard")
    )


def similar_sets(sets: DataFrame, group: str, at_least: float) -> DataFrame:
    """Pairs of distinct citation sets of a group with a Jaccard of at least ``at_least`` (above 0).

    Two such sets share an item among their rarest ones, so a set is only filed under its
    first ``size - ceil(at_least * size) + 1`` items, rarest first, and meets sets of fitting
    size there. A hot citation is seldom among the rarest. A pair is made once, under the
    first item the two prefixes share.
    """
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be above 0 and at most 1")
    items = sets.select(group, "citation_set", F.explode("citation_set").alias("_item"))
    counts = items.groupBy(group, "_item").agg(F.count("*").alias("_n"))
    ranked = join_same(items, counts, [group, "_item"]).groupBy(group, "citation_set").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_item"))).alias("_ranked")
    )
    # A hair is taken off before rounding up, so that no set of exactly the bound is missed.
    needed = F.ceil(F.size("_ranked") * F.lit(at_least) - F.lit(1e-9)).cast("int")
    prefix = F.slice("_ranked", 1, F.greatest(F.size("_ranked") - needed + 1, F.lit(1)))
    filed = ranked.select(group, "citation_set", prefix.alias("_prefix"))
    left = each(filed, [group, "citation_set", "_prefix"], "_prefix", "_item")
    right = left.select(
        F.col(group).alias("_of"), F.col("citation_set").alias("other_set"), F.col("_prefix").alias("_other_prefix"),
        F.col("_item").alias("_other_item"),
    )
    a, b = F.size("citation_set"), F.size("other_set")
    met = left.join(
        right,
        F.col(group).eqNullSafe(F.col("_of"))
        & (F.col("_item") == F.col("_other_item"))
        & (F.col("citation_set") < F.col("other_set"))
        & (F.least(a, b) >= F.greatest(a, b) * F.lit(at_least) - F.lit(1e-9)),
    ).filter(F.array_min(F.array_intersect("_prefix", "_other_prefix")) == F.col("_item"))
    shared = F.size(F.array_intersect("citation_set", "other_set"))
    return met.select(group, "citation_set", "other_set", (shared / (a + b - shared)).alias("jaccard")).filter(
        F.col("jaccard") >= at_least
    )


def jaccard_sums(sets: DataFrame, group: str) -> DataFrame:
    """Sum of the Jaccard over all answer pairs of each group, without making the pairs.

    Sets of at most ``SUBSET_SIZE`` citations are counted by the subsets they hold: two sets
    of sizes s and t that share n citations have C(n, r) subsets of size r in common, so the
    numbers of sets by (subset, size) give the sum by inclusion and exclusion. Rows grow with
    the sets; a hot citation only makes a count larger. Pairs with a larger set are made, if
    they share a citation.
    """
    small = sets.filter(F.size("citation_set") <= SUBSET_SIZE)
    subsets = F.expr(
        "transform(sequence(1, shiftleft(1, size(citation_set)) - 1),"
        " m -> filter(citation_set, (x, i) -> (m & shiftleft(1, i)) > 0))"
    )
    listed = small.select(group, "answers", F.size("citation_set").alias("_s"), subsets.alias("_subsets"))
    counted = (
        each(listed, [group, "answers", "_s"], "_subsets", "_subset")
        .groupBy(group, "_subset")
        .agg(*(F.sum(F.when(F.col("_s") == s, F.col("answers"))).alias(f"_c{s}") for s in range(1, SUBSET_SIZE + 1)))
    )
    # Subsets of one size together: pairs of answers with sets of sizes s and t that hold one.
    n = {s: F.coalesce(F.col(f"_c{s}"), F.lit(0)).cast("decimal(19,0)") for s in range(1, SUBSET_SIZE + 1)}
    sizes = [(s, t) for s in n for t in n if s <= t]
    behind = {(s, t): n[s] * n[t] if s < t else n[s] * (n[s] - 1) / 2 for s, t in sizes}
    moments = counted.groupBy(group, F.size("_subset").alias("_r")).agg(
        *(F.sum(behind[s, t].cast("decimal(38,0)")).alias(f"_p{s}_{t}") for s, t in sizes)
    )
    total = F.lit(0.0)
    for s, t in sizes:
        weight = F.get(F.array(*[F.lit(_subset_weight(r, s, t)) for r in range(SUBSET_SIZE + 1)]), F.col("_r"))
        total = total + F.col(f"_p{s}_{t}").cast("double") * weight
    few = moments.select(group, total.alias("_sum"))
    large = pairs_with(sets.filter(F.size("citation_set") > SUBSET_SIZE), sets, group)
    many = large.select(group, (F.col("pairs") * F.col("jaccard")).alias("_sum"))
    return few.unionByName(many).groupBy(group).agg(F.sum("_sum").alias("jaccard_sum"))


def _subset_weight(r: int, s: int, t: int) -> float:
    """What a common subset of size r adds to the Jaccard of sets of sizes s and t."""
    if r > min(s, t):
        return 0.0
    return float(sum(Fraction((-1) ** (r - n) * comb(r, n) * n, s + t - n) for n in range(1, r + 1)))


def pairs_with(some: DataFrame, sets: DataFrame, group: str) -> DataFrame:
    """Pairs of each of ``some`` sets with all of ``sets`` that share a citation, as ``set_pairs`` gives them.

    ``some`` holds the larger of the sets: where both are among them a pair is made once.
    """
    keyed = some.select(group, "citation_set", "answers", F.explode("citation_set").alias("_cited"))
    right = sets.select(
        F.col(group).alias("_of"), F.col("citation_set").alias("other_set"), F.col("answers").alias("other_answers"),
        (F.size("citation_set") > SUBSET_SIZE).alias("_both"), F.explode("citation_set").alias("_other_cited"),
    )
    return _jaccard_pairs(
        keyed.join(right, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_cited") == F.col("_other_cited"))).filter(
            ~F.col("_both") | (F.col("citation_set") <= F.col("other_set"))
        ),
        group,
    )
