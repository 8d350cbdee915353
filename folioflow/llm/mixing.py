"""Temperature mixing of sources to target weights, with DataFrame functions alone.

Each source's share of tokens is raised to an exponent and normalised. The exponent is
bisected until the weights meet a target entropy, or until no source has to be repeated more
often than a limit. The weights are realised as budgeted block permutations: documents fall
into blocks of bounded size, every epoch of a source runs through its blocks, and the
documents of a block, in an order of its own, up to the source's budget of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.tables import written

BLOCK_TOKENS, BLOCK_DOCUMENTS = 1 << 20, 1 << 16
SALTS = 64
STEPS = 40
HIGHEST = 8.0  # exponents are sought between 0 (all sources alike) and this
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: Column) -> Column:
    """Words of a whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_tokens(counted: DataFrame) -> DataFrame:
    """source, tokens, documents from (source, tokens) rows: one partial sum per task and source."""
    return counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))


def _weight(exponent: float) -> Column:
    """The numerator of a source's weight; sources without tokens have none."""
    return F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all_tokens"), F.lit(exponent))).otherwise(0.0)


def _entropy(sources: DataFrame, exponent: float) -> float:
    w = _weight(exponent)
    log_share = F.when(F.col("tokens") > 0, F.log(F.col("tokens") / F.col("all_tokens"))).otherwise(0.0)
    row = sources.agg(F.log(F.sum(w)).alias("z"), (F.sum(w * log_share) / F.sum(w)).alias("m")).first()
    return (row["z"] or 0.0) - exponent * (row["m"] or 0.0)


def _repetition(sources: DataFrame, exponent: float, budget: int) -> float:
    """How often the most repeated source would be used."""
    w = _weight(exponent)
    row = sources.agg(F.sum(w).alias("z"), F.max(F.when(F.col("tokens") > 0, w / F.col("tokens"))).alias("m")).first()
    return budget * row["m"] / row["z"] if row["z"] else 0.0


def find_exponent(
    sources: DataFrame, budget: int, entropy: float | None = None, repetition: float | None = None
) -> float:
    """The exponent whose weights have the target ``entropy`` (in nats), or the smallest, that is
    the flattest mix, with no source used more than ``repetition`` times.

    ``sources`` has source, tokens and all_tokens. Entropy falls as the exponent grows; a
    target outside what exponents from 0 to 8 reach gives the nearer end. Repetition falls
    towards exponent 1, the sources' own shares, where every source is used as often as the
    budget holds the corpus; a limit below that is met as nearly as it can be, by 1.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either a target entropy or a repetition limit")
    low, high = 0.0, HIGHEST if entropy is not None else 1.0

    def enough(exponent: float) -> bool:
        """Whether the exponent sought is at most this one."""
        if entropy is not None:
            return _entropy(sources, exponent) <= entropy
        return _repetition(sources, exponent, budget) <= repetition * (1 + 1e-9)

    if enough(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        if enough(middle):
            high = middle
        else:
            low = middle
    return high


def _shuffled(*parts: Column | str) -> Column:
    """A reproducible pseudo-random order."""
    return F.md5(F.concat_ws("/", *parts))


def plan(
    counted: DataFrame, budget_share: float, entropy: float | None = None, repetition: float | None = None
) -> DataFrame:
    """source, tokens, documents, weight, budget (tokens) and blocks of every source.

    ``counted`` has source and tokens. The budget of all sources together is ``budget_share``
    of the corpus' tokens.
    """
    totals = written(source_tokens(counted), "sources")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    sources = totals.withColumn("all_tokens", F.lit(max(whole, 1)))
    budget = int(budget_share * whole)
    exponent = find_exponent(sources, budget, entropy, repetition)
    norm = sources.agg(F.sum(_weight(exponent))).first()[0] or 1.0
    weight = _weight(exponent) / norm
    blocks = F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("documents") / BLOCK_DOCUMENTS))
    return written(
        sources.select(
            "source", "tokens", "documents", weight.alias("weight"), F.round(weight * budget).cast("long").alias("budget"),
            F.greatest(blocks, F.lit(1)).cast("long").alias("blocks"),
        ),
        "mix",
    )


def _realised(rows: DataFrame, mix: DataFrame, seed: str) -> DataFrame:
    """Rows of (source, tokens, key, row) as often as their source's budget holds them.

    Adds block, epoch and position, the tokens of the source's stream before the row.
    """
    site = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    named = mix.select(site.alias("site"), "budget", "blocks", F.col("tokens").alias("epoch_tokens"))
    # Salts spread a hot source wherever Spark joins by shuffle; a small mix it broadcasts by itself.
    salted = named.select("site", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = rows.withColumn("site", site).withColumn("place", F.conv(F.substring("key", 1, 15), 16, 10).cast("long"))
    dealt = (
        keyed.withColumn("salt", (F.col("place") % SALTS).cast("int"))
        .join(salted, ["site", "salt"])
        .withColumn("block", F.pmod(F.shiftright("place", 8), F.col("blocks")))
        .drop("salt", "blocks", "place")
    )
    # Blocks of every epoch in that epoch's order; only blocks, not documents, meet by source.
    in_order = W.partitionBy("site", "epoch").orderBy(_shuffled(F.lit(seed), "epoch", "site", "block"), "block")
    epochs = F.ceil(F.col("budget") / F.greatest("epoch_tokens", F.lit(1))).cast("long")
    blocks = (
        dealt.groupBy("site", "block").agg(F.sum("tokens").alias("block_tokens"))
        .join(named.drop("blocks"), "site")
        .filter("budget > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
        .withColumn("before", F.coalesce(F.sum("block_tokens").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("start", F.col("epoch") * F.col("epoch_tokens") + F.col("before"))
        .filter("start < budget")
        .select("site", "block", "epoch", "start", "budget")
    )
    blocks = written(blocks, "epochs")
    inside = W.partitionBy("site", "block", "epoch").orderBy(_shuffled(F.lit(seed), "epoch", "key"), "key")
    earlier = F.coalesce(F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        dealt.join(blocks, ["site", "block"])
        .withColumn("position", F.col("start") + earlier)
        .filter("position < budget")
        .drop("site", "start", "budget")
    )


def _mixed(
    docs: DataFrame, carried: list[str], budget_share: float, entropy: float | None, repetition: float | None, seed: str
) -> DataFrame:
    counted = docs.select(
        F.col("source").cast("string").alias("source"), tokens_of(F.col("text")).alias("tokens"),
        F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"), F.crc32("text").cast("string"))).alias("key"),
        F.struct(*(f"`{c}`" for c in carried)).alias("row"),
    )
    return _realised(counted, plan(counted.select("source", "tokens"), budget_share, entropy, repetition), seed)


def mix(
    docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, repetition: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """The mixture: doc_id, source, tokens, epoch, block, position of every use of a document.

    ``docs`` has doc_id, text and source. Tokens are words ``[^\\x20\\x09-\\x0D]+`` of whole
    texts. Every source gets its weight's share of the budget: whole epochs over all its
    documents, and of one more those that begin within the budget, so that it is exceeded by
    less than a document. ``position`` orders a source's stream.

    A null source is a source of its own. Null and empty texts have no tokens and go where
    their place in the order puts them; a source without any tokens gets no weight. Repeated
    rows count each. An empty table gives no rows; extra columns are ignored.
    """
    used = _mixed(docs, ["doc_id"], budget_share, entropy, repetition, seed)
    return used.select("row.doc_id", "source", "tokens", "epoch", "block", "position")


def mixed_documents(
    docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, repetition: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """The rows of ``docs`` with all their columns, as often as ``mix`` uses them."""
    used = _mixed(docs, docs.columns, budget_share, entropy, repetition, seed)
    return used.select(*(f"row.`{c}`" for c in docs.columns))
