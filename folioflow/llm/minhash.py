"""Near-duplicate documents by b-bit MinHash, with links confirmed on the full sets.

Each document's set of word shingles gives 240 minima. Bands of six minima make candidate
groups; the two low bits of every minimum, packed into a signature, estimate the similarity of
candidates by bit counts, corrected for chance collisions. What may reach the threshold is
compared on the whole texts. Copies (equal sets) are one class from the start. In a candidate
group everyone meets the smallest member first. Where that leaves more than one component the
group is dealt into tiles, and each two tiles are compared in one task, which returns only the
links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.components import components
from folioflow.llm.tables import own_columns, releasing, written
from folioflow.llm.wordhash import Words, mix, row_blocks, text_bytes

ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
BITS = 2
LONGS = -(-HASHES * BITS // 64)
MARGIN = 0.13  # over four standard deviations of the estimate at a similarity of 0.8
TILE = 1024  # members of a candidate group that meet in one task, and bytes of their sets
TILE_BYTES = 32 << 20

_rng = np.random.Generator(np.random.PCG64(411))
_TIMES = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    row, _, hashes = words.windows(width, whole_if_shorter=True)
    edges = np.searchsorted(row, np.arange(len(words.first)))
    return [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed b-bit signatures and band keys of non-empty sets."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    # Equal sets are found by whole hashes; minima need 32 bits.
    short = (flat >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((HASHES, len(sets)), np.uint32)
    spread = np.empty_like(short)
    for k in range(HASHES):
        np.bitwise_xor(short, _FLIP[k], out=spread)
        np.multiply(spread, _TIMES[k], out=spread)
        minima[k] = np.minimum.reduceat(spread, begins)
    bits = np.zeros((len(sets), LONGS * 64), np.uint8)
    low = minima.T & np.uint32((1 << BITS) - 1)
    for b in range(BITS):
        bits[:, b : HASHES * BITS : BITS] = (low >> np.uint32(b)) & 1
    packed = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    by_band = minima.T.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    keys = mix((by_band * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return packed, keys.view(np.int64)


_SIGNED = "text_hash long, n_shingles long, key1 long, key2 long, sig array<long>, bands array<long>"


def _sign(width: int):
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in row_blocks(offsets):
                sets = shingle_sets(Words(data, offsets[low : high + 1], lower=True), width)
                n = np.array([len(s) for s in sets], np.int64)
                key1, key2 = (
                    np.array([int(f(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                    for f in (mix, lambda s: mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                )
                sig, bands = [None] * len(sets), [None] * len(sets)
                full = np.flatnonzero(n)
                if len(full):
                    packed, keys = signatures([sets[i] for i in full])
                    for at, i in enumerate(full):
                        sig[i], bands[i] = packed[at], keys[at]
                own = [batch.column(c).slice(low, high - low) for c in ("doc_id", "text_hash")]
                columns = [*own, *map(pa.array, (n, key1, key2)), pa.array(sig, lists), pa.array(bands, lists)]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "text_hash", "n_shingles", "key1", "key2", "sig", "bands"]
                )

    return run


def _verify(width: int, percent: int):
    """Which pairs of texts have sets of at least the asked similarity."""

    def shingles(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return shingle_sets(Words(raw, np.array([0, len(raw)]), lower=True), width)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = lru_cache(maxsize=64)(shingles)
        for batch in batches:
            linked = []
            for text_a, text_b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                a, b = set_of(text_a.as_py()), set_of(text_b.as_py())
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
            )

    return run


def _sets(width: int):
    """Shingle set of each text, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for low, high in row_blocks(offsets):
                sets = shingle_sets(Words(data, offsets[low : high + 1], lower=True), width)
                packed = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), packed], ["rep", "shingles"]
                )

    return run


def _most_differing(percent: int) -> int:
    """Differing symbols up to which two signatures may belong to sets of the asked similarity."""
    chance = 1 / (1 << BITS)
    return int(HASHES * (1 - (chance + (1 - chance) * max(0.0, percent / 100 - MARGIN))))


def _differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Symbols in which signatures differ."""
    x = one ^ others
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)


def _spanning(percent: int):
    """Links between components in a group of members, no more than it takes to join them.

    Members outside the largest component look for links to others. The signatures say which
    may be alike; these are compared by counting shared shingles of the whole sets.
    """
    most = _most_differing(percent)

    def run(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        reps = rows.column("rep").combine_chunks()
        tile = rows.column("tile").to_numpy()
        across = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        label = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
        signature = rows.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, LONGS)
        sets = [np.frombuffer(s.as_buffer(), "<u8") for s in rows.column("shingles")]
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(n), size)[order]
        known, begins = np.unique(flat[order], return_index=True)
        begins = np.append(begins, len(flat))
        links: list[tuple[int, int]] = []
        largest = np.bincount(label).argmax()
        for x in np.flatnonzero(label != largest).tolist():
            able = (label != label[x]) & (np.minimum(size, size[x]) * 100 >= np.maximum(size, size[x]) * percent)
            if across:
                able &= tile != tile[x]
            able = np.flatnonzero(able)
            able = able[_differing(signature[x], signature[able]) <= most]
            if not len(able):
                continue
            at = np.searchsorted(known, sets[x])
            holders = np.concatenate([owner[a:z] for a, z in zip(begins[at], begins[at + 1], strict=True)])
            common = np.bincount(holders, minlength=n)[able]
            found = able[100 * common >= percent * (size[x] + size[able] - common)]
            for y in found[np.unique(label[found], return_index=True)[1]].tolist():
                links.append((x, y))
                label[label == label[y]] = label[x]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        a, b = (reps.take(pa.array(side)) for side in pairs.T)
        return pa.table([pc.min_element_wise(a, b), pc.max_element_wise(a, b)], names=["a", "b"])

    return run


def estimate(differing: int) -> float:
    """Similarity by the number of differing symbols, corrected for chance collisions."""
    chance = 1 / (1 << BITS)
    return ((1 - differing / HASHES) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicates in ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set holds its
    distinct ``width``-word shingles, or its whole sequence if it has fewer words. Documents
    whose sets share at least ``percent`` % of their union are linked; ``component_id`` is the
    smallest doc_id reachable, and ``kept`` marks it. One row per input row.

    Null and empty texts have no shingles and no links. Rows with a null doc_id have none
    either: their component_id is null, kept is false. Texts that have the same smallest doc_id
    count as one document; one that has it and also belongs to a smaller doc_id is not linked
    with the others by it. Extra columns are ignored; an empty table gives no rows.

    Sets are compared by 64-bit shingle hashes and, for copies, by two 64-bit sums of them.
    Links below the threshold by more than the margin of the estimate are never tested; a
    link at exactly 0.8 escapes all bands with a chance of 5 in a million.
    """
    return _judged(docs, width, percent).drop("text_hash")


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text."""
    rows = own_columns(docs, "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    signed = written(hashed.mapInArrow(releasing(_sign(width)), f"doc_id {id_type}, {_SIGNED}"), "signed")
    able = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(
        able.groupBy("key1", "key2").agg(
            F.min("doc_id").alias("rep"),
            *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")),
        ),
        "classes",
    )
    component = _components_of(rows, classes, width, percent)
    named = classes.join(component, F.col("rep") == F.col("node"), "left").select(
        F.col("key1").alias("_key1"), F.col("key2").alias("_key2"), F.coalesce("component", "rep").alias("found")
    )
    named = written(named, "named")
    # Rows without links need no class; the others look up theirs, hot classes split at run time.
    linked = (
        able.select("doc_id", "text_hash", "n_shingles", "key1", "key2")
        .join(named, (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")))
        .select("doc_id", "text_hash", "n_shingles", F.col("found").alias("component_id"))
    )
    alone = signed.filter("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def _components_of(rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component of the classes that are linked to others."""
    bands = classes.select("rep", F.explode("bands").alias("band"))
    groups = written(
        bands.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub < top"), "groups"
    ).select("band", "hub")
    members = written(bands.join(groups, "band"), "members")  # band, rep, hub
    slim = classes.select("rep", "n_shingles", "sig")
    texts = written(
        rows.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidates"
    )

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        one, other = (
            texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")).filter(f"text_{k} IS NOT NULL")
            for k in ("a", "b")
        )
        tested = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
        shape = "a {0}, b {0}, linked boolean".format(pairs.schema["a"].dataType.simpleString())
        return written(tested.mapInArrow(releasing(_verify(width, percent)), shape), label)

    # Everyone meets the likeliest of the smallest members of its groups.
    stars = members.filter("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("shared"))
    likeliest = (
        stars.groupBy("rep").agg(F.max(F.struct(F.col("shared"), (-F.col("hub")).alias("hub"))).alias("best"))
    ).select(F.least("rep", -F.col("best.hub")).alias("a"), F.greatest("rep", -F.col("best.hub")).alias("b"))
    tested = verified(likeliest.distinct(), "verified")
    tested = tested.filter("linked").select("a", "b")
    labels = written(components(tested), "labels")
    # Candidates in different components, from the groups in which more than one is left.
    placed = members.join(labels, F.col("rep") == F.col("node"), "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    mixed = written(
        placed.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high"),
        "mixed",
    ).select("band")
    open_members = written(placed.join(mixed, "band"), "open")
    wanted = open_members.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(
        texts.filter("text IS NOT NULL").join(wanted, "doc_id", "left_semi")
        .mapInArrow(releasing(_sets(width)), f"rep {texts.schema['doc_id'].dataType.simpleString()}, shingles binary"),
        "sets",
    )
    whole = open_members.join(slim, "rep").join(sets, "rep")
    sizes = whole.groupBy("band").agg(
        F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.octet_length("shingles").cast("long")) / TILE_BYTES)).cast("int").alias("tiles")
    )
    # Each two tiles of a group meet in one task; a group of one tile is one row per member.
    tile = F.pmod(F.xxhash64("rep", "shingles"), F.col("tiles")).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = (
        whole.join(sizes, "band")
        .withColumn("tile", tile)
        .withColumn("other", meets)
        .select(
            "band", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
            "tile", "rep", "component", "n_shingles", "sig", "shingles",
        )
    )
    id_type = classes.schema["rep"].dataType.simpleString()
    spanning = dealt.groupBy("band", "low", "high").applyInArrow(_spanning(percent), f"a {id_type}, b {id_type}")
    more = written(spanning.distinct(), "spanning")
    if not more.limit(1).count():
        return labels
    return written(components(tested.unionByName(more)), "labels")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns, one row of each near-duplicate group: the smallest doc_id.

    Rows are judged by doc_id and text: a doc_id that occurs with texts of several groups may
    stay with one and go with another. Of rows that stay with the same doc_id in the same group
    the first by text is kept. Rows without a doc_id or without shingles are linked with nothing
    and all stay.
    """
    # One row per doc_id and text, so that the join below can't multiply rows.
    judged = _judged(docs, width, percent).filter("kept")
    judged = judged.groupBy(F.col("doc_id").alias("judged"), F.col("text_hash").alias("of_text")).agg(
        F.max("n_shingles").alias("shingles")
    )
    verdicts = written(judged, "verdicts")
    # Only where several texts of a doc_id stay do texts have to be compared.
    several = verdicts.filter("shingles > 0").groupBy("judged").agg(F.count("*").alias("texts")).filter("texts > 1")
    contested = written(several.select(F.col("judged").alias("doc_id")), "contested")
    if contested.limit(1).count():
        texts = docs.select("doc_id", "text").join(contested, "doc_id", "left_semi").withColumn("hash", F.xxhash64("text"))
        meets = (F.col("doc_id") == F.col("judged")) & (F.col("hash") == F.col("of_text")) & (F.col("shingles") > 0)
        first = texts.join(verdicts, meets).groupBy(F.col("doc_id").alias("id")).agg(F.min_by("hash", "text").alias("first"))
        verdicts = verdicts.join(first, F.col("judged") == F.col("id"), "left").filter(
            "shingles = 0 OR first IS NULL OR first = of_text"
        )
    fields = [f"row.`{c}`" for c in docs.columns]
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("row")
    )
    # Equal rows meet where the join has brought them, so texts are shuffled once.
    place = F.row_number().over(W.partitionBy("id", "hash").orderBy("shingles"))
    met = rows.join(
        verdicts.select("judged", "of_text", "shingles"), (F.col("id") == F.col("judged")) & (F.col("hash") == F.col("of_text"))
    )
    stay = met.withColumn("place", place).filter("shingles = 0 OR place = 1")
    return stay.select(*fields).unionByName(rows.filter("id IS NULL").select(*fields))
