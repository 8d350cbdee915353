"""Small tables of awkward rows that every operator has to handle."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("lo mi ra tu ve so ka ne di po".split()) + rng.choice("abcdefgh") for _ in range(words))


LONG = prose(1, 30_000)
SHARED = prose(2, 60)


def rows() -> list[tuple]:
    texts = {
        1: prose(11, 120) + " " + SHARED + " " + prose(12, 40),
        2: SHARED + "\n" + prose(13, 90),
        3: None,
        4: "",
        5: " \t\n ",
        6: "word",
        7: "Été Σίγμα İ <|endoftext|> naïve 日本語 😀  two  spaces\x1c\x85end",
        8: LONG,
        9: prose(11, 120) + " " + SHARED + " " + prose(12, 40),
        10: prose(14, 12),
        11: prose(14, 13),
        12: prose(14, 14),
        13: "a b " * 40,
        14: "a b " * 40 + "tail",
        20: LONG[: len(LONG) // 2] + " and an end of its own",
    }
    out = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in texts.items()]
    out.append((None, prose(11, 120), None, None, None))
    out.append((None, None, None, None, None))
    out.append(out[0])  # a repeated row
    out.append((2, "another text with an id seen before", "fr", None, 1))
    return out


def awkward(spark: SparkSession) -> DataFrame:
    """With extra columns whose names operators might use themselves."""
    frame = spark.createDataFrame(rows(), SHAPE).repartition(3)
    return frame.selectExpr("*", "1 AS part", "'x' AS `_own`", "2 AS shard", "3 AS rest", "4 AS `a.b`", "5 AS rep", "6 AS piece")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SHAPE)
