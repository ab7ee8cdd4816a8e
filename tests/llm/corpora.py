"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz Zé ñu 漢字 the of, and. In".split()) + rng.choice(["", "a", "e", "is"]) for _ in range(n))


def texts(seed: int = 0) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): copies, near copies, shared passages, very long, empty and null ones, repeated rows, a null id."""
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 80)
    near = base.split()
    near[60] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper().replace("É", "é").replace("Ñ", "ñ")), (5, ""), (6, None), (7, " \t\n "), (8, "one two"), (9, "one two"), (10, "One TWO"),
        (11, words(rng, 50) + " " + passage + " " + words(rng, 40)), (12, words(rng, 30) + " " + passage), (13, "a" * 700), (14, words(rng, 6_000)), (15, passage), (15, passage),
        (None, words(rng, 60)), (None, base), (17, "<|endoftext|> it's 12½ 　x\x1cy | a|b"), (18, "ab " * 300),
    ]
    return rows + [(20 + i, words(rng, rng.randint(1, 90))) for i in range(30)]


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def with_clashes(df: DataFrame) -> DataFrame:
    """The table with columns called like the operators' own."""
    from pyspark.sql import functions as F

    names = ("ids", "score", "shard", "slot", "row", "node", "chunk", "text_crc32", "kept", "component_id", "held_out", "start", "length", "cell", "e", "digest")
    return df.select("*", *(F.lit("x").alias(n) for n in names))


def key(value: object) -> tuple:
    return (value is not None, value)
