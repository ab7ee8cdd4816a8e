"""Joining overlapping extracts and sampling whole customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_extracts(first: DataFrame, second: DataFrame, ts: str, cut: str) -> DataFrame:
    """The first extract and the second from ``cut`` on, so the overlap is counted once."""
    return first.unionByName(second.filter(F.col(ts) >= F.lit(cut).cast("timestamp_ntz")))


def sample_customers(df: DataFrame, fraction: float, customer: str, invoice: str, keep: list[str] | None = None,
                     key: str | None = None, seed: int = 0) -> DataFrame:
    """All rows of a fraction of the customers, nameless rows by invoice, and every row of the listed keys.

    The choice is a seeded digest of the entity, so it is the same on every run and in every engine, and needs no shuffle.
    """
    entity = F.coalesce(F.concat(F.lit("c:"), F.col(customer)), F.concat(F.lit("i:"), F.col(invoice)))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), entity)), 1, 12), 16, 10).cast("long")
    chosen = place % 1_000_000 < int(fraction * 1_000_000)
    if keep and key:
        chosen = chosen | F.col(key).isin(*keep)
    return df.filter(F.coalesce(chosen, F.lit(False)))
