"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A key descends from regions over racks to shards. On each level every child draws a number from the key and the child's
name, ``-ln(u) / weight``; the smallest draw wins, so children win in proportion to their weights, and a changed weight
moves only keys that enter or leave that child. A shard added as a region of its own therefore takes keys only into itself.

Slots number a shard's rows without gaps and without one big sort: equal rows are counted first, each shard is split into
``2 ** BUCKET_BITS`` buckets by hash, bucket totals give each bucket its first slot, and rows are ranked in their bucket.

Defined results: a null key is a key like any other; a null text has 0 bytes and checksum 0; repeated rows get a slot each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import written

BUCKET_BITS = 14


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: where it hangs and how much it should hold."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Equal shards, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return [Shard(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def grown_tree(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own: no subtree that was there changes its weight."""
    return [*tree, Shard(1 + max(s.region for s in tree), 1 + max(s.rack for s in tree), 1 + max(s.shard for s in tree), weight)]


def _winner(key: Column, level: str, children: Column) -> Column:
    """The child (name, weight, place) with the smallest draw."""
    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["name"]), 12)
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(2.0**52)) / child["weight"]).alias("draw"), child["name"].alias("name"), child["place"].alias("place"))

    return F.array_min(F.transform(children, draw))


def _children(rows: list[tuple[int, float, int]]) -> Column:
    """Children of one node as an array of (name, weight, place of its own children)."""
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(p).alias("place")) for n, w, p in rows))


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key. Shards without weight get nothing."""
    live = [s for s in tree if s.weight > 0]
    regions = sorted({s.region for s in live})
    racks = sorted({(s.region, s.rack) for s in live})
    weigh = lambda **of: sum(s.weight for s in live if all(getattr(s, k) == v for k, v in of.items()))
    top = _children([(r, weigh(region=r), i + 1) for i, r in enumerate(regions)])
    middle = F.array(*(_children([(k, weigh(region=r, rack=k), 1 + racks.index((r, k))) for q, k in racks if q == r]) for r in regions))
    leaves = F.array(*(_children([(s.shard, s.weight, 0) for s in live if (s.region, s.rack) == rk]) for rk in racks))
    region = _winner(key, "region", top)
    rack = _winner(key, "rack", F.element_at(middle, region["place"]))
    return _winner(key, "shard", F.element_at(leaves, rack["place"]))["name"]


def with_shards(df: DataFrame, key: str, tree: list[Shard], into: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; every other column passes through. No shuffle."""
    return df.withColumn(into, place(F.col(key), tree))


def with_slots(df: DataFrame, shard: str, *columns: str) -> DataFrame:
    """``shard`` and ``columns`` of each row with its slot: gapless from 0 in its shard."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(1 << BUCKET_BITS)).alias("__bucket")
    counted = written(df.groupBy(shard, *columns).agg(F.count("*").alias("__n")).select("*", bucket), "slots")
    totals = counted.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__all"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(shard, "__bucket", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.join(starts, [shard, "__bucket"]).withColumn("__first", F.col("__start") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return ranked.select(shard, *columns, F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1)).alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    tree = balanced_tree(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = with_slots(with_shards(sized, "doc_id", tree), "shard", "doc_id", "size", "text_crc32")
    return placed.withColumn("law", F.lit("key")).withColumn("grown_shard", place(F.col("doc_id"), grown_tree(tree)))
