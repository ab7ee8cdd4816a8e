"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are cut into ``lists`` slices; for a query, each slice ranks the candidates by its partial score, and
a candidate's score is the sum of its partial scores. Candidates are dealt into chunks, queries into blocks, and each
(block, chunk) pair is one bounded group.

1. Gather: each group reports the exact scores of the heads of its local lists; the k-th best of all of them is a score
   that k candidates are known to reach.
2. Cut off: a candidate that reaches it has at least one partial score of a ``lists``-th of it, so every group collects the
   entries at or above that share in any list, and no others can matter.
3. Resolve: the remaining scores of the collected entries are added up; those at or above the cutoff are ranked, at most
   k leave a group, and the final ranking reads only these.

The cutoff travels with its query, so nothing is broadcast and nothing but counts reaches the driver.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a
vector with fewer dimensions counts as filled up with zeros; rows with the query's own id are not its candidates; repeated
rows are candidates each; a query row repeated as it is counts once; extra columns are ignored. Scores are exact while
they fit a long, beyond which they stay at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """k, number of lists, rows of a chunk of candidates, rows of a block of queries."""

    k: int = 20
    lists: int = 4
    chunk_rows: int = 16_384
    block_rows: int = 1_024


PART_ROWS = 2_048  # candidates multiplied at once in a group


def scaled(df: DataFrame, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): the valid vectors with floor(scale * x) for each component."""
    x = F.col(embedding)
    valid = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(valid).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros; as doubles where their products add up exactly, else as Python's own whole numbers."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if not out.size or np.abs(out).max() ** 2 * width < 2.0**53:
        return out
    exact = np.zeros((len(vectors), width), dtype=object)
    for i, v in enumerate(vectors):
        exact[i, : len(v)] = [int(c) for c in v]
    return exact


def _partial_scores(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """A matrix of queries by candidates for each list."""
    if q.dtype != x.dtype or (q.dtype != object and q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2.0**53):
        q, x = ([[int(c) for c in row] for row in m] for m in (q, x))
        q, x = np.array(q, dtype=object), np.array(x, dtype=object)
    return [q[:, part] @ x[:, part].T for part in np.array_split(np.arange(q.shape[1]), lists)]


def _parts(queries: pd.DataFrame, candidates: pd.DataFrame, lists: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """For each part of the candidates: their ids, the lists' partial scores, and which entries are not a query with itself."""
    width = max(map(len, [*queries["v"], *candidates["v"]]), default=0)
    q = _matrix(queries["v"], width)
    for at in range(0, len(candidates), PART_ROWS):
        part = candidates.iloc[at : at + PART_ROWS]
        ids = part["id"].to_numpy()
        yield ids, _partial_scores(q, _matrix(part["v"], width), lists), queries["id"].to_numpy()[:, None] != ids[None, :]


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


def _heads(k: int, lists: int):  # noqa: ANN202
    """Phase 1 in one group: per query, the best scores among the heads of the local lists."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, partial, allowed in _parts(queries, candidates, lists):
            head = np.zeros(allowed.shape, dtype=bool)
            for p in partial:
                n = min(k + 1, len(ids))
                np.put_along_axis(head, np.argpartition(-p, n - 1, axis=1)[:, :n], True, axis=1)
            rows, cols = np.nonzero(head & allowed)
            found.append((rows, _longs(sum(p[rows, cols] for p in partial))))
        rows, scores = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        keep = _first_per_row(rows, np.lexsort((-scores, rows)), k)
        return pd.DataFrame({"q": queries["q"].to_numpy()[rows[keep]], "score": scores[keep]})

    return run


def _first_per_row(rows: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The first k of each row in an order that sorts by row."""
    ranked = rows[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    place = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.r_[starts, len(ranked)]))
    return order[place < k]


def _resolve(k: int, lists: int):  # noqa: ANN202
    """Phases 2 and 3 in one group: collect what the cutoff lets through, add it up, keep what can be among the first k."""

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        cut = queries["cutoff"].to_numpy(dtype=np.float64)
        cut = np.where(np.isnan(cut), -np.inf, cut)[:, None]
        # A double of a long may be rounded up; one step down keeps the cutoff safe.
        cut = np.where(np.abs(cut) > 2.0**52, np.nextafter(cut, -np.inf), cut)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for ids, partial, allowed in _parts(queries, candidates, lists):
            collected = np.zeros(allowed.shape, dtype=bool)
            for p in partial:
                collected |= (p * lists >= cut).astype(bool)
            rows, cols = np.nonzero(collected & allowed)
            scores = _longs(sum(p[rows, cols] for p in partial))
            reach = scores >= cut[rows, 0]
            rows, cols, scores = rows[reach], ids[cols[reach]], scores[reach]
            first = _first_per_row(rows, np.lexsort((cols, -scores, rows)), k)
            kept.append((rows[first], cols[first], scores[first]))
        rows, ids, scores = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 3
        first = _first_per_row(rows, np.lexsort((ids, -scores, rows)), k)
        return pd.DataFrame({"q": queries["q"].to_numpy()[rows[first]], "query_id": queries["id"].to_numpy()[rows[first]], "vec_id": ids[first], "score": scores[first]})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, search: Search | None = None) -> DataFrame:
    """The k best candidates of each query: query_id, rank, vec_id, score. Both sides are (id long, v array of long)."""
    search = search or Search()
    chunks = -(-candidates.count() // search.chunk_rows) or 1
    # Hashing deals groups unevenly; a few more of them keep the largest near the set size.
    chunks += chunks // 8
    queries = queries.distinct().withColumn("q", F.xxhash64("id", "v"))
    blocks = -(-queries.count() // search.block_rows) or 1
    blocks += blocks // 8
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # New names for the columns: both sides may stem from one table.
    right = candidates.select(F.col("id").alias("id"), F.col("v").alias("v"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("c"), every(blocks, "b"))

    def pairs(left: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
        left = left.select("*", F.pmod("q", F.lit(blocks)).cast("int").alias("b"), every(chunks, "c"))
        return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(run, schema)

    heads = pairs(queries, _heads(search.k, search.lists), "q long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    cutoffs = heads.select("q", "score", place.alias("place")).where(F.col("place") <= search.k)
    cutoffs = cutoffs.groupBy("q").agg(F.when(F.count("*") == search.k, F.min("score")).alias("cutoff"))
    resolved = pairs(queries.join(cutoffs, "q", "left"), _resolve(search.k, search.lists), "q long, query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return resolved.select("query_id", best.alias("rank"), "vec_id", "score").where(F.col("rank") <= search.k)


def every_twentieth(embeddings: DataFrame, search: Search | None = None) -> DataFrame:
    """The search of all rows whose id is divisible by 20 against all rows."""
    vectors = scaled(embeddings)
    return top_k(vectors.where("id % 20 = 0"), vectors, search)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) WHERE rank <= 20
"""
