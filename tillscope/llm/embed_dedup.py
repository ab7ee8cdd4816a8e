"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative per group.

Equal vectors are first made one row with a count. Centroids are fitted by spherical k-means on a bounded sample
(``Cells.sample`` rows of smallest hash); every vector is indexed: it lives in the cell of its nearest centroid and visits
each earlier cell whose border is within a reach of it. Two linked vectors of different cells meet if the one of the later cell
visits the earlier. How far that one lies from the border is measured: for links at exactly the threshold in random directions
around sampled vectors, and for all links that ``Cells.probes`` sampled vectors really have, found by brute force against every
row. The reach covers ``Cells.hard`` of the former and ``Cells.recall`` of the latter. ``exact`` takes sqrt(2 - 2 * threshold)
instead, which no link exceeds; it visits most cells when there are many dimensions.

Cells are cut into blocks, each pair of blocks is one bounded group, and a group gives only a count per vector and a
spanning forest of its links, never the pairs. Components are then joined over all groups.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do
rows without an id; repeated rows link with each other; a vector with fewer dimensions counts as filled up with zeros; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import components, written


@dataclass(frozen=True)
class Cells:
    """Threshold of a link; rows aimed at per cell and the most cells; how near a border is visited across (none: measured); whether near enough for every link; share of sampled links and of links at the threshold that the measure covers; probed vectors; rows of a block; rows of the sample."""

    threshold: float = 0.9
    cell_rows: int = 2_048
    most_cells: int = 1_024
    reach: float | None = None
    exact: bool = False
    recall: float = 0.995
    hard: float = 0.95
    probes: int = 512
    block_rows: int = 4_096
    sample: int = 16_384
    rounds: int = 8


def fit_centroids(sample: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means: unit centroids, each the direction of the sum of the vectors nearest to it."""
    k = min(k, len(sample))
    centroids = sample[np.random.default_rng(0).choice(len(sample), k, replace=False)] if k else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if k > 1 else 0):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where(length[:, None] > 1e-12, sums / np.maximum(length, 1e-12)[:, None], centroids)
    return centroids


def _unit_rows(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _in_cells(centroids: np.ndarray, reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cell, home, node, copies, x): each vector in its own cell and in the earlier cells it visits."""
    gap = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                x = _unit_rows(part.column("e"), centroids.shape[1])
                dots = x @ centroids.T
                own = np.argmax(dots, axis=1)
                between = np.maximum(gap[own], 1e-12)
                rows, cells = np.nonzero((dots.max(axis=1)[:, None] - dots) / between <= reach)
                earlier = cells < own[rows]
                rows, cells = np.concatenate([np.arange(len(x)), rows[earlier]]), np.concatenate([own, cells[earlier]])
                nodes, copies = part.column("node").to_numpy()[rows], part.column("copies").to_numpy()[rows]
                arrays = [pa.array(cells.astype(np.int32)), pa.array(np.arange(len(rows)) < len(x)), pa.array(nodes), pa.array(copies), pa.array([x[r].tobytes() for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "home", "node", "copies", "x"])

    return run


def _needed(a: np.ndarray, b: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The reach at which each pair of unit rows meets: 0 in one cell, else how far the row of the later cell lies from the border of the earlier one."""
    dots = [x @ centroids.T for x in (a, b)]
    own = [np.argmax(d, axis=1) for d in dots]
    swap, rows = own[0] < own[1], np.arange(len(a))
    later, earlier = np.where(swap, own[1], own[0]), np.where(swap, own[0], own[1])
    there = np.where(swap[:, None], dots[1], dots[0])
    return (there[rows, later] - there[rows, earlier]) / np.maximum(np.linalg.norm(centroids[later] - centroids[earlier], axis=1), 1e-12)


_STEPS = 1_024  # steps of the measured reach between 0 and 1


def _probed(probes: np.ndarray, centroids: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(step, links): links of the probes with a task's vectors, by the reach they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.zeros(_STEPS + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                x = _unit_rows(batch.slice(at, 2_000).column("e"), centroids.shape[1])
                near = x @ probes.T >= threshold
                rows = np.flatnonzero(near.any(axis=1))
                for probe in np.flatnonzero(near.any(axis=0)):
                    mine = rows[near[rows, probe]]
                    need = _needed(x[mine], np.broadcast_to(probes[probe], x[mine].shape), centroids)
                    steps += np.bincount(np.ceil(np.minimum(need, 1.0) * _STEPS).astype(np.int64), minlength=_STEPS + 1)
        used = np.flatnonzero(steps)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(steps[used])], ["step", "links"])

    return run


def measured_reach(vectors: DataFrame, sample: np.ndarray, centroids: np.ndarray, cells: Cells) -> float:
    """The reach that covers the wanted shares of links at the threshold and of the probes' own links."""
    if len(centroids) < 2:
        return 0.0
    a, rng = sample[:4_096], np.random.default_rng(1)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    at_threshold = cells.threshold * a + np.sqrt(max(0.0, 1 - cells.threshold**2)) * side
    hard = float(np.quantile(_needed(a, at_threshold, centroids), cells.hard))
    found = vectors.select("e").mapInArrow(_probed(sample[: cells.probes], centroids, cells.threshold), "step int, links long")
    found = found.groupBy("step").agg(F.sum("links").alias("links")).orderBy("step").collect()  # at most 1,025 rows
    links = np.cumsum([r["links"] for r in found])
    own = found[int(np.searchsorted(links, cells.recall * links[-1]))]["step"] / _STEPS if found else 0.0
    return max(hard, own)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of ``a`` and ``b``, pair by pair; a set's label is its smallest."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        labels = parent[labels]


def _links(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """In one pair of blocks: per vector the vectors linked with it, counting copies, and a forest of the links."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        x = np.frombuffer(b"".join(group["x"]), dtype=np.float64).reshape(len(group), -1)
        block, home, copies = (group[c].to_numpy() for c in ("block", "home", "copies"))
        order = np.argsort(block, kind="stable")
        x, home, copies, nodes = x[order], home[order], copies[order], group["node"].to_numpy()[order]
        n, links, labels = len(x), np.zeros(len(x), np.int64), np.arange(len(x))
        same = i == j
        split = n if same else int((block == i).sum())  # rows of the first block come first
        for a in range(0, split, 1_024):
            a_end = min(a + 1_024, split)
            for b in range(a if same else split, n, 1_024):
                near = x[a:a_end] @ x[b : b + 1_024].T >= threshold
                rows, cols = np.nonzero(near)
                rows, cols = rows + a, cols + b
                good = home[rows] | home[cols]
                if same:
                    good &= rows < cols
                rows, cols = rows[good], cols[good]
                np.add.at(links, rows, copies[cols])
                np.add.at(links, cols, copies[rows])
                labels = unite(labels, rows, cols)
        some = links > 0
        return pd.DataFrame({"node": nodes[some], "root": nodes[labels[some]], "links": links[some]})

    return run


def near_duplicates(embeddings: DataFrame, cells: Cells | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    cells = cells or Cells()
    e = F.transform("embedding", lambda c: c.cast("double"))
    usable = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
              & F.exists("embedding", lambda c: c != 0))
    rows = embeddings.select("vec_id", F.when(usable, e).alias("e"))
    classes = rows.where("e is not null").groupBy("e").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("e"))).first()
    width = width or 1
    size = max(1, min(cells.sample, (32 << 20) // (8 * width)))
    sample = [r["e"] for r in classes.select("e", F.xxhash64("first").alias("h")).orderBy("h", "e").limit(size).collect()]
    unit = _unit_rows(pa.array(sample, pa.list_(pa.float64())), width) if sample else np.zeros((0, width))
    centroids = fit_centroids(unit, max(1, min(cells.most_cells, n // cells.cell_rows)), cells.rounds)

    if cells.exact:
        reach = float(np.sqrt(max(0.0, 2 - 2 * cells.threshold))) + 1e-9
    else:
        reach = measured_reach(classes, unit, centroids, cells) if cells.reach is None else cells.reach
    placed = classes.select("node", "copies", "e").mapInArrow(_in_cells(centroids, reach), "cell int, home boolean, node long, copies long, x binary")
    placed = written(placed, "cells")
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / cells.block_rows).cast("int").alias("blocks"))
    # One row per cell, at most ``most_cells`` of them.
    placed = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = placed.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "node", "copies", "x")
    found = written(paired.groupBy("cell", "i", "j").applyInPandas(_links(cells.threshold), "node long, root long, links long"), "links")

    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(linked, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("e", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Rows without a usable vector stay out of the join, so that they do not meet on one key.
    used = rows.where("e is not null").join(named, "e").select("vec_id", "n_links", "component_id")
    unused = embeddings.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return used.unionByName(unused).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
