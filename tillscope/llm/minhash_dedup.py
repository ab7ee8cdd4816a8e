"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``keys`` keys are made, each key from ``per_key`` minhashes; every pair of one key from either
collection is the key of a table, so ``keys ** 2`` tables cost ``2 * keys * per_key`` minhashes, about the square root of
what they would cost one by one. Documents of similarity 0.75 miss each other in all tables about three times in ten
thousand, more similar ones far less.

Documents with equal shingle sets become one node first. Keys nobody else has are dropped before they are paired, so pairs
are formed only where both halves are shared. Candidates are then verified on the full sets, in two steps:

1. In each table a member drawn by hash is compared with the others; of all it meets, a node verifies the one it shares
   most tables with. Verified links give components.
2. Tables that still hold several components are joined into groups, groups are cut into blocks, and each pair of blocks
   compares its nodes of different components: the minhashes first, then the full sets of the nodes that come near another
   component, whose texts alone are sent. Blocks of one large component do not meet. This is exact for every candidate
   the tables produce: nothing is capped, and only links that join components leave a task.

Defined results: null and empty texts and texts of white space have no shingle and link with nothing; repeated rows are
in one component; a null id is never a component's id: such a row is kept only if nothing in its component has an id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import components, free_names, mixed, small_batches, texts_of, written
from tillscope.llm.shingles import alike, shingle_sets, slices
from tillscope.llm.words import forget


@dataclass(frozen=True)
class Tensor:
    """Words of a shingle, percent of similarity from which documents link, minhashes of a key, keys of a collection, nodes of a block."""

    width: int = 5
    percent: int = 75
    per_key: int = 3
    keys: int = 16
    block: int = 512

    @property
    def hashes(self) -> int:
        return 2 * self.keys * self.per_key

    @property
    def slack(self) -> float:
        """Six standard deviations below the threshold: pairs whose minhashes agree less are not verified."""
        s = self.percent / 100
        return s - 6 * (s * (1 - s) / self.hashes) ** 0.5


def minhashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """16 bits of each of ``n`` minhashes for each set; sets follow one another, none is empty."""
    multipliers = np.random.default_rng(4).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), n), dtype=np.uint16)
    for k, m in enumerate(multipliers):
        least = np.minimum.reduceat(hashes * m, starts)
        out[:, k] = (mixed(least) >> np.uint64(20)).astype(np.uint16)
    return out


def _sketch(tensor: Tensor):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for first, last in slices(texts):
                hashes, counts = shingle_sets(texts[first:last], tensor.width)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                sums, sketches = np.zeros((2, len(counts)), dtype=np.uint64), [b""] * len(counts)
                if len(some):
                    sums[0, some] = np.add.reduceat(mixed(hashes), starts)
                    sums[1, some] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    for i, sketch in zip(some, minhashes(hashes, counts[some], tensor.hashes), strict=True):
                        sketches[i] = sketch.tobytes()
                part = batch.slice(first, last - first)
                arrays = [part.column("doc_id"), part.column("row"), pa.array(counts.astype(np.int64)), *(pa.array(s.view(np.int64)) for s in sums), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n_shingles", "set1", "set2", "sketch"])

    return run


def _keys(tensor: Tensor):  # noqa: ANN202
    """(node, side, key): the keys of both collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_side = tensor.keys * tensor.per_key
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, tensor.hashes).astype(np.uint64)
            for side in (0, 1):
                parts = sketch[:, side * per_side : (side + 1) * per_side].reshape(-1, tensor.keys, tensor.per_key)
                key = np.broadcast_to(np.arange(tensor.keys, dtype=np.uint64), parts.shape[:2]).copy()
                for k in range(tensor.per_key):
                    key = key << np.uint64(16) | parts[:, :, k] if tensor.per_key <= 3 else mixed(key * np.uint64(65_537) + parts[:, :, k])
                nodes = np.repeat(batch.column("node").to_numpy(), tensor.keys)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.full(len(nodes), side == 0)), pa.array(key.ravel().view(np.int64))], ["node", "side", "key"])

    return run


def _verified(tensor: Tensor):  # noqa: ANN202
    """The pairs (a, b) whose texts' sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = texts_of(batch.column("text_a")), texts_of(batch.column("text_b"))
            good = []
            for first, last in slices([a + b for a, b in zip(left, right, strict=True)]):
                sets = [np.split(h, np.cumsum(c)[:-1]) for h, c in (shingle_sets(t[first:last], tensor.width) for t in (left, right))]
                good += [alike(a, b, tensor.percent) for a, b in zip(*sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _grids(tensor: Tensor, group: pd.DataFrame, i: int, j: int) -> tuple[tuple[pd.DataFrame, pd.DataFrame], list[np.ndarray], list[np.ndarray]]:
    """The rows, minhashes and components of either block of a pair; a block may be empty."""
    sides = tuple(group[group["block"] == b] for b in (i, j))
    return sides, [np.frombuffer(b"".join(g["sketch"]), dtype=np.uint16).reshape(len(g), tensor.hashes) for g in sides], [g["label"].to_numpy() for g in sides]


def _near(tensor: Tensor):  # noqa: ANN202
    """The rows of one pair of blocks whose minhashes come near to those of another component: only their texts are needed."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sides, grids, labels = _grids(tensor, group, *key[1:])
        meets = [np.zeros(len(g), dtype=bool) for g in sides]
        for a in range(len(sides[0]) if len(sides[1]) else 0):
            close = ((grids[1] == grids[0][a]).mean(axis=1) >= tensor.slack) & (labels[1] != labels[0][a])
            meets[0][a] = close.any()
            meets[1] |= close
        if key[1] == key[2]:
            return sides[0][meets[0]]
        return pd.concat([g[m] for g, m in zip(sides, meets, strict=True)])

    return run


def _blocks(members: DataFrame, tensor: Tensor) -> DataFrame:
    """``members`` (node, label, component) with their block and the blocks to compare it with.

    A label with a block's worth of nodes has blocks to itself, which never meet each other; the nodes of all smaller labels
    share blocks, each label in one.
    """
    labels = members.groupBy("component", "label").agg(F.count("*").alias("n")).withColumn("team", F.when(F.col("n") >= tensor.block, F.col("label")))
    order = Window.partitionBy("component").orderBy("team")
    teams = labels.groupBy("component", "team").agg(F.ceil(F.sum("n") / tensor.block).cast("int").alias("blocks"))
    teams = teams.withColumn("end", F.sum("blocks").over(order).cast("int")).withColumn("total", F.sum("blocks").over(Window.partitionBy("component")).cast("int"))
    teams = teams.withColumn("start", F.col("end") - F.col("blocks")).withColumnRenamed("team", "own").withColumnRenamed("component", "of")
    placed = labels.join(teams, (F.col("component") == F.col("of")) & F.col("team").eqNullSafe(F.col("own"))).drop("own", "of", "n")
    placed = members.join(placed, ["component", "label"])
    block = F.col("start") + F.pmod(F.xxhash64(F.when(F.col("team").isNull(), F.col("label")).otherwise(F.col("node"))), "blocks")
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda b: F.col("team").isNull() | (b < F.col("start")) | (b >= F.col("end")))
    return placed.select("component", "label", "node", block.cast("int").alias("block"), others.alias("others"))


def _between(tensor: Tensor):  # noqa: ANN202
    """In one pair of blocks: links between different components, as many as join them."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        (first, second), grids, labels = _grids(tensor, group, *key[1:])
        sets: dict[tuple[int, int], np.ndarray] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def set_of(side: int, frame: pd.DataFrame, row: int) -> np.ndarray:
            if (side, row) not in sets:
                sets[side, row] = shingle_sets([frame["text"].iat[row].encode()], tensor.width)[0]
            return sets[side, row]

        nodes = [g["node"].to_numpy() for g in (first, second)]
        found = []
        for a in range(len(first)):
            near = (grids[1] == grids[0][a]).mean(axis=1) if len(second) else np.zeros(0)
            near[labels[1] == labels[0][a]] = 0
            for b in np.flatnonzero(near >= tensor.slack):
                x, y = root(int(labels[0][a])), root(int(labels[1][b]))
                if x != y and alike(set_of(0, first, a), set_of(1, second, b), tensor.percent):
                    parent[max(x, y)] = min(x, y)
                    found.append((nodes[0][a], nodes[1][b]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(documents: DataFrame, tensor: Tensor | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text)."""
    return _components(documents, tensor).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_one(documents: DataFrame, tensor: Tensor | None = None) -> DataFrame:
    """The documents without near-duplicates: of each component the row of smallest id stays, whole and once; rows without words all stay.

    A row is known by its id, the hash of its text and, among rows alike in both, its text, so no two documents are one.
    Columns of any name pass through.
    """
    found = _components(documents.select("doc_id", "text"), tensor)
    chosen = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    row, bare, place, key, of = free_names(documents.columns, "row", "bare", "place", "key", "of")
    stays = chosen.select(F.col("best.doc_id").alias(key), F.col("best.row").alias(row), F.lit(False).alias(bare))
    stays = stays.unionByName(found.where("component is null").select(F.col("doc_id").alias(key), F.col("row").alias(row), F.lit(True).alias(bare)).distinct())
    kept = documents.withColumn(row, F.xxhash64("doc_id", "text"))
    kept = kept.join(stays.withColumnRenamed(row, of), (F.col(row) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(key)))
    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    same = Window.partitionBy("doc_id", row, "text").orderBy(*(others or [F.lit(0)]))
    kept = kept.withColumn(place, F.row_number().over(same))
    return kept.where(F.col(bare) | (F.col(place) == 1)).select(*[F.col(f"`{c}`") for c in documents.columns])


def _components(documents: DataFrame, tensor: Tensor | None) -> DataFrame:
    """doc_id, row, n_shingles, component (a number, null without shingles) and component_id for every row."""
    small_batches(documents.sparkSession)
    tensor = tensor or Tensor()
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    sketched = written(rows.mapInArrow(_sketch(tensor), f"doc_id {kind}, row long, n_shingles long, set1 long, set2 long, sketch binary"), "sketches")
    nodes = sketched.where("n_shingles > 0").groupBy("set1", "set2", "n_shingles")
    nodes = nodes.agg(F.min("row").alias("row"), F.min("doc_id").alias("first"), F.min("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Keys that two nodes share, then the tables that two nodes share: counts combine before they are sent, and a key or table
    # that very many nodes have is cut by the join.
    keys = nodes.select("node", "sketch").mapInArrow(_keys(tensor), "node long, side boolean, key long")
    several = keys.groupBy("side", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("side", "key")
    shared = keys.join(several, ["side", "key"])
    halves = shared.groupBy("node").agg(*(F.collect_list(F.when(F.col("side") == s, F.col("key"))).alias(n) for s, n in ((True, "left"), (False, "right"))))
    tables = halves.select("node", F.explode("left").alias("u"), "right").select("node", "u", F.explode("right").alias("v"))
    # The drawn member has the smallest number after an exclusive or with the table's, so every table draws its own.
    tables = tables.select("node", F.xxhash64("u", "v").alias("table")).withColumn("lot", F.col("node").bitwiseXOR(F.col("table")))
    several = tables.groupBy("table").agg(F.count("*").alias("n"), F.min("lot").alias("lot")).where("n > 1")
    several = several.select("table", F.col("lot").bitwiseXOR(F.col("table")).alias("drawn"))
    tables = written(tables.join(several, "table").select("node", "table", "drawn"), "tables")

    met = tables.where("node <> drawn").groupBy("node", "drawn").count().groupBy("node").agg(F.max_by("drawn", F.struct("count", "drawn")).alias("drawn"))
    pairs = written(met.select(F.col("node").alias("a"), F.col("drawn").alias("b")), "pairs")
    needed = nodes.join(tables.select("node").distinct(), "node").select("node", "row")
    texts = written(rows.select("row", "text").join(needed, "row").groupBy("node").agg(F.first("text").alias("text")), "texts")
    sides = [texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    links = written(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_verified(tensor), "a long, b long"), "links")
    joined = components(links, "sets")

    # Tables that still hold nodes of several components.
    named = tables.join(joined, "node", "left").select("node", "table", F.coalesce("component", "node").alias("label"))
    mixed_tables = named.groupBy("table").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("node").alias("least")).where("low <> high")
    residual = written(named.join(mixed_tables.select("table", "least"), "table").select("node", "label", "least").distinct(), "residual")
    groups = components(residual.select(F.col("node").alias("a"), F.col("least").alias("b")), "groups")
    members = residual.select("node", "label").distinct().join(groups, "node")
    blocks = _blocks(members, tensor).join(nodes.select("node", "sketch"), "node")
    blocks = blocks.withColumn("other", F.explode("others")).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "sketch")
    fields = "component long, i int, j int, block int, node long, label long, sketch binary"
    near = written(blocks.groupBy("component", "i", "j").applyInPandas(_near(tensor), fields), "near")
    blocks = near.join(texts, "node")
    late = written(blocks.groupBy("component", "i", "j").applyInPandas(_between(tensor), "a long, b long"), "late")
    joined = components(links.unionByName(late), "all")

    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("set1", "set2", "n_shingles", "component", "component_id")
    full = sketched.where("n_shingles > 0").join(named, ["set1", "set2", "n_shingles"]).select("doc_id", "row", "n_shingles", "component", "component_id")
    bare = sketched.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return full.unionByName(bare)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
