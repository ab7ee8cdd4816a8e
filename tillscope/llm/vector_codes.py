"""Vector codes: whole-number vectors cut into parts, each part replaced by the number of its nearest codebook entry.

Components become floor(scale * x). Codebooks start as the parts of the first vectors by id and are moved by a few rounds of
assignment and componentwise mean. Every step is exact: :func:`products` breaks whole numbers into limbs short enough that
float64 matrix products of limbs stay below 2 ** 53, where doubles hold every whole number, and adds the products up in
int64. Distances are then whole numbers, and the first of the smallest is taken. A task sends one count and one sum per entry
and component, whatever it reads, and codebooks (``entries`` x dimensions) are all that passes through the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a vector with fewer dimensions
counts as filled up with zeros, the longest one also up to a multiple of ``parts``; an empty vector is all zeros. Components
beyond ``+-2 ** bits_allowed(dimensions)`` count as that number, so that no distance leaves int64 (with 64 dimensions and a
scale of 1024 these are |x| from 2 ** 16). Of rows with one id the smaller vector comes first, rows without an id come last;
repeated rows count and are coded each; fewer rows than entries give as many entries; null labels are a label of their own;
columns other than the three named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tillscope.llm.common import written

ROWS = 4_096  # vectors multiplied at once


@dataclass(frozen=True)
class Codes:
    """Steps per unit of a component; parts of a vector; entries of a part's codebook, at most 256; rounds that move them."""

    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4


def bits_allowed(dimensions: int) -> int:
    """Bits of a component so that the squared distance of two whole vectors, and twice it, fit int64."""
    return (61 - (max(dimensions, 1) - 1).bit_length()) // 2 - 1


def _limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """Whole numbers as float64 limbs of ``width`` bits, lowest first; the highest carries the sign."""
    out, lowest, highest = [], int(x.min(initial=0)), int(x.max(initial=0))
    while lowest < -(1 << width) or highest >= 1 << width:
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x, lowest, highest = x >> width, lowest >> width, highest >> width
    return [*out, x.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray, width: int | None = None) -> np.ndarray:
    """The exact dot products of the rows of two int64 matrices, as long as they fit int64.

    A limb product sums one product of two ``width``-bit numbers per column, so it stays at most 2 ** 53.
    """
    width = width or (53 - (max(a.shape[1], 1) - 1).bit_length()) // 2
    total = np.zeros((len(a), len(b)), np.int64)
    of_b = _limbs(b, width)
    for i, high in enumerate(_limbs(a, width)):
        for j, low in enumerate(of_b):
            total += (high @ low.T).astype(np.int64) << np.int64(width * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, of equally near ones the first, and its squared distance."""
    apart = (book * book).sum(axis=1) - 2 * products(x, book)
    first = np.argmin(apart, axis=1)
    return first, apart[np.arange(len(x)), first] + (x * x).sum(axis=1)


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.frombuffer(b"".join(part.column("x").to_pylist()), "<i4").reshape(part.num_rows, width).astype(np.int64)


def whole_vectors(embeddings: DataFrame, vec_id: Column, vector: Column, label: Column, codes: Codes) -> tuple[DataFrame, int]:
    """(vec_id, label, x): x the whole components as little-endian 32-bit numbers. And the dimensions, a multiple of ``parts``."""
    good = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(vec_id.alias("vec_id"), label.alias("label"), F.when(good, vector.cast("array<double>")).alias("e")).where("e is not null")
    longest = rows.agg(F.max(F.size("e"))).first()[0] or 0
    width = -(-longest // codes.parts) * codes.parts
    most, scale = 1 << bits_allowed(width), codes.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, width), "<i4")
            with np.errstate(over="ignore"):  # beyond the range of doubles is beyond the bound
                x[np.arange(width) < sizes[:, None]] = np.clip(np.floor(lists.flatten().to_numpy() * scale), -most, most)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "label", "x"])

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("x", T.BinaryType())])
    return rows.mapInArrow(run, schema), width


def first_entries(whole: DataFrame, width: int, codes: Codes) -> np.ndarray:
    """The codebooks to begin with, (part, entry, component): the parts of the first vectors by id."""
    first = whole.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(codes.entries).collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in first), "<i4").reshape(len(first), codes.parts, width // codes.parts)
    return x.transpose(1, 0, 2).astype(np.int64)


def moved(whole: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts nearest to it."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for _, x in _rows(batches, parts * width):
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                code, _ = nearest(mine, books[p])
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                count[p] += np.bincount(code, minlength=entries)
                total[p, used] += np.add.reduceat(mine[order], starts, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = whole.select("x").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = sums.select("part", "entry", "n", F.posexplode("total").alias("place", "total")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    after = books.copy()
    for r in sums.collect():  # one row per number of the codebooks
        after[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return after


def coded(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error (squared distances summed over the parts)."""
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches, parts * width):
            code, error = np.zeros(len(x), f"<U{2 * parts}"), np.zeros(len(x), np.int64)
            for p in range(parts):
                entry, apart = nearest(x[:, p * width : (p + 1) * width], books[p])
                code, error = np.char.add(code, digits[entry]), error + apart
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return whole.mapInArrow(run, T.StructType([*whole.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def fit(embeddings: DataFrame, codes: Codes | None = None, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """The coded rows (written) and the codebooks, (part, entry, component)."""
    codes = codes or Codes()
    whole, width = whole_vectors(embeddings, F.col(vec_id), F.col(vector), F.col(label), codes)
    whole = written(whole, "whole-vectors")
    books = first_entries(whole, width, codes)
    for _ in range(codes.rounds if books.shape[1] else 0):
        books = moved(whole, books)
    return written(coded(whole, books), "vector-codes"), books


def compress(embeddings: DataFrame, codes: Codes | None = None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of (vec_id, embedding, label)."""
    rows, books = fit(embeddings, codes)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # Sums of a label combine before the shuffle. Beyond int64 the largest number stands for all.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int = 4) -> str:
    steps = ["c0 AS MATERIALIZED (SELECT v.i, e, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 256)"]
    for r in range(rounds + 1):
        near = f"SELECT vec_id, v.i // w AS p, e, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (i) GROUP BY ALL"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, min(d * 256 + e) % 256 AS e, min(d) AS d FROM ({near}) GROUP BY ALL)")
        mean = f"SELECT v.i, a.e, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN a{r} a ON a.vec_id = v.vec_id AND a.p = v.i // w GROUP BY ALL"
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.i, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN ({mean}) m USING (i, e))")
    return f"""
WITH kept AS MATERIALIZED (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT max(len(embedding)) // 4 AS w FROM kept),
v AS MATERIALIZED (SELECT vec_id, w, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM kept), s),
{", ".join(steps)},
z AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i // w, e, i)) AS h FROM c{rounds}, s)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM z JOIN kept USING (vec_id), books
"""


ORACLE = _oracle()
