"""What several of the operators share: batches as bytes, packed chunks, tables bucketed by chunk, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.session import materialize, shared_folder

# Rows of one Arrow batch. Whole texts can be long, so a batch holds few of them.
BATCH_ROWS = 500

# Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a task holds few whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    return materialize(df, f"llm-{label}")


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as make it unlike every given column, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """``df`` written to the shared folder bucketed by ``key``, without a shuffle; grouping by ``key`` later needs none either."""
    spark, name = df.sparkSession, f"llm_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def texts_of(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    binary = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    return [b"" if x is None else x for x in binary.to_pylist()]


def packed(array: np.ndarray) -> bytes:
    """An array's bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    """The array that :func:`packed` made bytes of."""
    return np.frombuffer(zstandard.decompress(blob), dtype=kind)


def runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of sorted numbers, and where the run of each begins and ends."""
    begin = np.flatnonzero(np.r_[np.ones(min(1, len(numbers)), dtype=bool), numbers[1:] != numbers[:-1]])
    return numbers[begin], begin, np.append(begin, len(numbers))[1:]


def task_ids() -> Iterator[int]:
    """Whole numbers that no other task gives: the partition in the high half, a counter in the low."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the component being its smallest node.

    Alternates two steps until nothing changes: every node hangs its larger neighbours on its smallest one, then
    its smaller neighbours and itself. Only counts reach the driver; each round is a table in the shared folder. A
    node with very many neighbours loses them to its smallest neighbour, and the minimum per node combines before the shuffle.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v"), f"{label}-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = written(small.where("u <> v").distinct(), f"{label}-small")
        same = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if same == small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first():
            roots = small.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        edges = small
