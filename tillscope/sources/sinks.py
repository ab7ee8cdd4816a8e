"""Writing cleaned lines and result tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def date_patterns(df: DataFrame) -> dict[str, str]:
    """The shortest ISO form each date column needs: date, seconds or microseconds."""
    stamps = [c for c, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")]
    if not stamps:
        return {}
    micro = lambda c: F.pmod(F.unix_micros(F.col(c).cast("timestamp")), F.lit(1_000_000)) != 0
    clock = lambda c: (F.hour(c) + F.minute(c) + F.second(c)) != 0
    found = df.agg(
        *[F.coalesce(F.bool_or(micro(c)), F.lit(False)).alias(f"m_{i}") for i, c in enumerate(stamps)],
        *[F.coalesce(F.bool_or(clock(c)), F.lit(False)).alias(f"c_{i}") for i, c in enumerate(stamps)],
    ).first()
    return {
        c: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" if found[f"m_{i}"] else "yyyy-MM-dd'T'HH:mm:ss" if found[f"c_{i}"] else "yyyy-MM-dd"
        for i, c in enumerate(stamps)
    }


def with_iso_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, p) for c, p in date_patterns(df).items()})


def write_cleaned_csv(df: DataFrame, path: str, line_no: str | None = "line_no") -> None:
    """Cleaned lines as text, in file order inside every part."""
    out = with_iso_dates(df)
    if line_no in out.columns:
        out = out.repartitionByRange(F.col(line_no)).sortWithinPartitions(line_no).drop(line_no)
    out.write.option("header", "true").csv(path)


_PUBLISHED = "version long, name string, folder string, format string"


def published(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """Folder and format of every table of the newest published set; empty where none was published."""
    rows = _manifest(spark, folder).collect()
    newest = max((r["version"] for r in rows), default=None)
    return {r["name"]: (r["folder"], r["format"]) for r in rows if r["version"] == newest}


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_PUBLISHED).json(f"{folder.rstrip('/')}/_published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PUBLISHED)  # nothing was published yet


def write_results(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One table per result, published together by one writer at a time.

    Tables are written to a folder of their own; when all are complete one manifest file is added that names them, which a
    file system shows whole or not at all. A job that dies before leaves readers with the set published last. A set of no
    tables is refused. Folders of older sets stay until their owner removes them.
    """
    if not tables:
        raise ValueError("a result set needs a table")
    spark, folder = next(iter(tables.values())).sparkSession, folder.rstrip("/")
    version = 1 + (_manifest(spark, folder).agg(F.max("version")).first()[0] or 0)
    place = f"{folder}/set-{version:06d}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.format(fmt).mode("errorifexists").save(f"{place}/{name}")
    rows = [(version, name, f"{place}/{name}", fmt) for name in tables]
    spark.createDataFrame(rows, _PUBLISHED).coalesce(1).write.mode("append").json(f"{folder}/_published")


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest published set."""
    found = published(spark, folder)
    if name not in found:
        raise ValueError(f"{folder} has no published table {name}")
    place, fmt = found[name]
    return spark.read.format(fmt).load(place)
