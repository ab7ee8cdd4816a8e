"""Deterministic sharded WARC archives: written from a table of pages, and read back.

Pages are range-sorted by id into shards of about equal payload. A shard's records go into files that roll once they reach
a compressed size, one gzip member per record; headers and digests are made anew for each. A file is written under a
temporary name and renamed when complete; the list of files is a manifest table that Spark's own commit makes visible at
once, and readers follow the manifest alone. Shards, file names and bytes depend on the pages only, so a task that runs
again after a lost executor writes the same files again.

Of records with equal payloads the one of the smallest page id is a response, the others are revisits that refer to it.
Which pages repeat is found on (id, digest) rows; these travel to the shards beside the pages, so the html is moved once.

Files are opened by executors through the Arrow file system of the folder's scheme (local, HDFS, S3, GCS).

Defined results: null html is an empty payload; rows without a page id are responses of their own, spread over the
shards by url and payload; of repeated rows with one id and payload one is the response; a null url gets a name made from
the id; control characters and blanks of a url are percent-encoded; extra columns are ignored; an empty table gives
archives without a page.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import small_batches, written
from tillscope.session import shared_folder

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: the standard's profile
_WRITERS = 16_384  # tasks that write, at most; neighbouring shards share one beyond it


@dataclass(frozen=True)
class Archive:
    """Payload bytes of a shard, fewest shards, compressed bytes at which a file is closed, the date in every record, and the
    payload size from which equal payloads are revisits."""

    shard_bytes: int = 256 << 20
    least_shards: int = 24
    roll_bytes: int = 64 << 20
    date: str = "2000-01-01T00:00:00Z"
    revisit_from: int = 0
    level: int = 6


def shard_starts(pages: DataFrame, archive: Archive) -> list[int]:
    """The smallest page id of each shard, ascending, from rows (page_id, size) without null ids.

    A shard begins where the bytes of all smaller ids pass a multiple of the target. Ids are written once, range-sorted with
    their bytes; totals of the ranges and a running sum inside each give the bytes before an id, whatever the ranges are.
    What reaches the driver are the starts: no more than the shards, one for each ``shard_bytes`` or the fewest allowed.
    """
    by_id = pages.groupBy("page_id").agg(F.sum("size").alias("size")).repartitionByRange("page_id")
    ids = written(by_id.withColumn("range", F.spark_partition_id()), "warc-ids")
    # One row for each shuffle partition, so running sums over them and their join are small.
    ranges = ids.groupBy("range").agg(F.sum("size").alias("held"))
    every = Window.orderBy("range")
    ranges = ranges.select("range", (F.sum("held").over(every) - F.col("held")).alias("behind"), F.sum("held").over(Window.partitionBy()).alias("total"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("range").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.least(F.lit(float(archive.shard_bytes)), F.col("total") / archive.least_shards)
    placed = ids.withColumn("before", before).join(F.broadcast(ranges), "range")
    starts = placed.groupBy(F.floor((F.col("behind") + F.col("before")) / target)).agg(F.min("page_id").alias("start"))
    return sorted(r["start"] for r in starts.select("start").collect())


def _shard(starts: list[int], shards: int) -> F.Column:
    """The shard of a row by its page id; rows without one are spread over all shards by what they hold."""
    lows = np.array(starts[1:], dtype=np.int64)

    @F.pandas_udf("int")
    def place(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, page_id.to_numpy(), side="right"), dtype="int32")

    spread = F.pmod(F.xxhash64("digest", "url"), F.lit(shards)).cast("int")
    return F.when(F.col("page_id").isNull(), spread).otherwise(place(F.coalesce("page_id", F.lit(0))))


def _lines(fields: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{copy}')}>"


def _target(url: str | None, page_id: int | None) -> str:
    return f"urn:page:{page_id}" if not url else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int, date: str) -> bytes:
    """One WARC record, uncompressed. ``copy`` tells apart records of one page id and payload, and without an id of one url too."""
    digest = _digest(payload)
    name = digest if page_id is not None else f"{url}/{digest}"
    http = _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, name, copy)), ("WARC-Date", date),
              ("WARC-Target-URI", _target(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _lines(fields, "WARC/1.1") + block + b"\r\n\r\n"


class _Files:
    """Writes a shard's records into rolling files and tells what it wrote."""

    def __init__(self, folder: str, archive: Archive) -> None:
        self.system, self.path = pafs.FileSystem.from_uri(folder)
        self.archive, self.out, self.done = archive, None, []
        self.shard, self.part = None, 0

    def start(self, shard: int) -> None:
        self.close()
        self.shard, self.part = shard, 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:06d}.warc.gz"
            self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.out, self.size, self.records, self.hash = self.system.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            body = _lines([("software", "tillscope"), ("format", "WARC File Format 1.1")], "")[2:-2]
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name, 0)), ("WARC-Date", self.archive.date), ("WARC-Filename", self.name),
                      ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
            self._member(_lines(fields, "WARC/1.1") + body + b"\r\n\r\n")
        self._member(data)
        self.records += 1
        if self.size >= self.archive.roll_bytes:
            self.close()

    def _member(self, data: bytes) -> None:
        press = zlib.compressobj(self.archive.level, zlib.DEFLATED, 31)
        member = press.compress(data) + press.flush()
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.hash.hexdigest()))
            self.out, self.part = None, self.part + 1


_MANIFEST = "shard int, file string, records long, bytes long, sha256 string"


def _writer(folder: str, archive: Archive):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, archive)
        known, first, copy = None, None, 0  # the page and payload at hand, whom it repeats, how many came before
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("shard", "page_id", "digest", "first", "url", "html", "is_page")]
            for shard, page_id, digest, smallest, url, html, is_page in zip(*columns, strict=True):
                if shard != files.shard:
                    files.start(shard)
                page = (page_id, digest, url if page_id is None else None)
                if page != known:
                    known, first, copy = page, None, 0
                if not is_page:
                    first = smallest
                    continue
                repeats = first is not None and (first != page_id or copy > 0)
                files.add(record(page_id, url, (html or "").encode(), first if repeats else None, copy, archive.date))
                copy += 1
        files.close()
        shards, names, records, sizes, hashes = zip(*files.done, strict=True) if files.done else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())],
                                         ["shard", "file", "records", "bytes", "sha256"])

    return run


def write_archives(pages: DataFrame, folder: str, archive: Archive | None = None) -> DataFrame:
    """Write (page_id, url, html) as archives into ``folder``; returns the manifest."""
    spark, archive = pages.sparkSession, archive or Archive()
    small_batches(spark)
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    light = pages.where("page_id is not null").select("page_id", (F.col("n") + 512).alias("size"))
    starts = shard_starts(light, archive)
    shards = max(archive.least_shards, len(starts))
    shard = _shard(starts, shards)
    ids = pages.where((F.col("n") >= archive.revisit_from) & F.col("page_id").isNotNull()).select("page_id", "digest")
    repeated = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    notes = ids.join(repeated, "digest").select("page_id", "digest", "first").distinct()
    nothing = F.lit(None).cast("string")
    notes = notes.withColumn("url", nothing).select(shard.alias("shard"), "page_id", "digest", "first", "url", nothing.alias("html"), F.lit(False).alias("is_page"))
    records = pages.select(shard.alias("shard"), "page_id", "digest", F.lit(None).cast("long").alias("first"), "url", "html", F.lit(True).alias("is_page"))
    # Each writer takes a run of neighbouring shards, named by its number, so that none waits for a hash to be even.
    writers = min(shards, _WRITERS)
    writer = F.floor(F.col("shard").cast("long") * writers / shards).cast("int")
    every = notes.unionByName(records).repartitionById(writers, writer).sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
    every.mapInArrow(_writer(folder, archive), _MANIFEST).write.json(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST).json(f"{folder}/_manifest")


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, each uncompressed, one at a time."""
    raw, unpack, held = b"", zlib.decompressobj(31), io.BytesIO()
    while True:
        raw = raw or stream.read(1 << 20)
        if not raw:
            if held.tell():
                raise ValueError("the archive ends inside a record")
            return
        held.write(unpack.decompress(raw))
        raw = unpack.unused_data
        if unpack.eof:
            yield held.getvalue()
            unpack, held = zlib.decompressobj(31), io.BytesIO()


def _head(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, fields, and what follows the blank line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, rest


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """(page id, payload bytes, payload digest, type, refers to) of a record; None for one without a page. Digests are checked."""
    first, fields, rest = _head(data)
    if first != "WARC/1.1" or len(rest) != int(fields["content-length"]) + 4:
        raise ValueError("not a WARC record of its stated length")
    if fields["warc-type"] not in ("response", "revisit"):
        return None
    block = rest[:-4]
    if fields["warc-block-digest"] != f"sha1:{_digest(block)}":
        raise ValueError(f"the block digest of {fields['warc-record-id']} is wrong")
    _, http, payload = _head(block)
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"the payload digest of {fields['warc-record-id']} is wrong")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("warc-page-id"), size, digest, fields["warc-type"], number("warc-refers-to-page-id")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page of the archives that the manifest lists, in any order of files."""
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/_manifest")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows = []
                    for member in _members(stream):
                        found = parse(member)
                        if found is not None:
                            rows.append((*found, name))
                        if len(rows) >= 5_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"])


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one."""
    folder = shared_folder(spark)
    return f"{folder if '://' in folder or folder.startswith('/') else '/' + folder}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, archive: Archive | None = None) -> DataFrame:
    """The pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, file."""
    folder = new_folder(pages.sparkSession)
    write_archives(pages, folder, archive)
    return read_archives(pages.sparkSession, folder)
