"""Two tokenizers' tokens of the same bytes aligned: common ends, the groups between them, overlaps, linked id pairs.

Tokens are lists of byte ends. The shorter list drives the search in the longer one: from a start that lies before it, each end
steps forward 1, 2, 4 ... places and then halves the last step (:func:`gallop`). An end that is found is common to both
tokenizers; common ends slice both lists into groups, and the difference of the ranks of a token's two ends in the other list
is the range of tokens that it overlaps.

Texts are cut before single blanks and line feeds between visible characters, where neither tokenizer has a token across
(:func:`segments`); distinct segments are encoded and aligned once and kept while a worker lives. Corpus-wide counts of linked
pairs come from chunks of documents: each chunk sends a pair once, with its count, and is told the pair's total, so a pair that
a third of the corpus holds is one row a chunk.

Defined results: texts that are null, empty, or whose joined tokens of either tokenizer differ from blank + text have no tokens
(a text holding U+2581 is one, as the piece reads as a blank); the strings of special tokens are plain text; repeated rows count each; a null id is carried; texts of any
length are read whole, a chunk holds at least one text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from tokenizers import Tokenizer

from tillscope.llm.common import bucketed, packed, small_batches, task_ids, unpacked, written
from tillscope.llm.words import kept, ragged

# Characters that are white space in no version of Unicode and belong to no marker of a piece.
_VISIBLE = "!-~¡-ᙿ、-퟿"
_PLAIN = re.compile(f"[{_VISIBLE}]+(?:[ \n][{_VISIBLE}]+)*")
_CUT = re.compile(f"(?<=[{_VISIBLE}])(?=[ \n][{_VISIBLE}])")


@dataclass(frozen=True)
class Alignment:
    """Segments a worker keeps; links of a chunk; bytes of documents per bucket of the chunk table."""

    known_segments: int = 300_000
    chunk_links: int = 1_000_000
    bucket_bytes: int = 48 << 20


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The place in ``long`` of its first value not below each of ``short``; ``start`` is a place not behind it. Both ascend."""
    low, high = start.astype(np.int64), start.astype(np.int64)
    step = 1
    on = np.flatnonzero((low < len(long)) & (long[np.minimum(low, len(long) - 1)] < short)) if len(long) else np.zeros(0, np.int64)
    while len(on):  # long[low] < short, and the place lies behind low
        high[on] = np.minimum(low[on] + step, len(long))
        beyond = high[on] < len(long)
        beyond[beyond] = long[high[on][beyond]] < short[on][beyond]
        low[on[beyond]] = high[on[beyond]]
        on, step = on[beyond], step * 2
    on = np.flatnonzero(high - low > 1)
    while len(on):
        middle = (low[on] + high[on]) // 2
        below = long[middle] < short[on]
        low[on[below]], high[on[~below]] = middle[below], middle[~below]
        on = on[high[on] - low[on] > 1]
    return high


def reach(a: np.ndarray, b: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end of ``a``: its rank among the ends of ``b`` (how many lie before it), and whether it is one of them.

    ``a_start`` and ``b_start`` give, per end of ``a`` and of ``b``, a rank in the other list that is surely not too high.
    """
    if len(a) <= len(b):
        rank = gallop(a, b, a_start)
        return rank, b[np.minimum(rank, len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)
    place = gallop(b, a, b_start)
    common = np.zeros(len(a), bool)
    hit = place[place < len(a)]
    common[hit[a[hit] == b[place < len(a)]]] = True
    # An end of a that lies behind k ends of b has rank k.
    before = np.bincount(place + (a[np.minimum(place, len(a) - 1)] == b), minlength=len(a) + 1)[: len(a)] if len(a) else np.zeros(0, np.int64)
    return np.cumsum(before), common


def segments(text: str) -> list[str]:
    """Blank + text cut into segments, each under a key: a segment of a blank and visible characters goes without its blank."""
    if _PLAIN.fullmatch(text):
        return text.replace("\n", " \n").split(" ")
    return [s[1:] if s[0] == " " and s[1:2] not in ("", " ", "\n") else s for s in _CUT.split(" " + text)]


def _unkeyed(key: str) -> str:
    return key if key[0] in " \n" else " " + key


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Byte:
    """A byte-level tokenizer file: ids of many texts, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Piece:
    """A piece model that puts a blank before a text: ids of texts that begin with a blank or line feed, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁|.\n|\n.", p) for p in pieces):
            raise ValueError("a piece crosses a blank or a line feed: texts cannot be cut there")
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        # The model's own blank stands for a text's first one; a text that begins otherwise has one blank too many.
        found = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [[self.blank] if t == " " else ids if t[0] == " " else ids[1:] if ids[:1] == [self.blank] else [] for t, ids in zip(texts, found, strict=True)]


class Aligned:
    """Segments met so far, encoded and aligned: flat arrays with a start and a length per segment."""

    def __init__(self, path_a: str, path_b: str, limit: int) -> None:
        self.a, self.b, self.limit = Byte(path_a), Piece(path_b), limit
        self.length_a, self.length_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = [np.zeros(0, np.uint32) for _ in range(4)]  # ids of a, ids of b, ranks of a's ends in b, whether common
        self.size = [np.zeros(0, np.int64) for _ in range(2)]
        self.start = self.size
        self.good = np.zeros(0, bool)

    def _forget(self) -> None:
        """Only the half that was met first stays: it holds the frequent segments."""
        n = self.limit // 2
        ends = [int(size[:n].sum()) for size in self.size]
        self.place = dict(islice(self.place.items(), n))
        self.flat = [x[: ends[i]].copy() for x, i in zip(self.flat, (0, 1, 0, 0), strict=True)]
        self.size, self.start, self.good = [x[:n].copy() for x in self.size], [x[:n].copy() for x in self.start], self.good[:n].copy()

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):  # bounded memory for a batch of very long texts
            part = new[at : at + 20_000]
            texts = [_unkeyed(k) for k in part]
            ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
            joined_a, joined_b = ([b"".join(map(t.bytes.__getitem__, x)) for x in ids] for t, ids in ((self.a, ids_a), (self.b, ids_b)))
            good = np.array([x == y == t.encode() for t, x, y in zip(texts, joined_a, joined_b, strict=True)], bool)
            for i in np.flatnonzero(~good).tolist():
                ids_a[i], ids_b[i] = [], []
            n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
            a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
            # Segments lie one after another, so their ends ascend and a segment's own ends begin at its first rank.
            first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            rank, common = reach(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.repeat(first_b, n_a), np.repeat(first_a, n_b))
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part)), strict=True))
            for i, x in enumerate((a, b, rank - np.repeat(first_b, n_a), common)):
                self.flat[i] = np.concatenate([self.flat[i], x.astype(np.uint32)])
            self.size = [np.concatenate([old, x]) for old, x in zip(self.size, (n_a, n_b), strict=True)]
            self.good = np.concatenate([self.good, good])
        self.start = [np.cumsum(n) - n for n in self.size]

    def _places(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))

    def batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids of a, ids of b, the ranks of a's ends among b's, and which of a's ends are common."""
        cut = [segments(t) if t else [] for t in texts]
        keys = list(chain.from_iterable(cut))
        place = self._places(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = list({keys[i] for i in missing.tolist()})
            if len(self.place) + len(new) > self.limit and len(self.place) > self.limit // 2:
                self._forget()
                missing = np.flatnonzero((place < 0) | (place >= len(self.place)))
                new = list({keys[i] for i in missing.tolist()})
            self._learn(new)
            place[missing] = self._places([keys[i] for i in missing.tolist()])
        ends = np.cumsum([0, *map(len, cut)])
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            p = place[i:j]
            if i == j or not self.good[p].all():
                yield tuple(np.zeros(0, np.int64) for _ in range(4))
                continue
            n_a, n_b = self.size[0][p], self.size[1][p]
            a, rank, common = (ragged(self.flat[k], self.start[0][p], n_a).astype(np.int64) for k in (0, 2, 3))
            yield a, ragged(self.flat[1], self.start[1][p], n_b).astype(np.int64), rank + np.repeat(np.cumsum(n_b) - n_b, n_a), common.astype(bool)


def overlaps(rank: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last token of b that each token of a overlaps, from the ranks of its two ends."""
    return np.concatenate([[0], rank[:-1] + common[:-1]])[: len(rank)], rank


_ALIGNED = (("a_ids", "array<int>"), ("b_ids", "array<int>"), ("a_cuts", "array<int>"), ("b_cuts", "array<int>"), ("b_first", "array<int>"), ("b_last", "array<int>"))


def align(documents: DataFrame, path_a: str, path_b: str, alignment: Alignment | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids; a_cuts, b_cuts: how many tokens of a and b lie before each common end; b_first, b_last: per token of a the range of b it overlaps."""
    small_batches(documents.sparkSession)
    alignment = alignment or Alignment()
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n, _ in _ALIGNED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("alignment", path_a, path_b), lambda: Aligned(path_a, path_b, alignment.known_segments))
        for batch in batches:
            columns: list[list] = [[] for _ in _ALIGNED]
            for a, b, rank, common in known.batch([t or "" for t in batch.column("text").to_pylist()]):
                for column, x in zip(columns, (a, b, np.flatnonzero(common) + 1, rank[common] + 1, *overlaps(rank, common)), strict=True):
                    column.append(x.astype(np.int32))
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)]).astype(np.int32), pa.array(np.concatenate(c) if c else np.zeros(0, np.int32))) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], schema.names)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


_CHUNK = T.StructType([T.StructField("chunk", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("counts", "links")),
                       T.StructField("shas", T.ArrayType(T.StringType())), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(), np.cumsum(np.concatenate([[0], column.value_lengths().to_numpy(zero_copy_only=False)]))
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _shares(n_a: int, n_b: int, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a's and b's tokens when the groups are written one after another, a's before b's."""
    group_a, group_b = np.searchsorted(cuts_a, np.arange(n_a), "right"), np.searchsorted(cuts_b, np.arange(n_b), "right")
    before_b, before_a = np.concatenate([[0], cuts_b]), np.concatenate([cuts_a, [n_a]])
    return np.arange(n_a) + before_b[group_a], np.arange(n_b) + before_a[group_b]


def _digests(size_a: int, size_b: int, alignment: Alignment, key: pa.DataType):  # noqa: ANN202
    """Chunks of documents: their counts, digests, distinct linked pairs with counts, and which pair each link is. Sizes are those of the vocabularies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written_a, written_b = [str(i).encode() for i in range(size_a)], [str(i).encode() for i in range(size_b)]
        # Each token as it stands before a comma, and as the last of its side of a group.
        texts = [x + s for some, end in ((written_a, b"|"), (written_b, b";")) for s in (b",", end) for x in some]
        numbers, ids, counts, shas, links, held = task_ids(), [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            pairs, which, times = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            row = [[next(numbers)], [packed(np.array(counts, np.int64))], [packed(which.astype(np.int32))], [shas], [pairs], [times], [ids]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (*to_arrow_schema(_CHUNK).types, pa.list_(key)), strict=True)], [*_CHUNK.names, "ids"])

        for batch in batches:
            a_all, b_all, cuts_a_all, cuts_b_all = (_lists(batch.column(n)) for n in ("a_ids", "b_ids", "a_cuts", "b_cuts"))
            for doc, a, b, cuts_a, cuts_b in zip(batch.column("doc_id").to_pylist(), a_all, b_all, cuts_a_all, cuts_b_all, strict=True):
                places_a, places_b = _shares(len(a), len(b), cuts_a, cuts_b)
                line = np.zeros(len(a) + len(b), np.int64)
                line[places_a], line[places_b] = a, b + 2 * size_a
                line[places_a[cuts_a - 1]] += size_a
                line[places_b[cuts_b - 1]] += size_b
                shas.append(hashlib.sha256(b"".join(map(texts.__getitem__, line.tolist()))[:-1]).hexdigest() if len(a) else "")
                links.append(a[cuts_a - 1].astype(np.int64) << 32 | b[cuts_b - 1])
                counts.append((len(a), len(b), len(cuts_a), len(cuts_a)))
                ids.append(doc)
                held += len(cuts_a) + 50
                if held >= alignment.chunk_links:
                    yield chunk()
                    ids, counts, shas, links, held = [], [], [], [], 0
        if ids:
            yield chunk()

    return run


_RESULT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _summed(schema: pa.Schema):  # noqa: ANN202
    """Per document the links that are their b id's best, and the sum of their totals."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        tables = []
        for row in chunks.to_pylist():
            order = np.argsort(told.column("pair").to_numpy())
            total, best = (told.column(n).to_numpy()[order] for n in ("total", "best"))
            counts, which = unpacked(row["counts"], "i8").reshape(-1, 4), unpacked(row["links"], "i4")
            sums = [np.concatenate([[0], np.cumsum(x[which].astype(np.int64))]) for x in (best == total, total)]
            ends = np.cumsum(counts[:, 3])
            per_doc = [s[ends] - s[ends - counts[:, 3]] for s in sums]
            columns = [*counts.T, *per_doc]
            tables.append(pa.table([pa.array(row["ids"], schema.field(0).type), *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(row["shas"], pa.string())], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def alignment_digests(documents: DataFrame, path_a: str, path_b: str, alignment: Alignment | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of (doc_id, text)."""
    alignment = alignment or Alignment()
    key = documents.schema["doc_id"].dataType
    aligned = align(documents, path_a, path_b, alignment).select("doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = T.StructType([*_CHUNK.fields, T.StructField("ids", T.ArrayType(key))])
    digests = _digests(len(Byte(path_a).bytes), len(Piece(path_b).bytes), alignment, to_arrow_type(key))
    chunks = bucketed(aligned.mapInArrow(digests, schema), "chunk", max(8, size // alignment.bucket_bytes), "alignment")

    asked = chunks.select(F.col("chunk").alias("asker"), F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("asker", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    totals = asked.groupBy("pair").agg(F.sum("times").alias("total"))
    totals = written(totals.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "alignment-pairs")
    best = totals.groupBy("b").agg(F.max("total").alias("best"))
    told = asked.select("asker", "pair").join(totals.join(best, "b").select("pair", "total", "best"), "pair")
    result = T.StructType([T.StructField("doc_id", key), *(T.StructField(n, T.LongType()) for n in _RESULT), T.StructField("groups_sha256", T.StringType())])
    mine = chunks.select("chunk", "counts", "links", "shas", "ids").groupBy("chunk")
    return mine.cogroup(told.groupBy("asker")).applyInArrow(_summed(to_arrow_schema(result)), result)
