"""Byte-level BPE by merge replay.

A task gathers the distinct words (matches of the splitting pattern) of its documents that it has not met yet and encodes
them together: an inverted index leads from each pair of neighbouring tokens to the positions where it stands, and merges
are replayed in rank order, each touching only the neighbours of the places it changes. Documents are then put together
from their words' ids. Every text is read once, nothing is shuffled. A worker process keeps its words over its tasks,
forgets them when they would exceed ``KNOWN_WORDS`` and goes on with an empty table; the ids are the same either way.

Defined results: a null text is an empty one and has no ids; strings that look like special tokens are ordinary text;
repeated rows are encoded each; extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillscope.llm.common import small_batches
from tillscope.llm.words import WordTable, kept, ragged

KNOWN_WORDS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str) -> regex.Pattern:
    """The splitting pattern with white space as Unicode's property has it."""
    inside = pattern.replace(r"[^\s", r"[^\p{White_Space}")
    return regex.compile(inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Replay:
    """Encodes batches of byte words by replaying merges over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.merges: dict[int, int] = {}  # by left << 32 | right, for the pairs met so far; -1: no merge

    def rank(self, pair: int) -> int:
        """The rank at which a pair merges, or -1."""
        found = self.merges.get(pair)
        if found is None:
            found = self.merges[pair] = self.ranks.get(self.bytes_of[pair >> 32] + self.bytes_of[pair & 0xFFFFFFFF], -1)
        return found

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A word that is a token stays whole; the others begin as single bytes. -2 ends a word, -1 is a place merged away.
        whole = [self.ranks.get(w) for w in words]
        sizes = np.fromiter((len(w) if r is None else 1 for w, r in zip(words, whole, strict=True)), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        start = np.full(int(ends[-1]) + 1, -2, dtype=np.int64)
        inside = np.ones(len(start), dtype=bool)
        inside[ends] = False
        flat = np.frombuffer(b"".join(w if r is None else b"\0" for w, r in zip(words, whole, strict=True)), np.uint8)
        start[inside] = self.single[flat]
        for at, r in zip((ends - sizes).tolist(), whole, strict=True):
            if r is not None:
                start[at] = r
        index = self._index(start)
        token, after, before = start.tolist(), list(range(1, len(start) + 1)), list(range(-1, len(start) - 1))
        merges, heap = self.merges, sorted(index)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            places.sort()
            for k, at in enumerate(places):
                left = token[at]
                if left < 0:
                    continue
                right = after[at]
                if token[right] < 0 or merges.get(left << 32 | token[right]) != rank:
                    continue  # a neighbour was merged meanwhile
                follow = after[right]
                token[at], token[right], after[at], before[follow] = rank, -1, follow, at
                previous = before[at]
                for place, pair in ((previous, token[previous] << 32 | rank if previous >= 0 and token[previous] >= 0 else -1), (at, rank << 32 | token[follow] if token[follow] >= 0 else -1)):
                    if pair >= 0:
                        new = merges.get(pair)
                        if new is None:
                            new = self.rank(pair)
                        if new >= 0:
                            if new in index:
                                index[new].append(place)
                            else:
                                index[new] = [place]
                                heapq.heappush(heap, new)
                if heap and heap[0] < rank:
                    # The merge has made way for an earlier one: that goes first, the rest of this rank after it.
                    if k + 1 < len(places):
                        if rank not in index:
                            index[rank] = []
                            heapq.heappush(heap, rank)
                        index[rank] += places[k + 1 :]
                    break
        done = np.array(token, dtype=np.int64)
        live = done >= 0
        count = np.cumsum(live)[ends]
        return done[live], np.diff(np.concatenate([[0], count]))

    def _index(self, token: np.ndarray) -> dict[int, list[int]]:
        """The inverted index: for each merge, by its rank, the places where its pair stands."""
        places = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
        pairs, which = np.unique(token[places] << 32 | token[places + 1], return_inverse=True)
        ranks = np.array([self.rank(p) for p in pairs.tolist()], dtype=np.int64)[which] if len(pairs) else np.zeros(0, np.int64)
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        return {int(r[0]): p.tolist() for r, p in zip(np.split(ranks, cuts), np.split(places, cuts), strict=True) if len(r)}


def known_words(path: str) -> WordTable:
    """The words this worker process has met in any of its tasks."""

    def make() -> WordTable:
        replay = Replay(load_ranks(path))
        return WordTable(lambda words: replay.encode([w.encode() for w in words]), KNOWN_WORDS)

    return kept(("byte_bpe", path), make)


class Vocabulary:
    """Token bytes by id, for decoding."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.length = np.zeros(ordered[-1][1] + 1, np.int64)
        self.length[[r for _, r in ordered]] = [len(t) for t, _ in ordered]
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(t for t, _ in ordered), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.flat, self.start[ids], self.length[ids]).tobytes()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of each row's whole text (array of int)."""
    small_batches(df.sparkSession)
    schema = T.StructType([f for f in df.schema if f.name != into] + [T.StructField(into, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = known_words(path), splitter(pattern)
        for batch in batches:
            parts = [split.findall(t or "") for t in batch.column(text).to_pylist()]
            ids = words.batch(parts)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
            names = [n for n in batch.schema.names if n != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*names, into])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of the ids; the decoded bytes come from the ids alone."""
    kept = [f for f in df.schema if f.name != ids]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(load_ranks(path))
        for batch in batches:
            column = batch.column(ids)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            hashed = [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
            decoded = [hashlib.sha256(vocabulary.decode(r)).hexdigest() for r in rows]
            arrays = [pa.array([len(r) for r in rows], pa.int64()), pa.array(hashed), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *arrays], schema.names)

    return df.mapInArrow(run, schema)


def encode_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return digests(encode(documents.select("doc_id", "text"), path, pattern).select("doc_id", "ids"), path)
