"""Hierarchical packing of documents into training sequences.

Documents are routed to tiers by length. Whole windows are cut from documents longer than the largest tier; what is left
of each goes to the smallest tier that holds it. Tiers are packed from the longest down: a window opens with its tier's
longest piece and its gap is filled from shorter tiers, the largest piece that fits first, the last tokens by cutting one
piece. What no longer fills a window is cut into powers of two, which need no padding. Sequences of one tier are dealt
into step groups so that their attention costs (sum of squared piece lengths) are balanced.

A task packs its documents in chunks of about ``chunk_tokens`` tokens, so nothing is shuffled, memory stays bounded and a
chunk leaves at most a few short sequences. Ids are those of the given tokenizer, without special tokens, and one end id.

Defined results: null and empty texts are one end id; repeated rows are packed each; a null id is carried like any other;
documents of any length are cut, none is dropped; columns other than id and text are not carried; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from tillscope.llm.common import ASCII_LOWER, small_batches, task_ids, texts_of
from tillscope.llm.words import WordTable, kept, ragged


@dataclass(frozen=True)
class Packing:
    """Window sizes, longest first, each a power of two; the end id; tokens of a chunk; sequences of a step group; words a task keeps."""

    tiers: tuple[int, ...] = (4096, 2048, 1024, 512, 256)
    end_id: int = 2
    chunk_tokens: int = 2_000_000
    step: int = 32
    known_words: int = 900_000


def word_encoder(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Ids of distinct words, for a tokenizer that ignores case and whose tokens never cross white space.

    Words go to the tokenizer in lines with a bar between them, which is quicker than one by one; a word that holds a bar
    itself is a line of its own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    tokenizer = Tokenizer.from_file(path)
    of = lambda lines: [np.array(e.ids, dtype=np.int64) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
    bar = int(of(["|"])[0][0])

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        odd = [i for i, w in enumerate(words) if b"|" in w]
        if odd:
            plain, lengths = encode([b"" if b"|" in w else w for w in words])
            parts = np.split(plain, np.cumsum(lengths)[:-1])
            for i in odd:
                parts[i] = of([words[i].decode()])[0]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        lines = [(b" | ".join(words[k : k + 200]) + b" |").decode() for k in range(0, len(words), 200)]
        ids = np.concatenate([x for k in range(0, len(lines), 250) for x in of(lines[k : k + 250])])
        ends = np.flatnonzero(ids == bar)
        return ids[ids != bar], np.diff(np.concatenate([[-1], ends])) - 1

    return encode


def added_tokens(path: str) -> tuple[bytes, ...]:
    """The contents of the tokenizer's added tokens, in small letters."""
    return tuple(t.content.encode().translate(ASCII_LOWER) for t in Tokenizer.from_file(path).get_added_tokens_decoder().values())


def words_of(text: bytes, added: tuple[bytes, ...]) -> list[bytes]:
    """The words of a text in small letters. A word that then holds an added token stays as it is: those are matched as written."""
    small = text.translate(ASCII_LOWER)
    words = small.split()
    if any(a in small for a in added):
        # Small letters stand where the others stood, so both texts have the same words.
        return [w if any(a in s for a in added) else s for w, s in zip(text.split(), words, strict=True)]
    return words


def _powers(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def arrange(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (size, pieces); a piece is (document, start, length). Every sequence is filled exactly."""
    longest, out = tiers[0], []
    pool: list[tuple[int, int, int]] = []  # (length, document, start) of every piece not placed yet, ascending
    for doc, n in enumerate(lengths):
        whole = n // longest
        out += [(longest, [(doc, k * longest, longest)]) for k in range(whole)]
        if n % longest:
            pool.append((n % longest, doc, whole * longest))
    pool.sort()
    for rank, size in enumerate(tiers):
        shorter = tiers[rank + 1] if rank + 1 < len(tiers) else 0
        # The window opens with the longest piece left. Pieces of shorter tiers wait for their own windows or for gaps in these.
        while pool and pool[-1][0] > shorter:
            length, doc, start = pool.pop()
            pieces, gap = [(doc, start, length)], size - length
            while gap and pool:
                at = bisect.bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if at >= 0:
                    n, doc, start = pool.pop(at)
                    pieces.append((doc, start, n))
                    gap -= n
                else:  # every piece is longer than the gap: the shortest gives its head
                    n, doc, start = pool.pop(0)
                    pieces.append((doc, start, gap))
                    bisect.insort(pool, (n - gap, doc, start + gap))
                    gap = 0
            if not gap:
                out.append((size, pieces))
                continue
            for part in _powers(size - gap):  # nothing is left to fill with
                taken, room = [], part
                while room:
                    doc, start, n = pieces[0]
                    taken.append((doc, start, min(n, room)))
                    pieces[0] = (doc, start + min(n, room), n - min(n, room))
                    room -= min(n, room)
                    if not pieces[0][2]:
                        pieces.pop(0)
                out.append((part, taken))
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], step: int) -> list[int]:
    """A group number for each sequence: per size, by falling attention cost, dealt to and fro."""
    group, first = [0] * len(sequences), 0
    by_size: dict[int, list[int]] = {}
    for i, (size, _) in enumerate(sequences):
        by_size.setdefault(size, []).append(i)
    for _, members in sorted(by_size.items(), reverse=True):
        groups = -(-len(members) // step)
        members.sort(key=lambda i: -sum(n * n for _, _, n in sequences[i][1]))
        for k, i in enumerate(members):
            turn, place = divmod(k, groups)
            group[i] = first + (place if turn % 2 == 0 else groups - 1 - place)
        first += groups
    return group


def pack(df: DataFrame, path: str, packing: Packing | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_size, step_group."""
    small_batches(df.sparkSession)
    packing = packing or Packing()
    key = T.StructField(doc_id, df.schema[doc_id].dataType)
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset", "sequence_size", "step_group")]
    schema = T.StructType([key, *longs, T.StructField("ids", T.BinaryType())])

    def chunk(keys: list, docs: list[np.ndarray], numbers: Iterator[int], groups: Iterator[int]) -> Iterator[pa.RecordBatch]:
        sequences = arrange([len(d) for d in docs], packing.tiers)
        names: dict[int, int] = {}
        rows: list[tuple] = []
        for (size, pieces), group in zip(sequences, step_groups(sequences, packing.step), strict=True):
            if group not in names:
                names[group] = next(groups)
            number, at = next(numbers), 0
            for doc, start, n in pieces:
                rows.append((keys[doc], start, n, len(docs[doc]), number, at, size, names[group], docs[doc][start : start + n].tobytes()))
                at += n
        for at in range(0, len(rows), 1_000):
            columns = list(zip(*rows[at : at + 1_000], strict=True))
            arrays = [pa.array(columns[0], to_arrow_type(key.dataType)), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("packing", path), lambda: WordTable(word_encoder(path), packing.known_words))
        added = kept(("packing-added", path), lambda: added_tokens(path))
        numbers, groups = task_ids(), task_ids()
        keys, docs, held = [], [], 0
        for batch in batches:
            split = [words_of(t, added) for t in texts_of(batch.column(text))]
            for k, ids in zip(batch.column(doc_id).to_pylist(), words.batch(split), strict=True):
                keys.append(k)
                docs.append(np.append(ids, packing.end_id).astype("<u4"))
                held += len(docs[-1])
            if held >= packing.chunk_tokens:
                yield from chunk(keys, docs, numbers, groups)
                keys, docs, held = [], [], 0
        yield from chunk(keys, docs, numbers, groups)

    return df.select(doc_id, text).mapInArrow(run, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
