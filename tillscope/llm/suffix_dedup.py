"""Removal of long repeated passages by a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. To sort few suffixes instead of all,
every window of that length is led to its anchor, the position in it of the smallest hash of ``gram`` bytes; equal windows
have their anchors at the same distance. Consecutive windows with one anchor share a context: the bytes they span.

1. Documents are packed into chunks, written once and bucketed by chunk, so that later steps join answers to them without
   moving text again.
2. Anchors are counted by gram and context over all chunks (equal ones of a chunk count as one row). A gram that stands
   alone repeats nowhere; contexts that stand together are suffixes equal over all their windows.
3. Of grams with different contexts, one context of each kind goes to the gram's group. Where window hashes say that two of
   them may share a window, the suffixes from there on are put in order by deep-shallow sorting, and the common prefixes of
   neighbours give exactly how far the windows repeat.
4. Each chunk gets its answers, unites the spans of repeated windows and cuts them from its documents.

Where a passage that many documents share begins or ends, contexts mix shared windows with each document's own surroundings,
so one gram can have a context for every document. Grams with more than ``compared`` contexts are therefore counted first.
Their contexts do not meet: each chunk asks about their distinct windows one by one, by two hashes of 64 bits.

Strings are judged on the input: what is cut in one place counts as a repeat for another, so all copies of a passage go.
Work and memory per group are bounded: in it a gram has at most ``compared`` contexts and one for each chunk, a window one
row for each chunk. A passage that very many documents share is one row per chunk.

Defined results: null text is empty; texts shorter than ``length`` stay whole; repeated rows remove each other if long
enough; a null id is carried like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tillscope.llm.common import bucketed, mixed, packed, runs, small_batches, task_ids, texts_of, unpacked, written
from tillscope.llm.shingles import prefix_hashes
from tillscope.llm.suffix_sort import SHALLOW_WORDS, sort_suffixes
from tillscope.llm.words import forget

UNIQUE, REPEATED, OPEN, SHOWN = range(4)  # answers on a context: alone; repeats; to be compared; repeats and is compared with


@dataclass(frozen=True)
class Repeats:
    """Bytes of a repeated string, bytes of a gram, bytes of a chunk, bytes of text behind one group of grams, contexts compared at once.

    A gram with more contexts than these has its windows judged one by one.
    """

    length: int = 200
    gram: int = 64
    chunk_bytes: int = 8 << 20
    group_bytes: int = 24 << 20
    compared: int = 20_000


_SPAN = 500_000  # bytes hashed at once; places in them fit 20 bits
_PLACE = np.uint64((1 << 20) - 1)
_NONE = np.zeros(0, dtype=np.uint64)


@dataclass
class Anchors:
    """Anchors of a chunk: first and last window and the anchor itself (places in the chunk), hashes of gram and context."""

    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    gram: np.ndarray
    context: np.ndarray


def _segments(sizes: np.ndarray, repeats: Repeats) -> Iterator[list[tuple[int, int]]]:
    """Runs of (from, to) in a chunk, each run at most _SPAN bytes; a longer document comes in overlapping parts."""
    run, held, begin = [], 0, 0
    for size in sizes.tolist():
        for at in range(0, max(1, size - repeats.length + 1), _SPAN // 2):
            end = min(size, at + _SPAN // 2 + repeats.length - 1)
            if end - at >= repeats.length:
                if held + end - at > _SPAN:
                    yield run
                    run, held = [], 0
                run.append((begin + at, begin + end))
                held += end - at
        begin += size
    if run:
        yield run


def find_anchors(data: np.ndarray, sizes: np.ndarray, repeats: Repeats) -> Anchors:
    """The anchors of all windows of a chunk's documents, in the order of their windows."""
    out: list[tuple[np.ndarray, ...]] = []
    width = repeats.length - repeats.gram + 1
    for run in _segments(sizes, repeats):
        part = np.concatenate([data[a:b] for a, b in run])
        p, down = prefix_hashes(part)
        grams = mixed((p[repeats.gram :] - p[: -repeats.gram]) * down[: len(part) - repeats.gram + 1])
        least, size = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < width:
            least = np.minimum(least[: size - width], least[width - size :])
        lengths = np.array([b - a for a, b in run])
        begins = np.cumsum(lengths) - lengths
        windows = lengths - repeats.length + 1
        window = np.arange(windows.sum()) + np.repeat(begins - (np.cumsum(windows) - windows), windows)
        owner = np.repeat(np.arange(len(run)), windows)
        anchor = (least[window] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
        first, last, at = window[new], window[np.r_[new[1:], len(window)] - 1], anchor[new]
        context = (p[last + repeats.length] - p[first]) * down[first]
        context = mixed(context + mixed(((at - first) * 1_024 + (last - first)).astype(np.uint64)))
        shift = np.array([a for a, _ in run])[owner[new]] - begins[owner[new]]
        out.append((first + shift, last + shift, at + shift, grams[at], context))
    return Anchors(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else Anchors(*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2)


def _pack(repeats: Repeats, kind: pa.DataType):  # noqa: ANN202
    def row(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        blob = zstandard.compress(b"".join(texts), 1)
        sizes = packed(np.array([len(t) for t in texts], dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.binary()), pa.array([blob], pa.binary())], ["chunk", "ids", "sizes", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        numbers, ids, texts, held = task_ids(), [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t) + 64
                if held >= repeats.chunk_bytes:
                    yield row(next(numbers), ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield row(next(numbers), ids, texts)

    return run


def _open(blob: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(blob), dtype=np.uint8), unpacked(sizes, "<i8")


def _distinct(anchors: Anchors, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (gram, context) of a chunk by group: the first anchor of each, the group, how many there are, and each anchor's row."""
    group = (anchors.gram % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((anchors.context, anchors.gram, group))
    gram, context = anchors.gram[order], anchors.context[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])] if len(order) else np.zeros(0, bool)
    row = np.zeros(len(order), dtype=np.int64)
    row[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return order[heads], group[order[heads]], np.diff(np.r_[heads, len(order)]), row


def _crowds(repeats: Repeats):  # noqa: ANN202
    """Grams that have more than one context in a chunk, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, blob in zip(*(batch.column(c).to_pylist() for c in ("sizes", "blob")), strict=True):
                anchors = find_anchors(*_open(blob, sizes), repeats)
                grams, contexts = np.unique(anchors.gram[_distinct(anchors, 1)[0]], return_counts=True)
                some = contexts > 1
                yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(contexts[some].astype(np.int64))], ["gram", "contexts"])

    return run


def split_hot(anchors: Anchors, hot: np.ndarray) -> tuple[Anchors, Anchors]:
    """The anchors at other grams, and those at the hot ones."""
    at = np.isin(anchors.gram, hot)
    return tuple(Anchors(*(x[side] for x in (anchors.first, anchors.last, anchors.at, anchors.gram, anchors.context))) for side in (~at, at))


@dataclass
class Windows:
    """Windows of a chunk's distinct contexts of hot grams: each one's context, place in it and kind; two hashes, group and plurality of each kind."""

    owner: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    keys: np.ndarray
    group: np.ndarray
    several: np.ndarray
    row: np.ndarray  # the distinct context of each anchor


def windows_of(data: np.ndarray, hot: Anchors, length: int, groups: int) -> Windows:
    """The windows of the hot anchors; kinds are numbered by group."""
    heads, _, count, row = _distinct(hot, 1)
    windows = hot.last[heads] - hot.first[heads] + 1
    sizes, upto = windows + length - 1, np.cumsum(windows)
    owner = np.repeat(np.arange(len(heads)), windows)
    place = np.arange(len(owner)) - np.repeat(upto - windows, windows)
    keys, ends, a = np.empty((2, len(owner)), dtype=np.uint64), np.cumsum(sizes), 0
    while a < len(heads):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + _SPAN, side="right")))
        part = np.concatenate([data[x : x + n] for x, n in zip(hot.first[heads[a:b]], sizes[a:b], strict=True)])
        some = slice(upto[a] - windows[a], upto[b - 1])
        at = (ends[a:b] - sizes[a:b] - ends[a] + sizes[a])[owner[some] - a] + place[some]
        for key, letters in zip(keys, (part, part ^ np.uint8(0xA5)), strict=True):
            p, down = prefix_hashes(letters)
            key[some] = mixed((p[at + length] - p[at]) * down[at])
        a = b
    group = (keys[0] % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((keys[1], keys[0], group))
    sort = keys[:, order]
    new = np.r_[True, (sort[:, 1:] != sort[:, :-1]).any(axis=0)] if len(order) else np.zeros(0, bool)
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    return Windows(owner, place, kind, sort[:, new], group[order[new]], np.bincount(kind, count[owner]) > 1, row)


def _ask_windows(repeats: Repeats, hot: np.ndarray, groups: int):  # noqa: ANN202
    """One row for each chunk and group of windows: the windows of hot grams the chunk holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "blob")), strict=True):
                data, lengths = _open(blob, sizes)
                found = windows_of(data, split_hot(find_anchors(data, lengths, repeats), hot)[1], repeats.length, groups)
                there = np.unique(found.group)
                for some in np.array_split(there, 1 + len(found.group) // _SPAN):
                    bounds = [np.searchsorted(found.group, some, side=s).tolist() for s in ("left", "right")]
                    rows = [(g, chunk, found.keys[:, a:b].tobytes(), found.several[a:b].tobytes()) for g, a, b in zip(some.tolist(), *bounds, strict=True)]
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["group", "chunk", "keys", "several"])

    return run


def _answer_windows(asked: pd.DataFrame) -> pd.DataFrame:
    """For each window asked about in a group: whether it repeats."""
    keys = np.concatenate([np.frombuffer(x, dtype=np.uint64).reshape(2, -1) for x in asked["keys"]], axis=1)
    several = np.frombuffer(b"".join(asked["several"]), dtype=bool)
    order = np.lexsort(keys)
    sort = keys[:, order]
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.cumsum(np.r_[True, (sort[:, 1:] != sort[:, :-1]).any(axis=0)]) - 1
    repeated = ((np.bincount(kind) > 1) | (np.bincount(kind, several) > 0))[kind]
    cuts = np.cumsum([len(x) for x in asked["several"]])[:-1]
    return pd.DataFrame({"chunk": asked["chunk"], "group": asked["group"], "kind": 2, "body": [packed(x) for x in np.split(repeated, cuts)]})


def _hot_spans(data: np.ndarray, hot: Anchors, answers: pd.DataFrame, length: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows of the runs of repeated windows at a chunk's hot anchors."""
    found = windows_of(data, hot, length, groups)
    repeated = np.zeros(len(found.group), dtype=bool)
    for g, body in zip(answers["group"], answers["body"], strict=True):
        repeated[slice(*np.searchsorted(found.group, [g, g + 1]))] = unpacked(body, "?")
    bit = repeated[found.kind]
    joined = bit[1:] & bit[:-1] & (found.owner[1:] == found.owner[:-1])
    begin, end = np.flatnonzero(bit & ~np.r_[False, joined][: len(bit)]), np.flatnonzero(bit & ~np.r_[joined, False][: len(bit)])
    stretches = np.bincount(found.owner[begin], minlength=int(found.row.max(initial=-1)) + 1)
    many = stretches[found.row]
    anchor = np.repeat(np.arange(len(many)), many)
    run = (np.cumsum(stretches) - stretches)[found.row[anchor]] + np.arange(len(anchor)) - np.repeat(np.cumsum(many) - many, many)
    return hot.first[anchor] + found.place[begin[run]], hot.first[anchor] + found.place[end[run]]


def _ask(repeats: Repeats, groups: int, hot: np.ndarray = _NONE):  # noqa: ANN202
    """One row for each chunk and group: the grams and contexts the chunk holds, but for hot grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "blob")), strict=True):
                anchors, _ = split_hot(find_anchors(*_open(blob, sizes), repeats), hot)
                heads, group, count, _ = _distinct(anchors, groups)
                rows = [(g, chunk, heads[a:b], count[a:b]) for g, a, b in zip(*(x.tolist() for x in runs(group)), strict=True)]
                data = [[r[0] for r in rows], [r[1] for r in rows], [anchors.gram[r[2]].tobytes() for r in rows], [anchors.context[r[2]].tobytes() for r in rows], [(r[3] > 1).tobytes() for r in rows]]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], ["group", "chunk", "gram", "context", "several"])

    return run


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """For each context asked about in a group of grams: alone, repeated, to be compared, or repeated and compared with."""
    asked = asked.sort_values("chunk")
    gram, context = (np.frombuffer(b"".join(asked[c]), dtype=np.uint64) for c in ("gram", "context"))
    several = np.frombuffer(b"".join(asked["several"]), dtype=bool)
    order = np.lexsort((context, gram))
    g, c = gram[order], context[order]
    new_gram = np.r_[True, g[1:] != g[:-1]]
    new_class = new_gram | np.r_[True, c[1:] != c[:-1]]
    class_of, gram_of = np.cumsum(new_class) - 1, np.cumsum(new_gram) - 1
    repeated = (np.bincount(class_of) > 1) | (np.bincount(class_of, several[order]) > 0)
    classes = np.bincount(gram_of[new_class])
    alone = np.bincount(gram_of[new_class], ~repeated) > 0
    compare = ((classes > 1) & alone)[gram_of]
    code = np.where(repeated[class_of], np.where(compare & new_class, SHOWN, REPEATED), np.where(compare, OPEN, UNIQUE)).astype(np.uint8)
    codes = np.empty_like(code)
    codes[order] = code
    cuts = np.cumsum([len(x) // 8 for x in asked["gram"]])[:-1]
    return pd.DataFrame({"chunk": asked["chunk"], "group": asked["group"], "kind": 0, "body": [packed(x) for x in np.split(codes, cuts)]})


def _codes(anchors: Anchors, answers: pd.DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The answer on each distinct context of a chunk, and the distinct context of each anchor."""
    heads, group, _, row = _distinct(anchors, groups)
    codes = np.zeros(len(heads), dtype=np.uint8)
    begin, end = (np.searchsorted(group, answers["group"].to_numpy(), side) for side in ("left", "right"))
    for a, b, body in zip(begin, end, answers["body"], strict=True):
        codes[a:b] = unpacked(body, "u1")
    return codes, row


def _show(repeats: Repeats, groups: int, hot: np.ndarray = _NONE):  # noqa: ANN202
    """One row for each chunk and group: the contexts to be compared."""

    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, chunk in chunks.iterrows():
            data, sizes = _open(chunk["blob"], chunk["sizes"])
            anchors, _ = split_hot(find_anchors(data, sizes, repeats), hot)
            heads, group, _, _ = _distinct(anchors, groups)
            codes, _ = _codes(anchors, answers, groups)
            shown = np.flatnonzero(codes >= OPEN)
            for g, first, last in zip(*runs(group[shown]), strict=True):
                at = shown[first:last]
                h = heads[at]
                body = [data[a : b + repeats.length] for a, b in zip(anchors.first[h], anchors.last[h], strict=True)]
                numbers = np.stack([h, anchors.at[h] - anchors.first[h], anchors.last[h] - anchors.first[h] + 1, codes[at] == OPEN]).astype(np.int32)
                rows.append((int(g), chunk["chunk"], anchors.gram[h].tobytes(), packed(numbers), packed(np.concatenate(body))))
        return pd.DataFrame(rows, columns=["group", "chunk", "gram", "numbers", "body"])

    return run


def shared_windows(data: np.ndarray, begin: np.ndarray, before: np.ndarray, windows: np.ndarray, wanted: np.ndarray, gram: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, first window, last window) for the windows of wanted contexts that another context holds too.

    Context i lies at ``begin[i]`` in ``data`` and has ``windows[i]`` windows, the anchor ``before[i]`` bytes from its start.
    """
    p, down = prefix_hashes(data)
    owner = np.repeat(np.arange(len(begin)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[owner] + place
    # Equal windows lie equally far before their anchors.
    key = mixed((p[at + length] - p[at]) * down[at] + mixed(gram[owner] + (before[owner] - place).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    equal = k[1:] == k[:-1]
    twin = np.zeros(len(key), dtype=bool)
    twin[order] = np.r_[False, equal] | np.r_[equal, False]
    kind = np.empty(len(key), dtype=np.int64)
    kind[order] = np.cumsum(np.r_[True, ~equal]) - 1 if len(key) else 0
    todo = twin & wanted[owner]
    pending = np.flatnonzero(todo & ~np.r_[False, todo[:-1] & (owner[1:] == owner[:-1])])  # where runs of such windows begin
    out: list[tuple[int, int, int]] = []
    done = np.zeros(len(key), dtype=bool)
    by_kind = order[np.argsort(kind[order], kind="stable")]
    bounds = np.searchsorted(kind[by_kind], np.arange(kind.max() + 2)) if len(kind) else np.zeros(1, np.int64)
    end = begin + windows + length - 1
    while len(pending):
        kinds = np.unique(kind[pending])
        members = np.concatenate([by_kind[bounds[x] : bounds[x + 1]] for x in kinds])
        suffixes, common = sort_suffixes(data, at[members], end[owner[members]], min(SHALLOW_WORDS, length // 8))
        best = np.zeros(len(members), dtype=np.int64)
        best[suffixes] = np.maximum(common, np.r_[common[1:], 0])
        reach = dict(zip(members.tolist(), best.tolist(), strict=True))
        later = []
        done[pending] = True
        for w in pending.tolist():
            shared = reach[w] - length + 1
            last = min(place[w] + shared, windows[owner[w]]) - 1
            if shared > 0:
                out.append((int(owner[w]), int(place[w]), int(last)))
            # What the longest match leaves of the run is looked at from its own beginning.
            follow = w + max(shared, 1)
            while follow < len(owner) and owner[follow] == owner[w]:
                if todo[follow]:
                    if not done[follow]:
                        later.append(follow)
                    break
                follow += 1
        pending = np.unique(np.array(later, dtype=np.int64))
    return out


def _compare(repeats: Repeats):  # noqa: ANN202
    """In one group of grams: which windows of open contexts another context shares."""

    def run(shown: pd.DataFrame) -> pd.DataFrame:
        gram = np.frombuffer(b"".join(shown["gram"]), dtype=np.uint64)
        numbers = np.concatenate([unpacked(x, "<i4").reshape(4, -1) for x in shown["numbers"]], axis=1).astype(np.int64)
        data = np.concatenate([unpacked(x, "u1") for x in shown["body"]])
        chunk = np.repeat(shown["chunk"].to_numpy(), [len(x) // 8 for x in shown["gram"]])
        sizes = numbers[2] + repeats.length - 1
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(gram, kind="stable")
        found: list[tuple[int, int, int]] = []
        cut = 0
        while cut < len(order):
            stop = min(cut + repeats.compared, len(order))
            if stop < len(order):  # a gram's contexts stay together
                stop = int(np.searchsorted(gram[order], gram[order[stop - 1]], side="right"))
            some = order[cut:stop]
            own = np.concatenate([data[begin[i] : begin[i] + sizes[i]] for i in some])
            lengths = sizes[some]
            found += [(int(some[i]), a, b) for i, a, b in shared_windows(own, np.cumsum(lengths) - lengths, numbers[1][some], numbers[2][some], numbers[3][some] > 0, gram[some], repeats.length)]
            cut = stop
        spans = np.array(found, dtype=np.int64).reshape(-1, 3)
        spans = spans[np.argsort(chunk[spans[:, 0]], kind="stable")]
        rows = []
        for c, first, last in zip(*runs(chunk[spans[:, 0]]), strict=True):
            s = spans[first:last]
            rows.append((c, int(shown["group"].iat[0]), 1, packed(np.stack([numbers[0][s[:, 0]], s[:, 1], s[:, 2]]).astype(np.int32))))
        return pd.DataFrame(rows, columns=["chunk", "group", "kind", "body"])

    return run


def _spans(anchors: Anchors, codes: np.ndarray, row: np.ndarray, compared: pd.DataFrame, length: int, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans of a chunk that repeated windows cover, in order. Spans of different documents never touch: windows lie inside one."""
    whole = np.isin(codes[row], (REPEATED, SHOWN))
    first, last = [anchors.first[whole]], [anchors.last[whole]]
    for body in compared["body"]:
        at, a, b = unpacked(body, "<i4").reshape(3, -1).astype(np.int64)
        first.append(anchors.first[at] + a)
        last.append(anchors.first[at] + b)
    if more:
        first.append(more[0])
        last.append(more[1])
    begin, end = np.concatenate(first), np.concatenate(last) + length
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order]


def _cut(repeats: Repeats, groups: int, hot: np.ndarray, hot_groups: int, with_text: bool, schema: pa.Schema):  # noqa: ANN202
    """The documents of a chunk without the repeated spans."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        given, rows = answers.to_pandas(), []
        for chunk in chunks.to_pylist():
            data, sizes = _open(chunk["blob"], chunk["sizes"])
            anchors, crowded = split_hot(find_anchors(data, sizes, repeats), hot)
            codes, row = _codes(anchors, given[given["kind"] == 0], groups)
            more = _hot_spans(data, crowded, given[given["kind"] == 2], repeats.length, hot_groups)
            begin, end = _spans(anchors, codes, row, given[given["kind"] == 1], repeats.length, more)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            cuts = np.searchsorted(begin, bounds)
            raw = data.tobytes()
            for i, doc_id in enumerate(chunk["ids"]):
                spans: list[list[int]] = []
                for a, b in zip(begin[cuts[i] : cuts[i + 1]].tolist(), end[cuts[i] : cuts[i + 1]].tolist(), strict=True):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                body = b"".join(raw[a:b] for a, b in zip([bounds[i], *(s[1] for s in spans)], [*(s[0] for s in spans), bounds[i + 1]], strict=True))
                size = bounds[i + 1] - bounds[i]
                rows.append((doc_id, size, size - len(body), len(spans), hashlib.sha256(body).hexdigest(), *([body.decode("utf-8", "ignore")] if with_text else [])))
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def remove_repeats(documents: DataFrame, repeats: Repeats | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of (doc_id, text).

    ``with_text`` adds what is kept as text; bytes of a letter that a cut has split are dropped with it.
    """
    small_batches(documents.sparkSession)
    repeats = repeats or Repeats()
    key = documents.schema["doc_id"].dataType
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(8, total // repeats.group_bytes), max(8, total // repeats.chunk_bytes)
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(key)), T.StructField("sizes", T.BinaryType()), T.StructField("blob", T.BinaryType())])
    chunks = bucketed(documents.select("doc_id", "text").mapInArrow(_pack(repeats, to_arrow_type(key)), schema), "chunk", buckets, "chunks")

    crowds = chunks.select("sizes", "blob").mapInArrow(_crowds(repeats), "gram long, contexts long")
    crowds = crowds.groupBy("gram").agg(F.sum("contexts").alias("contexts")).where(F.col("contexts") > repeats.compared).toPandas()
    hot = crowds["gram"].to_numpy(np.int64).view(np.uint64)
    # A context has at most length - gram + 1 windows, a window two hashes.
    hot_groups = max(8, int(crowds["contexts"].sum()) * (repeats.length - repeats.gram + 1) * 16 // repeats.group_bytes)
    asked = chunks.select("chunk", "sizes", "blob").mapInArrow(_ask(repeats, groups, hot), "group int, chunk long, gram binary, context binary, several binary")
    answers = written(asked.groupBy("group").applyInPandas(_answer, "chunk long, group int, kind int, body binary"), "answers")
    shown = chunks.select("chunk", "sizes", "blob").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    shown = shown.applyInPandas(_show(repeats, groups, hot), "group int, chunk long, gram binary, numbers binary, body binary")
    compared = written(shown.groupBy("group").applyInPandas(_compare(repeats), "chunk long, group int, kind int, body binary"), "compared")
    both = answers.unionByName(compared)
    if len(hot):
        windows = chunks.select("chunk", "sizes", "blob").mapInArrow(_ask_windows(repeats, hot, hot_groups), "group int, chunk long, keys binary, several binary")
        both = both.unionByName(written(windows.groupBy("group").applyInPandas(_answer_windows, "chunk long, group int, kind int, body binary"), "windows"))
    result = T.StructType([T.StructField("doc_id", key), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        result = result.add("text", T.StringType())
    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_cut(repeats, groups, hot, hot_groups, with_text, to_arrow_schema(result)), result)


def cut_repeats(documents: DataFrame, repeats: Repeats | None = None) -> DataFrame:
    """The documents with repeated passages cut from their texts; every other column passes through. No row is dropped.

    A null text becomes an empty one.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    cut = remove_repeats(documents.select(F.struct(*others).alias("doc_id"), "text"), repeats, with_text=True)
    return cut.select("doc_id.*", "text").select(*[F.col(f"`{c}`") for c in documents.columns])
