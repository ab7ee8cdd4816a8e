"""Katz backoff language model: Good-Turing discounted bigrams over unigrams, exactly normalised, trained and evaluated at scale.

A word's probability after another is, where the pair was seen in training, its discounted share of that context; else the
context's backoff weight times the word's own probability, which in turn is its discounted share of all training tokens,
or for a word never seen what the discounts leave over. A context's weight is what its seen pairs leave, divided by what
the words not seen after it weigh, so that the probabilities after every context sum to one.

1. Documents become chunks of local word numbers, written once and bucketed by chunk, so that answers join them without
   moving them again.
2. Each chunk asks the groups of words for the counts of its words; a group adds up what the chunks trained on, stores its
   part of the unigram table and numbers its words, the frequent ones low.
3. Each chunk asks the groups of contexts for its distinct pairs; a group adds up their counts, stores its part of the
   bigram table, and answers counts and what a context's weight needs: how many of its pairs were seen how often, and how
   often the words of these were. Pairs of contexts that hold more than a share of all tokens are dealt over all groups.
4. Each chunk evaluates its documents token by token from the answers.

Everything gathered grows with the corpus; the driver sees counts of counts and at most 1 / ``hot_share`` frequent contexts.

Defined results: null and empty texts and texts of white space are one end token; a null id counts as an empty one when
documents are held out; repeated rows are counted and scored each; extra columns are ignored; without training documents
every word is the unknown one and has probability one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tillscope.llm.common import bucketed, mixed, packed, runs, small_batches, task_ids, texts_of, unpacked, written
from tillscope.llm.shingles import slices, word_hashes

END = np.uint64(0xFFFFFFFFFFFFFFFF)  # stands for the end token among word hashes
BEGIN = 0  # the context of a document's first token; a word as context is its number plus one


@dataclass(frozen=True)
class Katz:
    """Counts up to ``discounted`` are discounted; bytes of text of a chunk and behind a group; the share from which a context is dealt out."""

    discounted: int = 5
    chunk_bytes: int = 16 << 20
    group_bytes: int = 24 << 20
    hot_share: float = 1 / 65_536


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts for counts 0 to k from the numbers of events seen 1 to k + 1 times; index 0 is unused.

    Where the numbers are too sparse for Good and Turing's estimate, a constant is taken from each count instead.
    """
    k = len(n) - 1
    out = np.ones(k + 1)
    if min(n) > 0:
        common = (k + 1) * n[k] / n[0]
        ratio = np.array([(r + 1) * n[r] / (r * n[r - 1]) for r in range(1, k + 1)])
        if common < 1:
            out[1:] = (ratio - common) / (1 - common)
            if ((out[1:] > 0) & (out[1:] < 1)).all():
                return out
    less = min(0.75, n[0] / (n[0] + 2 * n[1])) if n[0] else 0.5
    out[1:] = [(r - less) / r for r in range(1, k + 1)]
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers that fit 32 bits or else 64, packed byte by byte of their places, which packs small ones well."""
    kind = np.uint32 if not len(numbers) or (numbers.min() >= 0 and numbers.max() < 1 << 32) else np.int64
    raw = np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return bytes([raw.shape[1]]) + packed(raw.T)


def _from_planes(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.ascontiguousarray(unpacked(blob[1:], "u1").reshape(width, -1).T)
    return raw.view(np.uint32 if width == 4 else np.int64).ravel()


def _chunks(katz: Katz, kind: pa.DataType):  # noqa: ANN202
    """(chunk, ids, held, sizes, words, tokens): documents as numbers of the chunk's own distinct words."""

    def row(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        parts, sizes = [], []
        for first, last in slices(texts):
            hashes, count = word_hashes(texts[first:last])
            tokens = np.full(len(hashes) + len(count), END, dtype=np.uint64)
            inside = np.ones(len(tokens), dtype=bool)
            inside[np.cumsum(count + 1) - 1] = False
            tokens[inside] = hashes
            parts.append(tokens)
            sizes.append(count + 1)
        words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        blobs = [np.array(held, dtype=bool).tobytes(), packed(np.concatenate(sizes).astype(np.int64)), words.tobytes(), _planes(tokens)]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(kind)), *(pa.array([b], pa.binary()) for b in blobs)], ["chunk", "ids", "held", "sizes", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, held, texts, size = task_ids(), [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t) + 64
                if size >= katz.chunk_bytes:
                    yield row(next(numbers), ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield row(next(numbers), ids, held, texts)

    return run


@dataclass
class _Chunk:
    """A chunk opened: its words, tokens, tokens per document, and which tokens are trained on."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Chunk:
        return cls(np.frombuffer(row["words"], np.uint64), _from_planes(row["tokens"]), unpacked(row["sizes"], "<i8"), np.frombuffer(row["held"], bool))

    @property
    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) by local number, the context -1 at a document's begin; and each token's pair."""
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = self.tokens[:-1]
        key[1:] += 1
        key[np.cumsum(self.sizes) - self.sizes] = 0
        key <<= 32
        key |= self.tokens
        distinct, which = np.unique(key, return_inverse=True)
        return (distinct >> 32) - 1, distinct & 0xFFFFFFFF, which


def _word_group(words: np.ndarray, groups: int) -> np.ndarray:
    return (words % np.uint64(groups)).astype(np.int64)


def _ask_words(groups: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk.of(row)
                counts = np.bincount(chunk.tokens[chunk.trained], minlength=len(chunk.words))
                group = _word_group(chunk.words, groups)
                order = np.argsort(group, kind="stable")
                parts = [(g, order[a:b]) for g, a, b in zip(*(x.tolist() for x in runs(group[order])), strict=True)]
                data = [[g for g, _ in parts], [row["chunk"]] * len(parts), [chunk.words[p].tobytes() for _, p in parts], [_planes(counts[p]) for _, p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["group", "chunk", "words", "counts"])

    return run


_ANSWERS = "chunk long, group int, kind int, a binary, b binary, c binary, totals array<long>"
ANSWER, TABLE, HOT = range(3)


def _totals(counts: np.ndarray, k: int) -> list[int]:
    """Sum, number of positive counts, and how many are 1 to k + 1."""
    seen = counts[counts > 0]
    return [int(seen.sum()), len(seen), *np.bincount(seen[seen <= k + 1], minlength=k + 2)[1:].tolist()]


def _count_words(k: int, groups: int):  # noqa: ANN202
    """A group of words: its part of the unigram table, and each chunk's answer: numbers and counts of its words."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(asked["words"]), np.uint64)
        counts = np.concatenate([_from_planes(c) for c in asked["counts"]]).astype(np.int64)
        words, which = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, which, counts)
        group = int(asked["group"].iat[0])
        number = np.empty(len(words), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(words)) * groups + group
        rows = [(-1, group, TABLE, words[total > 0].tobytes(), _planes(total[total > 0]), b"", _totals(total, k))]
        cuts = np.cumsum([len(w) // 8 for w in asked["words"]])[:-1]
        rows += [(c, group, ANSWER, _planes(number[w]), _planes(total[w]), b"", None) for c, w in zip(asked["chunk"], np.split(which, cuts), strict=True)]
        return pd.DataFrame(rows, columns=["chunk", "group", "kind", "a", "b", "c", "totals"])

    return run


def _word_answers(chunk: _Chunk, answers: pd.DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of each of a chunk's words."""
    group = _word_group(chunk.words, groups)
    number, count = np.zeros(len(chunk.words), np.int64), np.zeros(len(chunk.words), np.int64)
    order = np.argsort(group, kind="stable")
    begin, end = (np.searchsorted(group[order], answers["group"].to_numpy(), side) for side in ("left", "right"))
    for first, last, a, b in zip(begin, end, answers["a"], answers["b"], strict=True):
        number[order[first:last]], count[order[first:last]] = _from_planes(a), _from_planes(b)
    return number, count


def _pair_groups(context: np.ndarray, word: np.ndarray, hot: np.ndarray, groups: int) -> np.ndarray:
    """The group of each pair, by its context, and by the whole pair for a hot one."""
    key = mixed(context.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    key = np.where(hot, mixed(key + word.astype(np.uint64)), key)
    return (key % np.uint64(groups)).astype(np.int64)


@dataclass
class _Dealt:
    """A chunk's distinct pairs by group, those of a context together: what they are, and each token's pair in this order.

    ``heads`` are where runs of one context in one group begin, ``run`` is each pair's run.
    """

    group: np.ndarray
    context: np.ndarray
    word: np.ndarray
    local: np.ndarray
    hot: np.ndarray
    which: np.ndarray

    @classmethod
    def of(cls, chunk: _Chunk, number: np.ndarray, count: np.ndarray, begins: int, limit: float, groups: int) -> _Dealt:
        left, right, which = chunk.pairs()
        context = np.where(left >= 0, number[left] + 1, BEGIN)
        hot = np.where(left >= 0, count[left], begins) > limit
        word = number[right]
        group = _pair_groups(context, word, hot, groups)
        # Pairs come sorted by context, and a stable sort by small numbers is quick.
        order = np.argsort(group.astype(np.uint16) if groups < 1 << 16 else group, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(group[order], context[order], word[order], right[order], hot[order], place[which])

    @property
    def heads(self) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (self.context[1:] != self.context[:-1]) | (self.group[1:] != self.group[:-1])]) if len(self.context) else np.zeros(0, np.int64)


def _ask_pairs(groups: int, begins: int, limit: float):  # noqa: ANN202
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        given, rows = answers.to_pandas(), []
        for row in chunks.to_pylist():
            chunk = _Chunk.of(row)
            number, count = _word_answers(chunk, given, groups)
            pairs = _Dealt.of(chunk, number, count, begins, limit, groups)
            trained = np.bincount(pairs.which[chunk.trained], minlength=len(pairs.word))
            weight, heads = count[pairs.local], pairs.heads
            lengths = np.diff(np.r_[heads, len(pairs.word)])
            # Every group with pairs has heads, so both are cut into the same groups.
            (present, begin, end), (_, head_begin, head_end) = runs(pairs.group), runs(pairs.group[heads])
            for g, a, b, c, d in zip(present.tolist(), begin, end, head_begin, head_end, strict=True):
                own = heads[c:d]
                rows.append((g, row["chunk"], _planes(pairs.context[own]), _planes(lengths[c:d]), _planes(pairs.word[a:b]), _planes(weight[a:b]), _planes(trained[a:b]), packed(pairs.hot[own])))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _PAIRS, strict=True)], schema=_PAIRS)

    return run


_PAIRS = pa.schema([("group", pa.int32()), ("chunk", pa.int64()), *((n, pa.binary()) for n in ("contexts", "runs", "words", "weights", "trained", "hot"))])
_PAIRS_SQL = "group int, chunk long, contexts binary, runs binary, words binary, weights binary, trained binary, hot binary"


def _sums(context: np.ndarray, contexts: int, seen: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """For each context over its seen pairs: pairs seen 1 to k times, the sum of larger counts; the same of the words' counts."""
    out = np.zeros((contexts, 2 * (k + 1)), np.int64)
    some = seen > 0
    for at, values in ((0, seen[some]), (k + 1, weight[some])):
        few = values <= k
        np.add.at(out, (context[some][few], at + values[few] - 1), 1)
        np.add.at(out, (context[some][~few], at + k), values[~few])
    return out


def _unique_pairs(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs by context and word, where each is first, and the pair of each row."""
    if max(context.max(), word.max()) < 1 << 31:  # both fit one number, which sorts quickly
        distinct, first, pair = np.unique(context.astype(np.int64) << 32 | word, return_index=True, return_inverse=True)
        return distinct >> 32, distinct & 0xFFFFFFFF, first, pair
    order = np.lexsort((word, context))
    new = np.r_[True, (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])]
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    return context[first].astype(np.int64), word[first].astype(np.int64), first, pair


def _count_pairs(k: int):  # noqa: ANN202
    """A group of contexts: its part of the bigram table, the sums of hot contexts, and each chunk's answer."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        heads, runs = [_from_planes(x) for x in asked["contexts"]], [_from_planes(x) for x in asked["runs"]]
        context, word = np.concatenate([np.repeat(h, r) for h, r in zip(heads, runs, strict=True)]), np.concatenate([_from_planes(x) for x in asked["words"]])
        distinct_context, distinct_word, first, pair = _unique_pairs(context, word)
        total = np.bincount(pair, np.concatenate([_from_planes(x) for x in asked["trained"]])).astype(np.int64)
        distinct_weight = np.concatenate([_from_planes(x) for x in asked["weights"]])[first].astype(np.int64)
        contexts, context_of = np.unique(distinct_context, return_inverse=True)
        sums = _sums(context_of, len(contexts), total, distinct_weight, k)
        group, seen = int(asked["group"].iat[0]), total > 0
        table_heads = np.flatnonzero(np.r_[True, distinct_context[seen][1:] != distinct_context[seen][:-1]]) if seen.any() else np.zeros(0, np.int64)
        runs_seen = np.diff(np.r_[table_heads, seen.sum()])
        table = _planes(np.stack([distinct_context[seen][table_heads], runs_seen]).ravel())
        rows = [(-1, group, TABLE, table, _planes(distinct_word[seen]), _planes(total[seen]), _totals(total, k))]
        hot = np.unique(np.concatenate([h[unpacked(x, "?")] for h, x in zip(heads, asked["hot"], strict=True)]))
        rows += [(int(h), group, HOT, b"", b"", b"", sums[np.searchsorted(contexts, h)].tolist()) for h in hot]
        cuts = np.cumsum([r.sum() for r in runs])[:-1]
        for number, p, h in zip(asked["chunk"], np.split(pair, cuts), heads, strict=True):
            rows.append((number, group, ANSWER, _planes(total[p]), _planes(sums[np.searchsorted(contexts, h)].T.ravel()), b"", None))
        return pd.DataFrame(rows, columns=["chunk", "group", "kind", "a", "b", "c", "totals"])

    return run


@dataclass(frozen=True)
class Model:
    """What is the same for all documents: training tokens, types, documents, discounts of words and pairs, mass of the unknown word."""

    tokens: int
    types: int
    begins: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    word_scale: float
    unknown: float

    @classmethod
    def of(cls, words: list[int], pairs: list[int], begins: int) -> Model:
        tokens, types, *seen = words
        d1, d2 = good_turing(seen), good_turing(pairs[2:])
        k = len(d1) - 1
        # Without rare words nothing is left over for the unknown one; it then counts as one more token.
        left = sum((1 - d1[r]) * r * seen[r - 1] for r in range(1, k + 1))
        scale = 1.0 if left > 0 else tokens / (tokens + 1)
        return cls(tokens, types, begins, d1, d2, scale, left / tokens if left > 0 else 1 / (tokens + 1))

    def word(self, count: np.ndarray) -> np.ndarray:
        """Probability of words by their training counts."""
        d = self.word_discounts
        return np.where(count > 0, d[np.where(count < len(d), count, 0)] * count / max(self.tokens, 1) * self.word_scale, self.unknown)

    def context(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after each context, the scale of its seen pairs, and its backoff weight."""
        k = len(self.word_discounts) - 1
        r = np.arange(1, k + 1)
        after = (sums[:, :k] * r).sum(axis=1) + sums[:, k]
        left = (sums[:, :k] * r * (1 - self.pair_discounts[1:])).sum(axis=1)
        scale = np.where(left > 0, 1.0, after / (after + 1.0))
        left = np.where(left > 0, left / np.maximum(after, 1), 1 / (after + 1.0))
        known = ((sums[:, k + 1 : 2 * k + 1] * r * self.word_discounts[1:]).sum(axis=1) + sums[:, 2 * k + 1]) / max(self.tokens, 1) * self.word_scale
        return after, scale, np.where(after > 0, left / (1 - known), 1.0)

    def pair(self, count: np.ndarray, after: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Probability of words after a context they were seen after."""
        d = self.pair_discounts
        return d[np.where(count < len(d), count, 0)] * count / np.maximum(after, 1) * scale


def _evaluate(model: Model, hot: dict[int, list[int]], groups: int, limit: float, schema: pa.Schema):  # noqa: ANN202
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        given, out = answers.to_pandas(), []
        for row in chunks.to_pylist():
            chunk = _Chunk.of(row)
            number, count = _word_answers(chunk, given[given["step"] == 0], groups)
            pairs = _Dealt.of(chunk, number, count, model.begins, limit, groups)
            heads = pairs.heads
            seen, sums = np.zeros(len(pairs.word), np.int64), np.zeros((len(heads), 2 * len(model.word_discounts)), np.int64)
            mine = given[given["step"] == 1]
            asked = mine["group"].to_numpy()
            cuts = [np.searchsorted(g, asked, side) for g in (pairs.group, pairs.group[heads]) for side in ("left", "right")]
            for first, last, head, stop, a, b in zip(*cuts, mine["a"], mine["b"], strict=True):
                seen[first:last] = _from_planes(a)
                sums[head:stop] = _from_planes(b).reshape(sums.shape[1], -1).T
            for h in np.flatnonzero(pairs.hot[heads]):
                sums[h] = hot[int(pairs.context[heads[h]])]
            single = model.word(count)
            lengths = np.diff(np.r_[heads, len(pairs.word)])
            after, scale, weight = (np.repeat(x, lengths) for x in model.context(sums))
            value = np.log10(np.where(seen > 0, model.pair(seen, after, scale), weight * single[pairs.local]))
            starts = np.cumsum(chunk.sizes) - chunk.sizes
            base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
            known = np.add.reduceat((count > 0)[chunk.tokens].astype(np.int64), starts)
            out.append((row["ids"], chunk.held, chunk.sizes, known, np.add.reduceat(base[chunk.tokens], starts), np.add.reduceat(value[pairs.which], starts)))
        tables = [pa.table([pa.array(i, schema.field(0).type), pa.array(h), pa.array(n), pa.array(k), pa.array(np.full(len(n), model.tokens)), pa.array(b), pa.array(s)], schema=schema) for i, h, n, k, b, s in out]
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def held_out(doc_id: F.Column) -> F.Column:
    """Documents that are not trained on; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _added(answers: DataFrame, k: int) -> list[int]:
    parts = answers.where(F.col("kind") == TABLE).agg(*(F.sum(F.col("totals")[i]) for i in range(k + 3))).first()
    return [int(x or 0) for x in parts]


def score(documents: DataFrame, katz: Katz | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text)."""
    small_batches(documents.sparkSession)
    katz = katz or Katz()
    k, key = katz.discounted, documents.schema["doc_id"].dataType
    marked = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    size, begins = marked.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    groups, buckets = max(8, (size or 0) // katz.group_bytes), max(8, (size or 0) // katz.chunk_bytes)
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(key)), *(T.StructField(n, T.BinaryType()) for n in ("held", "sizes", "words", "tokens"))])
    chunks = bucketed(marked.mapInArrow(_chunks(katz, to_arrow_type(key)), schema), "chunk", buckets, "tokens")
    by_chunk = chunks.groupBy("chunk")

    asked = chunks.select("chunk", "held", "sizes", "words", "tokens").mapInArrow(_ask_words(groups), "group int, chunk long, words binary, counts binary")
    words = written(asked.groupBy("group").applyInPandas(_count_words(k, groups), _ANSWERS), "unigrams")
    totals = _added(words, k)
    limit = totals[0] * katz.hot_share
    mine = words.where(F.col("kind") == ANSWER).select("chunk", "group", "a", "b")
    asked = by_chunk.cogroup(mine.groupBy("chunk")).applyInArrow(_ask_pairs(groups, begins, limit), _PAIRS_SQL)
    pairs = written(asked.groupBy("group").applyInPandas(_count_pairs(k), _ANSWERS), "bigrams")

    # Hot contexts hold more than ``hot_share`` of the training tokens each, so there are at most 1 / hot_share + 1 of them.
    hot_sums = pairs.where(F.col("kind") == HOT).groupBy("chunk").agg(*(F.sum(F.col("totals")[i]).alias(f"s{i}") for i in range(2 * (k + 1))))
    hot = {r[0]: list(r[1:]) for r in hot_sums.collect()}
    model = Model.of(totals, _added(pairs, k), begins)
    answers = mine.withColumn("step", F.lit(0)).unionByName(pairs.where(F.col("kind") == ANSWER).select("chunk", "group", "a", "b").withColumn("step", F.lit(1)))
    longs, doubles = ("n_tokens", "n_known", "train_tokens"), ("base_score", "score")
    result = T.StructType([T.StructField("doc_id", key), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in longs), *(T.StructField(n, T.DoubleType()) for n in doubles)])
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_evaluate(model, hot, groups, limit, to_arrow_schema(result)), result)
