"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one of ordinary words, and one in which pieces typical of toxic
text stand before the same ordinary words. A text is cut into overlapping windows of a few words; how many bytes fewer a
window takes with the toxic dictionary is its distance. A document's distances (largest, mean of the largest, share
above each calibrated threshold) give one logistic score, fitted on labelled documents that made no dictionary.

Labels are the only thing learned from other than the text. Fitting uses a bounded sample (``Settings.sample``);
scoring covers every byte of every document and is one pass without a shuffle.

Defined results: null and empty texts have one window of zero distance; documents without a label are scored like
others; without labels of both kinds every score is 0; repeated rows and extra columns stay as they are; a label row
that is null, or whose document is missing, teaches nothing; a document with several labels is toxic if one says so.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ASCII_LOWER, small_batches, texts_of
from tillscope.llm.words import forget


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents of each class, at most, that are read to fit, taken by a hash of their id; texts over
    ``longest`` bytes are not among them. The rest sets windows (in words), dictionary sizes and the compression level."""

    sample: int = 3000
    longest: int = 20_000
    window: int = 6
    stride: int = 3
    ordinary_bytes: int = 16_000
    level: int = 6
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic weights over a document's distances."""

    ordinary: bytes
    toxic: bytes
    cuts: tuple[float, ...]
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    settings: Settings


def _word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    gap = np.concatenate([[True], np.frombuffer(text, dtype=np.uint8) <= 32, [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def _distances(settings: Settings, ordinary: bytes, toxic: bytes) -> Callable[[bytes], np.ndarray]:
    """A function from a text to its windows' distances."""
    def packer(content: bytes) -> zs.ZstdCompressor:
        kind = {"dict_data": zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)} if content else {}
        return zs.ZstdCompressor(level=settings.level, write_content_size=False, write_checksum=False, write_dict_id=False, **kind)

    # The toxic pieces come first: what both dictionaries hold then lies equally far from the window and costs the same.
    plain, marked = packer(ordinary), packer(toxic + ordinary)

    def lengths(compressor: zs.ZstdCompressor, windows: zs.BufferWithSegments, n: int) -> np.ndarray:
        return np.fromiter(map(len, compressor.multi_compress_to_buffer(windows)), dtype=np.int64, count=n)

    def of(text: bytes) -> np.ndarray:
        text = b" " + text.translate(ASCII_LOWER) + b" "
        starts, ends = _word_edges(text)
        if not len(starts):
            return np.zeros(1)
        first = np.arange(0, max(1, len(starts) - settings.window + settings.stride), settings.stride)
        first = first[first < len(starts)]
        begin, end = starts[first] - 1, ends[np.minimum(first + settings.window, len(starts)) - 1] + 1
        windows = zs.BufferWithSegments(text, np.stack([begin, end - begin], 1).astype(np.uint64).tobytes())
        return (lengths(plain, windows, len(first)) - lengths(marked, windows, len(first))).astype(np.float64)

    return of


def _features(distances: np.ndarray, cuts: tuple[float, ...]) -> list[float]:
    top = -np.sort(-distances)
    shares = [math.sqrt(float(np.mean(distances >= c))) for c in cuts]
    counts = [math.log1p(float((distances >= c).sum())) for c in cuts]
    return [float(top[0]), float(top[:3].mean()), float(top[:6].mean()), float(distances.mean()), *shares, *counts]


def _typical(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """Word beginnings that toxic text holds far more often than chance allows, the strongest last.

    What counts is how many different words a piece follows, so that a passage copied many times is one piece of evidence.
    The evidence is a log-likelihood ratio; a piece counts once it exceeds what the best of so many pieces would reach by
    chance, and every piece that does is taken. Pieces that begin like one taken already add nothing.
    """
    seen: list[Counter] = []
    sizes: list[int] = []
    for docs in (ordinary, toxic):
        pairs: set[tuple[bytes, bytes]] = set()
        for text in docs:
            words = [w.strip(b".,;:!?()[]\"'") for w in text.translate(ASCII_LOWER).split()]
            pairs.update(zip([b"", *words], words, strict=False))
        counts: Counter = Counter()
        for _, word in pairs:
            if len(word) >= 4:
                counts.update({word[:n] for n in (4, 5, 6, 8, len(word))})
        seen.append(counts)
        sizes.append(len(pairs))
    share = sizes[1] / max(1, sum(sizes))

    def evidence(piece: bytes) -> float:
        a, b = seen[1][piece], seen[0][piece]
        p = a / (a + b)
        return 0.0 if p <= share else a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0.0)

    floor, chosen = math.log(max(2, len(seen[1]))), []
    for _, piece in sorted(((s, x) for x in seen[1] if (s := evidence(x)) >= floor), reverse=True):
        if not any(piece.startswith(x) or x.startswith(piece) for x in chosen):
            chosen.append(piece)
    return b" " + b" ".join(reversed(chosen)) + b" " if chosen else b""


def _common(ordinary: list[bytes], limit: int) -> bytes:
    """The ordinary words most documents hold, the commonest last: as many whole ones as ``limit`` bytes take."""
    seen: Counter = Counter()
    for text in ordinary:
        seen.update(set(text.translate(ASCII_LOWER).split()))
    common = [w for w, _ in sorted(seen.items(), key=lambda x: (x[1], x[0]), reverse=True)]
    taken = int(np.searchsorted(np.cumsum([len(w) + 1 for w in common]), limit + 1, side="right"))
    return b" ".join(reversed(common[:taken]))


def _logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; ``count`` weighs the rows."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (count * p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(len(w)), z.T @ (count * (p - y)) + 0.3 * w)
    return w


def fit(documents: DataFrame, marks: DataFrame, settings: Settings | None = None) -> Model:
    """A model from documents (doc_id, text) and one mark per id (doc_id, toxic). Half the sample makes dictionaries, half calibrates.

    The sample is at most ``sample`` ids of each class, so it may be broadcast; texts over ``longest`` bytes teach nothing.
    """
    settings = settings or Settings()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = None
    for kind in (0, 1):
        some = marks.where(F.col("toxic") == kind).select("doc_id", "toxic", order.alias("o")).orderBy("o", "doc_id").limit(settings.sample)
        ids = some if ids is None else ids.unionByName(some)
    short = documents.where(F.octet_length("text") <= settings.longest).join(F.broadcast(ids), "doc_id")
    rows = short.groupBy("o", "doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    docs = [(r["toxic"], r["text"].encode()) for r in sorted(rows, key=lambda r: (r["o"], r["doc_id"]))]
    make, tune = [d for i, d in enumerate(docs) if i % 2 == 0], [d for i, d in enumerate(docs) if i % 2]
    ordinary = _common([t for k, t in make if not k], settings.ordinary_bytes)
    toxic = _typical([t for k, t in make if k], [t for k, t in make if not k])
    y = np.array([k for k, _ in tune], dtype=np.float64)
    if not toxic or not len(y) or y.min() == y.max():
        return Model(ordinary, b"", (), (), (), (), settings)
    of = _distances(settings, ordinary, toxic)
    found = [of(t) for _, t in tune]
    clean = np.concatenate([d for d, k in zip(found, y, strict=True) if not k])
    # Thresholds that one ordinary window in a hundred, a thousand and ten thousand reaches.
    cuts = tuple(float(x) + 1 for x in np.quantile(clean, [0.99, 0.999, 0.9999]))
    x = np.array([_features(d, cuts) for d in found])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    # The sample holds the classes in other proportions than the labels do; rows are weighed back to the labels' own.
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    count = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum()) * len(y) / (totals[0] + totals[1])
    return Model(ordinary, toxic, cuts, tuple(mean), tuple(spread), tuple(_logistic((x - mean) / spread, y, count)), settings)


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 for each row's whole text. Extra columns pass through."""
    small_batches(df.sparkSession)
    schema = df.withColumn(into, F.lit(0.0)).schema
    mean, spread, weights = map(np.array, (model.mean, model.spread, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        of = _distances(model.settings, model.ordinary, model.toxic)
        for batch in batches:
            if model.weights:
                x = np.array([_features(of(t), model.cuts) for t in texts_of(batch.column(text))]).reshape(batch.num_rows, -1)
                values = 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / spread, np.ones(len(x))] @ weights, -30, 30))) if len(x) else np.zeros(0)
            else:
                values = np.zeros(batch.num_rows)
            names = [n for n in batch.schema.names if n != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values)], [*names, into])

    return df.mapInArrow(run, schema)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no label is learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_labels(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """The model from the labels of the documents that are not held out."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    return fit(documents.select("doc_id", "text"), marks, settings)


def classify(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    settings = settings or Settings()
    model = fit_labels(documents, labels, settings)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
