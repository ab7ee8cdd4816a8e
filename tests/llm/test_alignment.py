"""Aligned tokens against the two libraries on whole texts."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import sentencepiece
from corpora import texts, with_clashes, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillscope.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "a", "  a", " a", "a ", "a  b", "\n", "\n\n", " ", "  ", "a\nb", "a \nb", "a\n b", "\na\n", "a\tb c", "ä é x y", "x▁y", "a ▁", "▁", "<|endoftext|> a<s> </s> <unk> <0x41>", "漢字 かな\nか",
    "é\xa0x", "​x y", "a\x00b", "😀 😀😀\n😀", "a\x1c b", "a 　b", "\r\n x\r\ny", "l'été c'est", "don't I'll 12 345", "x" * 3_000, " a", "a\x85b c", "ﬁ x", "a ́b", "﻿a b", "a|b;c,d",
]


def rows():
    rng = random.Random(8)
    long = words(rng, 30_000) + "\n" + words(rng, 10)
    return [*texts(4), *((100 + i, t) for i, t in enumerate(ODD)), (300, long), (301, "the of and " * 2_000)]


def piece_bytes(model, i):
    p = model.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()


def tokens(text, a, model):
    """(id, end) of both tokenizers, by the libraries on the whole text."""
    if not text:
        return [], []
    whole = a.encode(" " + text, add_special_tokens=False)
    x, letters = whole.ids, alignment._byte_letters()
    bytes_a = [bytes(letters[c] for c in t) for t in whole.tokens]
    y = model.encode(text)
    bytes_b = [piece_bytes(model, i) for i in y]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], []
    return (list(zip(i, accumulate(map(len, b)), strict=True)) for i, b in ((x, bytes_a), (y, bytes_b)))


def brute(table):
    a, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    docs, often = [], Counter()
    for i, text in table:
        x, y = map(list, tokens(text, a, model))
        common = sorted({e for _, e in x} & {e for _, e in y})
        groups, links = [], []
        for start, end in zip([0, *common], common, strict=False):
            groups.append("|".join(",".join(str(i) for i, e in side if start < e <= end) for side in ([t for t in x if t[1] > start][: end - start], [t for t in y if t[1] > start][: end - start])))
            links.append((next(i for i, e in x if e == end), next(i for i, e in y if e == end)))
            x, y = [t for t in x if t[1] > end], [t for t in y if t[1] > end]
        docs.append((i, text, groups, links))
        often.update(links)
    best = Counter()
    for (_, b), n in often.items():
        best[b] = max(best[b], n)
    out = []
    for i, text, groups, links in docs:
        x, y = map(list, tokens(text, a, model))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((i, len(x), len(y), len(groups), len(links), sum(often[p] == best[p[1]] for p in links), sum(often[p] for p in links), sha))
    return sorted(out, key=str)


def test_digests_equal_the_libraries(spark):
    table = [r for r in rows() if r[0] is None or r[0] < 300]
    df = with_clashes(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    expected = brute(table)
    assert sum(r[1] == 0 for r in expected) >= 4 and sum(r[3] for r in expected) > 1_000
    for setting in (alignment.Alignment(), alignment.Alignment(known_segments=50, chunk_links=200)):
        found = sorted(map(tuple, alignment.alignment_digests(df, A, B, setting).collect()), key=str)
        assert found == expected


def test_long_texts_keep_their_bytes(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").where("doc_id >= 300")
    a, b = alignment.Byte(A), alignment.Piece(B)
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    for r, (_, text) in zip(alignment.align(df, A, B).orderBy("doc_id").collect(), rows()[-2:], strict=True):
        assert r["a_ids"] == a.encode([" " + text])[0] and r["b_ids"] == model.encode(text)
        ends = [np.cumsum([len(t.bytes[i]) for i in ids]) for t, ids in ((a, r["a_ids"]), (b, r["b_ids"]))]
        common = np.intersect1d(*ends)
        assert [ends[0][c - 1] for c in r["a_cuts"]] == [ends[1][c - 1] for c in r["b_cuts"]] == common.tolist()
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        assert r["b_first"] == (np.searchsorted(ends[1], starts[0], "right")).tolist()
        assert r["b_last"] == (np.searchsorted(starts[1], ends[0], "left") - 1).tolist()


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "▁")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.alignment_digests(df, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}
    assert alignment.alignment_digests(df.limit(0), A, B).count() == 0


ascending = st.lists(st.integers(1, 9), max_size=60).map(lambda x: np.cumsum(np.array(x, np.int64)))


@settings(max_examples=200, deadline=None)
@given(ascending, ascending, st.integers(0, 8))
def test_gallop_and_reach(a, b, early):
    place = np.searchsorted(b, a)
    assert alignment.gallop(a, b, np.maximum(place - early, 0)).tolist() == place.tolist()
    rank, common = alignment.reach(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64))
    assert rank.tolist() == place.tolist() and common.tolist() == np.isin(a, b).tolist()


def test_segments_join_to_the_text():
    for _, text in rows():
        if text:
            assert "".join(alignment._unkeyed(k) for k in alignment.segments(text)) == " " + text
