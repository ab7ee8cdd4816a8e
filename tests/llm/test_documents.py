"""Operators on documents against brute force, on awkward rows and empty tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from corpora import documents, key, texts, with_clashes, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import bpe, katz, minhash_dedup, packing, sharding, suffix_dedup, suffix_sort, toxicity, warc
from tillscope.llm.common import components
from tillscope.session import shared_folder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def data(text):
    return (text or "").encode()


# --- WARC


def pages(spark):
    rows = [(5, "http://a/\r\nb c", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", ""), (8, "u", None), (8, "u", None), (None, "v", "<p>é</p>"), (40, "w", "z" * 200_000), (1 << 40, "w", "q")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_warc_round_trip(spark):
    df = pages(spark)
    for archive in (warc.Archive(), warc.Archive(shard_bytes=300, least_shards=3, roll_bytes=200)):
        rows = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(with_clashes(df), archive).collect()), key=lambda r: tuple(map(key, r)))
        digest = lambda h: base64.b32encode(hashlib.sha1(data(h)).digest()).decode()
        p, e = digest("<p>é</p>"), digest("")
        assert rows == sorted([(None, 9, p, "response", None), (3, 9, p, "response", None), (5, 9, p, "revisit", 3), (8, 0, e, "response", None), (8, 0, e, "revisit", 8), (9, 0, e, "revisit", 8),
                               (40, 200_000, digest("z" * 200_000), "response", None), (1 << 40, 1, digest("q"), "response", None)], key=lambda r: tuple(map(key, r)))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_files_are_the_same_whoever_writes_them(spark):
    def files(df):
        return sorted(tuple(r) for r in warc.write_archives(df, warc.new_folder(spark), warc.Archive(shard_bytes=300, least_shards=3, roll_bytes=300)).collect())

    assert files(pages(spark)) == files(pages(spark).repartition(7, "html"))


def test_warc_shards_follow_the_bytes_of_any_ids(spark):
    draw = random.Random(4)
    sizes = {draw.randrange(-(1 << 63), 1 << 63) if draw.random() < 0.5 else draw.randrange(1 << 62, (1 << 62) + 5_000): draw.randrange(500, 3_000) for _ in range(3_000)}
    archive = warc.Archive(shard_bytes=100_000, least_shards=3)
    rows = spark.createDataFrame(list(sizes.items()), "page_id long, size long")
    ahead, want, last = 0, [], -1
    for page_id in sorted(sizes):
        if ahead // 100_000 != last:
            want.append(page_id)
            last = ahead // 100_000
        ahead += sizes[page_id]
    assert warc.shard_starts(rows.repartition(5), archive) == want == warc.shard_starts(rows.repartition(3, "size"), archive)
    assert warc.shard_starts(rows.limit(0), archive) == []


def test_warc_spreads_pages_without_ids(spark):
    rows = [(i, f"u{i}", "x" * 100) for i in range(300)] + [(None, f"v{i % 150}", "y" * 100) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    manifest = warc.write_archives(pages, folder, warc.Archive(least_shards=6))
    counts = [r["n"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert len(counts) == 6 and max(counts) < 150
    assert warc.read_archives(spark, folder).where("page_id is null and record_type = 'response'").count() == 300


def test_warc_refuses_changed_payload():
    record = warc.record(1, "u", b"payload", None, 0, "2000-01-01T00:00:00Z")
    assert warc.parse(record)[0] == 1
    with pytest.raises(ValueError, match="digest"):
        warc.parse(record.replace(b"payload", b"poyload"))


# --- near-duplicates


def brute_sets(rows):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_minhash(rows):
    sets, label = brute_sets(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), x in zip(rows, label, strict=True) if x == label[i] and d is not None]
        smallest = min(ids, default=None)
        out.append((doc, len(sets[i]), smallest, doc == smallest))
    return sorted(out, key=lambda r: tuple(map(key, r)))


def test_minhash_equals_brute_force(spark):
    for rows in (texts(), texts(3)[:12]):
        found = minhash_dedup.near_duplicates(with_clashes(documents(spark, rows)))
        assert sorted((tuple(r) for r in found.collect()), key=lambda r: tuple(map(key, r))) == brute_minhash(rows)
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_minhash_takes_apart_a_chain_and_a_crowd(spark):
    """Near copies of near copies, whose ends are not alike, and a crowd about one text: one component each."""
    rng = random.Random(4)
    text = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(25):
        rows.append((i, " ".join(text)))
        text = list(text)
        text[4 * i % 100] = f"c{i}"
        text[(4 * i + 2) % 100] = f"d{i}"
    crowd = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    for i in range(80):
        other = list(crowd)
        other[rng.randrange(100)] = f"x{i}"
        rows.append((100 + i, " ".join(other)))
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(documents(spark, rows), minhash_dedup.Tensor(block=8)).collect()}
    assert found == {d: c for d, _, c, _ in brute_minhash(rows)}


def test_minhash_tells_strays_from_a_family(spark):
    """One large family, and strays of similarity about 0.6 to 0.8 to it and to each other: some join it, some stay."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join([*base[:119], f"x{i}"])))
    for i, share in enumerate((0.70, 0.74, 0.78, 0.80, 0.82, 0.84, 0.86, 0.88, 0.90) * 3):
        keep = int(120 * share)
        rows.append((200 + i, " ".join([*base[:keep], *(f"s{i}q{k}" for k in range(120 - keep))])))
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(documents(spark, rows), minhash_dedup.Tensor(block=16)).collect()}
    assert found == {d: c for d, _, c, _ in brute_minhash(rows)} and len(set(found.values())) > 2


def test_keep_one_keeps_one_row_of_each_component(spark):
    rows = texts()
    kept = minhash_dedup.keep_one(documents(spark, rows)).collect()
    expected = {c for _, n, c, _ in brute_minhash(rows) if n}
    assert sorted(r["doc_id"] for r in kept if WORD.search(r["text"] or "") and r["doc_id"] is not None) == sorted(x for x in expected if x is not None)
    assert sum(not WORD.search(r["text"] or "") for r in kept) == 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1_000, 1_000 + i) for i in range(1, 200)] + [(2_000, 2_000)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1_000, 1_200), 1_000)}


# --- repeated passages


def brute_repeats(rows, length):
    starts = Counter(data(t)[i : i + length] for _, t in rows for i in range(len(data(t)) - length + 1))
    out = []
    for doc, text in rows:
        b, gone = data(text), set()
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        out.append((doc, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return sorted(out, key=lambda r: tuple(map(key, r)))


@pytest.mark.parametrize("repeats", [suffix_dedup.Repeats(), suffix_dedup.Repeats(length=24, gram=7, chunk_bytes=3_000, group_bytes=1_000, compared=5)])
def test_repeats_equal_brute_force(spark, repeats):
    rows = [(d, t[:9_000] if t else t) for d, t in texts()]
    found = suffix_dedup.remove_repeats(with_clashes(documents(spark, rows)), repeats)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: tuple(map(key, r))) == brute_repeats(rows, repeats.length)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=8))
def test_shared_windows_in_periodic_texts(parts):
    """All steps of the suffix array but the shuffles, on texts that repeat themselves."""
    import pandas as pd

    repeats = suffix_dedup.Repeats(length=9, gram=4, compared=3)
    raw = [p.encode() for p in parts]
    sizes, blob = np.array([len(r) for r in raw]), np.frombuffer(b"".join(raw), np.uint8)
    anchors = suffix_dedup.find_anchors(blob, sizes, repeats)
    asked = pd.DataFrame([r for b in suffix_dedup._ask(repeats, 2)(iter([_chunk(blob, sizes)])) for r in b.to_pylist()])
    answers = pd.concat([suffix_dedup._answer(g) for _, g in asked.groupby("group")]) if len(asked) else pd.DataFrame({"group": [], "body": []})
    shown = suffix_dedup._show(repeats, 2)(_chunk(blob, sizes).to_pandas(), answers)
    compared = pd.concat([suffix_dedup._compare(repeats)(g) for _, g in shown.groupby("group")]) if len(shown) else pd.DataFrame({"body": []})
    codes, row = suffix_dedup._codes(anchors, answers, 2)
    begin, end = suffix_dedup._spans(anchors, codes, row, compared, repeats.length)
    gone = sorted({i for a, b in zip(begin, end, strict=True) for i in range(a, b)})
    starts = Counter(r[i : i + 9] for r in raw for i in range(len(r) - 8))
    expected, offset = set(), 0
    for r in raw:
        for i in range(len(r) - 8):
            if starts[r[i : i + 9]] > 1:
                expected.update(range(offset + i, offset + i + 9))
        offset += len(r)
    assert gone == sorted(expected)


def _chunk(blob, sizes):
    import pyarrow as pa
    import zstandard

    from tillscope.llm.common import packed

    return pa.RecordBatch.from_pydict({"chunk": [0], "sizes": [packed(sizes.astype(np.int64))], "blob": [zstandard.compress(blob.tobytes())]})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=0, max_size=120), min_size=1, max_size=20), st.integers(0, 60))
def test_suffix_order_and_common_prefixes(parts, shared):
    raw = [("x" * shared + p).encode() for p in parts]
    blob = np.frombuffer(b"".join(raw) or b"\0", np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    order, common = suffix_sort.sort_suffixes(blob, ends - [len(r) for r in raw], ends)
    ordered = [raw[i] for i in order]
    assert ordered == sorted(raw)
    for a, b, c in zip(ordered, ordered[1:], common[1:], strict=False):
        true = suffix_sort.common_prefix(a, b)
        assert c == true or (c == 0 and true <= 40)


def test_many_documents_sharing_a_passage_do_not_meet_in_one_group(spark, monkeypatch):
    """A line of 120 bytes in the same surroundings nowhere, and a passage of 300 bytes: each gives grams a context per document."""
    rng = random.Random(5)
    own = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    line, passage = own(120), own(300)
    rows = [(i, f"{own(rng.randint(150, 260))}{line if i % 2 else passage}{own(rng.randint(150, 260))}") for i in range(600)]
    repeats = suffix_dedup.Repeats(chunk_bytes=40_000, group_bytes=1_000, compared=50)
    tables = {}

    def kept(df, label, write=suffix_dedup.written):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(suffix_dedup, "written", kept)
    found = suffix_dedup.remove_repeats(documents(spark, rows), repeats)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: tuple(map(key, r))) == brute_repeats(rows, repeats.length)
    met = Counter()
    for r in tables["answers"].where("kind = 0").collect():
        met[r["group"]] += len(suffix_dedup.unpacked(r["body"], "u1"))
    # Contexts of a group: those of one gram, and the few of the others that share its number.
    assert max(met.values()) < 2 * repeats.compared
    assert "windows" in tables


def test_cut_repeats_passes_columns_and_rows(spark):
    rows = texts()
    found = suffix_dedup.cut_repeats(documents(spark, rows))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"] and found.count() == len(rows)
    assert {r["doc_id"]: r["text"] for r in found.collect()}[8] == "one two"


# --- sharding


def test_sharding(spark):
    rows = texts()
    found = sharding.shard_documents(with_clashes(documents(spark, rows))).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in found) == sorted((d or -1, len(data(t)) + 1, zlib.crc32(data(t))) for d, t in rows)
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in found)
    assert len({(r["doc_id"], r["shard"]) for r in found}) == len({d for d, _ in rows})
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_a_changed_weight_moves_keys_only_between_changed_subtrees(spark):
    from dataclasses import replace

    tree = sharding.balanced_tree(12)
    heavier = [replace(s, weight=3.0) if s.shard == 5 else s for s in tree]
    ids = spark.range(20_000)
    df = ids.select(sharding.place(ids["id"], tree).alias("a"), sharding.place(ids["id"], heavier).alias("b"))
    rows = df.collect()
    where = {s.shard: (s.region, s.rack) for s in tree}
    for a, b in {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]}:
        assert where[b][0] == where[5][0]  # only into the region that grew
        assert where[a][0] != where[b][0] or where[b] == where[5]  # inside it only into the rack that grew
        assert where[a] != where[b] or b == 5  # inside that only into the shard
    assert 0.15 < sum(r["b"] == 5 for r in rows) / len(rows) < 0.28


# --- packing and BPE


def test_packing_matches_added_tokens_as_written(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = list(enumerate(["a <|ENDOFTEXT|> b", "A <|EndOfText|>B C", "a <|endoftext|> B", "X<|STARTOFTEXT|><|endoftext|>y", "<|endoftext|>|<|ENDOFTEXT|>", "A B"]))
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(documents(spark, rows), path).collect()
    for i, text in rows:
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(pieces, key=lambda r: r["start"]) if r["doc_id"] == i])
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_packing(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    plan = packing.Packing(chunk_tokens=9_000, step=3, known_words=40)
    pieces = packing.piece_digests(packing.pack(with_clashes(documents(spark, rows)), path, plan)).collect()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces if r["doc_id"] == i)
        assert [s for s, *_ in own] == [sum(n for _, n, *_ in own[:k]) for k in range(len(own))]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and total == len(ids) for s, n, c, total in own) and sum(n for _, n, *_ in own) == len(ids)
    for s in {r["sequence_id"] for r in pieces}:
        own = sorted((r["offset"], r["length"], r["sequence_size"]) for r in pieces if r["sequence_id"] == s)
        assert [o for o, *_ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
        size = sum(n for _, n, _ in own)
        assert size == own[0][2] <= 4_096 and size & (size - 1) == 0
    assert packing.pack(documents(spark, []), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=60))
def test_arrangement_fills_every_sequence(lengths):
    sequences = packing.arrange(lengths, (4_096, 1_024, 256))
    pieces = sorted(p for _, ps in sequences for p in ps)
    for d, n in enumerate(lengths):
        own = [(s, k) for doc, s, k in pieces if doc == d]
        assert [s for s, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))] and sum(k for _, k in own) == n
    assert all(sum(k for *_, k in ps) == size and size & (size - 1) == 0 for size, ps in sequences)
    groups = packing.step_groups(sequences, 4)
    assert all(c <= 4 for c in Counter(groups).values())


def test_byte_bpe(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts())]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    found = {r["doc_id"]: r for r in bpe.encode_digests(with_clashes(documents(spark, rows)), path, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = np.array(encoding.encode_ordinary(t or ""), dtype="<u4")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[i]["decoded_sha256"] == hashlib.sha256(data(t)).hexdigest()
    assert bpe.encode_digests(documents(spark, []), path, public_tokenizers.PATTERN).count() == 0


# --- Katz


def brute_katz(rows, k=5):
    """The model word by word, from the formulas alone: scores, and a function giving each context's total probability."""
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<begin>", *t], t, strict=False))
    total = sum(one.values())
    d1, d2 = (katz.good_turing([sum(c == r for c in n.values()) for r in range(1, k + 2)]) for n in (one, two))
    cut = lambda d, c: d[c] * c if c <= k else c
    left = sum(c - cut(d1, c) for c in one.values())
    scale = 1 if left > 0 else total / (total + 1)
    word = lambda w: cut(d1, one[w]) / total * scale if one[w] else (left / total if left > 0 else 1 / (total + 1)) if total else 1.0
    after = {}
    for (v, w), c in two.items():
        after.setdefault(v, {})[w] = c

    def pair(v, w):
        seen = after.get(v, {})
        n = sum(seen.values())
        if not n:
            return word(w)
        rest = sum(c - cut(d2, c) for c in seen.values())
        shrink = 1 if rest > 0 else n / (n + 1)
        if w in seen:
            return cut(d2, seen[w]) / n * shrink
        return (rest / n if rest > 0 else 1 / (n + 1)) / (1 - sum(word(x) for x in seen)) * word(w)

    out = []
    for (d, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in t)
        score = sum(math.log10(pair(v, w)) for v, w in zip(["<begin>", *t], t, strict=False))
        out.append((d, h, len(t), sum(one[w] > 0 for w in t), total, base, score))
    everything = [*one, "never seen"]
    return out, lambda v: sum(pair(v, w) for w in everything), after


def test_katz_equals_the_formulas_and_sums_to_one(spark):
    rows = texts() + [(100 + i, t) for i, (_, t) in enumerate(texts(8))]
    expected, mass, after = brute_katz(rows)
    assert all(abs(mass(v) - 1) < 1e-9 for v in [*list(after)[:40], "<begin>", "unseen"])
    for plan in (katz.Katz(), katz.Katz(chunk_bytes=4_000, group_bytes=2_000, hot_share=0.01)):
        found = [tuple(r) for r in katz.score(with_clashes(documents(spark, rows)), plan).collect()]
        order = lambda r: (key(r[0]), *r[1:5], round(r[5], 6))
        for a, b in zip(sorted(found, key=order), sorted(expected, key=order), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_katz_without_training_or_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = katz.score(documents(spark, [(held, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)
    assert katz.score(documents(spark, [])).count() == 0


# --- toxicity


def test_toxicity_learns_and_holds_out(spark, sf):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        w = words(rng, 60).split()
        for bad in ("idiot", "loser") if i % 3 == 0 else ():
            w[rng.randrange(60)] = bad
        rows.append((i, " ".join(w)))
    docs = documents(spark, [*rows, (9_001, ""), (9_002, None), (None, "idiot loser")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (12_345, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.classify(with_clashes(docs), labels).collect()
    marks = {r["doc_id"]: r for r in found}
    assert len(found) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [(marks[i]["predicted"], int(i % 3 == 0)) for i, _ in rows if marks[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) > 0
    assert marks[9_001]["predicted"] == marks[9_002]["predicted"] == 0
    assert marks[7]["held_out"] == (zlib.crc32(b"7") % 4 == 2)
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(documents(spark, []), labels).count() == 0


def brute_score(model, text):
    """The score of one text, window by window."""
    s = model.settings
    pack = lambda content: zstandard.ZstdCompressor(level=s.level, write_content_size=False, write_checksum=False, write_dict_id=False,
                                                    dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    plain, marked = pack(model.ordinary), pack(model.toxic + model.ordinary)
    raw = b" " + data((text or "").translate(LOWER)) + b" "
    found = list(re.finditer(rb"[^\x00-\x20]+", raw))
    distances = []
    for at in range(0, max(1, len(found) - 3), 3) if found else ():
        window = raw[found[at].start() - 1 : found[min(at + 5, len(found) - 1)].end() + 1]
        distances.append(len(plain.compress(window)) - len(marked.compress(window)))
    top = sorted(distances or [0], reverse=True)
    reached = [sum(d >= c for d in top) for c in model.cuts]
    mean = lambda x: sum(x) / len(x)
    features = [top[0], mean(top[:3]), mean(top[:6]), mean(top), *(math.sqrt(n / len(top)) for n in reached), *(math.log1p(n) for n in reached)]
    total = model.weights[-1] + sum(w * (x - m) / d for w, x, m, d in zip(model.weights[:-1], features, model.mean, model.spread, strict=True))
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(2)
    train = [(i, " ".join([*words(rng, 30).split(), *(["scumbag", "moron"] if i % 2 else []), *words(rng, 30).split()])) for i in range(300)]
    model = toxicity.fit_labels(documents(spark, train), spark.createDataFrame([(i, i % 2) for i, _ in train], "doc_id long, toxic int"))
    assert b"scumb" in model.toxic and model.weights
    rows = [*texts(), (900, "You MORON\x00 scumbag"), (901, "scumbag " * 90_000), (902, words(rng, 12) + "\n\n moron"), (903, "moron")]
    got = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(documents(spark, rows).select("doc_id", "text"), model).collect()}
    assert len(got) == len(set(rows))
    for (_, text), score in got.items():
        assert math.isclose(score, brute_score(model, text), rel_tol=1e-9, abs_tol=1e-12)


def test_toxicity_takes_every_piece_with_evidence_and_whole_ordinary_words():
    insults = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}insult" for i in range(150)]
    rng = random.Random(3)
    ordinary = [words(rng, 40).encode() for _ in range(400)]
    toxic = [(words(rng, 20) + " " + " ".join(f"{insult} {w}" for w in words(rng, 40).split())).encode() for insult in insults for _ in range(2)]
    found = toxicity._typical(toxic, ordinary).split()
    assert len(b" ".join(found)) > 700 and all(any(x.encode().startswith(piece) for piece in found) for x in insults)
    content = toxicity._common([b"aaa bbb ccc", b"bbb ccc", b"ccc"], 9)
    assert content == b"bbb ccc" and toxicity._common([b"aaa bbb ccc"], 11) == b"aaa bbb ccc"


def test_shared_folder_is_named(spark):
    assert shared_folder(spark)
