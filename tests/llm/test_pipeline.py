"""The pipeline on a given table: each stage's decisions, and packing of what is left against its tokens."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import minhash_dedup, suffix_dedup, toxicity
from tillscope.llm.common import table, written


def test_stages_follow_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), f"test-{len(outs)}")
        outs.append(docs)
        assert name and (len(outs) == 4 or docs.columns == columns)
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = toxicity.classify(raw.select("doc_id", "text"), table(spark, sf, "labels", "doc_id", "toxic"))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(outs[0]) == ids(verdict.where("predicted = 0"))
    assert ids(outs[1]) == ids(minhash_dedup.near_duplicates(outs[0]).where("kept"))
    cut = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(outs[1]).collect()}
    texts = {r["doc_id"]: r for r in outs[2].collect()}
    assert set(cut) == set(texts) and any(r["n_removed"] for r in cut.values())
    assert all(r["n_chars"] == len(r["text"]) and (cut[d]["n_removed"] or len(r["text"].encode()) == cut[d]["n_bytes"]) for d, r in texts.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = outs[3].orderBy("doc_id", "start").select("doc_id", "ids", "ids_crc32").collect()
    for d, r in texts.items():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        own = [p for p in pieces if p["doc_id"] == d]
        assert b"".join(p["ids"] for p in own) == ids and all(zlib.crc32(p["ids"]) == p["ids_crc32"] for p in own)


def test_extra_columns_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20).withColumn("__extra", F.lit(1)).withColumn("score", F.lit("s"))
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, out, sf)
            assert out.columns == frame.columns
        assert corpus_pipeline.STAGES[3][1](spark, out, sf).count() >= out.count()


def test_columns_called_like_helpers_keep_their_values(spark, sf):
    """Names that stages use inside, in any case, pass through them with their values."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    names = ["__score", "score", "Score_", "__row", "row", "place", "__place", "bare", "key", "OF", "n", "component"]
    frame = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    out = frame
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, sf)
        assert out.columns == frame.columns
        rows = [r.asDict() for r in out.collect()]
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)


def test_rows_of_one_hash_stay_two_documents(spark, monkeypatch):
    """With every row hash equal, documents are still told apart by id and text."""
    real, components, one = F.xxhash64, minhash_dedup._components, lambda *_: F.lit(7).cast("long")

    def found(documents, tensor):
        out = components(documents, tensor).withColumn("row", one())
        monkeypatch.setattr(minhash_dedup.F, "xxhash64", one)
        return out

    monkeypatch.setattr(minhash_dedup, "_components", found)
    rows = [(1, "one two three four five six"), (2, "other words stand in this text here"), (2, "other words stand in this text here"), (3, None), (3, ""), (None, "a third text with seven words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash_dedup.keep_one(df)
    monkeypatch.setattr(minhash_dedup.F, "xxhash64", real)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], *rows[3:]], key=str)
