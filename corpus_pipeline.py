"""From raw documents to packed training sequences: a toxicity filter, two deduplications, and packing.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one pieces of sequences. Columns that documents
have beside the usual ones pass through. ``run`` writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import minhash_dedup, packing, suffix_dedup, toxicity
from tillscope.llm.common import free_names, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of documents that are not held out.

    Null and empty texts are scored like others and stay unless their score is too high; repeated rows fare alike; a null id is
    never learned from; an empty table, or one without labels of both classes, loses nothing.
    """
    settings = toxicity.Settings()
    model = toxicity.fit_labels(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), settings)
    (score,) = free_names(docs.columns, "score")
    return toxicity.score(docs, model, into=score).where(F.col(score) < settings.threshold).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Documents without words (null, empty, blank) all stay; of repeated rows one stays; a null id comes after every other.
    """
    return minhash_dedup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand anywhere else are cut; ``n_chars`` follows the text.

    Null texts become empty ones; a text that repeats as a whole may become empty and stays a row.
    """
    cut = suffix_dedup.cut_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids and a checksum of these. Null and empty texts are one end id each."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

# Compression lengths, suffix sorting and a tokenizer's merges have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
