"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillscope.llm import alignment, bpe, embed_dedup, katz, minhash_dedup, packing, quality, sharding, suffix_dedup, topk, toxicity, vector_codes, warc
from tillscope.llm.common import table


def op1_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.every_twentieth(table(spark, sf, "embeddings", "vec_id", "embedding"))


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages", "page_id", "url", "html")).drop("file")


def op3_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf, "embeddings", "vec_id", "embedding"))


def op4_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf, "documents", "doc_id", "text"))


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents", "doc_id", "text"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf, "documents", "doc_id", "text"))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.piece_digests(pieces)


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents", "doc_id", "text")
    return bpe.encode_digests(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_katz(spark: SparkSession, sf: str) -> DataFrame:
    return katz.score(table(spark, sf, "documents", "doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels", "doc_id", "toxic"))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf, "embeddings", "vec_id", "embedding", "label"))


def op12_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.verdicts(table(spark, sf, "documents", "doc_id", "text", "lang", "source"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents", "doc_id", "text")
    return alignment.alignment_digests(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_REGISTERED = (
    op1_top_k, op2_warc, op3_embedding_dedup, op4_minhash_dedup, op5_suffix_dedup, op6_sharding, op7_packing, op8_byte_bpe, op9_katz,
    op10_toxicity, op11_vector_codes, op12_quality_rules, op13_alignment,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in _REGISTERED
}

ORACLES: dict[str, str] = {"op1_top_k": topk.ORACLE, "op3_embedding_dedup": embed_dedup.ORACLE, "op4_minhash_dedup": minhash_dedup.ORACLE,
                           "op11_vector_codes": vector_codes.ORACLE, "op12_quality_rules": quality.ORACLE}
