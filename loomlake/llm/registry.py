"""The operators' queries over whole tables, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import chat, knn_join, licenses, near_dedup, packing, quality, sentencepieces, suffix_dedup, token_counts, warc
from .util import read_table

TOKEN_LIMIT = 512
WINDOW = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents")).select(*quality.RESULT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(read_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_planted(spark, read_table(spark, sf_dir, "conversations")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(read_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), WINDOW)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_chat_format, op4_license_scan, op5_warc_chunks, op6_voronoi_knn, op7_minhash_near_dedup, op8_sentencepiece, op9_token_counts, op10_packing)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_quality_rules": quality.ORACLE_SQL,
        "op3_chat_format": chat.ORACLE_SQL,
        "op5_warc_chunks": warc.ORACLE_SQL,
        "op6_voronoi_knn": knn_join.ORACLE_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
