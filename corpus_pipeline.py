"""From raw documents to packed training sequences, by four of the operators in loomlake.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlake.llm import near_dedup, packing, quality, suffix_dedup
from loomlake.llm.util import cut, read_table

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
WINDOW = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return quality.filter_documents(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return near_dedup.filter_documents(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier go from the texts."""
    return suffix_dedup.remove_repeats(docs)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as pieces of full sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), WINDOW)


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", minhash_near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("mixture_packing", mixture_packing)]

#: SQL can't express tokens or whole-corpus suffix matches; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs
