"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import (
    block_names,
    byte_bpe,
    chat,
    packing,
    pii,
    quality,
    repair,
    simhash,
    token_scan,
    url_trust,
    vptree,
    whitening,
    wrappers,
)

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op3_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judged(_table(spark, sf_dir, "pages"))


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(_table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(_table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS))


def op8_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents")).drop("kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(_table(spark, sf_dir, "documents"))


def op11_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_planted(_table(spark, sf_dir, "conversations")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_digests(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_personal_data": op2_personal_data,
    "op3_url_trust": op3_url_trust,
    "op4_wrapper_induction": op4_wrapper_induction,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_vantage_point_trees": op8_vantage_point_trees,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_incremental_whitening": op11_incremental_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_structure_repair": op13_structure_repair,
}

ORACLES = {"op8_vantage_point_trees": vptree.ORACLE, "op10_exact_dedup": block_names.ORACLE}
