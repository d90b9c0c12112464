"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hnsw, licenses, lines, matroska, mixing, pii, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(_table(spark, sf_dir, "documents"))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op3_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(_table(spark, sf_dir, "documents"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(_table(spark, sf_dir, "conversations"))


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """Where this machine keeps the public tokenizers' files; bpe's operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_forced_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_components(_table(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(_table(spark, sf_dir, "documents"))


ALL = (
    op1_license_scan, op2_pii_bootstrap, op3_matroska_packets, op4_toxicity_chain, op5_chat_format, op6_simhash_bktree, op7_bpe_forced_cuts, op8_embedding_hnsw, op9_mix_sources, op10_line_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.license_sql(), "op5_chat_format": chat.CHAT_SQL}
