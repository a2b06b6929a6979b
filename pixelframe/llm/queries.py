"""Queries of this subpackage, one per operator, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import bpe, html_text, language, licenses, minhash, mixing, quality, sharding, token_counts, topk
from pixelframe.llm.common import table

#: Bytes of text in a shard; small, so that the query splits on small tables too.
SHARD_BYTES = 1 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded and decoded; digests of both."""
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digests=True)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates: three-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most SHARD_BYTES."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on texts and verdicts on their hosts."""
    return quality.report(table(spark, sf_dir, "documents")).drop("host_rate")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that are known licences."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_license_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and paragraphs of whole texts that are known licences."""
    return licenses.parts(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole texts, learned from the rows that are not held out."""
    return language.report(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole texts."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' target weights."""
    return mixing.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_bpe, op2_topk, op3_minhash, op4_sharding, op5_quality, op6_licenses, op6_license_parts, op7_language, op8_html, op9_token_counts, op10_mixing,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.oracle(5), "op3_minhash": minhash.oracle(3, 85), "op4_sharding": sharding.oracle(SHARD_BYTES), "op5_quality": quality.oracle(), "op6_licenses": licenses.oracle(), "op10_mixing": mixing.ORACLE}
