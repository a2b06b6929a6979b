"""The corpus pipeline: documents by way of five stages to encoded training text.

Each stage works on all rows its predecessor kept, and returns the columns of documents but for the last. Null and empty
texts have no letters and go in the first stage; a null source is a source of its own; repeated rows are near-duplicates of
each other, of which one stays; very long texts are read whole; an empty table gives an empty result; further columns of
documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm import bpe, language, minhash, mixing, quality
from pixelframe.llm.common import scratch, table, written
from pixelframe.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language known, go."""
    return language.keep(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose host is rejected, go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity of 0.8 or more)."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), digests=True)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]
#: Language models and BPE are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and what it wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as folder:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", folder)
    return STAGES[-1][1](spark, docs, sf_dir)
