"""The corpus pipeline: raw documents to tokens, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordshield.llm import bpe, mixing, quality, simhash, substring
from recordshield.llm.common import table
from recordshield.llm.queries import MIX_MOST, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, vocabulary
from recordshield.session import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in repeated spans leave all texts but the first; a text may become empty, no document goes."""
    return substring.dedup_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none, once or twice; texts of varied words are likelier to be drawn."""
    return mixing.mix_documents(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST, MIX_SEED, mixing.variety(F.col("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the whole text, their number and digest, and the digest of the bytes decoded from them."""
    path, pattern = vocabulary()
    return bpe.encode_table(docs, path, pattern, ["ids", "n_tokens", "ids_sha256", "decoded_sha256"], keep=["doc_id", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", source_mix),
    ("byte-level bpe", tokens),
]

#: The learned rules, XXH64 fingerprints and byte-level merges cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = store(docs, name.replace(" ", "-"))
    return docs
