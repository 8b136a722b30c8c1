"""From raw documents to a tokenised mix: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bandloom.llm import bpe, exact, jaccard, mixing, quality
from bandloom.session import small_batches, stored


#: Smaller than the operator's own: executors also hold what the stages before left in memory.
LIMITS = bpe.Limits(states=75_000, pairs=100_000, pieces=100_000)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and the likelihood ratio against the labelled target."""
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest identifier of each component of documents that share 80% of their 5-word shingles."""
    small_batches(spark)
    return jaccard.one_of_each(docs, jaccard.Join(words=5, least=80, of=100))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` (packed little-endian unsigned 32-bit) and whether the ids decode to the text."""
    small_batches(spark)
    ranks = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded", limits=LIMITS, keep=False)
    return tokens.selectExpr("doc_id", "lang", "source", "n_tokens", "ids", "decoded = coalesce(text, '') AS round_trip")


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("tokenise", tokenise),
]

#: SQL has neither the merges of the last stage nor the components of the third; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
