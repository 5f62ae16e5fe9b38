"""A corpus pipeline: quality, exact and near duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns the
columns of documents; the last one returns the token digests of what is left. Every stage is written
as Parquet below the shared folder and read again, so a lost executor costs part of one stage.

An empty documents table passes every stage as an empty table; how nulls, empty and long texts, ties
and repeated rows are treated is stated by the operator that each stage calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferbatch.llm import bpe, exact_dedup, mixing, ngram_join, quality
from inferbatch.session import apply_defaults, materialize

QUALITY_THRESHOLD = 0.3
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject; it learns from the labelled ones."""
    apply_defaults(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = quality.train(docs, labels.filter(fold != 0), "quality")
    return quality.accepted(docs, model, QUALITY_THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    apply_defaults(spark)
    return ngram_join.one_of_each(docs, width=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix of sources takes them; a partial copy counts its own characters."""
    apply_defaults(spark)
    mixed = mixing.repeated(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars")).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every row of the mix."""
    apply_defaults(spark)
    return bpe.token_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_gam", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("source_mixing", mix_stage),
    ("byte_bpe", token_stage),
]

# The quality classifier and the encoding cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    apply_defaults(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
