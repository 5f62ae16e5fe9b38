"""Exact duplicates: combine locally, merge salted digest groups, then combine the salt winners.

Texts are equal when they are identical after lower-casing A-Z. Every grouping stage has the
whole normalised text in its key, so equality is decided on content and the digest only spreads
the rows. Spark's partial aggregate combines the copies inside each task, the first shuffle
spreads one digest over `salts` tasks, and the second one receives at most `salts` rows of any
digest, so a text that fills a third of the table never meets in one task.

Defined results: a null text counts as empty; a null id never wins against another id, and rows
of a group that has only null ids all stay; repeated rows (same id, same text) share one
decision; an empty table gives an empty result; other columns are left alone, whatever their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferbatch.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 16
HOT_SHARE = 2000
NAME = ["digest", "check", "len"]


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and null as empty; other letters stay as they are."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, check, length, keep_id (largest id) and group_size."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        normalised(F.col(text_col)).alias("norm"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias("salt"),
    ).withColumn("digest", _digest(F.col("norm")))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest", "norm").agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    # From here on a text is named by its digest, length and a second hash. Should two different
    # texts ever agree in all three, the query stops instead of merging them.
    named = whole.select("digest", F.xxhash64("norm").alias("check"), F.length("norm").alias("len"), "id", "n")
    return named.groupBy("digest", "check", "len").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share a digest")).cast("bigint"))
        .otherwise(F.max("id"))
        .alias("keep_id"),
        F.sum("n").alias("group_size"),
    )


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(F.col(text_col))
    names = docs.select(
        F.col(id_col).alias("doc_id"),
        _digest(norm).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.length(norm).alias("len"),
    )
    groups = materialize(duplicate_groups(docs, id_col, text_col, salts), "text-groups")
    rows = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") * HOT_SHARE > rows
    # Fewer than HOT_SHARE groups can be that large, so this side is small at any size of the table.
    hot = groups.filter(is_hot).select(*NAME, F.lit(True).alias("hot"))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = names.join(F.broadcast(hot), NAME, "left").withColumn("part", part)
    return spread.join(groups.withColumn("part", F.explode(every)), [*NAME, "part"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = decisions(docs, id_col, text_col, salts).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_sha"))
    same_id = docs[id_col].eqNullSafe(F.col("__gone_id"))
    same_text = F.sha2(normalised(docs[text_col]).cast("binary"), 256) == F.col("__gone_sha")
    return docs.join(gone, same_id & same_text, "left_anti")
