"""Mix sources to target weights: capped water-filling, then seeded repetitions.

Sources share a budget in proportion to their weights, but none above `cap` times its own size;
what a capped source leaves is shared again by weight until no source is above its cap. A source
whose target is r times its size gives floor(r) whole repetitions of every document. The fractional
repetition, rounded to whole words, goes through the documents in a seeded order: each gives all its words
until the last one gives just those that are missing, so a source ends within half a word of its target.

The running sums behind that need no task of a whole source: rows are range-partitioned by source and
seeded order and written, sums are taken inside every (partition, source), and those of the partitions before
are added, one row per partition and source.

A partial copy of a document is its text up to the end of its last taken word. Rows of one id, source and text are
interchangeable: where only some of them are repeated once more, the further copies are of one of the rows.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own and
comes last; sources of size 0 have target 0; documents without words follow the whole repetitions only;
repeated rows are rows like any others; an empty table gives an empty result; other columns
are left alone, whatever their name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inferbatch.llm.sizes import broadcast_if_small
from inferbatch.session import materialize, small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
# Copies of one row are written in runs of at most so many.
RUN = 4096


def ranked_sources(sizes: DataFrame, label: str = "mix-sources") -> DataFrame:
    """Number the sources by code point, null last, without sorting them in one task.

    They are range-partitioned, numbered inside each partition, and shifted by the number of
    sources before it; only one count per partition reaches the driver.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last())
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), label)
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    if not before:
        return ranged.select("*", F.lit(0).cast("bigint").alias("rank")).drop("part")
    shift = ranged.sparkSession.createDataFrame(before, "part int, before bigint")
    order = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        ranged.withColumn("at", F.row_number().over(order))
        .join(shift, "part")
        .select("source", "source_size", (F.col("before") + F.col("at") - 1).alias("rank"))
    )


def water_fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add each source's `target`. Every round is one aggregate that returns a single row."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1)
    filled = materialize(
        sources.select("*", weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "mix-weights"
    )
    total = filled.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("most") < F.lit(level) * F.col("weight")
        row = filled.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, level = row["n"], float(total - row["held"]) / float(row["free"])
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return filled.select("source", "rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, digest, size, source_size, target, whole (repetitions), part (words
    of the fractional repetition), taken (words). `digest` is a hash of the text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _digest(text_col))
    # The number tells equal rows apart; it is fixed by writing it.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(water_fill(ranked_sources(sizes), weights, cap), "mix-plan")
    plan = plan.select(F.col("source").alias("plan_source"), "rank", "source_size", "target")
    rows = rows.join(broadcast_if_small(plan, 96), F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")
    gap = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("bigint")
    order = ["key", "doc_id", "size", "digest", "row"]
    rows = rows.withColumns({"key": key, "whole": whole}).withColumn("gap", gap)
    ranged = rows.repartitionByRange("rank", *order).withColumn("at", F.spark_partition_id())
    ranged = materialize(ranged, "mix-order")
    earlier = W.partitionBy("rank").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("rank", "at").agg(F.sum("size").alias("s"))
    sums = sums.select("rank", "at", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = F.sum("size").over(W.partitionBy("rank", "at").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    # One row per partition and source: broadcast as long as that is small.
    sums = broadcast_if_small(materialize(sums, "mix-sums"), 16)
    summed = ranged.withColumn("inside", inside).join(sums, ["rank", "at"])
    left = F.col("gap") - F.col("before") - F.col("inside") + F.col("size")
    part = F.greatest(F.lit(0), F.least("size", left)).cast("bigint")
    return summed.withColumn("part", part).select(
        "doc_id", "source", "digest", "size", "source_size", "target", "whole", "part",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
    )


def _digest(text_col: str) -> Column:
    return F.xxhash64(text_col).alias("digest")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        ends = (next(islice(re.finditer(WORD, t), k - 1, None)).end() for t, k in zip(texts, counts))
        return pd.Series([t[:end] for t, end in zip(texts, ends)], dtype=object)

    return cut(text, n)


def repeated(
    docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents as `mix` repeats them, with all their columns; the text of a partial copy is cut."""
    same = ["doc_id", "source", "digest", "size"]
    units = decisions.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("words"), F.max("whole").alias("whole"))
    full = (F.col("words") == F.col("n") * F.col("size")) & (F.col("words") > 0)
    units = units.withColumn("copies", F.col("whole") + F.when(full, 1).otherwise(0))
    # At most one unit of a source is taken in part.
    rest = F.when(full, 0).otherwise(F.col("words"))
    units = units.filter("copies > 0 OR words > 0").select(
        F.struct("doc_id", "source", "digest").alias("__unit"), F.col("copies").alias("__copies"), F.col("size").alias("__size"), rest.alias("__rest")
    )
    units = materialize(units, "mix-units")
    on = (
        docs[id_col].eqNullSafe(F.col("__unit.doc_id"))
        & docs[source_col].eqNullSafe(F.col("__unit.source"))
        & (F.xxhash64(docs[text_col]) == F.col("__unit.digest"))
    )
    mine = [docs[c] for c in docs.columns]
    joined = docs.join(units.filter("__copies > 0"), on)
    copies = joined.select(*mine, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
    # The further copies of a unit taken in part: whole ones in runs, and one that is cut.
    some = small_side(units.filter("__rest > 0"))
    ends = docs.join(some, on).select("__unit", "__size", "__rest", F.struct(*mine).alias("__row"))
    ends = materialize(ends.groupBy("__unit", "__size", "__rest").agg(F.first("__row").alias("__row")), "mix-ends")
    count = F.floor(F.col("__rest") / F.col("__size"))
    runs = ends.withColumn("__n", count).filter("__n > 0").withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / RUN))))
    last = F.least(F.lit(RUN), F.col("__n") - F.col("__run") * RUN)
    further = runs.withColumn("__k", F.explode(F.sequence(F.lit(1), last.cast("int")))).select("__row.*")
    cut = ends.withColumn("__n", F.col("__rest") % F.col("__size")).filter("__n > 0").select("__row", "__n")
    text = first_words(F.col("__row")[text_col], F.col("__n"))
    cut = cut.select(*[text.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
    return copies.union(further).union(cut)
