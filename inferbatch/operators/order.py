"""Ordered computations (row numbers, running sums, previous values) without one hot task.

A window partitioned by a group puts the whole group into one task, which breaks as soon
as one file, job or series holds a large share of the rows. Here the total order
(group columns, then order columns) is cut into balanced ranges first. The cut points come
from a small, deterministic sample, so the range a row falls into is a plain expression
that gives the same answer in every scan and every retry. Windows then run per
(group, range), and what earlier ranges of the same group contribute is added afterwards.
A cut point lies inside at most one group, so at most `ranges - 1` such carried rows exist;
that is the proof behind the broadcast of the carry table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "__range"
SAMPLE_PER_RANGE = 40
MIN_ROWS = 1024
HASH_SPACE = 1 << 31


def _key(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])


def cut_points(
    df: DataFrame, columns: Sequence[str], ranges: int, min_rows: int = MIN_ROWS
) -> tuple[list[str], T.DataType]:
    """Sorted cut points (as JSON) of the order over `columns`, at most `ranges - 1` of them.

    The sample keeps the keys whose hash falls below a threshold: about `SAMPLE_PER_RANGE`
    keys per range, however large the input is, and the same keys in every run. Inputs of
    fewer than `min_rows` rows per range get fewer ranges.
    """
    keyed = df.select(_key(columns).alias("k"))
    key_type = keyed.schema["k"].dataType
    rows = keyed.count()
    ranges = min(ranges, rows // max(1, min_rows))
    if ranges <= 1:
        return [], key_type
    below = min(HASH_SPACE, HASH_SPACE * SAMPLE_PER_RANGE * ranges // rows + 1)
    sample = keyed.filter(F.pmod(F.xxhash64("k"), F.lit(HASH_SPACE)) < below)
    # The sample is small by construction: one shuffle into one sorted partition.
    ordered = sample.distinct().repartition(1).sortWithinPartitions("k").select(F.to_json("k").alias("j"))
    keys = [r["j"] for r in ordered.collect()]
    picks = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    return list(dict.fromkeys(picks)), key_type


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row instead of once per reference."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def range_of(columns: Sequence[str], points: list[str], key_type: T.DataType) -> Column:
    """Number of cut points at or below the row's key, found in two short array scans."""
    if not points:
        return F.lit(0)
    step = max(1, math.isqrt(len(points)))

    def literal(some: list[str]) -> Column:
        return F.from_json(F.lit("[" + ",".join(some) + "]"), T.ArrayType(key_type))

    fine, coarse = literal(points), literal(points[step - 1 :: step])

    def place(key: Column) -> Column:
        def inside(block: Column) -> Column:
            near = F.slice(fine, block * step + 1, F.lit(step))
            return block * step + F.size(F.filter(near, lambda p: p <= key))

        return _bind(F.size(F.filter(coarse, lambda p: p <= key)), inside)

    return _bind(_key(columns).cast(key_type), place)


def with_range(
    df: DataFrame, group: Sequence[str], order: Sequence[str], ranges: int | None = None, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Add the range number of each row in the order (group, order).

    Group and order columns together should be unique: equal keys always share a range. A
    NULL group is a group like any other; order columns must not be NULL.
    """
    columns = [*group, *order]
    ranges = ranges or default_ranges(df)
    points, key_type = cut_points(df, columns, ranges, min_rows)
    return df.withColumn(RANGE, range_of(columns, points, key_type))


def default_ranges(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name where NULL equals NULL; the left keys stay."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    inclusive: bool = False,
    ranges: int | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Running sums per group in order, before the row (or including it)."""
    cut = with_range(df, group, order, ranges, min_rows)
    within = W.partitionBy(*group, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = cut.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(n) for n, v in sums.items()])

    totals = cut.groupBy(*group, RANGE).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    earlier = W.partitionBy(*group).orderBy(RANGE)
    carried = totals.select(
        *group,
        RANGE,
        F.lag(F.lit(1)).over(earlier).alias("__later"),
        *[
            F.sum(f"__t_{n}").over(earlier.rowsBetween(W.unboundedPreceding, -1)).alias(f"__c_{n}")
            for n in sums
        ],
    ).filter("__later IS NOT NULL")
    joined = join_null_safe(rows, F.broadcast(carried), [*group, RANGE], "left")
    kept = [c for c in df.columns if c not in sums]
    return joined.select(
        *kept, *[(F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n) for n in sums]
    )


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    ranges: int | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """1-based row number per group in order."""
    return running_sums(df, group, order, {name: F.lit(1).cast("long")}, True, ranges, min_rows)


def previous_value(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str = "previous",
    ranges: int | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Value of the preceding row of the same group, NULL on a group's first row."""
    cut = with_range(df, group, order, ranges, min_rows)
    within = W.partitionBy(*group, RANGE).orderBy(*order)
    rows = cut.select("*", F.lag(value).over(within).alias("__in"), F.row_number().over(within).alias("__rn"))
    last = cut.groupBy(*group, RANGE).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    carried = last.select(
        *group,
        F.col(RANGE),
        F.lag("__last").over(W.partitionBy(*group).orderBy(RANGE)).alias("__carry"),
    ).filter("__carry IS NOT NULL")
    joined = join_null_safe(rows, F.broadcast(carried), [*group, RANGE], "left")
    value_before = F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__in"))
    return joined.select(*[c for c in df.columns if c != name], value_before.alias(name))


