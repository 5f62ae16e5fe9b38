"""Hard negatives: exact inner-product search pruned by length buckets and sorted coordinate lists.

An anchor's positives are its best rows of the same label; the negatives of a positive are the best rows of
other labels whose score lies in a band below the positive's. Components become integers first, so every
score is an exact integer and ties are broken by the smaller id.

All rows are written once in the order of (label, length). A task reads its part of them in length
buckets: rows of one label and dimension whose lengths differ by a tenth at most, up to `bucket_rows` of
them. A bucket holds one sorted list per coordinate of its rows scaled to length one. For an anchor and the
least score that still matters to it, the bucket's greatest length gives the least cosine c, and a row whose
cosine is c or more has its coordinate f in

    [q_f c - r, q_f c + r],  r = sqrt((1 - q_f^2) (1 - c^2)),

widened to the end of the scale where q_f (or -q_f) is c or more. The lists of the anchor's focus
coordinates, its largest ones, turn these ranges into places; the candidate sets are intersected, and only
their rows are multiplied out and compared exactly. What matters rises while a task goes on: below the
weakest of the best rows a list already has, nothing counts. No list of candidates is capped.

Anchors meet all rows in waves of at most `wave_bytes`, the bound of what is sent to every task and of what
reaches the driver: an id, a label and a vector per anchor, then its positives. Each wave reads the rows
twice, once for the positives and once for the negatives; tasks return at most the asked number of rows per
list, and Spark merges them.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part;
nor do empty vectors. Vectors of different length are never compared. Rows that share an id are one entry of
a list, with the best score that qualifies; an anchor id with several rows is one anchor, its smallest
(label, vector). An anchor is neither its own positive nor its own negative. Without a row in its band a
positive has no row in the result; so has a positive of negative score. Integer components beyond what keeps a
score within a long count as that bound. An empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inferbatch.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# Percent of the positive's score between which a negative's score lies.
BAND = (50, 95)
BUCKET_ROWS = 2048
WAVE_BYTES = 8 << 20
# The shortest row of a bucket has at least this share of the length of its longest one.
LENGTH_SHARE = 0.9
FOCUS = 3
BLOCK_ANCHORS = 128
SLACK = 1e-9
# Below this bound sums of products are exact as doubles.
EXACT = 2**53


@dataclass(frozen=True)
class Anchors:
    """Anchors of one wave, label and dimension: what a task needs to compare them."""

    ids: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    focus: np.ndarray
    focus_values: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray) -> Anchors:
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        unit = vectors / np.where(lengths == 0, 1, lengths)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        return Anchors(ids, vectors, lengths, focus, np.take_along_axis(unit, focus, 1))

    def part(self, at: slice) -> Anchors:
        return Anchors(self.ids[at], self.vectors[at], self.lengths[at], self.focus[at], self.focus_values[at])


class Bucket:
    """Rows of similar length with a sorted list for each coordinate of their unit vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.ids, self.vectors = ids, vectors
        self.shortest, self.longest = float(lengths.min()), float(lengths.max())
        unit = vectors / np.where(lengths == 0, 1, lengths)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(unit, order, 0).T.copy()
        self.place = np.empty(order.shape[::-1], np.int32)
        np.put_along_axis(self.place, order.T, np.arange(len(ids), dtype=np.int32)[None, :], 1)

    def candidates(self, anchors: Anchors, least: np.ndarray) -> np.ndarray:
        """Rows (one line per anchor) that may reach the least score, by the focus coordinates' ranges."""
        n = len(self.ids)
        reach = anchors.lengths * np.where(least > 0, self.longest, self.shortest)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, least / reach, np.where(least > 0, np.inf, -np.inf)) - SLACK
        found = np.repeat((cosine <= 1)[:, None], n, 1)
        c = np.clip(cosine, -1, 1)
        for k in range(anchors.focus.shape[1]):
            q = anchors.focus_values[:, k]
            r = np.sqrt((1 - q * q).clip(0) * (1 - c * c))
            low = np.where(-q >= c, -1.0, q * c - r) - SLACK
            high = np.where(q >= c, 1.0, q * c + r) + SLACK
            for f in np.unique(anchors.focus[:, k]):
                at = np.flatnonzero((anchors.focus[:, k] == f) & (cosine <= 1) & (cosine > -1))
                first = np.searchsorted(self.lists[f], low[at], "left")
                last = np.searchsorted(self.lists[f], high[at], "right")
                narrow = (first > 0) | (last < n)
                at, first, last = at[narrow], first[narrow, None], last[narrow, None]
                found[at] &= (self.place[f] >= first) & (self.place[f] < last)
        return found

    def scores(self, anchors: Anchors, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are a candidate of any anchor, and the exact scores of all anchors with them."""
        rows = np.flatnonzero(found.any(0))
        left, right = anchors.vectors, self.vectors[rows]
        if left.size and right.size:
            most = int(np.abs(left).max()) * int(np.abs(right).max()) * left.shape[1]
            if most < EXACT:
                return rows, (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
        return rows, left @ right.T


class Best:
    """The best rows of each list so far: at most `most` ids a list, higher scores and smaller ids first."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.list, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.weakest = np.full(lists, np.iinfo(np.int64).min)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        lists = np.concatenate([self.list, lists])
        scores, ids = np.concatenate([self.score, scores]), np.concatenate([self.id, ids])
        # One entry per id, its best one.
        order = np.lexsort((-scores, ids, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        once = np.ones(len(ids), bool)
        once[1:] = (lists[1:] != lists[:-1]) | (ids[1:] != ids[:-1])
        lists, scores, ids = lists[once], scores[once], ids[once]
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        starts = np.searchsorted(lists, lists, "left")
        rank = np.arange(len(lists)) - starts
        keep = rank < self.most
        self.list, self.score, self.id = lists[keep], scores[keep], ids[keep]
        full = keep & (rank == self.most - 1)
        self.weakest[lists[full]] = scores[full]


def bounds(positive_score: np.ndarray, band: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative: band[0] * p <= 100 * score <= band[1] * p, in integers."""
    low = [-(-band[0] * int(p) // 100) for p in positive_score]
    high = [band[1] * int(p) // 100 for p in positive_score]
    return np.array(low, np.int64), np.array(high, np.int64)


def search_positives(bucket: Bucket, anchors: Anchors, best: Best, offset: int) -> None:
    """Add the bucket's rows to the lists of anchors of the same label; list k belongs to anchor k."""
    for start in range(0, len(anchors.ids), BLOCK_ANCHORS):
        part = anchors.part(slice(start, start + BLOCK_ANCHORS))
        lists = offset + start + np.arange(len(part.ids))
        least = best.weakest[lists]
        found = bucket.candidates(part, least)
        rows, scores = bucket.scores(part, found)
        a, r = np.nonzero(found[:, rows] & (scores >= least[:, None]) & (bucket.ids[rows] != part.ids[:, None]))
        best.add(lists[a], scores[a, r], bucket.ids[rows][r])


def search_negatives(
    bucket: Bucket, anchors: Anchors, low: np.ndarray, high: np.ndarray, best: Best, offset: int
) -> None:
    """The same for rows of other labels: one list per anchor and positive, within the positive's band.

    `low` and `high` have a column per positive; an empty band has low > high.
    """
    width = low.shape[1]
    for start in range(0, len(anchors.ids), BLOCK_ANCHORS):
        part = anchors.part(slice(start, start + BLOCK_ANCHORS))
        k = len(part.ids)
        lists = ((offset + start + np.arange(k)) * width)[:, None] + np.arange(width)
        upper = high[start : start + k]
        lower = np.maximum(low[start : start + k], best.weakest[lists])
        lower = np.where(low[start : start + k] > upper, np.iinfo(np.int64).max, lower)
        least = lower.min(1)
        wanted = np.flatnonzero(least < np.iinfo(np.int64).max)
        if not len(wanted):
            continue
        part = Anchors(*(x[wanted] for x in (part.ids, part.vectors, part.lengths, part.focus, part.focus_values)))
        found = bucket.candidates(part, least[wanted])
        rows, scores = bucket.scores(part, found)
        found = found[:, rows] & (bucket.ids[rows] != part.ids[:, None])
        got = []
        for j in range(width):
            a, r = np.nonzero(found & (scores >= lower[wanted, j, None]) & (scores <= upper[wanted, j, None]))
            got.append((lists[wanted][a, j], scores[a, r], bucket.ids[rows][r]))
        best.add(*(np.concatenate(x) for x in zip(*got)))


def _buckets(batches: Iterator[pa.RecordBatch], bucket_rows: int) -> Iterator[tuple[int, int, Bucket]]:
    """(label number, dimension, bucket) of rows that arrive in the order of (label, dimension, length)."""
    ids, vectors, labels, lengths = [], [], [], []

    def done() -> Iterator[tuple[int, int, Bucket]]:
        if ids:
            yield labels[0], len(vectors[0]), Bucket(np.array(ids, np.int64), np.stack(vectors))
        for x in (ids, vectors, labels, lengths):
            x.clear()

    for batch in batches:
        values = batch.column("v")
        flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *values.value_lengths().to_numpy()])
        for k, (i, label, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "label", "len2")))):
            vector = flat[ends[k] : ends[k + 1]]
            if ids and (
                label != labels[0]
                or len(vector) != len(vectors[0])
                or len(ids) >= bucket_rows
                or not LENGTH_SHARE**2 <= (length + 1) / (lengths[0] + 1) <= LENGTH_SHARE**-2
            ):
                yield from done()
            ids.append(i), vectors.append(vector.astype(np.int64)), labels.append(label), lengths.append(length)
    yield from done()


def indexed(
    vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE
) -> DataFrame:
    """Usable rows with integer components, written in the order of label and falling length."""
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), e.alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & ~bad)
    # Scores of clamped components still fit a long.
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.size("e"))).cast("double")
    whole = F.transform("e", lambda x: F.greatest(-most, F.least(most, F.floor(x * scale))).cast("bigint"))
    rows = rows.select("id", F.xxhash64("label").alias("label"), F.size("e").alias("dim"), whole.alias("v"))
    length = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    rows = rows.withColumn("len2", length)
    # The id is part of the range, so equal vectors of one label are cut among tasks like any others.
    order = ["label", "dim", F.desc("len2"), "id"]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order), "length-buckets")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
    scale: int = SCALE,
    bucket_rows: int = BUCKET_ROWS,
    wave_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a condition on the column `id`, `label` an expression over the columns of `vectors`.
    Labels are compared by their 64-bit hash, so they may be of any type.
    """
    spark = vectors.sparkSession
    rows = indexed(vectors, id_col, vector_col, label, scale)
    anchors = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = materialize(anchors.select("id", "a.label", "a.v"), "anchors")
    about = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    # An anchor brings its vector, and its positives with the bounds of their bands.
    per_anchor = 8 * (2 + (about["dim"] or 0) + 4 * positives)
    waves = max(1, math.ceil(2 * about["n"] * per_anchor / wave_bytes))
    found = None
    for wave in range(waves):
        members = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).orderBy("id").collect()
        out = _wave(spark, rows, [(r["id"], r["label"], r["v"]) for r in members], positives, negatives, band, bucket_rows)
        found = out if found is None else found.union(out)
    return found


def _wave(
    spark: SparkSession, rows: DataFrame, members: list[tuple], positives: int, negatives: int, band: tuple[int, int],
    bucket_rows: int,
) -> DataFrame:
    """Positives and negatives of the anchors of one wave, against all rows."""
    groups: dict[tuple[int, int], list[tuple]] = {}
    for i, label, v in members:
        groups.setdefault((label, len(v)), []).append((i, v))
    arrays = {
        key: (np.array([i for i, _ in group], np.int64), np.array([v for _, v in group], np.int64))
        for key, group in groups.items()
    }
    ids = np.concatenate([i for i, _ in arrays.values()]) if arrays else np.empty(0, np.int64)
    total = len(ids)
    sent = spark.sparkContext.broadcast(arrays)

    def received() -> tuple[dict[tuple[int, int], Anchors], dict[tuple[int, int], int], np.ndarray]:
        """Anchors by label and dimension, the number of the first of each, and all their ids."""
        made = {key: Anchors.of(*pair) for key, pair in sent.value.items()}
        sizes = [len(a.ids) for a in made.values()]
        starts = dict(zip(made, np.cumsum([0, *sizes]).tolist()))
        return made, starts, np.concatenate([a.ids for a in made.values()]) if made else np.empty(0, np.int64)

    def partial(best: Best, ids: np.ndarray, width: int) -> pa.RecordBatch:
        columns = [ids[best.list // width], best.list % width, best.score, best.id]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "list", "score", "id"])

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, starts, ids = received()
        best = Best(len(ids), positives)
        for label, dim, bucket in _buckets(batches, bucket_rows):
            if (label, dim) in made:
                search_positives(bucket, made[label, dim], best, starts[label, dim])
        yield partial(best, ids, 1)

    schema = "anchor bigint, list bigint, score bigint, id bigint"
    columns = rows.select("id", "label", "len2", "v")
    first = _merged(columns.mapInArrow(same_label, schema), positives)
    kept = materialize(first.drop("list"), "positives")
    at = {int(i): k for k, i in enumerate(ids)}
    low, high = np.full((total, positives), 1, np.int64), np.zeros((total, positives), np.int64)
    for r in kept.select("anchor", "rank", "score").collect():
        place = at[r["anchor"]], r["rank"] - 1
        (low[place],), (high[place],) = bounds([r["score"]], band)
    bands = spark.sparkContext.broadcast((low, high))

    def other_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, starts, ids = received()
        low, high = bands.value
        best = Best(len(ids) * positives, negatives)
        for label, dim, bucket in _buckets(batches, bucket_rows):
            for (own, size), anchors in made.items():
                if own != label and size == dim:
                    k = starts[own, size]
                    mine = slice(k, k + len(anchors.ids))
                    search_negatives(bucket, anchors, low[mine], high[mine], best, k)
        yield partial(best, ids, positives)

    second = _merged(columns.mapInArrow(other_labels, schema), negatives)
    second = second.select("anchor", (F.col("list") + 1).cast("int").alias("place"), "rank", "score", F.col("id").alias("negative_id"))
    kept = kept.select(
        F.col("anchor").alias("anchor_id"), F.col("rank").alias("p_rank"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")
    )
    joined = second.join(kept, (F.col("anchor") == F.col("anchor_id")) & (F.col("place") == F.col("p_rank")))
    out = joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
    return materialize(out, "hard-negatives")


def _merged(partial: DataFrame, most: int) -> DataFrame:
    """The best `most` ids of every list over all tasks, numbered from 1."""
    best = partial.groupBy("anchor", "list", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("anchor", "list").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
