"""Documents linked by the Jaccard similarity of their word n-grams: a grouped prefix join.

Two sets that overlap enough must share one of their first few elements in any common order, so only
these prefixes are joined. The order puts shingles that many documents hold last, which keeps common
passages out of the prefixes; the heavy shingles behind that are counted over all documents, and the
order only decides how much work there is, never which links are found.

1. Documents with equal sets become one class (digest of the whole set).
2. Classes with identical prefixes and size become one group; only groups are joined.
3. Hub round: per prefix element a few groups are hubs. Every other group is tried against them, and
   every member against the first of its group: linear in the bucket. Verified links are contracted
   to components.
4. Rest round: inside a bucket, only groups of different components are paired (the bucket's largest
   component stands on one side only), filtered by size, position and hash-range counts, expanded to
   members and verified. Links inside a component cannot change it and are not enumerated.
   Members of one group share their whole prefix, so those of different components are paired by the
   elements that follow it, which must hold a common one for the same reason.

Verification intersects the whole sets. A shingle is named by 64 bits of its words' hashes.

Defined results: null or blank texts have an empty set, n_shingles 0, and are linked with nothing; a
text of fewer words than `width` is one shingle; a null id is linked with nothing and has a null
component; rows that share an id are one node; an empty table gives an empty result; only the two
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferbatch.llm.components import components
from inferbatch.llm.sizes import broadcast_if_small
from inferbatch.session import discard, materialize, scratch_path, write_table

# Odd 64-bit multipliers of the mixing steps.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)
# Shingles are counted in chunks of this many; those in at least CHUNK_COUNT places of a chunk are
# heavy, and the HEAVY most frequent of all are put last in the order. That is 1 MB on each task.
CHUNK_SHINGLES = 2_000_000
CHUNK_COUNT = 2
HEAVY = 131_072
# Counts by hash range bound an overlap; there are enough ranges to hold at most 8 shingles on average.
LEAST_RANGES = 64
RANGE_FILL = 8


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's word n-grams, in text order, with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * MIX_A
        out = (out ^ (out >> np.uint64(29))) * MIX_B
    return out ^ (out >> np.uint64(32))


def range_counts(values: np.ndarray) -> np.ndarray:
    """Counts of a set by equal ranges of the hash; empty, thus no bound, if one exceeds a byte."""
    bits = LEAST_RANGES.bit_length() - 1
    while len(values) >= RANGE_FILL << bits:
        bits += RANGE_FILL.bit_length() - 1
    counts = np.bincount(values >> np.uint64(64 - bits), minlength=1 << bits)
    return counts.astype(np.int8) if counts.max() <= 127 else np.empty(0, np.int8)


def heavy_shingles(docs: DataFrame, width: int, most: int = HEAVY) -> np.ndarray:
    """The most frequent shingles of the whole table, rarest first; at most `most` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= CHUNK_COUNT
            columns = [pa.array(values[often].view(np.int64)), pa.array(counts[often])]
            return pa.RecordBatch.from_arrays(columns, names=["h", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(shingles(t.as_py(), width))
                size += len(held[-1])
                if size >= CHUNK_SHINGLES:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(most).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)


def document_sets(docs: DataFrame, width: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """Per document its id, set size, digests of set and prefix, the prefix, what follows, and counts by hash range."""
    by_hash = np.argsort(heavy)
    known = heavy[by_hash]
    rank = by_hash + 1
    kind = docs.schema["id"].dataType.simpleString()

    def prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix, and the elements behind it that hold a common one of any two with this prefix."""
        late = np.zeros(len(values), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            late = np.where(known[at] == values, rank[at], 0)
        n = len(values)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ordered = values[np.lexsort((values, late))].view(np.int64)
        size = n - -(-percent * n // 100) + 1
        # Two sets of n elements may each have this many of their own; without any they are equal.
        own = n - -(-2 * percent * n // (100 + percent))
        return ordered[:size], ordered[size : size + own + 1 if own else size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), width)) for t in batch.column(1)]
            cuts = [prefix(s) for s in sets]
            prefixes = [p for p, _ in cuts]
            columns = [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([xxhash.xxh3_128_digest(p.tobytes()) for p in prefixes], pa.binary()),
                pa.array(prefixes, pa.list_(pa.int64())),
                pa.array([x for _, x in cuts], pa.list_(pa.int64())),
                pa.array([range_counts(s) for s in sets], pa.list_(pa.int8())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "digest", "start", "prefix", "next", "regions"])

    schema = f"id {kind}, n bigint, digest binary, start binary, prefix array<bigint>, next array<bigint>, regions array<tinyint>"
    return docs.select("id", "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """Per document its id and whole set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t.as_py(), width)).view(np.int64) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "set"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, set array<bigint>")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _places_fit(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether enough elements can follow if this is the first common one."""
    return (F.least(n - i, m - j)) * (100 + percent) >= (n + m) * percent


def _any_place_fits(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether enough elements can lie before and after any common one."""
    return (F.least(i, j) + F.least(n - i, m - j)) * (100 + percent) >= (n + m) * percent


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar enough, as a written table."""
    spark = pairs.sparkSession
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    wanted = docs.join(broadcast_if_small(ids, 16), "id", "left_semi")
    path = scratch_path(spark, "pair-sets")
    sets = write_table(whole_sets(wanted, width), path)
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    similar = both * 100 >= (F.size("sa") + F.size("sb") - both) * percent
    links = materialize(pairs.join(left, "a").join(right, "b").filter(similar).select("a", "b"), "verified")
    discard(spark, path)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = materialize(document_sets(docs, width, percent, heavy_shingles(docs, width)), "sets")
    usable = sets.filter("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c"))
    classes = materialize(classes, "classes")
    # The prefixes stay where they are: only the ids of further copies are sent to them.
    copies = usable.select("id", "digest", "n").join(classes.filter("c > 1"), ["digest", "n"]).filter("id <> rep")
    copies = materialize(copies.select("id", "digest").distinct(), "copies")
    firsts = usable.join(broadcast_if_small(copies, 40), ["id", "digest"], "left_anti").withColumnRenamed("id", "rep")
    links = _class_links(firsts.select("rep", "n", "start", "prefix", "next", "regions"), docs, width, percent)
    found = components(links).withColumnRenamed("id", "rep")
    names = classes.select("digest", "n", "rep").join(found, "rep", "left")
    names = names.select("digest", "n", F.coalesce("component", "rep").alias("component"))
    # An id with several rows may stand in several classes: they are one node.
    rows = sets.select("id", "n", "digest").join(names, ["digest", "n"], "left")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


def _class_links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between class representatives that give the same components as all links."""
    groups = members.groupBy("n", "start").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("c"))
    others = members.select("rep", "n", "start").join(groups.filter("c > 1"), ["n", "start"]).filter("rep <> gid")
    others = materialize(others.select("rep", "gid").distinct(), "others")
    leaders = members.join(broadcast_if_small(others.select("rep"), 16), "rep", "left_anti")
    places = leaders.select(F.col("rep").alias("gid"), "n", F.posexplode("prefix").alias("i", "h"))
    counts = places.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    shared = materialize(places.join(counts, "h"), "shared")
    # An edited copy has rare elements of its own ahead of a shared one, so the group that holds the
    # element earliest is the one most like all the others. A second hub is any group, by hash.
    order = [F.struct(*keys, "gid", "n", "i") for keys in ([F.col("i").alias("o")], [F.xxhash64("gid").alias("o")])]
    hubs = shared.groupBy("h").agg(*[F.min(o).alias(f"hub{k}") for k, o in enumerate(order)])
    hub = F.explode(F.array(*[F.struct(f"hub{k}.gid", f"hub{k}.n", f"hub{k}.i") for k in range(len(order))]))
    hubs = hubs.select("h", hub.alias("hub")).distinct()
    tries = shared.join(hubs, "h")
    # This need not be the pair's first common element: that one may lie in a bucket of another hub.
    fits = _sizes_fit(F.col("n"), F.col("hub.n"), percent) & _any_place_fits(
        F.col("n"), F.col("i"), F.col("hub.n"), F.col("hub.i"), percent
    )
    tries = tries.filter(fits & (F.col("gid") != F.col("hub.gid")))
    to_hub = tries.select(
        F.least("hub.gid", "gid").alias("a"), F.greatest("hub.gid", "gid").alias("b")
    )
    to_first = others.select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    tries = _ranges_fit(to_hub.union(to_first).distinct(), members, percent)
    near = verified(materialize(tries, "hub-tries"), docs, width, percent)

    found = components(near).withColumnRenamed("id", "rep")
    parts = members.select("rep").join(others, "rep", "left").join(found, "rep", "left")
    parts = parts.withColumns({"gid": F.coalesce("gid", "rep"), "comp": F.coalesce("component", "rep")})
    parts = materialize(parts.select("rep", "gid", "comp"), "parts")
    # A group whose members fell into several components is tried part by part.
    split = parts.select("gid", "comp").distinct()
    rows = shared.select("h", "gid", "n", "i").join(split, "gid")
    counts = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("h").agg(F.max_by("comp", "c").alias("big"), F.count(F.lit(1)).alias("k"))
    rows = materialize(rows.join(mixed.filter("k > 1").drop("k"), "h"), "mixed")
    one = rows.filter("comp <> big").select("h", *[F.col(c).alias(f"{c}_1") for c in ("gid", "n", "i", "comp")])
    cross = (F.col("gid_1") != F.col("gid")) & (F.col("comp_1") != F.col("comp")) & ((F.col("comp") == F.col("big")) | (F.col("comp_1") < F.col("comp")))
    near_places = _places_fit(F.col("n_1"), F.col("i_1"), F.col("n"), F.col("i"), percent)
    pairs = one.join(rows, "h").filter(cross & _sizes_fit(F.col("n_1"), F.col("n"), percent) & near_places)
    pairs = pairs.select("gid_1", "comp_1", "gid", "comp").distinct()
    of_1 = parts.select(F.col("gid").alias("gid_1"), F.col("comp").alias("comp_1"), F.col("rep").alias("a"))
    of_2 = parts.select("gid", "comp", F.col("rep").alias("b"))
    pairs = pairs.join(of_1, ["gid_1", "comp_1"]).join(of_2, ["gid", "comp"]).select("a", "b")
    pairs = pairs.union(_inner_pairs(parts, split, members)).distinct()
    rest = verified(materialize(_ranges_fit(pairs, members, percent), "rest-tries"), docs, width, percent)
    return near.union(rest)


def _inner_pairs(parts: DataFrame, split: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one group, in different components, with a common element behind the prefix."""
    several = split.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("gid")
    rows = parts.join(broadcast_if_small(materialize(several, "split-groups"), 16), "gid")
    rows = members.select("rep", "next").join(rows, "rep").select("gid", "rep", "comp", F.explode("next").alias("h"))
    counts = rows.groupBy("gid", "h", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("gid", "h").agg(F.max_by("comp", "c").alias("big"), F.count(F.lit(1)).alias("k"))
    rows = materialize(rows.join(mixed.filter("k > 1").drop("k"), ["gid", "h"]), "split-mixed")
    one = rows.filter("comp <> big").select("gid", "h", F.col("rep").alias("a"), F.col("comp").alias("comp_1"))
    cross = (F.col("comp_1") != F.col("comp")) & ((F.col("comp") == F.col("big")) | (F.col("comp_1") < F.col("comp")))
    return one.join(rows, ["gid", "h"]).filter(cross).select("a", F.col("rep").alias("b")).distinct()


def _ranges_fit(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose counts by hash range already bound the overlap below what is needed."""
    a = members.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("regions").alias("ra"))
    b = members.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("regions").alias("rb"))
    smaller = F.zip_with("ra", "rb", lambda x, y: F.least(x, y))
    bound = F.aggregate(smaller, F.lit(0).cast("bigint"), lambda s, x: s + x)
    enough = bound * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    # Sets on both sides of a step in the number of ranges have no bound in common.
    enough = enough | (F.size("ra") != F.size("rb")) | (F.size("ra") == 0)
    fits = _sizes_fit(F.col("n_a"), F.col("n_b"), percent) & enough
    return pairs.join(a, "a").join(b, "b").filter(fits).select("a", "b")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The documents that stay: of each component the smallest id, with all columns."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
