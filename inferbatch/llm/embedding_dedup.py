"""Near-duplicate vectors: sign hashing in several tables, exact cosine, connected components.

Vectors are compared only within a label. Identical vectors are collapsed first, so a vector that
fills a third of the table is one row from then on. Random hyperplanes give every vector one sign
pattern per table; vectors that share a pattern are compared by their exact cosine in double
precision. A pair counts in the first table that brings it together. Buckets are compared in tiles:
a bucket of more than `tile` vectors is cut into parts, and every pair of parts is a task of its own,
so no bucket is capped and none meets in one task. Tasks return one partial count per vector and the
links that connect a tile, never its pairs.

The number of planes follows the logarithm of the number of vectors, so a bucket of unrelated vectors
keeps its size as the input grows; the number of tables follows from it, so that a pair right at the
threshold is missed with probability `MISS`, a closer one far less often, at every size. Links below
the threshold cannot occur.

Defined results: null, empty, zero and non-finite vectors, vectors with null components and vectors
with a null label link with nothing: n_links 0, component_id their own id. Vectors of different
length are not comparable and link with nothing. A null id links with nothing and has a null
component and kept false. Repeated rows count as other vectors. An empty table gives an empty result;
only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferbatch.llm.components import components
from inferbatch.session import materialize

MISS = 1e-4
LEAST_PLANES = 8
TILE = 1024
SEED = 20_240_101
# Buckets are padded to batches of about this many rows before they are compared.
BATCH_ROWS = 4096


def planes_and_tables(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Planes per table for so many vectors, and the tables that keep misses at `miss`."""
    planes = max(LEAST_PLANES, math.ceil(math.log2(max(rows, 1))) - 8)
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log1p(-meet))


def signatures(vectors: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """Sign patterns, one column per table."""
    normals = np.random.default_rng(seed).standard_normal((vectors.shape[1], planes * tables))
    signs = (vectors @ normals >= 0).reshape(len(vectors), tables, planes)
    return signs @ (1 << np.arange(planes))


def _linked(unit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into the tile) of rows of `left` and `right` whose cosine reaches the threshold."""
    a, b = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
    a, b = left[a], right[b]
    # The product only preselects; the decision is one sum per pair, the same in every tile.
    keep = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
    return a[keep], b[keep]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indices over the links."""
    root = np.arange(n)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return root


def tile_links(
    ids: np.ndarray, part: np.ndarray, parts: tuple[int, int], sigs: np.ndarray, table: int, unit: np.ndarray,
    copies: np.ndarray, threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Partial link counts and, per vector, the smallest id it reaches inside the tile.

    Rows are sorted by id. Pairs that already met in an earlier table are not counted again.
    """
    if parts[0] == parts[1]:
        rows = np.arange(len(ids))
        a, b = _linked(unit, rows, rows, threshold)
        once = a < b
        a, b = a[once], b[once]
    else:
        a, b = _linked(unit, np.flatnonzero(part == parts[0]), np.flatnonzero(part == parts[1]), threshold)
    fresh = np.ones(len(a), bool)
    for earlier in range(table):
        fresh &= sigs[a, earlier] != sigs[b, earlier]
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, a[fresh], copies[b[fresh]])
    np.add.at(counts, b[fresh], copies[a[fresh]])
    return counts, _roots(len(ids), a[fresh], b[fresh])


def _compared(tiles: DataFrame, threshold: float) -> DataFrame:
    """Partial counts and links of every tile; rows arrive sorted by tile."""
    keys = ["label", "dim", "table", "sig", "p", "q"]

    def tile(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("id")
        ids = rows["id"].to_numpy()
        unit = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float64).reshape(len(ids), -1)
        sigs = np.frombuffer(b"".join(rows["sigs"].to_pylist()), np.int32).reshape(len(ids), -1)
        parts = (rows["p"][0].as_py(), rows["q"][0].as_py())
        counts, roots = tile_links(
            ids, rows["part"].to_numpy(), parts, sigs, rows["table"][0].as_py(), unit, rows["copies"].to_numpy(), threshold
        )
        hit = (counts > 0) | (roots != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(counts[hit]), pa.array(ids[roots[hit]])], names=["id", "links", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            if rest.num_rows < BATCH_ROWS:
                continue
            starts = tile_starts(rest)
            for a, b in zip(starts, starts[1:]):
                if b - a > 1:
                    yield tile(rest.slice(a, b - a))
            rest = rest.slice(starts[-1])
        if rest is not None and rest.num_rows:
            starts = [*tile_starts(rest), rest.num_rows]
            for a, b in zip(starts, starts[1:]):
                if b - a > 1:
                    yield tile(rest.slice(a, b - a))

    def tile_starts(rows: pa.Table) -> list[int]:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for key in keys:
            values = rows[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new).tolist()

    columns = [*keys, "part", "id", "copies", "v", "sigs"]
    dealt = tiles.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "id bigint, links bigint, root bigint")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    miss: float = MISS,
    tile: int = TILE,
    seed: int = SEED,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    whole = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), whole.alias("e"), F.col(label_col).alias("label"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("e", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~bad & ~zero
    good = rows.filter(usable)
    distinct = good.groupBy("label", "e").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(distinct, "vectors")
    planes, tables = planes_and_tables(distinct.count(), threshold, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for value in batch.column(2):
                v = np.array(value.as_py(), np.float64)
                v = v / np.abs(v).max()
                units.append(v / np.sqrt((v * v).sum()))
            dims = np.array([len(v) for v in units], np.int32)
            sigs = np.zeros((len(dims), tables), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                sigs[at] = signatures(np.stack([units[k] for k in at]), planes, tables, seed)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    batch.column(3),
                    pa.array(dims, pa.int32()),
                    pa.array([v.tobytes() for v in units], pa.binary()),
                    pa.array([s.tobytes() for s in sigs.astype(np.int32)], pa.binary()),
                    pa.array(list(sigs), pa.list_(pa.int64())),
                ],
                names=["id", "copies", "label", "dim", "v", "sigs", "patterns"],
            )

    kind = vectors.schema[label_col].dataType.simpleString()
    schema = f"id bigint, copies bigint, label {kind}, dim int, v binary, sigs binary, patterns array<bigint>"
    signed = materialize(distinct.select("rep", "copies", "e", "label").mapInArrow(hashed, schema), "signed")
    # Labels of any type travel as a number that is the same for equal labels.
    signed = signed.withColumn("label", F.xxhash64("label"))
    places = signed.select("id", "label", "dim", F.posexplode("patterns").alias("table", "sig"))
    sizes = places.groupBy("label", "dim", "table", "sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    placed = signed.select("*", F.posexplode("patterns").alias("table", "sig")).drop("patterns")
    placed = placed.join(sizes, ["label", "dim", "table", "sig"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = placed.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})
    found = materialize(_compared(tiles, threshold), "tile-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    about = distinct.join(counts, F.col("rep") == counts["id"], "left").drop("id")
    about = about.join(groups, F.col("rep") == groups["id"], "left").drop("id")
    about = about.select(
        "label",
        "e",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    linked = good.join(about, ["label", "e"]).select("id", "n_links", "component")
    alone = rows.filter(F.coalesce(~usable, F.lit(True)))
    alone = alone.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
