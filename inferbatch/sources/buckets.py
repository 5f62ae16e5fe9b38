"""A job table laid out by tenant bucket and state class, and merges that rewrite only what they touch.

Rows lie in folders `gen=<version>/tenant_bucket=<b>/open=<true|false>`; a small manifest per version says which
generations make up each folder. A merge writes the partitions that hold an updated row into a new
generation, leaves all others as they are, and becomes visible with its manifest alone, so a reader sees
the version before or the one after, and a merge that breaks off leaves unread files only. Two
merges of the same version cannot both publish: the second finds its manifest taken and fails.

Tenant filters on such a table name the bucket too (`jobs.for_tenant`, `jobs.query_items`), and `open` tells
unfinished jobs from ended ones, so both reach the scan as partition filters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..session import committed, small_side
from .tables import latest_snapshot

BUCKETS = 64
PARTS = ["tenant_bucket", "open"]
WRITTEN = (T.StructField("outcome", T.StringType()), T.StructField("__gone", T.BooleanType()))
MANIFEST = "tenant_bucket int, open boolean, gen int"


def bucket_of(tenant: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class JobTable:
    """One version of a table below `root`; `schema` names the columns of its rows."""

    spark: SparkSession
    root: str
    schema: T.StructType
    buckets: int
    version: int
    parts: tuple[tuple[int, bool, int], ...]

    # --- reading ---

    def read(self) -> DataFrame:
        """The rows, with `tenant_bucket` and `open`."""
        return self._rows(self.parts).filter("NOT __gone").drop("outcome", "__gone")

    def _rows(self, parts: Sequence[tuple[int, bool, int]]) -> DataFrame:
        """Rows of some partitions as they were written, with the outcome of their merge and what it left out."""
        bucket = T.StructField("tenant_bucket", T.IntegerType(), True, {"buckets": self.buckets})
        fields = [*self.schema.fields, *WRITTEN, bucket, T.StructField("open", T.BooleanType())]
        if not parts:
            return self.spark.createDataFrame([], T.StructType(fields))
        paths = [f"{self.root}/gen={g}/tenant_bucket={b}/open={str(o).lower()}" for b, o, g in parts]
        kind = T.StructType([*fields, T.StructField("gen", T.IntegerType())])
        rows = self.spark.read.schema(kind).option("basePath", self.root).parquet(*paths)
        # The bucket carries the number of buckets along, for filters on tenants.
        numbered = F.col("tenant_bucket").alias("tenant_bucket", metadata={"buckets": self.buckets})
        return rows.select(*self.schema.names, *[f.name for f in WRITTEN], numbered, "open")

    # --- writing ---

    def merge(self, updates: DataFrame, act: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[JobTable, DataFrame]:
        """Apply `act` to the partitions that hold an id of `updates`: (the next version, outcome per id).

        `act(rows, updates)` returns the rows to keep with their `outcome` (NULL where nothing was asked) and a
        flag `__gone` for rows to leave out. Ids without a row are `missing`. The table's rows are read once;
        finding their partitions reads the ids alone.
        """
        asked = small_side(updates.select("id").distinct())
        touched = {
            (r["tenant_bucket"], r["open"])
            for r in self.read().select("id", *PARTS).join(asked, "id", "left_semi").select(*PARTS).distinct().collect()
        }
        old = [p for p in self.parts if p[:2] in touched]
        rest = [p for p in self.parts if p[:2] not in touched]
        gen = self.version + 1
        kept = self._rows(old).filter("NOT __gone").select(*self.schema.names)
        self._write(act(kept, updates).select(*self.schema.names, *[f.name for f in WRITTEN]), gen)
        made = self._generation(gen)
        rows = self._rows(made)
        done = rows.filter("outcome IS NOT NULL").select("id", "outcome")
        lost = updates.select("id").distinct().join(rows.select("id"), "id", "left_anti")
        after = self._publish([*rest, *made], gen)
        return after, done.unionByName(lost.select("id", F.lit("missing").alias("outcome")))

    def append(self, rows: DataFrame) -> JobTable:
        """New rows, in a generation of their own; nothing is read or rewritten."""
        gen = self.version + 1
        self._write(_plain(rows, self.schema), gen)
        return self._publish([*self.parts, *self._generation(gen)], gen)

    def compact(self, most: int = 4) -> JobTable:
        """Rewrite the partitions that consist of more than `most` generations."""
        count: dict[tuple[int, bool], int] = {}
        for p in self.parts:
            count[p[:2]] = count.get(p[:2], 0) + 1
        many = [p for p in self.parts if count[p[:2]] > most]
        if not many:
            return self
        gen = self.version + 1
        self._write(_plain(self._rows(many).filter("NOT __gone"), self.schema), gen)
        return self._publish([*(p for p in self.parts if p not in many), *self._generation(gen)], gen)

    def _write(self, rows: DataFrame, gen: int) -> None:
        ended = F.coalesce(F.col("status.status").isin(*V.TERMINAL), F.lit(False))
        placed = rows.withColumns({"tenant_bucket": bucket_of(F.col("tenant_id"), self.buckets), "open": ~ended})
        # One file per partition as a rule; a large one is cut by its jobs' ids.
        placed = placed.repartition(*PARTS)
        placed.write.mode("error").option("maxRecordsPerFile", 1_000_000).partitionBy(*PARTS).parquet(f"{self.root}/gen={gen}")

    def _generation(self, gen: int) -> list[tuple[int, bool, int]]:
        """The partitions a written generation has, from its folders."""
        jvm = self.spark.sparkContext._jvm
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.root}/gen={gen}/tenant_bucket=*/open=*")
        found = glob.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
        names = [(s.getPath().getParent().getName(), s.getPath().getName()) for s in found]
        return sorted((int(b.split("=")[1]), o == "open=true", gen) for b, o in names)

    def _publish(self, parts: list[tuple[int, bool, int]], version: int) -> JobTable:
        rows = self.spark.createDataFrame(sorted(parts), MANIFEST).coalesce(1)
        rows.write.mode("error").parquet(f"{self.root}/manifest/version={version:012d}")
        return JobTable(self.spark, self.root, self.schema, self.buckets, version, tuple(sorted(parts)))


def _plain(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows that no merge has touched."""
    return rows.select(*schema.names, F.lit(None).cast("string").alias("outcome"), F.lit(False).alias("__gone"))


def create(spark: SparkSession, root: str, schema: T.StructType, buckets: int = BUCKETS) -> JobTable:
    """An empty table. The number of buckets is fixed from now on."""
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("error").parquet(f"{root}/layout")
    return JobTable(spark, root, schema, buckets, 0, ())._publish([], 0)


def load(spark: SparkSession, root: str, schema: T.StructType) -> JobTable:
    """The newest published version."""
    path = latest_snapshot(spark, f"{root}/manifest")
    if path is None or not committed(spark, f"{root}/layout"):
        raise ValueError(f"no job table below {root}")
    buckets = spark.read.schema("buckets int").parquet(f"{root}/layout").first()["buckets"]
    parts = spark.read.schema(MANIFEST).parquet(path).collect()
    version = int(path.rsplit("=", 1)[1])
    return JobTable(spark, root, schema, buckets, version, tuple(sorted((r[0], r[1], r[2]) for r in parts)))


# --- what a merge does to the rows --------------------------------------------------


def fenced(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """`jobs.cas_update` for `merge`: status and epoch change where state and epoch are as expected."""
    wanted = updates.select(
        "id", F.struct("expected_status", "expected_epoch", "new_status", "bump_epoch", F.lit(True).alias("present")).alias("__u")
    )
    u = F.col("__u")
    same = u["expected_status"].isNull() | u["expected_status"].eqNullSafe(F.col("status"))
    hit = F.coalesce(same & (u["expected_epoch"] == F.col("epoch")), F.lit(False))
    outcome = F.when(u["present"], F.when(hit, F.lit("updated")).otherwise(F.lit("conflict")))
    done = F.coalesce(outcome == "updated", F.lit(False))
    return rows.join(small_side(wanted), "id", "left").withColumns(
        {
            "outcome": outcome,
            "status": F.when(done, u["new_status"]).otherwise(F.col("status")),
            "epoch": F.col("epoch") + F.when(done & u["bump_epoch"], 1).otherwise(0),
            "__gone": F.lit(False),
        }
    )


def replaced(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """For `merge`: rows as `updates` has them, whole, such as those of `jobs.claim` and `jobs.requeue`."""
    mine = rows.columns
    new = updates.select("id", F.struct(*[c for c in mine if c != "id"]).alias("__n"))
    joined = rows.join(small_side(new), "id", "left")
    found = F.col("__n").isNotNull()
    kept = [F.col("id"), *[F.when(found, F.col("__n")[c]).otherwise(F.col(c)).alias(c) for c in mine if c != "id"]]
    return joined.select(*kept, F.when(found, F.lit("updated")).alias("outcome"), F.lit(False).alias("__gone"))


def deleted(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """For `merge`: the rows that `updates` names are gone."""
    asked = updates.select("id", F.lit(True).alias("__hit"))
    joined = rows.join(small_side(asked), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return joined.withColumns({"outcome": F.when(hit, F.lit("deleted")), "__gone": hit})
