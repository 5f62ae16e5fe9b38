"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators are written for. Only settings that are safe to
# change in a live session are listed; sizing (memory, cores, shuffle partitions) stays
# with whoever submits the job.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Later entries of map_concat win, which header assembly relies on.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A repeated JSON key is no error: the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Stream state lies on disk instead of the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Rows may hold long texts: what one Python worker holds at a time is bounded by bytes, so
    # short rows still travel in large batches.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings the operators expect on an existing session.

    Functions of this package that run inside tasks are shipped by value, so executors do not
    need the package installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "inferbatch", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_defaults(spark)


# Fallback folders of local sessions without a configured one, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a single-process local master may
    fall back to a machine-local folder, one for each application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="inferbatch-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several later steps read, and continue from the written table.

    It cuts the lineage at a durable place: losing an executor afterwards costs a re-read of
    the shared folder, not a recomputation, and each reader scans only the columns it needs.
    """
    return write_table(df, scratch_path(df.sparkSession, label))


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table to a fresh path and read it from there."""
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, path: str) -> bool:
    """A table was written to this path to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


# Up to both bounds a lookup table is broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast a lookup table after measuring its rows and bytes, else leave the join to Spark.

    No more than one row beyond the bound is read for it.
    """
    width = F.sum(F.octet_length(F.struct("*").cast("string")))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(width, F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def lookup_table(df: DataFrame, label: str) -> DataFrame:
    """Write a derived lookup table once, then broadcast it if it is small enough.

    Counting the written table costs only its file footers. A large one is joined by shuffle,
    where AQE splits hot keys.
    """
    return small_side(materialize(df, label))
