"""How streams leave Spark: append tables, per-batch upserts and versioned state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ONCE = {"availableNow": True}


def append_table(df: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Write finished rows to `root/data`; exactly once through the sink's own log."""
    writer = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**(trigger or ONCE)).start(f"{root}/data")


def upsert_table(df: DataFrame, root: str, mode: str = "update", trigger: dict | None = None) -> StreamingQuery:
    """Write the changed rows of each batch to their own folder `root/data/batch=<id>`.

    A batch that is run again overwrites its folder, so the table does not depend on how often
    a batch was tried. `newest` reads the current rows.
    """
    return each_batch(df, root, lambda rows, n: write_batch(rows, f"{root}/data", n), mode, trigger)


def each_batch(
    df: DataFrame, root: str, act: Callable[[DataFrame, int], None], mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(act).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**(trigger or ONCE)).start()


def write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All batches of a folder with their number in `batch`."""
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*")


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of the latest batch per key."""
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return last.select(*key, *[F.col("__r")[c].alias(c) for c in rest])


def finish(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for an available-now query and raise its error, if any."""
    query.awaitTermination(seconds) if seconds else query.awaitTermination()
