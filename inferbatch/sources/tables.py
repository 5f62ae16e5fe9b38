"""Job and file tables: scans with explicit schemas, JSON encoding, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..schemas import FILE_OBJECT, FILE_ROW, JOB, JOB_ROW, JOB_SPEC, JOB_STATUS

KEEP_NULLS = {"ignoreNullFields": "false"}


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job rows with spec and status as stored JSON."""
    return spark.read.schema(JOB_ROW).parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """File rows with the file object as stored JSON."""
    return spark.read.schema(FILE_ROW).parquet(path)


def decode_batch(rows: DataFrame) -> DataFrame:
    """Stored JSON of spec and status to typed columns."""
    return rows.withColumns({"spec": F.from_json("spec", JOB_SPEC), "status": F.from_json("status", JOB_STATUS)}).select(
        JOB.names
    )


def encode_batch(jobs: DataFrame) -> DataFrame:
    """Typed jobs to stored rows.

    expiry is expires_at or 0; priority is the deadline in microseconds. Spec and status keep
    their null fields, as readers of the JSON expect them. Ownership columns start empty
    unless the input has them.
    """
    have = set(jobs.columns)

    def keep(name: str, default, kind: str):
        return (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)

    return jobs.select(
        "id",
        "tenant_id",
        F.coalesce("status.expires_at", F.lit(0)).cast("long").alias("expiry"),
        "tags",
        F.to_json("spec", KEEP_NULLS).alias("spec"),
        F.to_json("status", KEEP_NULLS).alias("status"),
        keep("processor_id", None, "string"),
        S.deadline_micros("spec.created_at", "spec.completion_window").alias("priority"),
        keep("epoch", 0, "long"),
        keep("recovery_attempts", 0, "long"),
    )


def decode_file(rows: DataFrame) -> DataFrame:
    """The file object of a stored file row, with its tenant."""
    parsed = rows.select("tenant_id", F.from_json("spec", FILE_OBJECT).alias("o"))
    return parsed.select("tenant_id", "o.*")


def encode_file(files: DataFrame) -> DataFrame:
    """File objects (column `file`) to stored rows; a missing or zero expiry is stored as 0."""
    expires = F.col("file.expires_at")
    return files.select(
        F.col("file.id").alias("id"),
        "tenant_id",
        F.when(expires > 0, expires).otherwise(F.lit(0)).cast("long").alias("expiry"),
        "tags",
        F.to_json("file", KEEP_NULLS).alias("spec"),
        F.lit(None).cast("string").alias("status"),
        F.col("file.purpose").alias("purpose"),
    )


def output_file_rows(sizes: DataFrame, now: int, default_ttl: int = 0) -> DataFrame:
    """File rows of finished jobs' output and error files.

    `sizes` has job_id, tenant_id, tags and per kind the id and bytes (NULL id: no file).
    The user's TTL tag wins over the configured one; without either the file never expires.
    """
    tag = F.try_element_at("tags", F.lit(V.TAG_OUTPUT_TTL)).try_cast("long")
    ttl = F.when(tag > 0, tag).otherwise(F.lit(default_ttl))
    kinds = F.array(
        *[
            F.struct(
                F.col(f"{kind}_file_id").alias("id"),
                F.col(f"{kind}_bytes").alias("bytes"),
                name.alias("filename"),
            )
            for kind, name in (("output", S.output_name("job_id")), ("error", S.error_name("job_id")))
        ]
    )
    rows = sizes.select("tenant_id", ttl.cast("long").alias("ttl"), F.explode(kinds).alias("f")).filter("f.id IS NOT NULL")
    file = F.struct(
        F.col("f.id").alias("id"),
        F.col("f.bytes").alias("bytes"),
        F.lit(now).cast("long").alias("created_at"),
        F.when(F.col("ttl") > 0, F.lit(now) + F.col("ttl")).cast("long").alias("expires_at"),
        F.col("f.filename").alias("filename"),
        F.lit("file").alias("object"),
        F.lit("batch_output").alias("purpose"),
        F.lit("processed").alias("status"),
    )
    empty = F.create_map().cast("map<string,string>")
    return encode_file(rows.select("tenant_id", empty.alias("tags"), file.alias("file")))


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Publish a new version of a table below `root`.

    The folder is written through Spark's commit protocol and counts as published once its
    success marker exists; a failed write leaves no readable version. One writer per table.
    """
    path = f"{root}/version={version:012d}"
    df.write.mode("error").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Path of the newest published version, None when there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True)
    for name in names:
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")):
            return f"{root}/{name}"
    return None


def read_table(spark: SparkSession, root: str, schema) -> DataFrame:
    """Newest version of a table with its explicit schema; empty before the first one.

    Typed job tables keep spec and status as structs, so a filter on `status.status` or the
    tenant reaches the Parquet scan and an unused spec is not read.
    """
    path = latest_snapshot(spark, root)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)
