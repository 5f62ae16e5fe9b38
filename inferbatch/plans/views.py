"""Batch-inference tables derived from the supplied star-schema tables.

Each function reads whole tables and maps their rows onto the shape an operator expects.
The catalogue keeps the same mapping as SQL text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..operators.workload import conversation_pairs
from ..schemas import JOB

NOW = 883612800  # 1998-01-01, the clock of all job queries
GATEWAYS = ["m0", "m1"]
LIVE = ["p0", "p1", "p2"]


# A table in a single file of one row group is read by one task, whatever its size. Between
# these sizes spreading the rows costs less than working on them alone.
SPREAD_BYTES = (4 << 20, 128 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if SPREAD_BYTES[0] <= size <= SPREAD_BYTES[1] and len(df.inputFiles()) == 1:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def _s(col: Column) -> Column:
    return col.cast("string")


def pick(index: Column, *texts: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (index + 1).cast("int"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per conversation, ten per file, with injected faults in some files."""
    pairs = conversation_pairs(
        table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", user_role="user"
    )
    c = F.col("conv_id")
    fault = c % 50
    return pairs.select(
        F.concat(F.lit("file_"), _s(F.floor(c / 10))).alias("file_id"),
        (c % 10 + 1).alias("line_no"),
        F.when(fault == 1, F.lit(""))
        .when(fault == 6, F.concat(F.lit("req-"), _s(c - 1)))
        .otherwise(F.concat(F.lit("req-"), _s(c)))
        .alias("custom_id"),
        F.when(fault == 2, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.when(fault == 3, F.lit("http://elsewhere/v1")).otherwise(pick(c % 5, *V.ENDPOINTS)).alias("url"),
        F.when(fault == 4, F.lit("")).otherwise(F.concat(F.lit("m"), _s(c % 3))).alias("model"),
        (fault == 5).alias("stream"),
        "system_prompt",
        "user_prompt",
    )


def clean_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests without faults; jobs are files."""
    df = requests(spark, sf_dir)
    number = F.regexp_extract("file_id", r"(\d+)$", 1).cast("long") * 10 + F.col("line_no") - 1
    return df.select(
        F.concat(F.lit("job_"), F.regexp_extract("file_id", r"(\d+)$", 1)).alias("job_id"),
        "file_id",
        "line_no",
        F.concat(F.lit("req-"), _s(number)).alias("custom_id"),
        F.lit("POST").alias("method"),
        pick(number % 5, *V.ENDPOINTS).alias("url"),
        F.concat(F.lit("m"), _s(number % 3)).alias("model"),
        F.lit(False).alias("stream"),
        "system_prompt",
        "user_prompt",
    )


def file_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One running job per request file: of every five, one is cancelled and one past its deadline."""
    files = requests(spark, sf_dir).select(F.col("file_id").alias("id")).distinct()
    kind = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 5
    known = {
        "status": F.when(kind == 1, F.lit("cancelling")).otherwise(F.lit("in_progress")),
        "cancelling_at": F.when(kind == 1, F.lit(NOW - 60)),
    }

    def field(f) -> Column:
        return known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)

    made = {
        "id": F.col("id"),
        "tenant_id": F.concat(F.lit("t"), _s(kind)),
        "tags": F.create_map(F.lit(V.TAG_HEADER_PREFIX + "x-origin"), F.col("id")),
        "status": F.struct(*[field(f) for f in JOB["status"].dataType]),
        "priority": (F.lit(NOW) + F.when(kind == 2, F.lit(-1)).otherwise(F.lit(3600))).cast("long") * 1000000,
    }
    return files.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows from orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    digit = F.substring("o_orderpriority", 1, 1)
    window = S.lookup(digit, {"1": "30m", "2": "2h", "3": "12h", "4": "24h"}, "48h")
    seconds = S.lookup(digit, {"1": 1800, "2": 7200, "3": 43200, "4": 86400}, 172800).cast("long")
    status = pick(k % 8, *V.STATUSES)
    total = F.when(status.isin("validating"), F.lit(0)).otherwise(k % 100 + 1).cast("long")
    done = F.when(status == "completed", total).otherwise(F.floor(total / 2))
    null_long = F.lit(None).cast("long")

    def stamp(state: str, after: int) -> Column:
        return F.when(status == state, created + after)

    spec = F.struct(
        F.lit("batch").alias("object"),
        pick(k % 5, *V.ENDPOINTS).alias("endpoint"),
        F.concat(F.lit("file_"), _s(k % 2500)).alias("input_file_id"),
        window.alias("completion_window"),
        F.create_map(F.lit("origin"), F.col("o_orderstatus")).alias("metadata"),
        created.alias("created_at"),
    )
    state = F.struct(
        status.alias("status"),
        F.when(status == "completed", F.concat(F.lit("file_out_"), _s(k))).alias("output_file_id"),
        F.lit(None).cast("string").alias("error_file_id"),
        stamp("cancelled", 900).alias("cancelled_at"),
        stamp("cancelling", 600).alias("cancelling_at"),
        stamp("completed", 1200).alias("completed_at"),
        stamp("expired", 172800).alias("expired_at"),
        F.when(k % 3 == 0, created + seconds).alias("expires_at"),
        stamp("failed", 300).alias("failed_at"),
        stamp("finalizing", 1000).alias("finalizing_at"),
        F.when(status.isin("in_progress", "finalizing", "completed"), created + k % 600).alias("in_progress_at"),
        F.struct(
            total.alias("total"), done.cast("long").alias("completed"), F.lit(0).cast("long").alias("failed")
        ).alias("request_counts"),
        F.lit(None).cast(JOB["status"].dataType["errors"].dataType).alias("errors"),
        F.lit(None).cast(JOB["status"].dataType["usage"].dataType).alias("usage"),
    )
    tags = F.create_map(
        F.lit("pth:x-team"),
        F.col("o_orderstatus"),
        F.lit("otel:traceparent"),
        F.concat(F.lit("00-"), _s(k)),
        F.lit("tier"),
        pick(k % 2, "gold", "basic"),
        F.lit(V.TAG_OUTPUT_TTL),
        F.when(k % 4 == 0, F.lit("x")).otherwise(_s(k % 4 * 3600)),
    )
    return o.select(
        F.concat(F.lit("batch_"), _s(k)).alias("id"),
        F.concat(F.lit("t"), _s(F.col("o_custkey") % 20)).alias("tenant_id"),
        F.when(k % 3 == 0, created + seconds).otherwise(F.lit(0)).cast("long").alias("expiry"),
        tags.alias("tags"),
        spec.alias("spec"),
        state.alias("status"),
        F.when((status == "validating") & (k % 16 == 0), null_long.cast("string"))
        .otherwise(F.concat(F.lit("p"), _s(k % 5)))
        .alias("processor_id"),
        F.when(k % 11 == 0, F.lit(0)).otherwise((created + seconds) * 1000000).cast("long").alias("priority"),
        (k % 4).alias("epoch"),
        (k % 6).alias("recovery_attempts"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows from part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    expiry = F.when(F.col("p_size") % 5 == 0, F.lit(0)).otherwise(NOW + (F.col("p_size") - 25) * 86400).cast("long")
    name = F.concat(F.regexp_replace("p_name", " ", "_"), pick(k % 3, ".jsonl", ".tar.gz", ""))
    purpose = pick(k % 8, *V.PURPOSES)
    file_id = F.concat(F.lit("file_"), _s(k))
    return p.select(
        file_id.alias("id"),
        F.concat(F.lit("t"), _s(k % 20)).alias("tenant_id"),
        F.struct(
            file_id.alias("id"),
            (F.col("p_retailprice") * 100).cast("long").alias("bytes"),
            F.lit(NOW - 86400).cast("long").alias("created_at"),
            F.when(expiry > 0, expiry).alias("expires_at"),
            name.alias("filename"),
            F.lit("file").alias("object"),
            purpose.alias("purpose"),
            F.lit("uploaded").alias("status"),
        ).alias("spec"),
        expiry.alias("expiry"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("tags"),
        purpose.alias("purpose"),
    )


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files.

    The pattern matches a single file as well as a folder of files; a plain path would have
    to be a folder.
    """
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the inference call returned, one row per line item."""
    return outcomes_of(table(spark, sf_dir, "lineitem"))


def outcomes_of(li: DataFrame, job: Column | None = None) -> DataFrame:
    """Outcomes of line items; a job is an order unless `job` names another one."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 20
    # A column of its own: written out in every place, it makes a method too long to be compiled.
    li = li.withColumn("__code", F.when(k == 0, 429).when(k == 1, 500).when(k == 2, 400).when(k == 3, 0).otherwise(200))
    code = F.col("__code")
    prompt = (F.col("l_quantity") * 10).cast("long")
    answer = F.col("l_partkey") % 500
    body = F.concat(
        F.lit('{"usage":{"prompt_tokens":'),
        _s(prompt),
        F.when(answer % 10 != 0, F.concat(F.lit(',"completion_tokens":'), _s(answer))).otherwise(F.lit("")),
        F.lit("}}"),
    )
    ident = F.concat_ws("_", *[_s(F.col(c)) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    job = F.concat(F.lit("batch_"), _s(F.col("l_orderkey"))) if job is None else job
    return li.select(
        job.alias("job_id"),
        F.concat(F.lit("batch_req_"), ident).alias("request_id"),
        F.concat(F.lit("c-"), ident).alias("custom_id"),
        F.concat(F.lit("m"), _s(F.col("l_suppkey") % 3)).alias("route_key"),
        pick(S.lookup(F.col("l_returnflag"), {"A": 0, "N": 1}, 2), "ep-a", "ep-b", "ep-c").alias("endpoint"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        code.alias("status_code"),
        F.when(code == 200, F.when(F.col("l_partkey") % 97 == 0, F.lit("not json")).otherwise(body))
        .when(code == 400, F.lit("bad input"))
        .when(code >= 429, F.concat(F.lit('{"error":{"message":"slow down","code":'), _s(code), F.lit("}}")))
        .alias("body"),
        F.when(code == 0, F.lit("UNKNOWN")).when(code != 200, S.error_category(code)).alias("error_category"),
        F.when(code == 0, F.lit("connection reset")).alias("error_message"),
        F.when((code == 429) & (F.col("l_partkey") % 5 == 0), F.lit(V.DROPPED_TTL_EXPIRED)).alias("dropped_reason"),
        (F.col("l_partkey") % 13 == 0).alias("had_capacity_retry"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples that reset every 1,000 events, one series per event type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("series"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 1000).cast("double").alias("value"),
    )
