"""Streaming operators.

Stateful steps use Spark's own: windowed and keyed aggregation, de-duplication within the
watermark, and keyed state with event-time timers. Where a batch operator already is exact under skew
(adaptive limit, planning), the stream hands it one micro-batch at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import values as V
from ..operators import adaptive, ingest, plan
from ..operators.results import is_success
from ..session import materialize
from ..sources.requests import number_lines, with_source
from . import stateful
from .sinks import each_batch, upsert_table, write_batch


# --- progress ---------------------------------------------------------------------


SLOTTED = "job_id string, slot timestamp, total long, completed long, failed long, first_ts long, last_ts long"


def progress_counts(results: DataFrame, ttl: float = V.PROGRESS_TTL, clock: Column | None = None) -> DataFrame:
    """Running total, completed and failed per job and slot, with the times of the first and the last result.

    A slot is a time to live by the clock of arrival (or a `clock` of the caller's, a timestamp). Its state is dropped
    when the slot is over, so state does not outlive the jobs that made it; `live_progress` joins
    the slots of a job. Counts are combined before the shuffle, so a hot job is no hot task.
    """
    arrived = results.withColumn("__at", F.current_timestamp() if clock is None else clock).withWatermark("__at", "0 seconds")
    slot = F.window("__at", f"{max(1, round(ttl * 1000))} milliseconds").alias("w")
    counts = arrived.groupBy("job_id", slot).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_success()).alias("completed"),
        F.count_if(~is_success()).alias("failed"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return counts.select("job_id", F.col("w.start").alias("slot"), "total", "completed", "failed", "first_ts", "last_ts")


def progress_stream(
    results: DataFrame, root: str, interval: str | None = "1 second", ttl: float = V.PROGRESS_TTL, clock: Column | None = None
) -> StreamingQuery:
    """Push changed progress at most once per interval; the last batch is the final push.

    `interval=None` processes what is there and stops.
    """
    trigger = {"processingTime": interval} if interval else None
    return upsert_table(progress_counts(results, ttl, clock), root, "update", trigger)


def live_progress(slots: DataFrame, now: int, ttl: int = V.PROGRESS_TTL) -> DataFrame:
    """Progress per job that was updated within its time to live (seconds), from the newest rows of its slots.

    A job that was silent for longer than its time to live started afresh: only what came after counts.
    """
    own = W.partitionBy("job_id").orderBy("slot")
    before = F.max("last_ts").over(own.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("first_ts") - before > ttl, F.col("slot"))
    begin = F.max("fresh").over(W.partitionBy("job_id"))
    joined = slots.withColumn("fresh", fresh).withColumn("begin", begin).filter("begin IS NULL OR slot >= begin")
    sums = [F.sum(c).cast("long").alias(c) for c in ("total", "completed", "failed")]
    return joined.groupBy("job_id").agg(*sums, F.max("last_ts").alias("last_ts")).filter(F.col("last_ts") + ttl > now)


# --- results ----------------------------------------------------------------------


def dedupe_results(results: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """First delivered result per request id; repeats within the watermark are dropped.

    The state of an id is kept for the watermark delay only.
    """
    return results.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["request_id"])


# Fixed for the life of a checkpoint; some hundred open requests a bucket are a good number.
BUCKETS = 1024


def correlate_stream(requests: DataFrame, results: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Each request with the time of its first result, or `batch_expired` at its deadline.

    `requests` has request_id (unique), ts and deadline (timestamps), `results` has request_id
    and res_ts. Open requests are the state of hash buckets, each with an event-time timer at the first
    deadline, so any deadline is kept, however far off. A result counts from the request's time up to its
    deadline; it may arrive before the request. Once answered or expired, a request's state is
    gone; later repeats and results of unknown requests wait until the watermark has passed
    them and drop out. A request without a deadline stays open until it is answered.
    """
    none = F.lit(None).cast("timestamp")
    asked = requests.select("request_id", F.col("ts").alias("at"), "deadline", F.lit(True).alias("asked"))
    came = results.select("request_id", F.col("res_ts").alias("at"), none.alias("deadline"), F.lit(False).alias("asked"))
    both = asked.withWatermark("at", delay).unionByName(came.withWatermark("at", delay))
    rows = both.select("request_id", "at", F.unix_micros("at").alias("micros"), F.unix_micros("deadline").alias("deadline"), "asked")
    out = stateful.settled(rows, buckets)
    times = [F.timestamp_micros(c).alias(c) for c in ("ts", "deadline", "res_ts")]
    open_ = F.col("res_ts").isNull()
    return out.select("request_id", *times).withColumns(
        {
            "error_code": F.when(open_, F.lit("batch_expired")),
            "error_message": F.when(open_, F.lit(V.NOT_COLLECTED_MESSAGE)),
        }
    )


def fan_out(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results of one shared stream with the job they belong to.

    A join on the request id against the table of pending requests takes the place of one
    subscription per job; results nobody waits for drop out.
    """
    return results.join(requests.select("request_id", "job_id"), "request_id")


def late_results(results: DataFrame, closed: DataFrame) -> DataFrame:
    """Add `late`: the result came after its request was resolved or given up.

    `closed` has request_id and closed_at. Late results are to be dropped and counted.
    """
    ends = closed.select("request_id", "closed_at")
    joined = results.join(ends, "request_id", "left")
    return joined.withColumn("late", F.coalesce(F.col("ts") > F.col("closed_at"), F.lit(False))).drop("closed_at")


# --- adaptive limit ---------------------------------------------------------------


def aimd_stream(
    signals: DataFrame, order: list[str], root: str, limits: adaptive.Limits = adaptive.Limits(), trigger: dict | None = None
) -> StreamingQuery:
    """Follow the adaptive limit of every endpoint across micro-batches.

    A batch is replayed by the parallel batch operator from the state the batch before it
    left in `root/state`; its trace goes to `root/data`. The state is one row per endpoint.
    Re-running a batch reads the same earlier state and overwrites its own folders.
    """

    def act(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        state = None
        if n > 0:
            state = spark.read.schema("endpoint string, `limit` long, run long").parquet(f"{root}/state/batch={n - 1}")
        trace = materialize(adaptive.aimd_trace(rows, order, limits, state), "trace")
        write_batch(trace, f"{root}/data", n)
        write_batch(adaptive.aimd_state(trace, order, limits, state), f"{root}/state", n)

    return each_batch(signals, root, act, trigger=trigger)


# --- stop causes ------------------------------------------------------------------


def causes(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each event as a cause to stop its job: job_id, ts and cause.

    `events` has job_id, cause and ts (seconds); `jobs` has job_id and deadline (microseconds,
    0 for none). A deadline that passed before an event is the earlier cause.
    """
    known = jobs.select("job_id", F.nullif(F.col("deadline"), F.lit(0).cast("long")).alias("__deadline"))
    joined = events.join(known, "job_id", "left")
    passed = F.coalesce(F.col("__deadline") <= F.col("ts") * 1000000, F.lit(False))
    at = F.when(passed, F.floor(F.col("__deadline") / 1000000).cast("long")).otherwise(F.col("ts"))
    cause = F.when(passed, F.lit("expired")).otherwise(F.col("cause"))
    return joined.select("job_id", at.alias("ts"), cause.alias("cause"))


def first_causes(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """The first cause that stops each job: cancelled, shutdown or expired."""
    first = F.min(F.struct("ts", "cause")).alias("first")
    return causes(events, jobs).groupBy("job_id").agg(first).select("job_id", "first.ts", "first.cause")


def cause_stream(
    events: DataFrame, jobs: DataFrame, root: str, trigger: dict | None = None, ttl: float = V.EVENT_TTL
) -> StreamingQuery:
    """Keep the first cause per job up to date as events arrive; a job is forgotten `ttl` seconds after its last change."""
    rows = stateful.partial_causes(causes(events, jobs))
    return upsert_table(stateful.live_causes(rows, ttl), root, "update", trigger)


# --- rates ------------------------------------------------------------------------


def rate_stream(events: DataFrame, by: list[str], window: str, slide: str, delay: str, seconds: float, ts: str = "ts") -> DataFrame:
    """Events per second in sliding windows, emitted when the watermark closes them."""
    kept: list[Column] = [F.col(c) for c in by]
    grouped = events.withWatermark(ts, delay).groupBy(F.window(ts, window, slide).alias("w"), *kept)
    return grouped.agg((F.count(F.lit(1)) / F.lit(seconds)).alias("rate")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "rate"
    )


# --- ingest -----------------------------------------------------------------------


def ingest_stream(spark, path: str, root: str, gateways: DataFrame, file_id=None, files_per_batch: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Validate and plan request files as they arrive; one file is one job.

    A micro-batch holds whole files, so the rules that need all lines of a file hold. Verdicts
    go to `root/verdict`, plan entries to `root/plan`, rejected requests to `root/rejected`.
    """
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def act(raw: DataFrame, n: int) -> None:
        lines = number_lines(raw, file_id).withColumn("job_id", F.col("file_id"))
        made = plan.build_plan(lines, gateways)
        narrow = made.lines.drop("value", "system_prompt")
        write_batch(ingest.file_verdict(ingest.check_lines(narrow, validated=True)), f"{root}/verdict", n)
        write_batch(made.entries, f"{root}/plan", n)
        write_batch(made.rejected.select("job_id", "request_id", "custom_id", "error"), f"{root}/rejected", n)

    return each_batch(with_source(reader.text(path)), root, act, trigger=trigger)
