"""The whole batch job: request lines to results, counts and usage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..operators import infer as run
from ..operators import jobs as J
from ..operators import plan as planning
from ..operators import results as res
from ..schemas import ATTEMPT
from ..session import committed, discard, materialize, scratch_path, small_side
from ..sources import requests as src


@dataclass
class JobRun:
    """Tables a finished run leaves behind."""

    plan: planning.Plan
    results: DataFrame

    @property
    def rejected(self) -> DataFrame:
        return self.plan.rejected


SENT = ["job_id", "request_id", "custom_id", "route_key", "prefix_hash", "line_no", "url", "model", "value"]


def with_user_prompt(requests: DataFrame) -> DataFrame:
    """Add the user prompt the stand-in client reads."""
    prompts = F.from_json("value", "body STRUCT<messages: ARRAY<STRUCT<role: STRING, content: STRING>>>")
    user = F.get(F.filter(prompts["body"]["messages"], lambda m: m["role"] == "user"), F.lit(0))["content"]
    return requests.withColumn("user_prompt", user)


def run_jobs(
    lines: DataFrame,
    gateways: DataFrame,
    make_client: Callable[[], run.Client],
    method: str = "model",
    use_global: bool = False,
    **retry,
) -> JobRun:
    """Validate, route, plan, infer and collect all jobs of `lines` in one pass.

    The attempts are written once before anything reads them: calls to a model are dear and
    must not be repeated because two reports use the same results.
    """
    plan = planning.build_plan(lines, gateways, method, use_global)
    calls = run.infer(plan.requests.select(*SENT), make_client, prepare=with_user_prompt, **retry)
    return JobRun(plan, res.to_results(run.final_outcomes(materialize(calls, "attempts"))))


# --- a job to its end, resumable ------------------------------------------------------

ATTEMPTS = T.StructType([T.StructField(c, T.StringType()) for c in run.CARRIED] + ATTEMPT.fields)


@dataclass
class FinishedRun:
    """What a run leaves in its folder: the finished jobs, every attempt, every result row."""

    jobs: DataFrame
    attempts: DataFrame
    results: DataFrame


def stop_cause(now: int) -> Column:
    """Why a job may not dispatch: the earlier of its passed deadline and its cancellation, else NULL."""
    deadline = F.when(F.col("priority") > 0, F.col("priority") / 1000000)
    cancelled = F.col("status.status") == "cancelling"
    first = cancelled & F.coalesce(deadline > F.col("status.cancelling_at"), F.lit(True))
    return (
        F.when(first, F.lit("batch_cancelled"))
        .when(deadline <= now, F.lit("batch_expired"))
        .when(cancelled, F.lit("batch_cancelled"))
    )


def result_rows(spark: SparkSession, out: str, waves: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(attempts, their results, requests rejected at ingest) of a run's folder."""
    paths = [wave_path(out, k) for k in range(waves)]
    attempts = spark.read.schema(ATTEMPTS).parquet(*paths)
    return attempts, res.to_results(run.final_outcomes(attempts)), spark.read.parquet(f"{out}/rejected")


def wave_path(out: str, wave: int) -> str:
    return f"{out}/attempts/wave={wave}"


def all_rows(executed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Results of execution and of ingest together, one row per request."""
    cols = ["job_id", "request_id", "custom_id", "route_key", "response", "error"]
    none = F.lit(None).cast(executed.schema["response"].dataType).alias("response")
    return executed.select(*cols).unionByName(rejected.withColumn("response", none).select(*cols))


def finish_jobs(
    jobs: DataFrame,
    lines: DataFrame,
    gateways: DataFrame,
    make_client: Callable[[], run.Client],
    out: str,
    now: int,
    method: str = "model",
    use_global: bool = False,
    fairness: bool = False,
    waves: int = 8,
    requests_per_task: int = 2000,
    stops: str | None = None,
    **retry,
) -> FinishedRun:
    """Run every unfinished job of `jobs` to its end below the folder `out`, or resume there.

    Requests of a job that is past its deadline or cancelled are answered `batch_expired` or
    `batch_cancelled` without a call; the others get their headers and are sent. Output and error
    files hold each request once. A job ends `failed` when its file has a bad line (only requests
    rejected ahead of that line are published, and it has no counts), `expired` or `cancelled` by
    its cause, else `completed`.

    The work is cut into `waves`, by file and run of lines, and each wave's attempts are committed
    before the next starts. After a loss of the driver, the same call goes on behind the committed
    waves: their requests are not sent again, those of the broken wave are. The first run fixes
    the number of waves; planning is repeated, as request ids depend on job and line alone. A
    `stops` names a folder of stop causes (Parquet files of job_id, cause and ts, such as those of
    `cause_stream`). It is read again before each wave and, by the tasks, before each call, so a job that is
    cancelled during the run stops there: the requests it has left are answered without a call.
    A finished folder is only read. Lines without an unfinished job are left out, and so are jobs
    that have ended already. Needs the lines that `build_plan` needs, one file per job.
    """
    spark = jobs.sparkSession
    if not committed(spark, f"{out}/run"):
        spark.createDataFrame([(waves,)], "waves int").write.mode("overwrite").parquet(f"{out}/run")
    waves = spark.read.parquet(f"{out}/run").first()["waves"]
    if not committed(spark, f"{out}/jobs"):
        open_jobs = jobs.filter(~F.col("status.status").isin(*V.TERMINAL))
        _execute(open_jobs, lines, gateways, make_client, out, now, method, use_global, fairness, waves, requests_per_task, stops, retry)
    attempts, executed, rejected = result_rows(spark, out, waves)
    return FinishedRun(spark.read.parquet(f"{out}/jobs"), attempts, all_rows(executed, rejected))


def _execute(
    jobs, lines, gateways, make_client, out, now, method, use_global, fairness, waves, requests_per_task, stops, retry
) -> None:
    spark = jobs.sparkSession
    scratch = scratch_path(spark, "decoded")

    def store(df: DataFrame) -> DataFrame:
        run_of_lines = F.floor(F.col("line_no") / V.MAX_FILE_LINES)
        cut = df.withColumn("wave", F.pmod(F.xxhash64("file_id", run_of_lines), F.lit(waves)).cast("int"))
        cut.write.partitionBy("wave").parquet(scratch)
        return spark.read.schema(cut.schema).parquet(scratch)

    tenants = jobs.select(F.col("id").alias("job_id"), "tenant_id")
    own = lines.drop("tenant_id").join(small_side(tenants), "job_id")
    plan = planning.build_plan(own, gateways, method, use_global, store)
    context = planning.job_headers(jobs).select(
        F.col("id").alias("job_id"), "priority", "headers", stop_cause(now).alias("cause")
    )
    objective = F.lit(None).cast("string")
    if "objective" in gateways.columns:
        objective = F.col("gateway.objective")
    requests = planning.build_headers(
        plan.requests.join(small_side(context), "job_id").withColumn("objective", objective), now, fairness
    )
    tasks = max(spark.sparkContext.defaultParallelism, ceil(plan.entries.count() / waves / requests_per_task))
    for k in range(waves):
        if committed(spark, wave_path(out, k)):
            continue
        wave = requests.filter(F.col("wave") == k)
        if stops:
            wave = with_live_causes(wave, stops)
        sent = wave.filter("cause IS NULL").select(*SENT, "headers")
        stopped = run.stops_in(stops) if stops else None
        called = run.infer(sent, make_client, parallelism=tasks, prepare=with_user_prompt, stopped=stopped, **retry)
        answered = run.not_dispatched(wave.filter("cause IS NOT NULL"))
        called.unionByName(answered).write.mode("overwrite").parquet(wave_path(out, k))
    kept = plan.rejected.withColumn("early", F.lit(False)).unionByName(plan.early.withColumn("early", F.lit(True)))
    kept.write.mode("overwrite").parquet(f"{out}/rejected")
    failed = plan.lines.select("job_id", "file_id").join(plan.bad_files, "file_id", "left_semi").select("job_id").distinct()
    failed = materialize(failed, "failed-jobs")
    discard(spark, scratch)

    attempts, executed, rejected = result_rows(spark, out, waves)
    rows = all_rows(executed, rejected)
    src.write_results(rows, f"{out}/results", mode="overwrite")
    counts = res.request_counts(executed, rejected.filter("NOT early"))
    ended = with_end_state(jobs, failed, attempts, now)
    done = J.finalise(ended, counts, src.result_files(rows), now, state="__end").drop("__end")
    done.write.mode("overwrite").parquet(f"{out}/jobs")


def with_live_causes(wave: DataFrame, stops: str) -> DataFrame:
    """Requests whose job has stopped by now get its first cause, unless they have one already."""
    spark = wave.sparkSession
    now = run.stops_in(stops)()
    rows = spark.createDataFrame(list(now.items()), "job_id string, live_cause string")
    joined = wave.join(small_side(rows), "job_id", "left")
    return joined.withColumn("cause", F.coalesce("cause", "live_cause")).drop("live_cause")


def with_end_state(jobs: DataFrame, failed: DataFrame, attempts: DataFrame, now: int) -> DataFrame:
    """Add `__end`, the state each job ends in.

    A deadline that passes once everything was dispatched does not expire the job any more.
    """
    calls = attempts.groupBy(F.col("job_id").alias("id")).agg(
        F.max(F.col("attempt") > 0).alias("__called"),
        F.max((F.col("attempt") == 0) & (F.col("error_category") == "batch_expired")).alias("__late"),
        F.max((F.col("attempt") == 0) & (F.col("error_category") == "batch_cancelled")).alias("__stopped"),
    )
    bad = failed.select(F.col("job_id").alias("id"), F.lit(True).alias("__bad"))
    cause = stop_cause(now)
    late = F.coalesce("__late", F.lit(False)) | ~F.coalesce("__called", F.lit(False)) & (cause == "batch_expired")
    state = (
        F.when(F.col("__bad"), F.lit("failed"))
        .when((cause == "batch_cancelled") | F.col("__stopped"), F.lit("cancelled"))
        .when(late, F.lit("expired"))
        .otherwise(F.lit("completed"))
    )
    joined = jobs.join(calls, "id", "left").join(bad, "id", "left")
    return joined.select(*jobs.columns, state.alias("__end"))
