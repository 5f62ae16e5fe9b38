"""Recovery after a crash, orphan triage and expiry collection, each as one set-based pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..session import small_side
from .jobs import STATE, deadline_passed, is_expired, is_terminal


def orphans(jobs: DataFrame, live: DataFrame | None) -> DataFrame:
    """Owned jobs that are not finished and whose processor is not in the live snapshot.

    `live` has processor_id. Without a snapshot nothing is an orphan.
    """
    owned = jobs.filter(F.col("processor_id").isNotNull() & ~is_terminal())
    if live is None:
        return owned.limit(0)
    return owned.join(small_side(live.select("processor_id").distinct()), "processor_id", "left_anti").select(*jobs.columns)


def triage_orphans(jobs: DataFrame, live: DataFrame | None, now: int, dry_run: bool = False) -> DataFrame:
    """Decide about every orphan: `action`, `new_status` and whether the row changes.

    cancelling ends as cancelled; a passed deadline as failed (both counted as expired); a
    job without deadline is an error; the rest goes back to the queue. A dry run decides the
    same and changes nothing.
    """
    found = orphans(jobs, live)
    has_deadline = F.coalesce("priority", F.lit(0)) > 0
    action = (
        F.when(F.col(STATE) == "cancelling", F.lit("cancelled"))
        .when(deadline_passed(now), F.lit("failed"))
        .when(has_deadline, F.lit("re_enqueued"))
        .otherwise(F.lit("error"))
    )
    return found.withColumn("action", action).select(
        "id",
        "processor_id",
        F.col(STATE).alias("old_status"),
        "epoch",
        "action",
        F.when(F.col("action").isin("cancelled", "failed"), F.col("action"))
        .when(F.col("action") == "re_enqueued", F.lit("validating"))
        .alias("new_status"),
        ((F.col("action") != "error") & F.lit(not dry_run)).alias("changes"),
    )


def reconcile_summary(triaged: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Totals of one cycle: expired, re_enqueued, conflicts, errors.

    `outcomes` (id, outcome) tells which planned changes met a newer row.
    """
    rows = triaged.select("id", "action")
    if outcomes is None:
        rows = rows.withColumn("outcome", F.lit(None).cast("string"))
    else:
        rows = rows.join(outcomes.select("id", "outcome"), "id", "left")
    lost = F.coalesce(F.col("outcome") == "conflict", F.lit(False))
    moved = F.col("action").isin("cancelled", "failed")
    back = F.col("action") == "re_enqueued"
    return rows.agg(
        F.count_if(moved & ~lost).alias("expired"),
        F.count_if(back & ~lost).alias("re_enqueued"),
        F.count_if(moved & lost).alias("conflicts"),
        F.count_if((F.col("action") == "error") | (back & lost)).alias("errors"),
    )


def recover(claimed: DataFrame, has_output: DataFrame, now: int) -> DataFrame:
    """Route jobs claimed for recovery: `status_label`, `action`, `new_status`, `cancel_phase`.

    `claimed` are job rows after the claim, `has_output` (job_id) the jobs with a non-empty
    output file. A job past its recovery budget fails with what survived.
    """
    out = has_output.select(F.col("job_id").alias("id")).distinct().withColumn("__out", F.lit(True))
    joined = claimed.join(out, "id", "left")
    state = F.col(STATE)
    with_output = F.coalesce("__out", F.lit(False))
    spent = F.col("recovery_attempts") > V.MAX_RECOVERY_ATTEMPTS
    # Deadline from the row, else from its expires_at; a job with neither cannot be queued again.
    stored = F.coalesce(F.col("status.expires_at") * 1000000, F.lit(0))
    deadline = F.when(F.coalesce("priority", F.lit(0)) > 0, F.col("priority")).otherwise(stored)
    again = F.when(deadline <= 0, F.lit("failed")).when(deadline_passed(now, deadline), F.lit("expired")).otherwise(F.lit("re_enqueued"))
    action = (
        F.when(is_terminal(), F.lit("cleaned_up"))
        .when(spent, F.lit("failed"))
        .when(state == "finalizing", F.lit("finalized"))
        .when(state == "cancelling", F.lit("cancelled"))
        .when(state == "in_progress", F.when(with_output, F.lit("failed")).otherwise(again))
        .when(state == "validating", again)
        .otherwise(F.lit("failed"))
    )
    phase = F.when(F.coalesce("status.request_counts.total", F.lit(0)) > 0, F.lit("in_progress")).otherwise(F.lit("queued"))
    staged = joined.withColumn("action", action)
    new_status = S.lookup(
        F.col("action"),
        {
            "finalized": "completed",
            "cancelled": "cancelled",
            "failed": "failed",
            "expired": "expired",
            "re_enqueued": "validating",
        },
    )
    return staged.select(
        "id",
        state.alias("status_label"),
        "action",
        new_status.alias("new_status"),
        F.when(F.col("action") == "cancelled", phase).alias("cancel_phase"),
    )


def recovery_summary(recovered: DataFrame) -> DataFrame:
    """Recoveries by (status, action)."""
    return recovered.groupBy(F.col("status_label").alias("status"), "action").agg(F.count(F.lit(1)).alias("jobs"))


def stale_artifacts(artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Work folders (path, job_id) whose job row is gone: the list to delete."""
    return artifacts.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti").select("path", "job_id")


def expired_jobs(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.filter(is_expired(now)).select("id")


def expired_files(files: DataFrame, now: int) -> DataFrame:
    """Expired files with the stored object to delete before the row: folder and name."""
    late = files.filter(is_expired(now))
    return late.select(
        "id", S.tenant_folder("tenant_id").alias("folder"), S.storage_name("id", "spec.filename").alias("name")
    )


def collect_expired(
    jobs: DataFrame, files: DataFrame, now: int, undeletable: DataFrame | None = None, dry_run: bool = False
) -> DataFrame:
    """One row per expired job and file: `kind`, `id`, `path` to delete and `outcome`.

    `undeletable` (folder, name) lists stored objects whose deletion failed: their rows stay
    and count as failed. A dry run reports `found` only. All rows are handled in one pass,
    so none is skipped by paging over a shrinking table.
    """
    gone_jobs = expired_jobs(jobs, now).select(
        F.lit("batch").alias("kind"), "id", F.lit(None).cast("string").alias("path"), F.lit(False).alias("__failed")
    )
    late = expired_files(files, now)
    if undeletable is not None:
        stuck = undeletable.select("folder", "name", F.lit(True).alias("__failed"))
        late = late.join(stuck, ["folder", "name"], "left").fillna(False, ["__failed"])
    else:
        late = late.withColumn("__failed", F.lit(False))
    gone_files = late.select(F.lit("file").alias("kind"), "id", F.concat_ws("/", "folder", "name").alias("path"), "__failed")
    outcome: Column = F.when(F.lit(dry_run), F.lit("found")).when(F.col("__failed"), F.lit("failed")).otherwise(F.lit("deleted"))
    return gone_jobs.unionByName(gone_files).select("kind", "id", "path", outcome.alias("outcome"))


def retention_summary(collected: DataFrame) -> DataFrame:
    """Totals of one expiry cycle."""

    def total(kind: str, outcome: str, name: str) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("outcome") == outcome)).alias(name)

    return collected.agg(
        total("batch", "deleted", "batches_deleted"),
        total("file", "deleted", "files_deleted"),
        total("batch", "failed", "batches_failed"),
        total("file", "failed", "files_failed"),
    )
