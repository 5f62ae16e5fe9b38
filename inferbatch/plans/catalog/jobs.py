"""Queries over job and file tables: filters, paging, claiming, updates, recovery, expiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions import values as V
from ...operators import jobs as J
from ...operators import lifecycle as L
from ...operators import results as res
from ...schemas import JOB, JOB_STATUS
from ...session import scratch_path
from ...sources import buckets
from ...sources import requests as src
from ...sources import tables as tab
from .. import views
from . import query
from .execution import results
from .sqlviews import sql

NOW = views.NOW
T_TERMINAL = "('completed', 'failed', 'expired', 'cancelled')"


def number():
    """Key of the source row, read back from the id."""
    return F.regexp_extract("id", r"(\d+)$", 1).cast("long")


def state(df, *names):
    """Flat view of job rows: id and the named status fields."""
    return [F.col(f"status.{n}").alias(n.split(".")[-1]) for n in names]


@query(
    "encode_batch",
    sql(
        """SELECT id, tenant_id, coalesce(expires_at, 0) AS expiry, (created_at + secs) * 1000000 AS priority,
             endpoint, completion_window, status, total, completed, created_at FROM jobs""",
        "jobs",
    ),
)
def encode_batch(spark, d):
    """Typed jobs to stored JSON rows, through a Parquet table, and back to typed columns."""
    path = scratch_path(spark, "jobs")
    tab.encode_batch(views.jobs(spark, d)).write.parquet(path)
    jobs = tab.decode_batch(tab.read_jobs(spark, path))
    return jobs.select(
        "id",
        "tenant_id",
        "expiry",
        "priority",
        F.col("spec.endpoint").alias("endpoint"),
        F.col("spec.completion_window").alias("completion_window"),
        F.col("status.status").alias("status"),
        F.col("status.request_counts.total").alias("total"),
        F.col("status.request_counts.completed").alias("completed"),
        F.col("spec.created_at").alias("created_at"),
    )


@query(
    "encode_file",
    sql(
        """SELECT id, tenant_id, CASE WHEN expiry > 0 THEN expiry END AS expires_at, filename, purpose,
             'uploaded' AS status FROM files""",
        "files",
    ),
)
def encode_file(spark, d):
    path = scratch_path(spark, "files")
    tab.encode_file(views.files(spark, d).withColumn("file", F.col("spec"))).write.parquet(path)
    back = tab.decode_file(tab.read_files(spark, path))
    return back.select("id", "tenant_id", "expires_at", "filename", "purpose", "status")


@query(
    "job_info",
    sql(
        "SELECT id, o_orderstatus AS team, '00-' || k AS trace, 1::INT AS headers, 1::INT AS traces FROM jobs",
        "jobs",
    ),
)
def job_info(spark, d):
    from ...operators.plan import job_headers

    j = job_headers(views.jobs(spark, d))
    return j.select(
        "id",
        F.col("headers")["x-team"].alias("team"),
        F.col("trace_context")["traceparent"].alias("trace"),
        F.size("headers").alias("headers"),
        F.size("trace_context").alias("traces"),
    )


@query(
    "validate_jobs",
    sql(
        f"""SELECT id, CASE
             WHEN k % 13 = 1 THEN 'completion_window is required'
             WHEN k % 13 = 2 THEN 'completion_window must be a valid duration (e.g., 24h)'
             WHEN k % 13 = 3 THEN 'endpoint is required'
             WHEN k % 13 = 4 THEN 'invalid endpoint: /v1/files'
             WHEN k % 13 = 5 THEN 'input_file_id is required'
             WHEN k % 13 = 6 THEN 'metadata: too many keys (max 16, got 17)'
             WHEN k % 13 = 7 THEN 'metadata: key exceeds 64 characters'
             WHEN k % 13 = 8 THEN 'metadata: value for key "origin" exceeds 512 characters'
             WHEN k % 13 = 9 THEN 'output_expires_after.anchor must be ''created_at'''
             WHEN k % 13 = 10 OR (k % 13 = 11 AND secs < 3600)
               THEN 'output_expires_after.seconds must be between 3600 (1 hour) and 2592000 (30 days)'
           END AS error_msg FROM jobs""",
        "jobs",
    ),
)
def validate_jobs(spark, d):
    """Every rule is broken by one residue class of the order keys."""
    n = number() % 13
    j = views.jobs(spark, d)
    many = F.map_from_entries(
        F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.struct(i.cast("string"), F.lit("v")))
    )
    long_key = F.create_map(F.repeat(F.lit("k"), 65), F.lit("v"))
    long_value = F.create_map(F.lit("origin"), F.repeat(F.lit("é"), 257))
    seconds = F.round(S.duration_seconds("spec.completion_window")).cast("long")
    submitted = j.select(
        "id",
        F.when(n == 1, F.lit("")).when(n == 2, F.lit("one day")).otherwise(F.col("spec.completion_window")).alias("completion_window"),
        F.when(n == 3, F.lit(None)).when(n == 4, F.lit("/v1/files")).otherwise(F.col("spec.endpoint")).alias("endpoint"),
        F.when(n != 5, F.col("spec.input_file_id")).alias("input_file_id"),
        F.when(n == 6, many).when(n == 7, long_key).when(n == 8, long_value).otherwise(F.col("spec.metadata")).alias("metadata"),
        F.when(n == 9, F.lit("now")).when(n.isin(10, 11), F.lit("created_at")).alias("expires_anchor"),
        F.when(n == 9, F.lit(7200)).when(n == 10, F.lit(2592001)).when(n == 11, seconds).cast("long").alias("expires_seconds"),
    )
    return J.validate_jobs(submitted).select("id", "error_msg")


@query(
    "check_inputs",
    sql(
        """SELECT j.id, CASE WHEN f.id IS NULL THEN 'Input file with ID ''' || j.input_file_id || ''' not found'
             WHEN f.purpose <> 'batch' THEN 'Input file ''' || j.input_file_id || ''' has purpose ''' || f.purpose
               || ''', but must have purpose ''batch''' END AS input_error
           FROM jobs j LEFT JOIN files f ON f.id = j.input_file_id AND f.tenant_id = j.tenant_id""",
        "jobs",
        "files",
    ),
)
def check_inputs(spark, d):
    return J.check_inputs(views.jobs(spark, d), views.files(spark, d)).select("id", "input_error")


@query(
    "validate_files",
    sql(
        """SELECT id, CASE k % 10
               WHEN 0 THEN 'Missing required parameter: ''purpose'''
               WHEN 1 THEN 'Invalid file purpose ''other''. Must be one of: assistants, assistants_output, batch, batch_output, fine-tune, fine-tune-results, vision, user_data'
               WHEN 2 THEN 'both expires_after[anchor] and expires_after[seconds] must be provided together'
               WHEN 3 THEN 'invalid expires_after[anchor] ''now''. Only ''created_at'' is supported'
               WHEN 4 THEN 'invalid expires_after[seconds]: must be a valid integer'
               WHEN 5 THEN 'expires_after[seconds] must be between 3600 (1 hour) and 2592000 (30 days)' END AS error_msg,
             CASE WHEN k % 10 >= 7 THEN 883612800 + 7776000 WHEN k % 10 = 6 THEN 883612800 + 7200 END::BIGINT AS expires_at,
             CASE k % 3 WHEN 0 THEN id || '.jsonl' ELSE filename END AS filename
           FROM files""",
        "files",
    ),
)
def validate_files(spark, d):
    f = views.files(spark, d)
    n = number() % 10
    uploads = f.select(
        "id",
        F.when(number() % 3 == 0, F.lit("/")).otherwise(F.concat(F.lit("dir/sub/"), F.col("spec.filename"))).alias("filename"),
        F.when(n == 0, F.lit("")).when(n == 1, F.lit("other")).otherwise(F.col("purpose")).alias("purpose"),
        F.when(n == 3, F.lit("now")).when(n.isin(4, 5, 6), F.lit("created_at")).alias("expires_anchor"),
        F.when(n == 4, F.lit("1h")).when(n == 5, F.lit("60")).when(n.isin(2, 3, 6), F.lit("7200")).alias("expires_seconds"),
    )
    return J.validate_files(uploads, NOW).select("id", "error_msg", "expires_at", "filename")


@query(
    "query_by_tenant_and_tags",
    sql("SELECT id, priority FROM jobs WHERE tenant_id = 't3' AND tier = 'gold' AND o_orderstatus = 'F'", "jobs"),
)
def query_by_tenant_and_tags(spark, d):
    kept = J.query_items(
        views.jobs(spark, d), tenant="t3", tags={"tier": "gold", "pth:x-team": "F"}, include_static=False
    )
    return kept.select("id", "priority")


@query(
    "query_by_any_tag",
    sql("SELECT id FROM jobs WHERE tier = 'gold' OR o_orderstatus = 'P'", "jobs"),
)
def query_by_any_tag(spark, d):
    return J.query_items(views.jobs(spark, d), tags={"tier": "gold", "pth:x-team": "P"}, any_tag=True).select("id")


@query(
    "query_expired",
    sql(f"SELECT id, expiry FROM jobs WHERE expiry > 0 AND expiry <= {NOW}", "jobs"),
)
def query_expired(spark, d):
    return J.query_items(views.jobs(spark, d), expired_at=NOW).select("id", "expiry")


@query(
    "query_owned_open",
    sql(
        f"SELECT id, processor_id FROM jobs WHERE processor_id = 'p1' AND status NOT IN {T_TERMINAL}",
        "jobs",
    ),
)
def query_owned_open(spark, d):
    kept = J.query_items(views.jobs(spark, d), processor="p1", non_terminal=True, has_processor=True)
    return kept.select("id", "processor_id")


@query(
    "query_by_purpose_and_ids",
    sql("SELECT id FROM files WHERE purpose = 'batch' AND id IN ('file_2', 'file_10', 'file_11')", "files"),
)
def query_by_purpose_and_ids(spark, d):
    return J.query_items(views.files(spark, d), ids=["file_2", "file_10", "file_11"], purpose="batch").select("id")


@query("query_without_condition", sql("SELECT id FROM jobs WHERE false", "jobs"))
def query_without_condition(spark, d):
    return J.query_items(views.jobs(spark, d)).select("id")


@query(
    "state_predicates",
    sql(
        f"""SELECT id, status IN {T_TERMINAL} AS terminal, status IN ('validating','in_progress','cancelling') AS cancellable,
             status IN ('validating','in_progress') AS runnable,
             priority > 0 AND priority < {NOW}000000 AS late, processor_id IS NULL AND status = 'validating' AS queued
           FROM jobs""",
        "jobs",
    ),
)
def state_predicates(spark, d):
    return views.jobs(spark, d).select(
        "id",
        J.is_terminal().alias("terminal"),
        J.is_cancellable().alias("cancellable"),
        J.is_runnable().alias("runnable"),
        J.deadline_passed(NOW).alias("late"),
        J.is_queued().alias("queued"),
    )


@query(
    "queued_jobs",
    sql("SELECT id FROM jobs WHERE processor_id IS NULL AND status = 'validating'", "jobs"),
)
def queued_jobs(spark, d):
    return J.queued_ids(views.jobs(spark, d))


@query(
    "cancel_jobs",
    sql(
        f"""SELECT id, action, CASE WHEN action IN ('cancelled', 'cancelling') THEN action ELSE status END AS status,
             CASE WHEN action = 'cancelled' THEN {NOW} WHEN status = 'cancelled' THEN created_at + 900 END AS cancelled_at,
             CASE WHEN action = 'cancelling' THEN {NOW} WHEN status = 'cancelling' THEN created_at + 600 END AS cancelling_at,
             CASE WHEN action = 'cancelled' THEN epoch + 1 ELSE epoch END AS epoch
           FROM (SELECT *, CASE WHEN status = 'cancelled' THEN 'noop'
                   WHEN status NOT IN ('validating', 'in_progress', 'cancelling') THEN 'reject'
                   WHEN status = 'cancelling' THEN 'resend_event'
                   WHEN status = 'validating' AND processor_id IS NULL THEN 'cancelled' ELSE 'cancelling' END AS action
                 FROM jobs WHERE tenant_id IN ('t1', 't2', 't3'))""",
        "jobs",
    ),
)
def cancel_jobs(spark, d):
    j = views.jobs(spark, d)
    wanted = j.filter(F.col("tenant_id").isin("t1", "t2", "t3")).select("id")
    out = J.cancel_jobs(j, wanted, NOW)
    return out.select("id", "action", *state(out, "status", "cancelled_at", "cancelling_at"), "epoch")


@query(
    "cancel_events",
    sql(
        f"""SELECT id AS job_id, 'cancel' AS type, {NOW}::BIGINT AS ts, 2592000::BIGINT AS ttl FROM jobs
           WHERE status IN ('cancelling', 'in_progress') OR (status = 'validating' AND processor_id IS NOT NULL)""",
        "jobs",
    ),
)
def cancel_events(spark, d):
    j = views.jobs(spark, d)
    return J.cancel_events(J.cancel_jobs(j, j.select("id"), NOW), NOW)


@query(
    "transition",
    sql(
        f"""SELECT id, target AS status,
             CASE WHEN target = 'finalizing' THEN {NOW} WHEN status = 'finalizing' THEN created_at + 1000 END AS finalizing_at,
             CASE WHEN target = 'failed' THEN {NOW} WHEN status = 'failed' THEN created_at + 300 END AS failed_at,
             CASE WHEN target = 'validating' THEN priority // 1000000 ELSE expires_at END AS expires_at,
             CASE WHEN k % 2 = 0 THEN 7 ELSE total END AS total
           FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 'finalizing' WHEN k % 3 = 1 OR priority = 0 THEN 'failed'
                   ELSE 'validating' END AS target FROM jobs)""",
        "jobs",
    ),
)
def transition(spark, d):
    n = number() % 3
    j = views.jobs(spark, d).withColumns(
        {
            "target": F.when(n == 0, F.lit("finalizing"))
            .when((n == 1) | (F.col("priority") == 0), F.lit("failed"))
            .otherwise(F.lit("validating")),
            "counts": F.when(
                number() % 2 == 0,
                F.struct(*[F.lit(x).cast("long").alias(c) for c, x in (("total", 7), ("completed", 3), ("failed", 4))]),
            ),
        }
    )
    out = J.transition(j, "target", NOW, "counts")
    return out.select("id", *state(out, "status", "finalizing_at", "failed_at", "expires_at", "request_counts.total"))


@query(
    "with_file_ids",
    sql(
        """SELECT id, CASE WHEN k % 2 = 0 THEN 'new_' || k ELSE output_file_id END AS output_file_id,
             CASE WHEN k % 5 = 0 THEN 'err_' || k END AS error_file_id FROM jobs""",
        "jobs",
    ),
)
def with_file_ids(spark, d):
    text = number().cast("string")
    j = views.jobs(spark, d).withColumns(
        {
            "o": F.when(number() % 2 == 0, F.concat(F.lit("new_"), text)).otherwise(F.lit("")),
            "e": F.when(number() % 5 == 0, F.concat(F.lit("err_"), text)),
        }
    )
    out = J.with_file_ids(j, "o", "e")
    return out.select("id", *state(out, "output_file_id", "error_file_id"))


@query(
    "claim",
    sql(
        """SELECT id, 'p9' AS processor_id, epoch + 1 AS epoch, 0::BIGINT AS recovery_attempts, priority FROM jobs
           WHERE processor_id IS NULL AND status = 'validating' ORDER BY priority, id LIMIT 25""",
        "jobs",
    ),
)
def claim(spark, d):
    return J.claim(views.jobs(spark, d), "p9", 25).select("id", "processor_id", "epoch", "recovery_attempts", "priority")


@query(
    "requeue",
    sql(
        f"""SELECT id, outcome, CASE WHEN outcome = 'requeued' THEN 'validating' ELSE status END AS status,
             CASE WHEN outcome = 'requeued' THEN NULL ELSE processor_id END AS processor_id,
             CASE WHEN outcome = 'requeued' THEN epoch + 1 ELSE epoch END AS epoch
           FROM (SELECT *, CASE WHEN processor_id IS NOT NULL AND status NOT IN {T_TERMINAL} THEN 'requeued'
                   ELSE 'conflict' END AS outcome FROM jobs WHERE tenant_id = 't4')
           UNION ALL SELECT 'gone_' || s_suppkey, 'missing', NULL, NULL, NULL FROM supplier""",
        "jobs",
    ),
)
def requeue(spark, d):
    j = views.jobs(spark, d)
    gone = views.table(spark, d, "supplier").select(F.concat(F.lit("gone_"), F.col("s_suppkey").cast("string")).alias("id"))
    ids = J.for_tenant(j, "t4").select("id").unionByName(gone)
    out = J.requeue(j, ids)
    return out.select("id", "outcome", *state(out, "status"), "processor_id", "epoch")


@query(
    "claim_owned",
    sql(
        f"""SELECT id, epoch + 1 AS epoch, recovery_attempts + 1 AS recovery_attempts, priority FROM jobs
           WHERE processor_id = 'p3' AND status NOT IN {T_TERMINAL}""",
        "jobs",
    ),
)
def claim_owned(spark, d):
    return J.claim_owned(views.jobs(spark, d), "p3").select("id", "epoch", "recovery_attempts", "priority")


@query(
    "list_batches",
    sql("SELECT id, true AS has_more FROM jobs WHERE tenant_id = 't5' ORDER BY id LIMIT 15 OFFSET 30", "jobs"),
)
def list_batches(spark, d):
    return J.list_batches(views.jobs(spark, d), "t5", after=30, limit=15).select("id", "has_more")


@query(
    "list_files",
    sql(
        """SELECT id, count(*) OVER () > 200 AS has_more FROM files WHERE tenant_id = 't2' AND purpose = 'batch'
           ORDER BY id LIMIT 200""",
        "files",
    ),
)
def list_files(spark, d):
    return J.list_files(views.files(spark, d), "t2", limit=200, purpose="batch").select("id", "has_more")


@query(
    "page_deep",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, has_more FROM (
         SELECT *, (SELECT count(*) FROM lineitem) > 45050 AS has_more FROM lineitem)
       ORDER BY 1 LIMIT 50 OFFSET 45000""",
)
def page_deep(spark, d):
    """A page far into the table, found by row number instead of by skipping rows."""
    li = views.table(spark, d, "lineitem")
    ids = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    return J.page(ids, 45000, 50, near=10_000)


@query(
    "page_after",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, count(*) OVER () > 50 AS has_more
       FROM lineitem WHERE l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey > '5' ORDER BY 1 LIMIT 50""",
)
def page_after(spark, d):
    """The page behind the last id of the one before, however far into the table."""
    li = views.table(spark, d, "lineitem")
    ids = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    return J.page_after(ids, "5", 50)


def job_queue(spark, d):
    """Queue entries: every job, and entries whose job row is gone."""
    j = views.jobs(spark, d).select("id", F.col("priority").alias("deadline"))
    lost = views.table(spark, d, "customer").select(
        F.concat(F.lit("lost_"), F.col("c_custkey").cast("string")).alias("id"), F.lit(1).cast("long").alias("deadline")
    )
    return j.unionByName(lost)


TRIAGE = f"""
 SELECT id, CASE WHEN late THEN 'expired' WHEN status = 'cancelling' THEN 'success'
              WHEN status NOT IN ('validating', 'in_progress') THEN 'skipped' ELSE 'run' END AS result,
        CASE WHEN late THEN 'expired_dequeue' WHEN status IN ('cancelling', 'validating', 'in_progress') THEN 'none'
             ELSE 'not_runnable_state' END AS reason,
        CASE WHEN late THEN 'expired' WHEN status = 'cancelling' THEN 'cancelled' END AS new_status
 FROM (SELECT *, priority > 0 AND priority < {NOW}000000 AS late FROM jobs)
 UNION ALL SELECT 'lost_' || c_custkey, 'skipped', 'db_inconsistency', NULL FROM customer"""


@query("triage", sql(TRIAGE, "jobs"))
def triage(spark, d):
    return J.triage(job_queue(spark, d), views.jobs(spark, d), NOW)


@query(
    "jobs_processed",
    sql(
        "SELECT result, reason, count(*)::BIGINT AS jobs FROM triage GROUP BY result, reason",
        "jobs",
        ctes=f"triage AS ({TRIAGE})",
    ),
)
def jobs_processed(spark, d):
    from ...operators import observe

    return observe.jobs_processed(J.triage(job_queue(spark, d), views.jobs(spark, d), NOW))


@query(
    "classify_outcome",
    sql(
        """SELECT id, CASE k % 5 WHEN 0 THEN 'expired' WHEN 1 THEN 'cancelled'
             WHEN 2 THEN CASE WHEN total = completed THEN NULL ELSE 'shutdown' END
             WHEN 3 THEN 'disk full' END AS outcome FROM jobs""",
        "jobs",
    ),
)
def classify_outcome(spark, d):
    n = number() % 5
    rows = views.jobs(spark, d).select(
        "id",
        F.when(n == 0, F.lit("expired")).when(n == 1, F.lit("cancelled")).when(n == 2, F.lit("shutdown")).alias("cause"),
        F.when(n.isin(1, 3), F.lit("disk full")).alias("exec_error"),
        "status.request_counts.*",
    )
    return J.classify_outcome(rows).select("id", "outcome")


@query(
    "merge_progress",
    sql(
        """SELECT id, CASE WHEN status = 'in_progress' AND k % 2 = 0 THEN 99 ELSE total END AS total,
             CASE WHEN status = 'in_progress' AND k % 2 = 0 THEN 42 ELSE completed END AS completed FROM jobs""",
        "jobs",
    ),
)
def merge_progress(spark, d):
    j = views.jobs(spark, d)
    live = j.filter(number() % 2 == 0).select(
        F.col("id").alias("job_id"),
        F.struct(*[F.lit(x).cast("long").alias(c) for c, x in (("total", 99), ("completed", 42), ("failed", 1))]).alias("counts"),
    )
    out = J.merge_progress(j, live)
    return out.select("id", *state(out, "request_counts.total", "request_counts.completed"))


@query(
    "apply_updates",
    sql(
        """SELECT id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE status END AS status,
             CASE WHEN k % 3 = 1 THEN 'patched' ELSE tier END AS tier FROM jobs""",
        "jobs",
    ),
)
def apply_updates(spark, d):
    j = views.jobs(spark, d)
    n = number() % 3
    failed = F.col("status").withField("status", F.lit("failed"))
    updates = j.filter(n != 2).select(
        "id",
        F.when(n == 0, failed).alias("status"),
        F.when(n == 1, F.create_map(F.lit("tier"), F.lit("patched"))).alias("tags"),
    )
    out = J.apply_updates(j, updates)
    return out.select("id", *state(out, "status"), F.col("tags")["tier"].alias("tier"))


def job_table(spark, d):
    """The jobs as a table laid out by tenant and state class."""
    return buckets.create(spark, scratch_path(spark, "job-table"), JOB).append(views.jobs(spark, d))


def fenced(spark, d):
    return J.cas_update(views.jobs(spark, d), fenced_updates(spark, d))


def fenced_updates(spark, d):
    """Updates from a snapshot: a third carries an old epoch, a third an old status, some no job."""
    j = views.jobs(spark, d)
    n = number() % 3
    old = F.col("status").withField("status", F.lit("unknown"))
    updates = j.select(
        "id",
        F.when(n == 1, old).when(n == 0, F.col("status")).alias("expected_status"),
        (F.col("epoch") - F.when(n == 2, 1).otherwise(0)).alias("expected_epoch"),
        F.col("status").withField("status", F.lit("failed")).alias("new_status"),
        F.lit(True).alias("bump_epoch"),
    )
    gone = views.table(spark, d, "supplier").select(
        F.concat(F.lit("gone_"), F.col("s_suppkey").cast("string")).alias("id"),
        F.lit(None).cast(JOB_STATUS).alias("expected_status"),
        F.lit(0).cast("long").alias("expected_epoch"),
        F.lit(None).cast(JOB_STATUS).alias("new_status"),
        F.lit(False).alias("bump_epoch"),
    )
    return updates.unionByName(gone)


@query(
    "cas_update",
    sql(
        """SELECT id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE status END AS status,
             CASE WHEN k % 3 = 0 THEN epoch + 1 ELSE epoch END AS epoch FROM jobs""",
        "jobs",
    ),
)
def cas_update(spark, d):
    table, _ = fenced(spark, d)
    return table.select("id", *state(table, "status"), "epoch")


@query(
    "cas_outcomes",
    sql(
        """SELECT id, CASE WHEN k % 3 = 0 THEN 'updated' ELSE 'conflict' END AS outcome FROM jobs
           UNION ALL SELECT 'gone_' || s_suppkey, 'missing' FROM supplier""",
        "jobs",
    ),
)
def cas_outcomes(spark, d):
    return fenced(spark, d)[1]


OF_FEW = "tenant_id IN ('t2', 't5')"


@query(
    "merge_fenced",
    sql(
        f"""SELECT id, CASE WHEN k % 3 = 0 AND {OF_FEW} THEN 'failed' ELSE status END AS status,
              CASE WHEN k % 3 = 0 AND {OF_FEW} THEN epoch + 1 ELSE epoch END AS epoch FROM jobs""",
        "jobs",
    ),
)
def merge_fenced(spark, d):
    """Fenced updates of two tenants' jobs merged into the table: the next version as it is read."""
    table, _ = merged(spark, d)
    rows = table.read()
    return rows.select("id", *state(rows, "status"), "epoch")


@query(
    "merge_outcomes",
    sql(
        f"""SELECT id, CASE WHEN k % 3 = 0 THEN 'updated' ELSE 'conflict' END AS outcome FROM jobs WHERE {OF_FEW}
            UNION ALL SELECT 'gone_' || s_suppkey, 'missing' FROM supplier""",
        "jobs",
    ),
)
def merge_outcomes(spark, d):
    return merged(spark, d)[1]


def merged(spark, d):
    own = views.jobs(spark, d).select("id", "tenant_id")
    updates = fenced_updates(spark, d).join(own, "id", "left").filter(f"tenant_id IS NULL OR {OF_FEW}").drop("tenant_id")
    return job_table(spark, d).merge(updates, buckets.fenced)


@query(
    "merge_claims",
    sql(
        """SELECT id, processor_id, epoch, tenant_id FROM (
             SELECT id, CASE WHEN q THEN 'p9' ELSE processor_id END AS processor_id, CASE WHEN q THEN epoch + 1 ELSE epoch END AS epoch,
                    tenant_id FROM (SELECT *, processor_id IS NULL AND status = 'validating' AND row_number() OVER (
                      ORDER BY processor_id IS NULL AND status = 'validating' DESC, priority NULLS LAST, id) <= 25 AS q FROM jobs))
           WHERE tenant_id <> 't7'""",
        "jobs",
    ),
)
def merge_claims(spark, d):
    """25 jobs claimed and one tenant's jobs deleted, each as a merge of its own."""
    table = job_table(spark, d)
    table, _ = table.merge(J.claim(table.read().drop(*buckets.PARTS), "p9", 25), buckets.replaced)
    table, _ = table.merge(J.for_tenant(table.read(), "t7").select("id"), buckets.deleted)
    return table.read().select("id", "processor_id", "epoch", "tenant_id")


@query(
    "delete_ids",
    sql(
        """SELECT 'kept' AS side, count(*)::BIGINT AS rows FROM jobs WHERE tenant_id <> 't7'
           UNION ALL SELECT 'deleted', count(*)::BIGINT FROM jobs WHERE tenant_id = 't7'""",
        "jobs",
    ),
)
def delete_ids(spark, d):
    j = views.jobs(spark, d)
    kept, gone = J.delete_ids(j, J.for_tenant(j, "t7").select("id"))
    count = F.count(F.lit(1)).alias("rows")
    return kept.agg(F.lit("kept").alias("side"), count).unionByName(gone.agg(F.lit("deleted").alias("side"), count))


@query(
    "finalise",
    sql(
        f"""SELECT j.id, CASE WHEN j.k % 10 = 0 AND r.job_id IS NOT NULL THEN 'failed' ELSE 'completed' END AS status,
             CASE WHEN j.k % 10 <> 0 OR r.job_id IS NULL THEN {NOW} WHEN j.status = 'completed' THEN created_at + 1200 END
               AS completed_at,
             coalesce(r.total, j.total) AS total, coalesce(r.ok, j.completed) AS completed,
             coalesce(r.outs > 0, false) AND j.k % 10 <> 0 OR j.status = 'completed' AS has_output,
             coalesce(r.errs > 0, false) AS has_error
           FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS total, count(*) FILTER (http_code = 200) AS ok,
               count(*) FILTER (error_code IS NULL) AS outs, count(error_code) AS errs FROM results GROUP BY job_id) r
             ON r.job_id = j.id""",
        "jobs",
        "results",
    ),
)
def finalise(spark, d):
    """All jobs finished from their results; one in ten loses its output upload."""
    r = results(spark, d)
    lost = r.select("job_id").distinct().filter(F.regexp_extract("job_id", r"(\d+)$", 1).cast("long") % 10 == 0)
    out = J.finalise(
        views.jobs(spark, d),
        res.request_counts(r),
        src.result_files(r),
        NOW,
        lost.withColumn("kind", F.lit("output")),
    )
    return out.select(
        "id",
        *state(out, "status", "completed_at", "request_counts.total", "request_counts.completed"),
        F.col("status.output_file_id").isNotNull().alias("has_output"),
        F.col("status.error_file_id").isNotNull().alias("has_error"),
    )


@query(
    "output_file_rows",
    sql(
        f"""SELECT kind || '_' || j.id AS id, j.tenant_id, 'batch_output' AS purpose,
             {NOW} + CASE WHEN output_ttl <> 'x' THEN output_ttl::BIGINT ELSE 86400 END AS expiry,
             'batch_' || kind || '_' || j.id || '.jsonl' AS filename, n AS bytes
           FROM jobs j JOIN (SELECT job_id, 'output' AS kind, count(*) FILTER (error_code IS NULL) AS n FROM results GROUP BY 1
             UNION ALL SELECT job_id, 'error', count(error_code) FROM results GROUP BY 1) r ON r.job_id = j.id
           WHERE n > 0""",
        "jobs",
        "results",
    ),
)
def output_file_rows(spark, d):
    files = src.result_files(results(spark, d))
    j = views.jobs(spark, d).select(F.col("id").alias("job_id"), "tenant_id", "tags")

    def ident(kind):
        return F.when(F.col(f"{kind}_rows") > 0, F.concat(F.lit(f"{kind}_"), "job_id"))

    sizes = j.join(files, "job_id").withColumns(
        {
            "output_file_id": ident("output"),
            "error_file_id": ident("error"),
            "output_bytes": F.col("output_rows"),
            "error_bytes": F.col("error_rows"),
        }
    )
    rows = tab.output_file_rows(sizes, NOW, default_ttl=86400)
    return rows.select(
        "id",
        "tenant_id",
        "purpose",
        "expiry",
        F.get_json_object("spec", "$.filename").alias("filename"),
        F.get_json_object("spec", "$.bytes").cast("long").alias("bytes"),
    )


@query(
    "snapshots",
    sql("SELECT status, count(*)::BIGINT AS jobs FROM jobs GROUP BY status", "jobs"),
)
def snapshots(spark, d):
    """Two published versions of the job table; readers see the newest."""
    root = scratch_path(spark, "table")
    j = views.jobs(spark, d)
    tab.write_snapshot(tab.encode_batch(j.limit(0)), root, 1)
    tab.write_snapshot(tab.encode_batch(j), root, 2)
    back = tab.decode_batch(tab.read_jobs(spark, tab.latest_snapshot(spark, root)))
    return back.groupBy(F.col("status.status").alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


@query(
    "job_table_scan",
    sql("SELECT id, priority, created_at FROM jobs WHERE status = 'in_progress' AND tenant_id = 't8'", "jobs"),
)
def job_table_scan(spark, d):
    """A job table on disk; tenant and state class are filtered by its folders, the state in the scan."""
    running = J.for_tenant(job_table(spark, d).read(), "t8").filter(F.col("open") & (F.col(J.STATE) == "in_progress"))
    return running.select("id", "priority", F.col("spec.created_at").alias("created_at"))


def live(spark):
    return spark.createDataFrame([(p,) for p in views.LIVE], "processor_id string")


ORPHANS = f"""
 SELECT id, processor_id, status AS old_status, epoch,
        CASE WHEN status = 'cancelling' THEN 'cancelled' WHEN priority > 0 AND priority < {NOW}000000 THEN 'failed'
             WHEN priority > 0 THEN 're_enqueued' ELSE 'error' END AS action
 FROM jobs WHERE processor_id NOT IN ('p0', 'p1', 'p2') AND status NOT IN {T_TERMINAL}"""


@query(
    "triage_orphans",
    sql(
        """SELECT *, CASE WHEN action IN ('cancelled', 'failed') THEN action WHEN action = 're_enqueued' THEN 'validating' END
             AS new_status, action <> 'error' AS changes FROM orphans""",
        "jobs",
        ctes=f"orphans AS ({ORPHANS})",
    ),
)
def triage_orphans(spark, d):
    return L.triage_orphans(views.jobs(spark, d), live(spark), NOW)


@query(
    "orphans_without_snapshot",
    sql("SELECT id FROM jobs WHERE false", "jobs"),
)
def orphans_without_snapshot(spark, d):
    return L.orphans(views.jobs(spark, d), None).select("id")


@query(
    "reconcile_summary",
    sql(
        """SELECT count(*) FILTER (action IN ('cancelled', 'failed') AND epoch <> 3)::BIGINT AS expired,
             count(*) FILTER (action = 're_enqueued' AND epoch <> 3)::BIGINT AS re_enqueued,
             count(*) FILTER (action IN ('cancelled', 'failed') AND epoch = 3)::BIGINT AS conflicts,
             count(*) FILTER (action = 'error' OR (action = 're_enqueued' AND epoch = 3))::BIGINT AS errors FROM orphans""",
        "jobs",
        ctes=f"orphans AS ({ORPHANS})",
    ),
)
def reconcile_summary(spark, d):
    triaged = L.triage_orphans(views.jobs(spark, d), live(spark), NOW)
    outcomes = triaged.select("id", F.when(F.col("epoch") == 3, F.lit("conflict")).otherwise(F.lit("updated")).alias("outcome"))
    return L.reconcile_summary(triaged, outcomes)


RECOVER = f"""
 SELECT id, status_label, action, new_status, CASE WHEN action = 'cancelled' THEN
          CASE WHEN total > 0 THEN 'in_progress' ELSE 'queued' END END AS cancel_phase
 FROM (SELECT *, CASE action WHEN 'finalized' THEN 'completed' WHEN 're_enqueued' THEN 'validating'
                   WHEN 'cleaned_up' THEN NULL ELSE action END AS new_status
   FROM (SELECT id, status AS status_label, total,
     CASE WHEN status IN {T_TERMINAL} THEN 'cleaned_up' WHEN recovery_attempts > 3 THEN 'failed'
          WHEN status = 'finalizing' THEN 'finalized' WHEN status = 'cancelling' THEN 'cancelled'
          WHEN status = 'in_progress' AND k % 2 = 0 THEN 'failed'
          WHEN coalesce(deadline, 0) <= 0 THEN 'failed'
          WHEN deadline < {NOW}000000 THEN 'expired' ELSE 're_enqueued' END AS action
   FROM (SELECT *, CASE WHEN priority > 0 THEN priority ELSE expires_at * 1000000 END AS deadline FROM jobs)))"""


def recovered(spark, d):
    j = views.jobs(spark, d)
    has_output = j.filter(number() % 2 == 0).select(F.col("id").alias("job_id"))
    return L.recover(j, has_output, NOW)


@query("recover", sql(RECOVER, "jobs"))
def recover(spark, d):
    return recovered(spark, d)


@query(
    "recovery_summary",
    sql(
        "SELECT status_label AS status, action, count(*)::BIGINT AS jobs FROM r GROUP BY 1, 2",
        "jobs",
        ctes=f"r AS ({RECOVER})",
    ),
)
def recovery_summary(spark, d):
    return L.recovery_summary(recovered(spark, d))


@query(
    "stale_artifacts",
    sql(
        """SELECT 'work/' || l_orderkey || '/' || l_linenumber AS path, 'batch_' || (l_orderkey * 2) AS job_id FROM lineitem
           WHERE 'batch_' || (l_orderkey * 2) NOT IN (SELECT id FROM jobs)""",
        "jobs",
    ),
)
def stale_artifacts(spark, d):
    li = views.table(spark, d, "lineitem")
    paths = li.select(
        F.concat_ws("/", F.lit("work"), "l_orderkey", "l_linenumber").alias("path"),
        F.concat(F.lit("batch_"), (F.col("l_orderkey") * 2).cast("string")).alias("job_id"),
    )
    return L.stale_artifacts(paths, views.jobs(spark, d))


COLLECT = f"""
 SELECT 'batch' AS kind, id, NULL AS path, 'deleted' AS outcome FROM jobs WHERE expiry > 0 AND expiry <= {NOW}
 UNION ALL
 SELECT 'file', id, 't-' || substr(sha256(tenant_id), 1, 61) || '/' || id || CASE WHEN k % 3 = 1 THEN '.gz' ELSE '.jsonl' END,
        CASE WHEN tenant_id = 't6' THEN 'failed' ELSE 'deleted' END
 FROM files WHERE expiry > 0 AND expiry <= {NOW}"""


def collected(spark, d):
    f = views.files(spark, d)
    stuck = L.expired_files(J.for_tenant(f, "t6"), NOW).select("folder", "name")
    return L.collect_expired(views.jobs(spark, d), f, NOW, stuck)


@query("collect_expired", sql(COLLECT, "jobs", "files"))
def collect_expired(spark, d):
    return collected(spark, d)


@query(
    "retention_summary",
    sql(
        """SELECT count(*) FILTER (kind = 'batch' AND outcome = 'deleted')::BIGINT AS batches_deleted,
             count(*) FILTER (kind = 'file' AND outcome = 'deleted')::BIGINT AS files_deleted,
             count(*) FILTER (kind = 'batch' AND outcome = 'failed')::BIGINT AS batches_failed,
             count(*) FILTER (kind = 'file' AND outcome = 'failed')::BIGINT AS files_failed FROM c""",
        "jobs",
        "files",
        ctes=f"c AS ({COLLECT})",
    ),
)
def retention_summary(spark, d):
    return L.retention_summary(collected(spark, d))


@query(
    "durations",
    sql(
        """SELECT id, secs::DOUBLE AS seconds, (created_at + secs) * 1000000 AS deadline,
             CASE WHEN k % 7200 < 60 THEN (k % 7200) || 's' WHEN k % 7200 < 3600 THEN (k % 7200 // 60) || 'm'
                  WHEN k % 7200 // 60 % 60 = 0 THEN (k % 7200 // 3600) || 'h'
                  ELSE (k % 7200 // 3600) || 'h ' || (k % 7200 // 60 % 60) || 'm' END AS elapsed
           FROM jobs""",
        "jobs",
    ),
)
def durations(spark, d):
    return views.jobs(spark, d).select(
        "id",
        S.duration_seconds("spec.completion_window").alias("seconds"),
        S.deadline_micros("spec.created_at", "spec.completion_window").alias("deadline"),
        S.format_duration(number() % 7200).alias("elapsed"),
    )
