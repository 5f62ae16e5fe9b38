"""Job and file tables: filters, checks, paging, claiming, fenced updates and transitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from .order import number_rows

STATE = "status.status"
# Rows a page may take through a single top-k task; deeper pages are found by row number.
NEAR_ROWS = 100_000


# --- predicates -------------------------------------------------------------------


def is_terminal(status: str | Column = STATE) -> Column:
    return S.as_col(status).isin(*V.TERMINAL)


def is_cancellable(status: str | Column = STATE) -> Column:
    return S.as_col(status).isin(*V.CANCELLABLE)


def is_runnable(status: str | Column = STATE) -> Column:
    return S.as_col(status).isin(*V.RUNNABLE)


def deadline_passed(now: int, priority: str | Column = "priority") -> Column:
    """The deadline (microseconds, 0 for none) lies before `now` (seconds)."""
    p = F.coalesce(S.as_col(priority), F.lit(0))
    return (p > 0) & (p < F.lit(now * 1000000).cast("long"))


def is_expired(now: int, expiry: str | Column = "expiry") -> Column:
    """The row's expiry is set and reached."""
    return (S.as_col(expiry) > 0) & (S.as_col(expiry) <= now)


def is_queued() -> Column:
    return F.col("processor_id").isNull() & (F.coalesce(F.col(STATE), F.lit("")) == "validating")


# --- filters ----------------------------------------------------------------------


def query_items(
    df: DataFrame,
    ids: Sequence[str] = (),
    tenant: str = "",
    tags: Mapping[str, str] | None = None,
    any_tag: bool = False,
    expired_at: int | None = None,
    purpose: str = "",
    non_terminal: bool = False,
    processor: str = "",
    has_processor: bool = False,
    include_static: bool = True,
) -> DataFrame:
    """Rows that meet all given conditions; without any condition the result is empty.

    Tags must all match, or one of them with `any_tag`. `include_static=False` leaves out the
    spec, which then is not read either.
    """
    conditions: list[Column] = []
    if ids:
        conditions.append(F.col("id").isin(*ids))
    if tenant:
        conditions.append(of_tenant(df, tenant))
    if tags:
        hits = [F.coalesce(F.try_element_at("tags", F.lit(k)) == v, F.lit(False)) for k, v in tags.items()]
        conditions.append(S.any_of(hits) if any_tag else S.all_of(hits))
    if expired_at is not None:
        conditions.append(is_expired(expired_at))
    if purpose:
        conditions.append(F.col("purpose") == purpose)
    if processor:
        conditions.append(F.col("processor_id") == processor)
    if non_terminal:
        conditions.append(~is_terminal() & F.col("open") if "open" in df.columns else ~is_terminal())
    if has_processor:
        conditions.append(F.col("processor_id").isNotNull())
    kept = df.filter(S.all_of(conditions)) if conditions else df.limit(0)
    return kept if include_static else kept.drop("spec")


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """What a tenant can see: rows of others do not exist for it."""
    return df.filter(of_tenant(df, tenant))


def of_tenant(df: DataFrame, tenant: str) -> Column:
    """The tenant's rows; in a bucketed table its bucket too, which the scan prunes by."""
    mine = F.col("tenant_id") == tenant
    if "tenant_bucket" not in df.columns:
        return mine
    buckets = df.schema["tenant_bucket"].metadata["buckets"]
    return mine & (F.col("tenant_bucket") == F.pmod(F.xxhash64(F.lit(tenant)), F.lit(buckets)).cast("int"))


def queued(jobs: DataFrame) -> DataFrame:
    return jobs.filter(is_queued() & F.col("open") if "open" in jobs.columns else is_queued())


def queued_ids(jobs: DataFrame) -> DataFrame:
    return queued(jobs).select("id")


# --- paging -----------------------------------------------------------------------


def page(df: DataFrame, start: int, limit: int, near: int = NEAR_ROWS) -> DataFrame:
    """Rows `start .. start+limit` by ascending id, with `has_more` on each row.

    One row more than asked for is looked up to learn whether the listing goes on. A page that
    ends within `near` rows is a top-k, which every task holds; one further off is found by row
    number, which never gathers the skipped rows. Both give the same rows.
    """
    if start + limit + 1 <= near:
        rows = df.orderBy("id").offset(start).limit(limit + 1)
    else:
        numbered = number_rows(df, [], ["id"], "__row")
        rows = numbered.filter(F.col("__row").between(start + 1, start + limit + 1)).drop("__row")
    return _with_more(rows, limit)


def page_after(df: DataFrame, last: str | None, limit: int) -> DataFrame:
    """The `limit` rows behind the id `last` (NULL: from the start) by ascending id, with `has_more` on each row.

    The last id of a page is where the next one starts: the scan skips what lies before it, every task holds
    a top-k of one page, and the cost of a page does not grow with its distance from the start.
    """
    behind = df if last is None else df.filter(F.col("id") > last)
    return _with_more(behind.orderBy("id").limit(limit + 1), limit)


def _with_more(rows: DataFrame, limit: int) -> DataFrame:
    """Leave out the row beyond the page, which only tells that there is more."""
    whole = W.partitionBy(F.lit(0))  # at most limit + 1 rows
    marked = rows.withColumns(
        {"has_more": F.count(F.lit(1)).over(whole) > limit, "__last": F.max("id").over(whole)}
    )
    return marked.filter(~F.col("has_more") | (F.col("id") != F.col("__last"))).select(*rows.columns, "has_more")


def list_limit(limit: int | None, top: int) -> int:
    value = V.DEFAULT_LIST_LIMIT if limit is None else limit
    if not 1 <= value <= top:
        raise ValueError(f"limit must be between 1 and {top}")
    return value


def list_batches(jobs: DataFrame, tenant: str, after: int = 0, limit: int | None = None) -> DataFrame:
    """One page of a tenant's jobs; the limit is 1..100, 20 by default."""
    if after < 0:
        raise ValueError("after must be equal to or greater than 0")
    return page(for_tenant(jobs, tenant), after, list_limit(limit, V.MAX_LIST_BATCHES)).orderBy("id")


def list_files(
    files: DataFrame, tenant: str, after: int = 0, limit: int | None = None, order: str = "desc", purpose: str = ""
) -> DataFrame:
    """One page of a tenant's files; the limit is 1..10000.

    Descending order turns the page around, it does not change which rows are on it.
    """
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    if purpose and purpose not in V.PURPOSES:
        raise ValueError(f"invalid purpose {purpose!r}")
    kept = query_items(files, tenant=tenant, purpose=purpose)
    rows = page(kept, after, list_limit(limit, V.MAX_LIST_FILES))
    return rows.orderBy(F.col("id").desc() if order == "desc" else F.col("id").asc())


# --- checks of submitted jobs and files -------------------------------------------


def _first_failure(rules: Sequence[tuple[Column, Column]]) -> Column:
    expr = F
    for failed, message in rules:
        expr = expr.when(failed, message)
    return expr


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Add `error_msg` of the first rule a submitted job breaks, NULL when it is fine.

    Needs completion_window, endpoint, input_file_id, metadata, expires_anchor and
    expires_seconds (both NULL when no output expiry is asked for). Metadata sizes are bytes.
    """
    c, text = F.col, lambda name: F.coalesce(F.col(name), F.lit(""))
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    long_value = F.filter(F.map_entries(meta), lambda e: F.octet_length(e["value"]) > V.MAX_METADATA_VALUE_BYTES)
    asked = c("expires_anchor").isNotNull() | c("expires_seconds").isNotNull()
    seconds = F.coalesce("expires_seconds", F.lit(0))
    rules = [
        (text("completion_window") == "", F.lit("completion_window is required")),
        (
            S.duration_seconds("completion_window").isNull(),
            F.lit("completion_window must be a valid duration (e.g., 24h)"),
        ),
        (text("endpoint") == "", F.lit("endpoint is required")),
        (~c("endpoint").isin(*V.ENDPOINTS), F.concat(F.lit("invalid endpoint: "), c("endpoint"))),
        (text("input_file_id") == "", F.lit("input_file_id is required")),
        (
            F.size(meta) > V.MAX_METADATA_KEYS,
            F.concat(F.lit("metadata: too many keys (max 16, got "), F.size(meta).cast("string"), F.lit(")")),
        ),
        (
            F.exists(F.map_keys(meta), lambda k: F.octet_length(k) > V.MAX_METADATA_KEY_BYTES),
            F.lit("metadata: key exceeds 64 characters"),
        ),
        (
            F.size(long_value) > 0,
            F.concat(
                F.lit('metadata: value for key "'), F.get(long_value, F.lit(0))["key"], F.lit('" exceeds 512 characters')
            ),
        ),
        (asked & (text("expires_anchor") != "created_at"), F.lit("output_expires_after.anchor must be 'created_at'")),
        (
            asked & ~seconds.between(V.MIN_EXPIRATION, V.MAX_EXPIRATION),
            F.lit("output_expires_after.seconds must be between 3600 (1 hour) and 2592000 (30 days)"),
        ),
    ]
    return jobs.withColumn("error_msg", _first_failure(rules))


def check_inputs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Add `input_error`: the input file must exist for the tenant and have purpose `batch`."""
    known = files.select(
        F.col("id").alias("__file"), F.col("tenant_id").alias("__tenant"), F.col("purpose").alias("__purpose")
    )
    on = (F.col("spec.input_file_id") == F.col("__file")) & (F.col("tenant_id") == F.col("__tenant"))
    file = F.col("spec.input_file_id")
    rules = [
        (F.col("__file").isNull(), F.concat(F.lit("Input file with ID '"), file, F.lit("' not found"))),
        (
            F.col("__purpose") != "batch",
            F.concat(
                F.lit("Input file '"), file, F.lit("' has purpose '"), F.col("__purpose"), F.lit("', but must have purpose 'batch'")
            ),
        ),
    ]
    return jobs.join(known, on, "left").select(*jobs.columns, _first_failure(rules).alias("input_error"))


def validate_files(uploads: DataFrame, now: int, default_ttl: int = V.DEFAULT_FILE_EXPIRATION) -> DataFrame:
    """Add `error_msg`, `expires_at` and the cleaned `filename` of uploads.

    Needs id, filename, purpose, expires_anchor and expires_seconds (text, NULL when absent).
    """
    anchor, given = F.coalesce("expires_anchor", F.lit("")), F.coalesce("expires_seconds", F.lit(""))
    seconds = F.when(given.rlike(r"^[+-]?[0-9]+$"), given.try_cast("long"))
    purpose = F.coalesce("purpose", F.lit(""))
    asked = (anchor != "") | (given != "")
    known = ", ".join(V.PURPOSES)
    rules = [
        (purpose == "", F.lit("Missing required parameter: 'purpose'")),
        (
            ~purpose.isin(*V.PURPOSES),
            F.concat(F.lit("Invalid file purpose '"), purpose, F.lit(f"'. Must be one of: {known}")),
        ),
        (
            asked & ((anchor == "") | (given == "")),
            F.lit("both expires_after[anchor] and expires_after[seconds] must be provided together"),
        ),
        (
            asked & (anchor != "created_at"),
            F.concat(F.lit("invalid expires_after[anchor] '"), anchor, F.lit("'. Only 'created_at' is supported")),
        ),
        (asked & seconds.isNull(), F.lit("invalid expires_after[seconds]: must be a valid integer")),
        (
            asked & ~seconds.between(V.MIN_EXPIRATION, V.MAX_EXPIRATION),
            F.lit("expires_after[seconds] must be between 3600 (1 hour) and 2592000 (30 days)"),
        ),
    ]
    trimmed = F.regexp_replace(F.coalesce("filename", F.lit("")), "/+$", "")
    base = F.element_at(F.split(trimmed, "/"), -1)
    staged = uploads.withColumns({"error_msg": _first_failure(rules), "__base": base})
    good = F.col("error_msg").isNull()
    ttl = F.when(asked, seconds).otherwise(F.lit(default_ttl))
    return staged.select(
        *[c for c in uploads.columns if c != "filename"],
        F.when(F.col("__base").isin("", ".", ".."), F.concat("id", F.lit(".jsonl"))).otherwise(F.col("__base")).alias("filename"),
        "error_msg",
        F.when(good, F.lit(now) + ttl).cast("long").alias("expires_at"),
    )


# --- state changes ----------------------------------------------------------------


def _stamped(status: Column, target: Column, now: int, priority: Column) -> Column:
    """The status struct in its new state, with the timestamp that state sets."""
    stamp = F.lit(now).cast("long")
    out = status
    for state, field in V.STATUS_TIMESTAMP.items():
        out = out.withField(field, F.when(target == state, stamp).otherwise(status[field]))
    deadline = F.floor(priority / 1000000).cast("long")
    missing = F.raise_error(F.lit("a deadline is required for status validating")).cast("long")
    back = F.when(F.coalesce(priority, F.lit(0)) > 0, deadline).otherwise(missing)
    out = out.withField("expires_at", F.when(target == "validating", back).otherwise(status["expires_at"]))
    known = F.when(target.isin(*V.STATUSES), target).otherwise(
        F.raise_error(F.concat(F.lit("invalid status: "), target)).cast("string")
    )
    return out.withField("status", known)


def transition(jobs: DataFrame, target, now: int, counts: str | None = None) -> DataFrame:
    """Move every job to `target` (a state or a column of states) and stamp the change.

    Request counts are replaced only when a non-NULL `counts` struct is given. Going back to
    `validating` needs a deadline and sets expires_at from it; an unknown state is an error.
    """
    state = F.lit(target) if isinstance(target, str) and target in V.STATUSES else S.as_col(target)
    status = _stamped(F.col("status"), state, now, F.col("priority"))
    if counts:
        status = status.withField("request_counts", F.coalesce(F.col(counts), F.col("status.request_counts")))
    return jobs.withColumn("status", status)


def with_file_ids(jobs: DataFrame, output_id: str, error_id: str) -> DataFrame:
    """Record file ids where they are not empty; existing ids stay otherwise."""
    status = F.col("status")
    for field, source in (("output_file_id", output_id), ("error_file_id", error_id)):
        status = status.withField(field, F.coalesce(F.nullif(F.col(source), F.lit("")), F.col(f"status.{field}")))
    return jobs.withColumn("status", status)


def merge_progress(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """Live counts replace the stored ones of jobs in progress.

    `progress` has job_id and a counts struct.
    """
    live = progress.select(F.col("job_id").alias("id"), F.col("counts").alias("__live"))
    merged = F.when(
        (F.col(STATE) == "in_progress") & F.col("__live").isNotNull(), F.col("__live")
    ).otherwise(F.col("status.request_counts"))
    joined = jobs.join(live, "id", "left").withColumn("status", F.col("status").withField("request_counts", merged))
    return joined.select(*jobs.columns)


def cancel_jobs(jobs: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """Add `action` and the resulting row for the jobs in `wanted` (id).

    noop: already cancelled. reject: no longer cancellable. resend_event: cancelling already.
    cancelled: was queued, ends at once. cancelling: is running, gets a cancel event.
    """
    asked = jobs.join(wanted.select("id").distinct(), "id", "left_semi")
    action = (
        F.when(F.col(STATE) == "cancelled", F.lit("noop"))
        .when(~is_cancellable(), F.lit("reject"))
        .when(F.col(STATE) == "cancelling", F.lit("resend_event"))
        .when(is_queued(), F.lit("cancelled"))
        .otherwise(F.lit("cancelling"))
    )
    staged = asked.withColumn("action", action)
    status, stamp = F.col("status"), F.lit(now).cast("long")
    for state in ("cancelled", "cancelling"):
        hit = F.col("action") == state
        status = status.withField(f"{state}_at", F.when(hit, stamp).otherwise(F.col(f"status.{state}_at")))
    changed = F.col("action").isin("cancelled", "cancelling")
    status = status.withField("status", F.when(changed, F.col("action")).otherwise(F.col(STATE)))
    epoch = F.col("epoch") + F.when(F.col("action") == "cancelled", 1).otherwise(0)
    return staged.withColumns({"status": status, "epoch": epoch})


def cancel_events(cancelled: DataFrame, now: int, ttl: int = V.EVENT_TTL) -> DataFrame:
    """The cancel events that follow from `cancel_jobs`."""
    sent = cancelled.filter(F.col("action").isin("cancelling", "resend_event"))
    return sent.select(
        F.col("id").alias("job_id"), F.lit("cancel").alias("type"), F.lit(now).cast("long").alias("ts"), F.lit(ttl).cast("long").alias("ttl")
    )


# --- queue ------------------------------------------------------------------------


def claim(jobs: DataFrame, owner: str, n: int) -> DataFrame:
    """The next `n` queued jobs for `owner`, earliest deadline first, as their updated rows."""
    picked = queued(jobs).orderBy(F.col("priority").asc_nulls_last(), "id").limit(n)
    return picked.withColumns(
        {
            "processor_id": F.lit(owner),
            "epoch": F.col("epoch") + 1,
            "recovery_attempts": F.lit(0).cast("long"),
        }
    )


def requeue(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Put jobs back into the queue; add `outcome`.

    requeued: owned and not terminal. conflict: the job is in the table but not in that
    state. missing: no such job (all other columns NULL). A requeued job keeps its times.
    """
    asked = ids.select("id").distinct().join(jobs, "id", "left")
    ok = F.col("processor_id").isNotNull() & ~is_terminal()
    outcome = F.when(F.col("tenant_id").isNull(), "missing").when(F.coalesce(ok, F.lit(False)), "requeued").otherwise("conflict")
    staged = asked.withColumn("outcome", outcome)
    hit = F.col("outcome") == "requeued"
    return staged.withColumns(
        {
            "processor_id": F.when(~hit, F.col("processor_id")),
            "status": F.col("status").withField("status", F.when(hit, F.lit("validating")).otherwise(F.col(STATE))),
            "epoch": F.col("epoch") + F.when(hit, 1).otherwise(0),
        }
    ).select(*jobs.columns, "outcome")


def claim_owned(jobs: DataFrame, owner: str) -> DataFrame:
    """Jobs `owner` still holds, claimed again for recovery under a new epoch."""
    mine = jobs.filter((F.col("processor_id") == owner) & ~is_terminal())
    return mine.withColumns(
        {
            "epoch": F.col("epoch") + 1,
            "recovery_attempts": F.col("recovery_attempts") + 1,
            "priority": F.coalesce("priority", F.lit(0)),
        }
    )


def triage(queue: DataFrame, jobs: DataFrame, now: int) -> DataFrame:
    """What to do with each dequeued id: `result`, `reason` and `new_status`.

    `queue` has id and deadline (microseconds, 0 for none). The first case that applies wins.
    """
    known = jobs.select("id", F.col(STATE).alias("__state"), F.lit(True).alias("__known"))
    joined = queue.join(known, "id", "left")
    gone, late = F.col("__known").isNull(), deadline_passed(now, "deadline")
    stopping = F.col("__state") == "cancelling"
    idle = ~is_runnable("__state")

    def decide(missing, expired, cancelled, skipped, run) -> Column:
        return (
            F.when(gone, F.lit(missing)).when(late, F.lit(expired)).when(stopping, F.lit(cancelled)).when(idle, F.lit(skipped)).otherwise(F.lit(run))
        )

    return joined.select(
        "id",
        decide("skipped", "expired", "success", "skipped", "run").alias("result"),
        decide("db_inconsistency", "expired_dequeue", "none", "not_runnable_state", "none").alias("reason"),
        decide(None, "expired", "cancelled", None, None).alias("new_status"),
    )


def classify_outcome(df: DataFrame) -> DataFrame:
    """Add `outcome` of an execution from `cause`, the counts and `exec_error`.

    expired and cancelled always win. A shutdown is ignored when every request succeeded.
    Otherwise the executor's own error counts; NULL means the job completes.
    """
    all_done = (F.col("failed") == 0) & (F.col("completed") == F.col("total"))
    cause = F.col("cause")
    return df.withColumn(
        "outcome",
        F.when(cause.isin("expired", "cancelled"), cause)
        .when(cause == "shutdown", F.when(~all_done, cause))
        .otherwise(F.col("exec_error")),
    )


# --- updates ----------------------------------------------------------------------


def apply_updates(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """New table in which only given (non-NULL) status and tags replace stored ones.

    `updates` has id, status and tags, at most one row per id.
    """
    new = updates.select("id", F.col("status").alias("__s"), F.col("tags").alias("__t"))
    joined = jobs.join(new, "id", "left")
    tags = F.when(F.size("__t") > 0, F.col("__t")).otherwise(F.col("tags"))
    return joined.withColumns({"status": F.coalesce("__s", "status"), "tags": tags}).select(*jobs.columns)


def cas_update(jobs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fenced update: (new table, outcome per update).

    `updates` has id, expected_status (struct, NULL for any), expected_epoch, new_status
    (struct) and bump_epoch; one row per id. Outcomes: updated, conflict, missing.
    """
    wanted = updates.select(
        "id",
        F.struct("expected_status", "expected_epoch", "new_status", "bump_epoch", F.lit(True).alias("present")).alias("__u"),
    )
    u = F.col("__u")
    joined = jobs.withColumn("__job", F.lit(True)).join(wanted, "id", "full")
    same_state = u["expected_status"].isNull() | u["expected_status"].eqNullSafe(F.col("status"))
    hit = F.col("__job") & u["present"] & same_state & (u["expected_epoch"] == F.col("epoch"))
    staged = joined.withColumn(
        "outcome",
        F.when(F.col("__job").isNull(), F.lit("missing"))
        .when(u["present"].isNull(), F.lit(None))
        .when(F.coalesce(hit, F.lit(False)), F.lit("updated"))
        .otherwise(F.lit("conflict")),
    )
    done = F.coalesce(F.col("outcome") == "updated", F.lit(False))
    table = staged.filter("__job IS NOT NULL").withColumns(
        {
            "status": F.when(done, u["new_status"]).otherwise(F.col("status")),
            "epoch": F.col("epoch") + F.when(done & u["bump_epoch"], 1).otherwise(0),
        }
    )
    return table.select(*jobs.columns), staged.filter("outcome IS NOT NULL").select("id", "outcome")


def delete_ids(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, ids that existed and are gone)."""
    keys = ids.select("id")
    return df.join(keys, "id", "left_anti"), df.join(keys, "id", "left_semi").select("id")


def finalise(
    jobs: DataFrame,
    counts: DataFrame,
    files: DataFrame,
    now: int,
    failed_uploads: DataFrame | None = None,
    state: str | None = None,
) -> DataFrame:
    """Finish jobs: counts, file ids, and the state a column `state` of the jobs names, else `completed`.

    `counts` is (job_id, total, completed, failed), `files` the ids per job; a job without
    results has neither and keeps NULL ids. Where an upload failed (job_id, kind) the state is
    `failed` and only the surviving file id is recorded.
    """
    one = counts.select(F.col("job_id").alias("id"), F.struct("total", "completed", "failed").alias("__counts"))
    ids = files.select(F.col("job_id").alias("id"), F.col("output_file_id").alias("__out"), F.col("error_file_id").alias("__err"))
    joined = jobs.join(one, "id", "left").join(ids, "id", "left")
    if failed_uploads is None:
        joined = joined.withColumns({"__no_out": F.lit(False), "__no_err": F.lit(False)})
    else:
        lost = failed_uploads.groupBy(F.col("job_id").alias("id")).agg(
            F.max(F.col("kind") == "output").alias("__no_out"), F.max(F.col("kind") == "error").alias("__no_err")
        )
        joined = joined.join(lost, "id", "left").fillna(False, ["__no_out", "__no_err"])
    ended = F.col(state) if state else F.lit("completed")
    target = F.when(F.col("__no_out") | F.col("__no_err"), F.lit("failed")).otherwise(ended)
    staged = joined.withColumns(
        {
            "__target": target,
            "__out": F.when(~F.col("__no_out"), F.col("__out")),
            "__err": F.when(~F.col("__no_err"), F.col("__err")),
        }
    )
    done = with_file_ids(transition(staged, "__target", now, "__counts"), "__out", "__err")
    return done.select(*jobs.columns)
