"""Queries over outcomes and results: result building, counts, usage, drains and audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions import values as V
from ...operators import infer as run
from ...operators import ingest
from ...operators import results as res
from ...session import materialize, scratch_path
from ...sources import requests as src
from .. import flow, views
from . import query
from .ingest import gateways
from .sqlviews import sql


def results(spark, d):
    return res.to_results(views.outcomes(spark, d))


@query(
    "batch_job",
    sql(
        """SELECT model AS route_key, count(*)::BIGINT AS total, count(*)::BIGINT AS completed, 0::BIGINT AS failed,
             sum(length(user_prompt))::DOUBLE AS prompt_tokens, sum(length(user_prompt) // 2)::DOUBLE AS generation_tokens
           FROM requests r
           WHERE model IN ('m0', 'm1') AND file_id NOT IN (SELECT file_id FROM checked WHERE error_rule IS NOT NULL)
           GROUP BY model""",
        "checked",
    ),
)
def batch_job(spark, d):
    """The flagship: conversations to validated, planned and executed jobs, per model."""
    lines = src.request_lines(views.requests(spark, d)).withColumns(
        {"job_id": F.col("file_id"), "byte_len": ingest.line_length()}
    )
    done = flow.run_jobs(lines, gateways(spark), run.echo_client)
    ok = res.is_success()
    counts = done.results.groupBy("route_key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed")
    )
    return counts.join(res.token_usage(done.results).drop("requests"), "route_key", "left")


@query(
    "batch_job_end_to_end",
    sql(
        """SELECT id, CASE WHEN bad_line IS NOT NULL THEN 'failed' WHEN kind = 1 THEN 'cancelled'
                  WHEN kind = 2 THEN 'expired' ELSE 'completed' END AS status,
             CASE WHEN bad_line IS NULL THEN n END AS total, CASE WHEN bad_line IS NULL THEN good END AS completed,
             CASE WHEN bad_line IS NULL THEN n - good END AS failed, good AS output_lines, n - good AS error_lines,
             good > 0 AS has_output, n > good AS has_error, 0::BIGINT AS missing, 0::BIGINT AS repeated
           FROM (SELECT id, kind, bad_line, count(*) FILTER (bad_line IS NULL OR line_no < bad_line AND NOT routed) AS n,
                   count(*) FILTER (bad_line IS NULL AND kind IN (0, 3, 4) AND routed) AS good
                 FROM (SELECT file_id AS id, line_no, substr(file_id, 6)::BIGINT % 5 AS kind, model IN ('m0', 'm1') AS routed,
                         min(CASE WHEN error_rule IS NOT NULL THEN line_no END) OVER (PARTITION BY file_id) AS bad_line
                       FROM checked) GROUP BY id, kind, bad_line)""",
        "checked",
    ),
)
def batch_job_end_to_end(spark, d):
    """Every job to its end state; a fifth each is cancelled, past its deadline, or may have a bad file."""
    lines = src.request_lines(views.requests(spark, d)).withColumns(
        {"job_id": F.col("file_id"), "byte_len": ingest.line_length()}
    )
    out = scratch_path(spark, "batch-run")
    jobs = views.file_jobs(spark, d)
    done = flow.finish_jobs(jobs, lines, gateways(spark), run.echo_client, out, views.NOW)
    texts = spark.read.schema("value string, kind string, job_id string").text(f"{out}/results")
    written = texts.groupBy(F.col("job_id").alias("id")).agg(
        F.count_if(F.col("kind") == "output").alias("output_lines"), F.count_if(F.col("kind") == "error").alias("error_lines")
    )
    whole = lines.join(done.jobs.filter("status.status <> 'failed'").select(F.col("id").alias("job_id")), "job_id")
    asked = whole.select("job_id", S.request_id("job_id", "line_no").alias("request_id"))
    audit = res.audit_results(asked, done.results.join(asked.select("job_id").distinct(), "job_id", "left_semi"))
    one = done.jobs.join(written, "id", "left").join(audit.withColumnRenamed("job_id", "id"), "id", "left")
    zero = F.lit(0).cast("long")
    return one.select(
        "id",
        "status.status",
        "status.request_counts.total",
        "status.request_counts.completed",
        "status.request_counts.failed",
        F.coalesce("output_lines", zero).alias("output_lines"),
        F.coalesce("error_lines", zero).alias("error_lines"),
        F.col("status.output_file_id").isNotNull().alias("has_output"),
        F.col("status.error_file_id").isNotNull().alias("has_error"),
        F.coalesce("missing", zero).alias("missing"),
        F.coalesce(F.col("repeated") + F.col("foreign"), zero).alias("repeated"),
    )


@query(
    "to_results",
    sql(
        """SELECT request_id, http_code::INT AS status_code, error_code,
             CASE error_code WHEN 'UNKNOWN' THEN 'connection reset'
               WHEN 'batch_expired' THEN 'This request could not be executed before the completion window expired.'
               WHEN 'PARSE_ERROR' THEN 'response body could not be parsed' END AS message,
             CASE http_code WHEN 400 THEN '{"error":{"message":"bad input","type":"invalid_request_error"}}'
               WHEN 429 THEN '{"error":{"message":"slow down","code":429}}'
               WHEN 500 THEN '{"error":{"message":"slow down","code":500}}' END AS error_body
           FROM results""",
        "results",
    ),
)
def to_results(spark, d):
    return results(spark, d).select(
        "request_id",
        F.col("response.status_code").alias("status_code"),
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("message"),
        F.when(F.col("response.status_code") != 200, F.col("response.body")).alias("error_body"),
    )


@query(
    "to_async_results",
    """SELECT event_id,
         CASE WHEN kind IN (0, 1, 2, 5) THEN NULL WHEN kind = 3 THEN 403 WHEN kind = 4 THEN 502 ELSE 200 END AS status_code,
         CASE kind WHEN 0 THEN 'deadline' WHEN 1 THEN 'server_error' WHEN 2 THEN 'server_error'
                   WHEN 5 THEN 'parse_error' END AS error_code,
         CASE kind WHEN 0 THEN 'async request failed' WHEN 1 THEN 'gate drop' WHEN 2 THEN 'async response has no body'
                   WHEN 5 THEN 'response body could not be parsed' END AS message,
         CASE kind WHEN 3 THEN '{}' WHEN 4 THEN '{"error":{"message":"upstream"}}'
                   WHEN 6 THEN props WHEN 7 THEN props WHEN 8 THEN props WHEN 9 THEN props END AS body
       FROM (SELECT event_id, props, event_id % 10 AS kind FROM events)""",
)
def to_async_results(spark, d):
    e = views.table(spark, d, "events")
    kind = F.col("event_id") % 10
    messages = e.select(
        "event_id",
        F.col("event_id").cast("string").alias("request_id"),
        F.when(kind >= 6, F.col("props")).when(kind == 5, F.lit("{broken")).when(kind == 4, F.lit("upstream")).alias("payload"),
        F.when(kind == 3, 403).when(kind == 4, 502).when(kind.isin(5, 6, 2), 200).otherwise(0).alias("status_code"),
        F.when(kind == 0, F.lit("deadline")).alias("error_code"),
        F.when(kind == 1, F.lit("gate drop")).alias("error_message"),
    )
    out = res.to_async_results(messages)
    return out.select(
        F.col("request_id").cast("long").alias("event_id"),
        F.col("response.status_code").alias("status_code"),
        F.col("error.code").alias("error_code"),
        F.col("error.message").alias("message"),
        F.col("response.body").alias("body"),
    )


@query(
    "request_counts",
    sql(
        """SELECT job_id, count(*)::BIGINT AS total,
             count(*) FILTER (http_code = 200)::BIGINT AS completed,
             (count(*) - count(*) FILTER (http_code = 200))::BIGINT AS failed
           FROM results GROUP BY job_id""",
        "results",
    ),
)
def request_counts(spark, d):
    return res.request_counts(results(spark, d))


@query(
    "request_counts_rejected",
    sql(
        """SELECT job_id, count(*)::BIGINT AS total, count(*) FILTER (model <> 'm2')::BIGINT AS completed,
             count(*) FILTER (model = 'm2')::BIGINT AS failed FROM clean GROUP BY job_id""",
        "clean",
    ),
)
def request_counts_rejected(spark, d):
    """Counts of a run in which one model has no gateway."""
    lines = src.request_lines(views.clean_requests(spark, d)).withColumn("byte_len", ingest.line_length())
    done = flow.run_jobs(lines, gateways(spark), run.echo_client)
    return res.request_counts(done.results, done.rejected)


@query(
    "token_usage",
    sql(
        """SELECT route_key, count(*)::BIGINT AS requests, sum(prompt_tokens)::DOUBLE AS prompt_tokens,
             sum(coalesce(completion_tokens, 0))::DOUBLE AS generation_tokens
           FROM results WHERE http_code = 200 GROUP BY route_key""",
        "results",
    ),
)
def token_usage(spark, d):
    return res.token_usage(results(spark, d))


@query(
    "errors_by_model",
    sql(
        "SELECT route_key, count(*)::BIGINT AS errors FROM results WHERE coalesce(http_code, 0) <> 200 GROUP BY route_key",
        "results",
    ),
)
def errors_by_model(spark, d):
    return res.errors_by_model(results(spark, d))


@query(
    "failure_codes",
    sql(
        """SELECT coalesce(error_code, 'http_' || http_code) AS code, count(*)::BIGINT AS failures
           FROM results WHERE coalesce(http_code, 0) <> 200 GROUP BY 1""",
        "results",
    ),
)
def failure_codes(spark, d):
    return res.failure_codes(results(spark, d))


@query(
    "status_mapping",
    sql(
        """SELECT request_id,
             CASE WHEN status_code = 400 THEN 'INVALID_REQ' WHEN status_code = 429 THEN 'RATE_LIMIT'
                  WHEN status_code >= 500 THEN 'SERVER_ERROR' ELSE 'UNKNOWN' END AS category,
             CASE WHEN status_code = 400 THEN 'invalid_request_error' WHEN status_code = 429 THEN 'rate_limit_error'
                  WHEN status_code >= 500 THEN 'server_error' ELSE 'unknown_error' END AS type,
             CASE WHEN status_code = 400 THEN 'invalid_request_error' WHEN status_code = 429 THEN 'rate_limit_error'
                  WHEN status_code >= 500 THEN 'server_error' ELSE 'api_error' END AS api_type,
             CASE WHEN status_code = 0 THEN true WHEN status_code = 429 THEN NOT ttl_dropped
                  ELSE status_code >= 500 END AS retryable,
             CASE WHEN status_code = 400 THEN 'HTTP 400: bad input'
                  WHEN status_code >= 429 THEN 'HTTP ' || status_code || ': slow down' END AS message
           FROM outcomes""",
        "outcomes",
    ),
)
def status_mapping(spark, d):
    o = views.outcomes(spark, d)
    category = S.error_category("status_code")
    return o.select(
        "request_id",
        category.alias("category"),
        S.error_type(category).alias("type"),
        S.api_error_type("status_code").alias("api_type"),
        S.is_retryable("status_code", "dropped_reason").alias("retryable"),
        F.when(F.col("status_code") >= 400, S.parse_error_body("status_code", "body")).alias("message"),
    )


FLAKY = """
 SELECT request_id, job_id, status_code, ttl_dropped,
        CASE WHEN status_code = 0 OR status_code >= 500 OR (status_code = 429 AND NOT ttl_dropped)
             THEN CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 4 END ELSE 1 END AS attempts,
        l_partkey % 3 = 0 AS heals
 FROM outcomes"""


def flaky_client() -> run.Client:
    """Answers with the stored outcome; where the row heals, the second attempt succeeds."""
    seen: set[str] = set()

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        again = pd.Series([i in seen for i in batch["request_id"]], index=batch.index) & batch["heals"]
        seen.update(batch["request_id"])
        out = batch[["request_id", "status_code", "body", "error_category", "error_message", "dropped_reason"]].copy()
        out.loc[again, "status_code"] = 200
        out.loc[again, "body"] = "{}"
        out.loc[again, ["error_category", "error_message", "dropped_reason"]] = None
        out["retry_after"] = None
        return out

    return call


def no_wait(_seconds: float) -> None:
    """Stands in for sleeping where only the sequence of attempts matters."""


def attempts(spark, d):
    o = views.outcomes(spark, d)
    part = F.split("request_id", "_").getItem(4).cast("long")
    plan = o.withColumns({"prefix_hash": part % 7, "line_no": part, "heals": part % 3 == 0})
    return run.infer(plan, flaky_client, max_retries=3, sleep=no_wait)


@query(
    "infer_attempts",
    sql(
        """SELECT request_id, attempts::BIGINT AS attempts,
             attempts > 1 AND (status_code >= 500 OR status_code = 429) AS had_capacity_retry FROM flaky""",
        "outcomes",
        ctes=f"flaky AS ({FLAKY})",
    ),
)
def infer_attempts(spark, d):
    """Retries over every line item: attempts per request and the capacity flag."""
    return run.capacity_retry(attempts(spark, d))


@query(
    "infer_final",
    sql(
        """SELECT CASE WHEN attempts > 1 AND heals THEN 200 ELSE status_code END::INT AS status_code,
             count(*)::BIGINT AS requests, sum(attempts)::BIGINT AS attempts
           FROM flaky GROUP BY 1""",
        "outcomes",
        ctes=f"flaky AS ({FLAKY})",
    ),
)
def infer_final(spark, d):
    final = run.final_outcomes(materialize(attempts(spark, d), "attempts"))
    return final.groupBy("status_code").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("attempts").alias("attempts")
    )


@query(
    "infer_resume",
    sql("SELECT request_id FROM outcomes WHERE l_partkey % 4 = 0", "outcomes"),
)
def infer_resume(spark, d):
    """What a re-run still has to do when three quarters of the results are written."""
    o = views.outcomes(spark, d)
    part = F.split("request_id", "_").getItem(4).cast("long")
    return run.remaining(o.select("request_id"), o.filter(part % 4 != 0))


@query(
    "parse_error_results",
    """SELECT 'batch_req_' || page_id AS request_id, 'batch_req_' || page_id AS custom_id, 'parse_error' AS code,
         'failed to parse request line: ' || url AS message FROM pages""",
)
def parse_error_results(spark, d):
    p = views.table(spark, d, "pages")
    rows = p.select(
        F.lit("job").alias("job_id"),
        F.concat(F.lit("batch_req_"), F.col("page_id").cast("string")).alias("request_id"),
        F.lit("m0").alias("route_key"),
        F.col("url").alias("parse_error"),
    )
    out = res.parse_error_results(rows)
    return out.select("request_id", "custom_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


def event_requests(spark, d):
    e = views.table(spark, d, "events")
    return e.select(
        F.concat(F.lit("job_"), (F.col("user_id") % 50).cast("string")).alias("job_id"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("custom_id"),
        F.col("event_type").alias("route_key"),
    )


def event_messages(spark, d):
    """Nine of ten events have a result; every seventh event two; some results are foreign."""
    e = views.table(spark, d, "events")
    k = F.col("event_id")
    first = e.filter(k % 10 != 0).select(
        F.concat(F.lit("r"), k.cast("string")).alias("request_id"), (k * 2).alias("seq"), F.lit("first").alias("copy")
    )
    second = e.filter((k % 10 != 0) & (k % 7 == 0)).select(
        F.concat(F.lit("r"), k.cast("string")).alias("request_id"), (k * 2 + 1).alias("seq"), F.lit("second").alias("copy")
    )
    foreign = e.filter(k % 11 == 0).select(
        F.concat(F.lit("x"), k.cast("string")).alias("request_id"), k.alias("seq"), F.lit("first").alias("copy")
    )
    return first.unionByName(second).unionByName(foreign)


@query(
    "resolve_results",
    """SELECT 'job_' || (user_id % 50) AS job_id, 'r' || event_id AS request_id, 'c' || event_id AS custom_id,
         event_type AS route_key, event_id * 2 AS seq, 'first' AS copy FROM events WHERE event_id % 10 <> 0""",
)
def resolve_results(spark, d):
    return res.resolve_results(event_requests(spark, d), event_messages(spark, d), ["seq"])


@query(
    "first_results",
    """SELECT 'c' || l_suppkey AS request_id, min(l_orderkey) AS seq FROM lineitem GROUP BY 1""",
)
def first_results(spark, d):
    li = views.table(spark, d, "lineitem")
    rows = li.select(
        F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("request_id"), F.col("l_orderkey").alias("seq")
    )
    return res.first_results(rows, ["seq"])


@query(
    "drain_unresolved",
    f"""SELECT 'job_' || (user_id % 50) AS job_id, 'r' || event_id AS request_id, 'batch_expired' AS code,
         '{V.NOT_COLLECTED_MESSAGE}' AS message FROM events WHERE event_id % 10 = 0""",
)
def drain_unresolved(spark, d):
    out = res.drain_unresolved(
        event_requests(spark, d), event_messages(spark, d), "batch_expired", V.NOT_COLLECTED_MESSAGE
    )
    return out.select("job_id", "request_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


@query(
    "drain_stopped",
    f"""SELECT 'r' || event_id AS request_id,
         CASE WHEN event_type = 'error' THEN 'batch_expired' ELSE 'batch_cancelled' END AS code,
         CASE WHEN event_type = 'error' THEN '{V.BATCH_ERROR_MESSAGE["batch_expired"]}'
              ELSE '{V.BATCH_ERROR_MESSAGE["batch_cancelled"]}' END AS message
       FROM events WHERE event_id % 3 = 0 OR value > 100""",
)
def drain_stopped(spark, d):
    e = views.table(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(F.col("event_type") == "error", F.lit("deadline")).otherwise(F.lit("shutdown")).alias("cause"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("dispatched_at"),
    )
    out = res.drain(rows, "cause", F.lit(100.0))
    return out.select("request_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


@query(
    "all_errors",
    sql(
        """SELECT code, count(*)::BIGINT AS errors FROM (
             SELECT error_code AS code FROM results WHERE error_code IS NOT NULL
             UNION ALL SELECT 'model_not_found' FROM clean WHERE model = 'm2') GROUP BY code""",
        "results",
        "clean",
    ),
)
def all_errors(spark, d):
    from ...operators import plan

    _, rejected = plan.reject_unrouted(plan.route(views.clean_requests(spark, d), gateways(spark)))
    merged = res.all_errors(rejected, results(spark, d))
    return merged.groupBy(F.col("error.code").alias("code")).agg(F.count(F.lit(1)).alias("errors"))


@query(
    "same_members",
    """SELECT p_brand AS brand, bool_and(n = 0) AS same FROM (
         SELECT p_brand, p_type, sum(s) AS n FROM (
           SELECT p_brand, p_type, 1 AS s FROM part UNION ALL
           SELECT p_brand, CASE WHEN p_brand LIKE '%1' AND p_size > 40 THEN 'OTHER' ELSE p_type END, -1 FROM part)
         GROUP BY 1, 2) GROUP BY 1""",
)
def same_members(spark, d):
    p = views.table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_type", "p_size")
    changed = p.withColumn(
        "p_type", F.when(F.col("brand").like("%1") & (F.col("p_size") > 40), F.lit("OTHER")).otherwise(F.col("p_type"))
    )
    return res.same_members(p, changed, "brand", "p_type")


@query(
    "audit_results",
    """SELECT job_id, count(*) FILTER (asked)::BIGINT AS requests, count(*) FILTER (asked AND answers = 0)::BIGINT AS missing,
         count(*) FILTER (NOT asked)::BIGINT AS "foreign", count(*) FILTER (answers > 1)::BIGINT AS repeated
       FROM (SELECT 'job_' || (user_id % 50) AS job_id, true AS asked,
               CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS answers FROM events
             UNION ALL SELECT 'job_x', false, 1 FROM events WHERE event_id % 11 = 0) GROUP BY job_id""",
)
def audit_results(spark, d):
    asked = event_requests(spark, d)
    answers = event_messages(spark, d).join(asked.select("request_id", "job_id"), "request_id", "left")
    return res.audit_results(asked, answers.withColumn("job_id", F.coalesce("job_id", F.lit("job_x"))))


@query(
    "write_results",
    sql(
        """SELECT job_id, kind, count(*)::BIGINT AS rows, sum(http_code)::BIGINT AS codes, min('c-' || substr(request_id, 11)) AS first_id,
             max('c-' || substr(request_id, 11)) AS last_id, 0::BIGINT AS malformed
           FROM (SELECT r.* REPLACE ('month_' || strftime(o_orderdate, '%Y-%m') AS job_id), CASE WHEN error_code IS NULL THEN 'output' ELSE 'error' END AS kind
                 FROM results r JOIN orders ON o_orderkey = l_orderkey) GROUP BY job_id, kind""",
        "results",
    ),
)
def write_results(spark, d):
    """Write output and error files of every job, here all orders of a month, read them back, and check what the
    lines of each file hold."""
    path = scratch_path(spark, "results")
    owner = views.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("month_"), F.date_format("o_orderdate", "yyyy-MM")).alias("owner"))
    # The numbers of a line item are a third of its line: they are joined and brought together, then made to text.
    items = views.table(spark, d, "lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    placed = items.drop("o_orderkey").hint("rebalance", F.col("owner"))
    src.write_results(res.to_results(views.outcomes_of(placed, F.col("owner"))), path, placed=True)
    back = spark.read.schema("value string, kind string, job_id string").text(path)
    line = F.from_json("value", "custom_id string, response struct<status_code: long>")
    good = F.array_join(F.json_object_keys("value"), ",") == "id,custom_id,response,error"
    return back.withColumn("line", line).groupBy("job_id", "kind").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("line.response.status_code").alias("codes"),
        F.min("line.custom_id").alias("first_id"),
        F.max("line.custom_id").alias("last_id"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("malformed"),
    )


@query(
    "result_files",
    sql(
        """SELECT job_id, count(*) FILTER (error_code IS NULL)::BIGINT AS output_rows, count(error_code)::BIGINT AS error_rows,
             count(*) FILTER (error_code IS NULL) > 0 AS has_output, count(error_code) > 0 AS has_error
           FROM results GROUP BY job_id""",
        "results",
    ),
)
def result_files(spark, d):
    f = src.result_files(results(spark, d))
    return f.select(
        "job_id",
        "output_rows",
        "error_rows",
        F.col("output_file_id").isNotNull().alias("has_output"),
        F.col("error_file_id").isNotNull().alias("has_error"),
    )
