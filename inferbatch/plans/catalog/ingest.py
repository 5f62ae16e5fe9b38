"""Queries over request files: scan, decode, validate, de-duplicate, route and plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions import values as V
from ...operators import ingest, plan, workload
from ...session import scratch_path
from ...sources import requests as src
from .. import views
from . import query
from .sqlviews import FNV, sql


def checked(spark, d) -> DataFrame:
    lines = src.request_lines(views.requests(spark, d))
    return ingest.check_lines(ingest.decode_requests(lines))


def clean_lines(spark, d) -> DataFrame:
    lines = src.request_lines(views.clean_requests(spark, d))
    return ingest.decode_requests(lines)


def gateways(spark) -> DataFrame:
    """Two configured models."""
    return spark.createDataFrame([(m, f"http://{m}") for m in views.GATEWAYS], "route_key string, url string")


@query(
    "conversation_pairs",
    sql("SELECT conv_id, system_prompt, user_prompt FROM pairs", "pairs"),
)
def conversation_pairs(spark, d):
    conv = views.table(spark, d, "conversations")
    return workload.conversation_pairs(conv, "conv_id", "turn", "role", "text", user_role="user")


@query(
    "read_requests",
    sql(
        """SELECT count(*)::BIGINT AS lines, sum(octet_length(encode(custom_id)))::BIGINT AS id_bytes,
           0::BIGINT AS gaps, 0::BIGINT AS misnumbered FROM clean""",
        "clean",
    ),
)
def read_requests(spark, d):
    """Write the request lines as files, scan them back, and check numbers and offsets per file."""
    path = scratch_path(spark, "requests")
    src.write_workload(src.request_lines(views.clean_requests(spark, d)).repartition(8), path)
    lines = src.read_requests(spark, path)
    per_file = lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("line_no").alias("last_no"),
        F.sum(F.col("byte_len").cast("long")).alias("bytes"),
        F.max(F.col("byte_offset") + F.col("byte_len")).alias("last_end"),
        F.sum(F.octet_length(F.get_json_object("value", "$.custom_id"))).alias("id_bytes"),
    )
    return per_file.agg(
        F.sum("n").alias("lines"),
        F.sum("id_bytes").cast("long").alias("id_bytes"),
        F.count_if(F.col("bytes") != F.col("last_end")).alias("gaps"),
        F.count_if(F.col("n") != F.col("last_no")).alias("misnumbered"),
    )


@query(
    "validate_requests",
    sql("SELECT file_id, line_no, rule0 AS error_rule, msg0 AS error_msg FROM checked", "checked"),
)
def validate_requests(spark, d):
    lines = ingest.decode_requests(src.request_lines(views.requests(spark, d)))
    return ingest.validate_requests(lines).select("file_id", "line_no", "error_rule", "error_msg")


@query(
    "check_lines",
    sql("SELECT file_id, line_no, error_rule, error_msg FROM checked", "checked"),
)
def check_lines(spark, d):
    return checked(spark, d).select("file_id", "line_no", "error_rule", "error_msg")


@query(
    "file_verdict",
    sql(
        """SELECT file_id, count(*)::BIGINT AS lines, count(error_rule) = 0 AS ok,
           min(CASE WHEN error_rule IS NOT NULL THEN line_no END) AS bad_line,
           min_by(error_rule, line_no) FILTER (error_rule IS NOT NULL) AS error_rule,
           min_by(CASE WHEN error_rule = 'duplicate' THEN error_msg
                       ELSE 'validate request at line ' || line_no || ': ' || error_msg END, line_no)
             FILTER (error_rule IS NOT NULL) AS error_msg
           FROM checked GROUP BY file_id""",
        "checked",
    ),
)
def file_verdict(spark, d):
    return ingest.file_verdict(checked(spark, d))


@query(
    "duplicate_ids",
    sql(
        """SELECT file_id, custom_id, count(*)::BIGINT AS uses FROM requests
           GROUP BY file_id, custom_id HAVING count(*) > 1""",
        "requests",
    ),
)
def duplicate_ids(spark, d):
    return ingest.duplicate_ids(views.requests(spark, d))


@query(
    "duplicate_keys_orders",
    """SELECT l_orderkey AS file_id, l_linenumber::VARCHAR AS custom_id, count(*)::BIGINT AS uses
       FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys_orders(spark, d):
    li = views.table(spark, d, "lineitem")
    return ingest.duplicate_ids(
        li.select(
            F.col("l_orderkey").alias("file_id"),
            F.col("l_linenumber").cast("string").alias("custom_id"),
            F.col("l_partkey").alias("line_no"),
        )
    )


@query(
    "mark_duplicates",
    """SELECT event_type AS file_id, event_id AS line_no, event_id > min(event_id) OVER
         (PARTITION BY event_type, user_id) AS is_repeat FROM events""",
)
def mark_duplicates(spark, d):
    e = views.table(spark, d, "events")
    lines = e.select(
        F.col("event_type").alias("file_id"),
        F.col("event_id").alias("line_no"),
        F.col("user_id").cast("string").alias("custom_id"),
    )
    return ingest.mark_duplicates(lines).select("file_id", "line_no", "is_repeat")


@query(
    "byte_offsets",
    """SELECT source AS file_id, doc_id AS line_no, octet_length(encode(text))::BIGINT + 1 AS byte_len,
         coalesce(sum(octet_length(encode(text)) + 1) OVER
           (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
           AS byte_offset
       FROM documents""",
)
def byte_offsets(spark, d):
    """Document texts as the lines of one file per source; a source may hold most of the rows."""
    docs = views.table(spark, d, "documents")
    lines = docs.select(
        F.col("source").alias("file_id"),
        F.col("doc_id").alias("line_no"),
        ingest.line_length("text").cast("long").alias("byte_len"),
    )
    return ingest.with_offsets(lines).select("file_id", "line_no", "byte_len", "byte_offset")


SIZED = """(SELECT source || CASE WHEN n_chars > 1000 THEN '-long' ELSE '-short' END AS file_id, doc_id AS line_no, lang,
   octet_length(encode(text)) + 1 AS len FROM documents)"""


def sized_lines(spark, d) -> DataFrame:
    """Documents as lines: per source one file of long lines and one of short lines."""
    kind = F.when(F.col("n_chars") > 1000, F.lit("-long")).otherwise(F.lit("-short"))
    return views.table(spark, d, "documents").select(
        F.concat("source", kind).alias("file_id"),
        F.col("doc_id").alias("line_no"),
        F.col("lang").alias("model"),
        ingest.line_length("text").alias("byte_len"),
    )


@query(
    "file_stats",
    f"""SELECT file_id, count(*)::BIGINT AS lines, sum(len)::BIGINT AS bytes, count(DISTINCT lang)::BIGINT AS models,
         CASE WHEN sum(len) > 100000 THEN 'bytes' WHEN count(*) > 30 THEN 'lines' END AS breach
       FROM {SIZED} GROUP BY file_id""",
)
def file_stats(spark, d):
    return ingest.file_stats(sized_lines(spark, d), max_bytes=100000, max_lines=30)


@query(
    "oversized_files",
    f"""SELECT file_id, line_no FROM {SIZED} QUALIFY sum(len) OVER (PARTITION BY file_id) <= 100000
         AND count(*) OVER (PARTITION BY file_id) <= 30""",
)
def oversized_files(spark, d):
    """Lines of the files that keep within their limits."""
    lines = sized_lines(spark, d)
    return ingest.drop_oversized(lines, ingest.file_stats(lines, 100000, 30)).select("file_id", "line_no")


@query(
    "prefix_hash",
    sql("SELECT DISTINCT system_prompt, prefix_hash FROM hashes", "hashes"),
)
def prefix_hash(spark, d):
    lines = clean_lines(spark, d)
    return plan.with_prefix_hash(lines).select("system_prompt", "prefix_hash").distinct()


@query(
    "prefix_hash_customers",
    sql(
        "SELECT system_prompt, prefix_hash FROM h",
        ctes="c AS (SELECT c_name AS system_prompt FROM customer), h AS ("
        + "SELECT * FROM ("
        + FNV.format(source="c")
        + "))",
    ),
)
def prefix_hash_customers(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_name").alias("system_prompt"))
    return plan.with_prefix_hash(c).select("system_prompt", "prefix_hash")


@query(
    "reject_unrouted",
    sql(
        """SELECT job_id, custom_id, 'model_not_found' AS code,
           'model "' || model || '" is not configured in any gateway' AS message
           FROM clean WHERE model NOT IN ('m0', 'm1')""",
        "clean",
    ),
)
def reject_unrouted(spark, d):
    lines = views.clean_requests(spark, d)
    _, rejected = plan.reject_unrouted(plan.route(lines, gateways(spark)))
    return rejected.select("job_id", "custom_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


@query(
    "route_by_tenant",
    sql(
        """SELECT id, tenant_id || '/m' || (k % 3) AS route_key,
           CASE WHEN tenant_id IN ('t0', 't1') AND k % 3 < 2 THEN 'http://' || tenant_id || '/m' || (k % 3) END AS url
           FROM jobs""",
        "jobs",
    ),
)
def route_by_tenant(spark, d):
    j = views.jobs(spark, d)
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    lines = j.select("id", "tenant_id", F.concat(F.lit("m"), (number % 3).cast("string")).alias("model"))
    keys = [f"{t}/{m}" for t in ("t0", "t1") for m in ("m0", "m1")]
    gw = spark.createDataFrame([(k, f"http://{k}") for k in keys], "route_key string, url string")
    return plan.route(lines, gw, method="tenant").select("id", "route_key", F.col("gateway.url").alias("url"))


@query(
    "route_global",
    sql("SELECT id, 'http://all' AS url FROM jobs", "jobs"),
)
def route_global(spark, d):
    j = views.jobs(spark, d).select("id", "tenant_id", F.col("spec.endpoint").alias("model"))
    gw = spark.createDataFrame([("*", "http://all")], "route_key string, url string")
    return plan.route(j, gw, use_global=True).select("id", F.col("gateway.url").alias("url"))


@query(
    "distinct_gateways",
    """SELECT p_brand AS url, p_type AS timeout, count(*)::BIGINT AS models
       FROM part GROUP BY p_brand, p_type""",
)
def distinct_gateways(spark, d):
    gw = views.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("route_key"), F.col("p_brand").alias("url"), F.col("p_type").alias("timeout")
    )
    return plan.distinct_gateways(gw)


@query(
    "validate_pools",
    """SELECT c_mktsegment AS pool, count(*)::BIGINT AS models,
         'models "' || min(c_name) || '" and "' || max(c_name) || '" both map to pool "' || c_mktsegment
           || '": each pool must have a single consumer' AS error,
         'bq:requests:' || c_mktsegment AS request_queue, 'bq:results:' || c_mktsegment || ':c1' AS result_queue
       FROM customer GROUP BY c_mktsegment""",
)
def validate_pools(spark, d):
    models = views.table(spark, d, "customer").select(F.col("c_name").alias("model"), F.col("c_mktsegment").alias("pool"))
    return plan.validate_pools(models, prefix="bq:", consumer="c1")


@query(
    "safe_names",
    """SELECT source AS job_id, url AS model, base || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS safe_name
       FROM (SELECT source, url, base, row_number() OVER (PARTITION BY source, base ORDER BY first_line, url) AS n
             FROM (SELECT lang AS source, url, min(line) AS first_line,
                     CASE WHEN url = '' THEN 'unknown' ELSE regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g') END AS base
                   FROM (SELECT page_id AS line, url, 'l' || (page_id % 3) AS lang FROM pages) GROUP BY 1, 2))""",
)
def safe_names(spark, d):
    """Page addresses as model names: they need the most replacing."""
    p = views.table(spark, d, "pages")
    lines = p.select(
        F.concat(F.lit("l"), (F.col("page_id") % 3).cast("string")).alias("job_id"),
        F.col("page_id").alias("line_no"),
        F.col("url").alias("model"),
    )
    return plan.safe_names(lines).select("job_id", "model", "safe_name")


@query(
    "safe_names_collide",
    """SELECT 'all' AS job_id, model, base || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS safe_name
       FROM (SELECT model, base, row_number() OVER (PARTITION BY base ORDER BY first_line, model) AS n
             FROM (SELECT model, min(line) AS first_line, regexp_replace(model, '[^a-zA-Z0-9._-]+', '_', 'g') AS base
                   FROM (SELECT p_partkey AS line, replace(p_name, ' ', (['/', ':', ' '])[(p_partkey % 3 + 1)::INT])
                                AS model FROM part) GROUP BY 1))""",
)
def safe_names_collide(spark, d):
    p = views.table(spark, d, "part")
    sep = views.pick(F.col("p_partkey") % 3, "/", ":", " ")
    lines = p.select(
        F.lit("all").alias("job_id"),
        F.col("p_partkey").alias("line_no"),
        F.replace("p_name", F.lit(" "), sep).alias("model"),
    )
    return plan.safe_names(lines).select("job_id", "model", "safe_name")


@query(
    "build_plan",
    sql("SELECT job_id, model, position, custom_id, prefix_hash, line_no FROM plan", "plan"),
)
def build_plan(spark, d):
    lines = src.request_lines(views.clean_requests(spark, d))
    entries = plan.build_plan(with_lengths(lines), gateways(spark)).entries
    return entries.select("job_id", "model", "position", "custom_id", "prefix_hash", "line_no")


def with_lengths(lines: DataFrame) -> DataFrame:
    return lines.withColumn("byte_len", ingest.line_length())


@query(
    "plan_position",
    """SELECT l_orderkey % 3 AS job_id, 'm' || (l_suppkey % 2) AS model, l_linenumber::BIGINT AS prefix_hash,
         l_orderkey * 10000000000 + l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS line_no,
         row_number() OVER (PARTITION BY l_orderkey % 3, l_suppkey % 2 ORDER BY l_linenumber, l_orderkey, l_partkey,
           l_suppkey) AS position
       FROM lineitem""",
)
def plan_position(spark, d):
    """Six large groups over all line items: positions are computed in balanced ranges."""
    li = views.table(spark, d, "lineitem")
    lines = li.select(
        (F.col("l_orderkey") % 3).alias("job_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")).alias("model"),
        F.col("l_linenumber").cast("long").alias("prefix_hash"),
        (
            F.col("l_orderkey") * 10000000000
            + F.col("l_linenumber").cast("long") * 1000000000
            + F.col("l_partkey") * 10000
            + F.col("l_suppkey")
        ).alias("line_no"),
    )
    return plan.plan_position(lines)


@query(
    "write_plan",
    sql(
        """SELECT model, count(*)::BIGINT AS entries, sum(line_no)::BIGINT AS line_sum, 0::BIGINT AS out_of_order
           FROM plan GROUP BY model""",
        "plan",
    ),
)
def write_plan(spark, d):
    """Write the plan and check on the way back that every file is in order."""
    lines = src.request_lines(views.clean_requests(spark, d))
    entries = plan.build_plan(with_lengths(lines), gateways(spark)).entries
    path = scratch_path(spark, "plan")
    src.write_plan(entries, path)
    back = spark.read.schema(entries.schema).parquet(path)
    return plan.count_disorder(back).select("model", "entries", "line_sum", "out_of_order")


@query(
    "prefix_groups",
    sql(
        """SELECT model, count(*)::BIGINT AS prompts, sum(n)::BIGINT AS requests, max(n)::BIGINT AS largest,
           round(sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS shared
           FROM (SELECT model, prefix_hash, count(*) AS n FROM plan GROUP BY 1, 2) GROUP BY model""",
        "plan",
    ),
)
def prefix_groups(spark, d):
    lines = plan.with_prefix_hash(views.clean_requests(spark, d)).filter(F.col("model").isin(*views.GATEWAYS))
    return plan.prefix_groups(lines).withColumn("shared", F.round("shared", 6))


@query(
    "dispatch_order",
    sql(
        """SELECT id, row_number() OVER (ORDER BY deadline, prefix_hash, id) AS position
           FROM (SELECT id, (created_at + secs) * 1000000 AS deadline, k % 7 AS prefix_hash FROM jobs)""",
        "jobs",
    ),
)
def dispatch_order(spark, d):
    j = views.jobs(spark, d)
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    rows = j.select(
        "id",
        S.deadline_micros("spec.created_at", "spec.completion_window").alias("deadline"),
        (number % 7).alias("prefix_hash"),
    )
    return plan.dispatch_order(rows, ["id"]).select("id", "position")


@query(
    "build_headers",
    sql(
        f"""SELECT id, o_orderstatus AS team,
           CASE WHEN priority > 0 AND priority // 1000 - {views.NOW}000 >= 0
                THEN (priority // 1000 - {views.NOW}000)::VARCHAR END AS slo_ms,
           CASE WHEN endpoint = '/v1/responses' THEN 'fast' END AS objective, tenant_id AS fairness
           FROM jobs""",
        "jobs",
    ),
)
def build_headers(spark, d):
    j = plan.job_headers(views.jobs(spark, d))
    rows = j.withColumn("objective", F.when(F.col("spec.endpoint") == "/v1/responses", F.lit("fast")))
    h = plan.build_headers(rows, views.NOW, fairness=True)
    return h.select(
        "id",
        F.col("headers")["x-team"].alias("team"),
        F.col("headers")[V.HEADER_SLO_TTFT_MS].alias("slo_ms"),
        F.col("headers")[V.HEADER_OBJECTIVE].alias("objective"),
        F.col("headers")[V.HEADER_FAIRNESS_ID].alias("fairness"),
    )


@query(
    "tenant_folder",
    """SELECT c_name AS tenant, 't-' || substr(sha256(c_name), 1, 61) AS folder FROM customer""",
)
def tenant_folder(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_name").alias("tenant"))
    return c.withColumn("folder", S.tenant_folder("tenant"))


@query(
    "storage_names",
    sql(
        """SELECT id, id || CASE WHEN k % 3 = 1 THEN '.gz' ELSE '.jsonl' END AS storage_name,
           'batch_output_' || id || '.jsonl' AS output_name, 'batch_error_' || id || '.jsonl' AS error_name
           FROM files""",
        "files",
    ),
)
def storage_names(spark, d):
    f = views.files(spark, d)
    return f.select(
        "id",
        S.storage_name("id", "spec.filename").alias("storage_name"),
        S.output_name("id").alias("output_name"),
        S.error_name("id").alias("error_name"),
    )


@query(
    "derived_ids",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey,
         'batch_req_' || substr(sha256(l_orderkey || chr(1) || l_linenumber), 1, 32) AS request_id,
         'file_' || substr(sha256(l_partkey::VARCHAR), 1, 32) AS file_id,
         'batch_' || substr(sha256(l_suppkey::VARCHAR), 1, 32) AS batch_id
       FROM lineitem""",
)
def derived_ids(spark, d):
    li = views.table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_partkey",
        S.request_id("l_orderkey", "l_linenumber").alias("request_id"),
        S.file_id("l_partkey").alias("file_id"),
        S.batch_id("l_suppkey").alias("batch_id"),
    )
