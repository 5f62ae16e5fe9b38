"""Queries that generate workloads from table rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ...functions import values as V
from ...operators import workload as W
from ...session import scratch_path
from ...sources import requests as src
from .. import views
from . import query
from .sqlviews import sql


def uniform_sql(salt: str, index: str, seed: int = 42) -> str:
    return f"((('0x' || substr(md5('{salt}:{seed}:' || {index}), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)"


def length_sql(dist: str, mean, stdev, salt: str, index: str, low: int, top, seed: int = 42) -> str:
    u1, u2 = uniform_sql(salt + "a", index, seed), uniform_sql(salt + "b", index, seed)
    gauss = f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * {math.pi!r} * {u2}))"
    if dist == "fixed":
        return f"{int(mean)}::BIGINT"
    if dist == "lognormal":
        s2 = math.log(1 + stdev**2 / mean**2)
        value = f"exp({math.log(mean) - s2 / 2!r} + {math.sqrt(s2)!r} * {gauss})"
    elif dist == "normal":
        value = f"({float(mean)!r} + {float(stdev)!r} * {gauss})"
    else:
        bottom = max(low, mean - stdev)
        value = f"({float(bottom)!r} + {float(mean + stdev - bottom)!r} * {u1})"
    return f"least(greatest({low}, round_even({value}, 0)::BIGINT), {top})::BIGINT"


KINDS = [("fixed", 100, 0, 1, 4096), ("lognormal", 1500, 1200, 16, 4096), ("normal", 500, 400, 1, 2048), ("uniform", 64, 80, 16, 120)]


@query(
    "sample_length",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, "
    + ", ".join(
        f"{length_sql(k, m, s, k, '(l_orderkey * 100000 + l_partkey)', lo, hi)} AS {k}_length" for k, m, s, lo, hi in KINDS
    )
    + " FROM lineitem",
)
def sample_length(spark, d):
    li = views.table(spark, d, "lineitem")
    index = F.col("l_orderkey") * 100000 + F.col("l_partkey")
    return li.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_partkey",
        *[W.sample_length(k, m, s, F.lit(42), index, k, lo, hi).alias(f"{k}_length") for k, m, s, lo, hi in KINDS],
    )


WORDS = "[" + ", ".join(f"'{w}'" for w in V.SYNTHETIC_WORDS) + "]"


@query(
    "synthetic_prompt",
    f"""SELECT p_partkey, CASE WHEN p_size = 0 THEN '' ELSE array_to_string(list_transform(range(0, p_size),
         lambda i: ({WORDS})[((i + p_partkey) % 15 + 1)::INT]), ' ') END AS prompt FROM part""",
)
def synthetic_prompt(spark, d):
    p = views.table(spark, d, "part")
    return p.select("p_partkey", W.synthetic_prompt(F.col("p_size").cast("long"), "p_partkey").alias("prompt"))


PERSONAS = """personas AS (SELECT persona,
   trim(substr('[Persona ' || lpad(persona::VARCHAR, 3, '0') || '] ' || text, 1, 256), ' ') AS system_prompt
 FROM (SELECT row_number() OVER (ORDER BY doc_id, text) - 1 AS persona, text FROM documents
       WHERE doc_id IS NOT NULL AND text IS NOT NULL QUALIFY persona < 32))"""


def personas(spark, d):
    return W.system_prompts(views.table(spark, d, "documents"), "doc_id", "text", 32, 64)


@query("system_prompts", sql("SELECT persona, system_prompt FROM personas", ctes=PERSONAS))
def system_prompts(spark, d):
    return personas(spark, d)


def generated(seed: int = 42, prefix: str = "req") -> str:
    tokens = length_sql("lognormal", 300, 200, "in", "i", 16, 400, seed)
    out = length_sql("lognormal", 500, 400, "out", "i", 1, 2048, seed)
    return f"""SELECT i AS line_no, '{prefix}-' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS custom_id,
       {out} AS max_tokens, system_prompt, trim(substr(text, 1, {tokens} * 4), ' ') AS user_prompt
     FROM (SELECT doc_id AS i, text FROM documents) LEFT JOIN personas ON persona = i % 32"""


LENGTHS = {"input_length": ("lognormal", 300, 200, 400), "output_length": ("lognormal", 500, 400, 2048)}


@query("generate_requests", sql(generated(), ctes=PERSONAS))
def generate_requests(spark, d):
    docs = views.table(spark, d, "documents")
    out = W.generate_requests(docs, "doc_id", "m0", personas=personas(spark, d), text="text", **LENGTHS)
    return out.select("line_no", "custom_id", "max_tokens", "system_prompt", "user_prompt")


@query(
    "generate_jobs",
    sql(
        """SELECT job_id, completion_window, count(*)::BIGINT AS requests, sum(max_tokens)::BIGINT AS max_tokens,
             sum(length(user_prompt))::BIGINT AS prompt_chars, min(custom_id) AS first_id FROM (
           """
        + " UNION ALL ".join(
            f"SELECT 'job-{x}' AS job_id, '{w}' AS completion_window, * FROM ({generated(42 + n, 'job-' + x)})"
            for n, (x, w) in enumerate((("a", "30m"), ("b", "2h"), ("c", "24h")))
        )
        + ") GROUP BY 1, 2",
        ctes=PERSONAS,
    ),
)
def generate_jobs(spark, d):
    docs = views.table(spark, d, "documents")
    out = W.generate_jobs(docs, "doc_id", "m0", personas=personas(spark, d), text="text", **LENGTHS)
    return out.groupBy("job_id", "completion_window").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("max_tokens").alias("max_tokens"),
        F.sum(F.length("user_prompt")).cast("long").alias("prompt_chars"),
        F.min("custom_id").alias("first_id"),
    )


@query(
    "generate_from_conversations",
    sql(
        """SELECT conv_id AS line_no, 'req-' || lpad(conv_id::VARCHAR, 4, '0') AS custom_id, system_prompt, user_prompt,
             100::BIGINT AS max_tokens FROM pairs""",
        "pairs",
    ),
)
def generate_from_conversations(spark, d):
    conv = views.table(spark, d, "conversations")
    pairs = W.conversation_pairs(conv, "conv_id", "turn", "role", "text", user_role="user")
    out = W.generate_requests(pairs, "conv_id", "m0", output_length=("fixed", 100, 0, None))
    return out.select("line_no", "custom_id", "system_prompt", "user_prompt", "max_tokens")


@query(
    "write_workload",
    sql(
        f"""SELECT count(*)::BIGINT AS lines, count(DISTINCT custom_id)::BIGINT AS ids, sum(max_tokens)::BIGINT AS max_tokens,
             sum(length(user_prompt))::BIGINT AS prompt_chars FROM ({generated()})""",
        ctes=PERSONAS,
    ),
)
def write_workload(spark, d):
    """Write the generated requests as JSONL and read every line back."""
    docs = views.table(spark, d, "documents")
    out = W.generate_requests(docs, "doc_id", "m0", personas=personas(spark, d), text="text", **LENGTHS)
    path = scratch_path(spark, "workload")
    src.write_workload(src.request_lines(out), path)
    back = spark.read.text(path)
    body = F.from_json("value", "custom_id string, body struct<max_tokens: long, messages: array<struct<role: string, content: string>>>")
    rows = back.select(body.alias("r")).select(
        "r.custom_id", "r.body.max_tokens", F.length(F.col("r.body.messages")[1]["content"]).alias("chars")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("lines"),
        F.countDistinct("custom_id").alias("ids"),
        F.sum("max_tokens").alias("max_tokens"),
        F.sum("chars").cast("long").alias("prompt_chars"),
    )
