"""The derived tables of `plans.views` once more, as SQL text for the comparison engine."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["pairs"] = (
    (),
    """
 SELECT c.conv_id,
        CASE WHEN c.st < c.ut THEN s.text ELSE 'You are a helpful assistant.' END AS system_prompt,
        u.text AS user_prompt
 FROM (SELECT conv_id, count(*) AS n,
              min(CASE WHEN role = 'user' AND text <> '' THEN turn END) AS ut,
              min(CASE WHEN role = 'system' AND text <> '' THEN turn END) AS st
       FROM conversations GROUP BY conv_id) c
 JOIN conversations u ON u.conv_id = c.conv_id AND u.turn = c.ut
 LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.turn = c.st
 WHERE c.n >= 2""",
)

ENDPOINTS = "['/v1/responses','/v1/chat/completions','/v1/embeddings','/v1/completions','/v1/moderations']"
STATUSES = "['validating','failed','in_progress','finalizing','completed','expired','cancelling','cancelled']"
PURPOSES = (
    "['assistants','assistants_output','batch','batch_output','fine-tune','fine-tune-results','vision','user_data']"
)

VIEWS["requests"] = (
    ("pairs",),
    f"""
 SELECT 'file_' || (conv_id // 10) AS file_id, conv_id % 10 + 1 AS line_no,
        CASE conv_id % 50 WHEN 1 THEN '' WHEN 6 THEN 'req-' || (conv_id - 1) ELSE 'req-' || conv_id END AS custom_id,
        CASE conv_id % 50 WHEN 2 THEN 'GET' ELSE 'POST' END AS method,
        CASE conv_id % 50 WHEN 3 THEN 'http://elsewhere/v1' ELSE ({ENDPOINTS})[(conv_id % 5 + 1)::INT] END AS url,
        CASE conv_id % 50 WHEN 4 THEN '' ELSE 'm' || (conv_id % 3) END AS model,
        conv_id % 50 = 5 AS stream, system_prompt, user_prompt
 FROM pairs""",
)

VIEWS["checked"] = (
    ("requests",),
    """
 SELECT *, CASE WHEN rule0 IS NULL AND uses0 > 1 THEN 'duplicate' ELSE rule0 END AS error_rule,
        CASE WHEN rule0 IS NULL AND uses0 > 1
             THEN 'line ' || line_no || ': duplicate custom_id "' || custom_id || '"' ELSE msg0 END AS error_msg
 FROM (SELECT *, row_number() OVER (PARTITION BY file_id, custom_id, rule0 IS NULL ORDER BY line_no) AS uses0
       FROM (SELECT *,
         CASE WHEN custom_id = '' THEN 'custom_id' WHEN method <> 'POST' THEN 'method'
              WHEN url NOT LIKE '/%' THEN 'url_relative' WHEN model = '' THEN 'model'
              WHEN stream THEN 'stream' END AS rule0,
         CASE WHEN custom_id = '' THEN 'custom_id is required' WHEN method <> 'POST' THEN 'invalid method: ' || method
              WHEN url NOT LIKE '/%' THEN 'url must be a relative path: ' || url
              WHEN model = '' THEN 'model id is empty'
              WHEN stream THEN 'streaming is not supported in batch requests (model: ' || model || ')' END AS msg0
         FROM requests))""",
)

VIEWS["clean"] = (
    ("pairs",),
    f"""
 SELECT 'job_' || (conv_id // 10) AS job_id, 'file_' || (conv_id // 10) AS file_id, conv_id % 10 + 1 AS line_no,
        'req-' || conv_id AS custom_id, 'POST' AS method, ({ENDPOINTS})[(conv_id % 5 + 1)::INT] AS url,
        'm' || (conv_id % 3) AS model, system_prompt, user_prompt
 FROM pairs""",
)

# FNV-1a over the UTF-8 bytes of a text, 32 bit.
FNV = """
 SELECT system_prompt, list_reduce(list_prepend(2166136261::UBIGINT,
          list_transform(range(0, octet_length(encode(system_prompt))::BIGINT),
                         lambda i: ('0x' || substr(hex(encode(system_prompt)), (2 * i + 1)::BIGINT, 2))::UBIGINT)),
          lambda a, b: ((xor(a, b) * 16777619) % 4294967296)::UBIGINT)::BIGINT AS prefix_hash
 FROM (SELECT DISTINCT system_prompt FROM {source})"""

VIEWS["hashes"] = (("clean",), FNV.format(source="clean"))

VIEWS["plan"] = (
    ("clean", "hashes"),
    """
 SELECT c.job_id, c.file_id, c.line_no, c.custom_id, c.url, c.model, h.prefix_hash, c.user_prompt, c.system_prompt,
        row_number() OVER (PARTITION BY c.job_id, c.model ORDER BY h.prefix_hash, c.line_no) AS position
 FROM clean c JOIN hashes h USING (system_prompt) WHERE c.model IN ('m0', 'm1')""",
)

VIEWS["jobs"] = (
    (),
    f"""
 SELECT *,
   CASE WHEN k % 3 = 0 THEN created_at + secs ELSE 0 END AS expiry,
   CASE WHEN k % 3 = 0 THEN created_at + secs END AS expires_at,
   CASE WHEN status = 'validating' AND k % 16 = 0 THEN NULL ELSE 'p' || (k % 5) END AS processor_id,
   CASE WHEN k % 11 = 0 THEN 0 ELSE (created_at + secs) * 1000000 END AS priority,
   k % 4 AS epoch, k % 6 AS recovery_attempts,
   CASE WHEN status = 'validating' THEN 0 ELSE k % 100 + 1 END AS total,
   CASE WHEN status = 'validating' THEN 0 WHEN status = 'completed' THEN k % 100 + 1
        ELSE (k % 100 + 1) // 2 END AS completed,
   CASE WHEN k % 2 = 0 THEN 'gold' ELSE 'basic' END AS tier,
   CASE WHEN k % 4 = 0 THEN 'x' ELSE (k % 4 * 3600)::VARCHAR END AS output_ttl,
   CASE WHEN status = 'completed' THEN 'file_out_' || k END AS output_file_id
 FROM (SELECT o_orderkey AS k, 'batch_' || o_orderkey AS id, 't' || (o_custkey % 20) AS tenant_id, o_orderstatus,
              epoch(o_orderdate)::BIGINT AS created_at,
              ({STATUSES})[(o_orderkey % 8 + 1)::INT] AS status,
              ({ENDPOINTS})[(o_orderkey % 5 + 1)::INT] AS endpoint,
              'file_' || (o_orderkey % 2500) AS input_file_id,
              CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1800 WHEN '2' THEN 7200 WHEN '3' THEN 43200
                   WHEN '4' THEN 86400 ELSE 172800 END AS secs,
              CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '30m' WHEN '2' THEN '2h' WHEN '3' THEN '12h'
                   WHEN '4' THEN '24h' ELSE '48h' END AS completion_window
       FROM orders)""",
)

VIEWS["files"] = (
    (),
    f"""
 SELECT p_partkey AS k, 'file_' || p_partkey AS id, 't' || (p_partkey % 20) AS tenant_id,
        CASE WHEN p_size % 5 = 0 THEN 0 ELSE 883612800 + (p_size - 25)::BIGINT * 86400 END AS expiry,
        replace(p_name, ' ', '_') || (['.jsonl', '.tar.gz', ''])[(p_partkey % 3 + 1)::INT] AS filename,
        ({PURPOSES})[(p_partkey % 8 + 1)::INT] AS purpose, p_brand AS brand
 FROM part""",
)

VIEWS["outcomes"] = (
    (),
    """
 SELECT *, CASE WHEN status_code = 200 THEN
            CASE WHEN l_partkey % 97 = 0 THEN 'not json' ELSE 'json' END END AS body_kind,
        (l_quantity * 10)::BIGINT AS prompt_tokens,
        CASE WHEN l_partkey % 500 % 10 <> 0 THEN l_partkey % 500 END AS completion_tokens,
        status_code = 429 AND l_partkey % 5 = 0 AS ttl_dropped,
        l_partkey % 13 = 0 AS had_capacity_retry
 FROM (SELECT 'batch_' || l_orderkey AS job_id,
        'batch_req_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS request_id,
        'm' || (l_suppkey % 3) AS route_key, l_orderkey, l_partkey, l_quantity,
        CASE l_returnflag WHEN 'A' THEN 'ep-a' WHEN 'N' THEN 'ep-b' ELSE 'ep-c' END AS endpoint,
        epoch(l_shipdate)::BIGINT AS ts,
        CASE (l_orderkey + l_linenumber) % 20 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 400 WHEN 3 THEN 0
             ELSE 200 END AS status_code
       FROM lineitem)""",
)

# Result of each outcome: an error code where the row goes to the error file, else an HTTP code.
VIEWS["results"] = (
    ("outcomes",),
    """
 SELECT *, CASE WHEN status_code = 0 THEN 'UNKNOWN' WHEN ttl_dropped THEN 'batch_expired'
                WHEN body_kind = 'not json' THEN 'PARSE_ERROR' END AS error_code,
        CASE WHEN status_code > 0 AND NOT ttl_dropped AND coalesce(body_kind, '') <> 'not json'
             THEN status_code END AS http_code
 FROM outcomes""",
)

VIEWS["samples"] = (
    (),
    """
 SELECT event_type AS series, floor(epoch(ts))::BIGINT AS ts, event_id AS seq, (event_id % 1000)::DOUBLE AS value
 FROM events""",
)


def sql(select: str, *views: str, ctes: str = "") -> str:
    """`select` with the named views, and those they need, in front as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        visit(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return (f"WITH {', '.join(parts)} " if parts else "") + select
