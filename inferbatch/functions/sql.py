"""The scalar helpers as SQL functions, for use in `spark.sql` text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import values as V


def _case(column: str, table: dict, default: str) -> str:
    def text(v) -> str:
        return str(v) if isinstance(v, int) else f"'{v}'"

    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


# name -> (parameters, result type, expression)
FUNCTIONS = {
    "error_category": (
        "status INT",
        "STRING",
        "CASE WHEN status = 400 THEN 'INVALID_REQ' WHEN status IN (401, 403) THEN 'AUTH_ERROR'"
        " WHEN status = 429 THEN 'RATE_LIMIT' WHEN status >= 500 THEN 'SERVER_ERROR' ELSE 'UNKNOWN' END",
    ),
    "error_type": ("category STRING", "STRING", _case("category", V.CATEGORY_TYPE, f"'{V.CATEGORY_TYPE_DEFAULT}'")),
    "api_error_type": (
        "status INT",
        "STRING",
        _case("status", V.API_ERROR_TYPE, "CASE WHEN status >= 500 THEN 'server_error' ELSE 'api_error' END"),
    ),
    "is_retryable": (
        "status INT, dropped_reason STRING",
        "BOOLEAN",
        "CASE WHEN coalesce(status, 0) <= 0 THEN true"
        f" WHEN status IN (429, 503) THEN coalesce(dropped_reason, '') <> '{V.DROPPED_TTL_EXPIRED}' ELSE status >= 500 END",
    ),
    "batch_error_message": (
        "code STRING",
        "STRING",
        _case("code", V.BATCH_ERROR_MESSAGE, f"'{V.BATCH_ERROR_MESSAGE_DEFAULT}'"),
    ),
    "size_bucket": (
        "total_lines BIGINT",
        "STRING",
        "CASE WHEN total_lines < 100 THEN '100' WHEN total_lines < 1000 THEN '1000'"
        " WHEN total_lines < 10000 THEN '10000' WHEN total_lines < 30000 THEN '30000' ELSE 'large' END",
    ),
    "format_duration": (
        "seconds BIGINT",
        "STRING",
        "CASE WHEN seconds < 60 THEN seconds || 's' WHEN seconds < 3600 THEN (seconds DIV 60) || 'm'"
        " WHEN seconds DIV 60 % 60 = 0 THEN (seconds DIV 3600) || 'h'"
        " ELSE (seconds DIV 3600) || 'h ' || (seconds DIV 60 % 60) || 'm' END",
    ),
    "tenant_folder": (
        "tenant STRING",
        "STRING",
        "CASE WHEN coalesce(tenant, '') = '' THEN raise_error('tenantID cannot be empty')"
        " ELSE 't-' || substr(sha2(tenant, 256), 1, 61) END",
    ),
    "storage_name": (
        "file_id STRING, filename STRING",
        "STRING",
        r"file_id || coalesce(nullif(regexp_extract(filename, '([.][^./]*)$', 1), ''), '.jsonl')",
    ),
    "safe_model_name": (
        "model STRING",
        "STRING",
        "coalesce(nullif(regexp_replace(model, '[^a-zA-Z0-9._-]+', '_'), ''), 'unknown')",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (parameters, result, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    return list(FUNCTIONS)
