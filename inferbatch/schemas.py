"""Explicit schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TAGS = T.MapType(S, S)

REQUEST_LINE = _struct(
    ("custom_id", S),
    ("method", S),
    ("url", S),
    (
        "body",
        _struct(
            ("model", S),
            ("stream", B),
            ("messages", T.ArrayType(_struct(("role", S), ("content", S)))),
        ),
    ),
)

COUNTS = _struct(("total", L), ("completed", L), ("failed", L))

USAGE = _struct(
    ("input_tokens", L),
    ("input_tokens_details", _struct(("cached_tokens", L))),
    ("output_tokens", L),
    ("output_tokens_details", _struct(("reasoning_tokens", L))),
    ("total_tokens", L),
)

ERRORS = _struct(
    ("object", S),
    ("data", T.ArrayType(_struct(("code", S), ("message", S), ("param", S), ("line", L)))),
)

JOB_SPEC = _struct(
    ("object", S),
    ("endpoint", S),
    ("input_file_id", S),
    ("completion_window", S),
    ("metadata", TAGS),
    ("created_at", L),
)

JOB_STATUS = _struct(
    ("status", S),
    ("output_file_id", S),
    ("error_file_id", S),
    ("cancelled_at", L),
    ("cancelling_at", L),
    ("completed_at", L),
    ("expired_at", L),
    ("expires_at", L),
    ("failed_at", L),
    ("finalizing_at", L),
    ("in_progress_at", L),
    ("request_counts", COUNTS),
    ("errors", ERRORS),
    ("usage", USAGE),
)

JOB = _struct(
    ("id", S),
    ("tenant_id", S),
    ("expiry", L),
    ("tags", TAGS),
    ("spec", JOB_SPEC),
    ("status", JOB_STATUS),
    ("processor_id", S),
    ("priority", L),
    ("epoch", L),
    ("recovery_attempts", L),
)

# The same row with spec and status still in their stored JSON text.
JOB_ROW = _struct(
    ("id", S),
    ("tenant_id", S),
    ("expiry", L),
    ("tags", TAGS),
    ("spec", S),
    ("status", S),
    ("processor_id", S),
    ("priority", L),
    ("epoch", L),
    ("recovery_attempts", L),
)

FILE_OBJECT = _struct(
    ("id", S),
    ("bytes", L),
    ("created_at", L),
    ("expires_at", L),
    ("filename", S),
    ("object", S),
    ("purpose", S),
    ("status", S),
)

FILE_ROW = _struct(
    ("id", S),
    ("tenant_id", S),
    ("expiry", L),
    ("tags", TAGS),
    ("spec", S),
    ("status", S),
    ("purpose", S),
)

RESPONSE = _struct(("status_code", I), ("request_id", S), ("body", S))
ERROR = _struct(("code", S), ("message", S))

RESULT = _struct(
    ("job_id", S),
    ("request_id", S),
    ("custom_id", S),
    ("route_key", S),
    ("response", RESPONSE),
    ("error", ERROR),
    ("had_capacity_retry", B),
)

RESULT_MESSAGE = _struct(
    ("request_id", S),
    ("payload", S),
    ("status_code", I),
    ("error_code", S),
    ("error_message", S),
)

EVENT = _struct(("job_id", S), ("type", S), ("ts", L), ("ttl", L))

SAMPLE = _struct(("metric", S), ("labels", TAGS), ("ts", L), ("seq", L), ("le", D), ("value", D))

PHASE = _struct(
    ("phase", S),
    ("cycle", L),
    *[(f"{family}_{p}", D) for family in ("ttft", "tpot", "itl", "req_latency") for p in ("p50", "p95", "p99")],
    ("ok_rps", D),
    ("err_rps", D),
    ("error_rate", D),
    ("completed", L),
    ("errors", L),
)

# What one call of the user's inference function returns per request.
ATTEMPT = _struct(
    ("request_id", S),
    ("attempt", I),
    ("status_code", I),
    ("body", S),
    ("error_category", S),
    ("error_message", S),
    ("dropped_reason", S),
    ("retry_after", D),
    ("wait_seconds", D),
    ("final", B),
    ("had_capacity_retry", B),
)
