"""Scalar helpers on columns: ids, durations, hashes, error mapping, formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as a CASE expression."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


# --- hashes and ids ---------------------------------------------------------------


def fnv1a32(text) -> Column:
    """FNV-1a over the UTF-8 bytes of a string, as an unsigned 32-bit value in a LONG.

    Byte i of the text is read out of its hex form, so the whole fold is one expression.
    Each step is masked to 32 bits before the multiplication, whose result stays below
    2**57 and cannot overflow under ANSI arithmetic.
    """
    hexed = F.hex(F.encode(as_col(text), "UTF-8"))
    positions = F.sequence(F.lit(1), F.octet_length(as_col(text)))
    folded = F.aggregate(
        positions,
        F.lit(V.FNV_OFFSET).cast("long"),
        lambda acc, i: (acc.bitwiseXOR(F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")))
        * F.lit(V.FNV_PRIME)
        % F.lit(1 << 32),
    )
    return F.when(F.octet_length(as_col(text)) == 0, F.lit(V.FNV_OFFSET).cast("long")).otherwise(folded)


def first_system_prompt(messages) -> Column:
    """Content of the first system message that is not empty, else NULL."""
    kept = F.filter(as_col(messages), lambda m: (m["role"] == "system") & (m["content"] != ""))
    return F.get(kept, F.lit(0))["content"]


def prefix_hash(messages) -> Column:
    """Hash of the first system prompt; the all-ones value when there is none."""
    prompt = first_system_prompt(messages)
    return F.when(prompt.isNull(), F.lit(V.NO_PREFIX_HASH).cast("long")).otherwise(fnv1a32(prompt))


def tenant_folder(tenant) -> Column:
    """Storage folder of a tenant; an empty tenant is an error."""
    t = as_col(tenant)
    return F.when(
        F.coalesce(t, F.lit("")) == "", F.raise_error(F.lit("tenantID cannot be empty")).cast("string")
    ).otherwise(F.concat(F.lit("t-"), F.substring(F.sha2(t, 256), 1, 61)))


def storage_name(file_id, filename) -> Column:
    """File id plus the extension of the original name, `.jsonl` when it has none."""
    ext = F.regexp_extract(as_col(filename), r"(\.[^./]*)$", 1)
    return F.concat(as_col(file_id), F.when(ext == "", F.lit(".jsonl")).otherwise(ext))


def output_name(job_id) -> Column:
    return F.concat(F.lit("batch_output_"), as_col(job_id), F.lit(".jsonl"))


def error_name(job_id) -> Column:
    return F.concat(F.lit("batch_error_"), as_col(job_id), F.lit(".jsonl"))


def make_id(prefix: str, *parts) -> Column:
    """`<prefix><hash>` from the given parts.

    Ids are derived, not random: a retried or recomputed task must give the same rows.
    """
    text = F.concat_ws("\u0001", *[as_col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 32))


def request_id(job_id, line_no) -> Column:
    return make_id("batch_req_", job_id, line_no)


def file_id(*parts) -> Column:
    return make_id("file_", *parts)


def batch_id(*parts) -> Column:
    return make_id("batch_", *parts)


def safe_model_base(model) -> Column:
    """Model name usable in a path: runs of other characters become one underscore."""
    base = F.regexp_replace(as_col(model), r"[^a-zA-Z0-9._-]+", "_")
    return F.when(base == "", F.lit("unknown")).otherwise(base)


def route_key(method: str, tenant, model) -> Column:
    """`tenant/model` when routing by tenant and the tenant is known, else the model."""
    if method != "tenant":
        return as_col(model)
    t = as_col(tenant)
    return F.when(F.coalesce(t, F.lit("")) != "", F.concat(t, F.lit("/"), as_col(model))).otherwise(as_col(model))


# --- durations and deadlines ------------------------------------------------------

# Duration units in seconds.
UNIT_SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ns": 1e-9}
_TERM = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h)"


def duration_seconds(text) -> Column:
    """Seconds in a duration such as `1h30m`, `-1.5h` or `250ms`; NULL when malformed."""
    t = as_col(text)
    terms = F.regexp_extract_all(t, F.lit(f"({_TERM})"), 1)

    def seconds(term: Column) -> Column:
        number = F.regexp_extract(term, r"^([0-9.]+)", 1).cast("double")
        return number * lookup(F.regexp_extract(term, r"([^0-9.]+)$", 1), UNIT_SECONDS)

    total = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + seconds(term))
    sign = F.when(t.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(t.rlike(r"^[+-]?0$"), F.lit(0.0))
        .when(t.rlike(f"^[+-]?(?:{_TERM})+$"), sign * total)
        .otherwise(F.lit(None).cast("double"))
    )


def deadline_micros(created_at, window) -> Column:
    """Deadline in microseconds; 0 when the window or the creation time is missing."""
    created = as_col(created_at)
    missing = (F.coalesce(as_col(window), F.lit("")) == "") | (F.coalesce(created, F.lit(0)) <= 0)
    micros = created * F.lit(1000000) + F.round(duration_seconds(window) * 1e6).cast("long")
    return F.when(missing, F.lit(0).cast("long")).otherwise(micros)


def format_duration(seconds) -> Column:
    """`45s`, `8m`, `2h` or `1h 15m`."""
    s = as_col(seconds).cast("long")
    minutes = F.floor(s / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60

    def text(c):
        return c.cast("string")

    return (
        F.when(s < 60, F.concat(text(s), F.lit("s")))
        .when(minutes < 60, F.concat(text(minutes), F.lit("m")))
        .when(rest == 0, F.concat(text(hours), F.lit("h")))
        .otherwise(F.concat(text(hours), F.lit("h "), text(rest), F.lit("m")))
    )


# --- error mapping ----------------------------------------------------------------


def error_category(status) -> Column:
    s = as_col(status)
    return (
        F.when(s == 400, "INVALID_REQ")
        .when(s.isin(401, 403), "AUTH_ERROR")
        .when(s == 429, "RATE_LIMIT")
        .when(s >= 500, "SERVER_ERROR")
        .otherwise("UNKNOWN")
    )


def error_type(category) -> Column:
    return lookup(as_col(category), V.CATEGORY_TYPE, V.CATEGORY_TYPE_DEFAULT)


def api_error_type(status) -> Column:
    s = as_col(status)
    known = lookup(s, V.API_ERROR_TYPE)
    return F.coalesce(known, F.when(s >= 500, F.lit("server_error")).otherwise(F.lit("api_error")))


def is_retryable(status, dropped_reason=None) -> Column:
    """Network errors (no status), 429 and 5xx; a drop for an expired TTL is final."""
    s = F.coalesce(as_col(status).cast("int"), F.lit(0))
    reason = F.lit("") if dropped_reason is None else F.coalesce(as_col(dropped_reason), F.lit(""))
    return F.when(s <= 0, True).when(s.isin(429, 503), reason != V.DROPPED_TTL_EXPIRED).otherwise(s >= 500)


def is_capacity_signal(status) -> Column:
    s = F.coalesce(as_col(status).cast("int"), F.lit(0))
    return (s == 429) | (s >= 500)


def parse_error_body(status, body) -> Column:
    """`HTTP <code>: <message>`, the message being error.message or the raw body."""
    message = F.get_json_object(as_col(body), "$.error.message")
    text = F.when(F.coalesce(message, F.lit("")) != "", message).otherwise(as_col(body))
    return F.concat(F.lit("HTTP "), as_col(status).cast("string"), F.lit(": "), text)


def batch_error_message(code) -> Column:
    return lookup(as_col(code), V.BATCH_ERROR_MESSAGE, V.BATCH_ERROR_MESSAGE_DEFAULT)


def usage(body) -> Column:
    """Prompt, completion and total tokens of a response body, as doubles.

    A field that is absent or not a JSON number is NULL: the reader does not turn a
    quoted number into a double.
    """
    fields = "prompt_tokens DOUBLE, completion_tokens DOUBLE, total_tokens DOUBLE"
    return F.from_json(as_col(body), f"usage STRUCT<{fields}>")["usage"]


# --- numbers ----------------------------------------------------------------------


def size_bucket(lines) -> Column:
    n = as_col(lines)
    expr = F
    for bound in (100, 1000, 10000, 30000):
        expr = expr.when(n < bound, F.lit(str(bound)))
    return expr.otherwise(F.lit("large"))


def interpolate_decile(deciles, percent: int) -> Column:
    """Percentile read from the 11 decile values p0..p100, linear in between."""
    arr = as_col(deciles)
    lower = min(percent // 10, 9)
    fraction = (percent - lower * 10) / 10
    lo, hi = F.get(arr, F.lit(lower)), F.get(arr, F.lit(lower + 1))
    return F.when(F.coalesce(F.size(arr), F.lit(0)) < 11, F.lit(0.0)).otherwise(lo + F.lit(fraction) * (hi - lo))


def phase_name(stem) -> Column:
    """`burst` of `burst-1`; the whole text when there is no dash."""
    s = as_col(stem)
    return F.when(s.contains("-"), F.regexp_extract(s, r"^(.*)-[^-]*$", 1)).otherwise(s)


def phase_cycle(stem) -> Column:
    """`1` of `burst-1`, 0 when the last part is not a number."""
    digits = F.regexp_extract(as_col(stem), r"-([0-9]+)$", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("long")).cast("long")


def exponential_bounds(start: float, factor: float, count: int) -> list[float]:
    """Upper bounds of an exponential histogram, without +Inf."""
    return [start * factor**i for i in range(count)]


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
