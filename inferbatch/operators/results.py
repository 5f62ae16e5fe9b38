"""From inference outcomes to result rows, counts, usage and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V


def _response(status, request_id, body) -> Column:
    return F.struct(
        S.as_col(status).cast("int").alias("status_code"), S.as_col(request_id).alias("request_id"), body.alias("body")
    )


def _error(code, message) -> Column:
    return F.struct(S.as_col(code).alias("code"), S.as_col(message).alias("message"))


def is_json_object(text) -> Column:
    """The text is one JSON object (or JSON null, which decodes to an empty one)."""
    kind = F.schema_of_variant(F.try_parse_json(S.as_col(text)))
    return F.coalesce(kind.rlike("^(OBJECT|VOID)"), F.lit(False))


def _wrapped(body, kind: Column | None = None) -> Column:
    fields = [F.col(body).alias("message")] + ([kind.alias("type")] if kind is not None else [])
    return F.to_json(F.struct(F.struct(*fields).alias("error")))


def to_results(outcomes: DataFrame) -> DataFrame:
    """Result rows of direct calls: `response` or `error`, by the first case that applies.

    No answer at all is SERVER_ERROR; a failure without HTTP status keeps its category; a
    drop for an expired TTL is `batch_expired`; any other HTTP failure becomes a response
    whose body is the server's JSON or a wrapped text; a 200 needs a JSON object as body.
    """
    c = F.col
    status = c("__status")
    empty = F.coalesce(c("body"), F.lit("")) == ""
    # Steps of their own, not written out in every place: one long expression makes a method that stays interpreted.
    decoded = outcomes.withColumns(
        {"__json": is_json_object("body"), "__status": F.coalesce(c("status_code").cast("int"), F.lit(0))}
    ).withColumn("__category", F.coalesce(c("error_category"), S.error_category(status)))
    no_answer = (status <= 0) & c("error_category").isNull()
    transport = (status <= 0) & c("error_category").isNotNull()
    dropped = (status != 200) & (F.coalesce(c("dropped_reason"), F.lit("")) == V.DROPPED_TTL_EXPIRED)
    failed_http = status != 200
    unparsable = ~empty & ~c("__json")
    cases = [
        (no_answer, F.lit("SERVER_ERROR"), F.lit("inference returned no response")),
        (transport, c("error_category"), c("error_message")),
        (dropped, F.lit("batch_expired"), F.lit(V.BATCH_ERROR_MESSAGE["batch_expired"])),
        (~failed_http & unparsable, F.lit("PARSE_ERROR"), F.lit("response body could not be parsed")),
    ]
    http_body = (
        F.when(empty, F.lit("{}")).when(c("__json"), c("body")).otherwise(_wrapped("body", S.error_type("__category")))
    )
    body = F.when(failed_http, http_body).when(~empty, c("body"))
    # Only a call that succeeded in the end tells of earlier retries; a failed one speaks for itself.
    retried = F.coalesce("had_capacity_retry", F.lit(False)) if "had_capacity_retry" in outcomes.columns else F.lit(False)
    return _finish(decoded, cases, body, retried & (status == 200))


def to_async_results(messages: DataFrame) -> DataFrame:
    """Result rows of queue messages (payload, status_code, error_code, error_message)."""
    c = F.col
    code = F.coalesce(c("error_code"), F.lit(""))
    text = F.coalesce(c("error_message"), F.lit(""))
    raw_status = F.coalesce(c("status_code").cast("int"), F.lit(0))
    status = c("__status")
    good = status.between(200, 299)
    empty = F.coalesce(c("payload"), F.lit("")) == ""
    decoded = messages.withColumns(
        {
            "__json": is_json_object("payload"),
            "__status": F.when(raw_status == 0, F.lit(200)).otherwise(raw_status),
        }
    )
    failed = (raw_status == 0) & ((code != "") | (text != ""))
    cases = [
        (
            failed,
            F.when(code == "", F.lit("server_error")).otherwise(code),
            F.when(text == "", F.lit("async request failed")).otherwise(text),
        ),
        (empty & good, F.lit("server_error"), F.lit("async response has no body")),
        (~empty & ~c("__json") & good, F.lit("parse_error"), F.lit("response body could not be parsed")),
    ]
    body = F.when(empty, F.lit("{}")).when(c("__json"), c("payload")).otherwise(_wrapped("payload"))
    return _finish(decoded, cases, body)


def _first_case(cases: list[tuple[Column, Column, Column]], part: int) -> Column:
    expr = F
    for case in cases:
        expr = expr.when(case[0], case[part])
    return expr


def _finish(
    df: DataFrame, cases: list[tuple[Column, Column, Column]], body: Column, retried: Column | None = None
) -> DataFrame:
    """The first case that holds gives the error; without one the row has a response.

    Code, message and body are computed as flat columns first and packed afterwards, so a
    reader of one field does not drag the expressions of all others along.
    """
    kept = [c for c in ("job_id", "request_id", "custom_id", "route_key", "endpoint", "ts") if c in df.columns]
    flag = F.lit(False) if retried is None else retried
    numbered = [(held, F.lit(i), F.lit(i)) for i, (held, _, _) in enumerate(cases)]
    by_number = [(F.col("__case") == i, code, text) for i, (_, code, text) in enumerate(cases)]
    staged = df.withColumn("__case", _first_case(numbered, 1)).withColumns(
        {"__code": _first_case(by_number, 1), "__text": _first_case(by_number, 2), "__body": body}
    )
    failed = F.col("__code").isNotNull()
    return staged.select(
        *kept,
        F.when(~failed, _response("__status", "request_id", F.col("__body"))).alias("response"),
        F.when(failed, _error("__code", "__text")).alias("error"),
        flag.alias("had_capacity_retry"),
    )


def parse_error_results(df: DataFrame) -> DataFrame:
    """Requests whose stored line no longer parses: results without a call.

    The custom id cannot be read, so the request id stands in for it.
    """
    message = F.concat(F.lit("failed to parse request line: "), F.col("parse_error"))
    return df.select(
        "job_id",
        "request_id",
        F.col("request_id").alias("custom_id"),
        "route_key",
        F.lit(None).cast("struct<status_code:int,request_id:string,body:string>").alias("response"),
        _error(F.lit("parse_error"), message).alias("error"),
        F.lit(False).alias("had_capacity_retry"),
    )


def first_results(results: DataFrame, arrival: list[str]) -> DataFrame:
    """The first delivered result per request id.

    A minimum over (arrival, row) combines before the shuffle, so an id delivered very many
    times does not fill a task.
    """
    rest = [c for c in results.columns if c != "request_id"]
    packed = F.struct(*[F.col(c).alias(f"__a{i}") for i, c in enumerate(arrival)], *rest)
    first = results.groupBy("request_id").agg(F.min_by(packed, F.struct(*arrival)).alias("__first"))
    return first.select("request_id", *[F.col("__first")[c].alias(c) for c in rest])


def resolve_results(requests: DataFrame, results: DataFrame, arrival: list[str]) -> DataFrame:
    """Results joined to the pending requests they answer; foreign and repeated ones drop out."""
    one = first_results(results, arrival)
    return requests.join(one, "request_id")


def drain_unresolved(requests: DataFrame, results: DataFrame, code: str, message: str | None = None) -> DataFrame:
    """Error rows for requests without a result, so that output + error = total."""
    open_requests = requests.join(results.select("request_id"), "request_id", "left_anti")
    return drained(open_requests, F.lit(code), F.lit(message) if message else None)


def drained(requests: DataFrame, code: Column, message: Column | None = None) -> DataFrame:
    text = S.batch_error_message(code) if message is None else message
    kept = [c for c in ("job_id", "request_id", "custom_id", "route_key") if c in requests.columns]
    return requests.select(*kept, _error(code, text).alias("error"))


def drain(requests: DataFrame, cause, at, dispatched_at: str = "dispatched_at") -> DataFrame:
    """Error rows for requests not dispatched when their job stopped.

    Reaching the deadline gives `batch_expired`; every other cause `batch_cancelled`.
    """
    waiting = F.col(dispatched_at).isNull() | (F.col(dispatched_at) > S.as_col(at))
    code = F.when(S.as_col(cause) == "deadline", F.lit("batch_expired")).otherwise(F.lit("batch_cancelled"))
    return drained(requests.filter(waiting), code)


def all_errors(rejected: DataFrame, executed: DataFrame) -> DataFrame:
    """Errors found at ingest together with those of execution; nothing is merged away."""
    cols = ["job_id", "request_id", "custom_id", "route_key", "error"]
    return rejected.select(cols).unionByName(executed.filter("error IS NOT NULL").select(cols))


def is_success() -> Column:
    """HTTP 200 without error; a row with an error has no response. Never NULL."""
    return F.col("response.status_code").eqNullSafe(F.lit(200))


def failure_code() -> Column:
    """`error.code`, else `http_<status>`, else `unknown`; NULL for a success."""
    status = F.col("response.status_code")
    return F.when(
        ~is_success(),
        F.when(F.col("error").isNotNull(), F.col("error.code"))
        .when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string")))
        .otherwise(F.lit("unknown")),
    )


def request_counts(results: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """total, completed and failed per job; requests rejected at ingest count as failed."""
    rows = results.select("job_id", is_success().cast("int").alias("ok"))
    if rejected is not None:
        rows = rows.unionByName(rejected.select("job_id", F.lit(0).alias("ok")))
    return rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("ok").cast("long").alias("completed"),
        F.count_if(F.col("ok") == 0).alias("failed"),
    )


def token_usage(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Prompt and generation tokens of successful requests, by route key.

    Rows without either number, or with a negative one, do not count; a single missing number
    is 0.
    """
    keys = by or ["route_key"]
    tokens = S.usage(F.when(is_success(), F.col("response.body")))
    used = results.select(*keys, tokens.alias("__u"))
    prompt, answer = F.col("__u.prompt_tokens"), F.col("__u.completion_tokens")
    p, a = F.coalesce(prompt, F.lit(0.0)), F.coalesce(answer, F.lit(0.0))
    counted = (prompt.isNotNull() | answer.isNotNull()) & (p >= 0) & (a >= 0)
    # Conditional sums instead of a filter: the condition is not pushed down and expanded.
    totals = used.groupBy(*keys).agg(
        F.count_if(counted).alias("requests"),
        F.sum(F.when(counted, p)).alias("prompt_tokens"),
        F.sum(F.when(counted, a)).alias("generation_tokens"),
    )
    return totals.filter("requests > 0")


def errors_by_model(results: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Failed requests per route key, other HTTP codes and ingest rejections included."""
    rows = results.select("route_key", (~is_success()).alias("__bad"))
    if rejected is not None:
        rows = rows.unionByName(rejected.select("route_key", F.lit(True).alias("__bad")))
    return rows.groupBy("route_key").agg(F.count_if("__bad").alias("errors")).filter("errors > 0")


def failure_codes(results: DataFrame) -> DataFrame:
    """Failures by code."""
    coded = results.select(failure_code().alias("code"), (~is_success()).alias("__bad"))
    # Successes form one extra group that is dropped by its count, after the aggregation.
    return coded.groupBy("code").agg(F.count_if("__bad").alias("failures")).filter("failures > 0")


def same_members(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: do both sides hold the same values, each the same number of times?"""
    signed = a.select(key, value, F.lit(1).alias("__n")).unionByName(b.select(key, value, F.lit(-1).alias("__n")))
    balance = signed.groupBy(key, value).agg(F.sum("__n").alias("__n"))
    return balance.groupBy(key).agg((F.max(F.abs("__n")) == 0).alias("same"))


def audit_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Per job: requests without a result, results without a request, requests answered twice or more.

    Output and error files together must hold each request exactly once.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    marks = requests.select("job_id", "request_id", one.alias("asked"), zero.alias("answered")).unionByName(
        results.select("job_id", "request_id", zero.alias("asked"), one.alias("answered"))
    )
    ids = marks.groupBy("job_id", "request_id").agg(F.sum("asked").alias("asked"), F.sum("answered").alias("answered"))
    return ids.groupBy("job_id").agg(
        F.count_if(F.col("asked") > 0).alias("requests"),
        F.count_if((F.col("asked") > 0) & (F.col("answered") == 0)).alias("missing"),
        F.count_if(F.col("asked") == 0).alias("foreign"),
        F.count_if(F.col("answered") > 1).alias("repeated"),
    )
