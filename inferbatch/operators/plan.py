"""Routing and planning: gateways, headers, prefix hashes, safe names and plan order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..session import lookup_table, materialize, small_side
from . import ingest
from .order import number_rows

def route(df: DataFrame, gateways: DataFrame, method: str = "model", use_global: bool = False) -> DataFrame:
    """Add `route_key` and `gateway` (NULL when the key has none).

    `gateways` has route_key plus configuration columns, one row per key: a repeated key fails the
    query instead of doubling requests. In global mode its single row serves every model, and any
    other number of rows is refused. `method="tenant"` looks up `tenant/model` and needs a
    tenant_id column.
    """
    config = [c for c in gateways.columns if c != "route_key"]
    keyed = df.withColumn("route_key", S.route_key(method, "tenant_id" if method == "tenant" else F.lit(""), "model"))
    if use_global:
        rows = gateways.select(*config).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"global mode needs exactly one gateway, found {'none' if not rows else 'several'}")
        only = rows[0]
        return keyed.withColumn("gateway", F.struct(*[F.lit(only[c]).alias(c) for c in config]))
    repeated = F.raise_error(F.concat(F.lit("repeated route key "), F.col("route_key")))
    gateway = F.when(F.count(F.lit(1)) > 1, repeated).otherwise(F.any_value(F.struct(*config)))
    packed = gateways.groupBy("route_key").agg(gateway.alias("gateway"))
    return keyed.join(small_side(packed), "route_key", "left")


def reject_unrouted(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into routed requests and `model_not_found` error results."""
    known = routed.filter("gateway IS NOT NULL")
    message = F.concat(F.lit('model "'), F.col("model"), F.lit('" is not configured in any gateway'))
    rejected = routed.filter("gateway IS NULL").select(
        "job_id",
        S.request_id("job_id", "line_no").alias("request_id"),
        "custom_id",
        "line_no",
        "route_key",
        F.struct(F.lit("model_not_found").alias("code"), message.alias("message")).alias("error"),
    )
    return known, rejected


def distinct_gateways(gateways: DataFrame, key: str = "route_key") -> DataFrame:
    """One row per distinct configuration with the number of models that share it."""
    config = [c for c in gateways.columns if c != key]
    return gateways.groupBy(*config).agg(F.count(F.lit(1)).alias("models"))


def validate_pools(models: DataFrame, prefix: str, consumer: str) -> DataFrame:
    """Queue names per pool, and an error where more than one model maps to it.

    Needs model and pool; explicit request_queue / result_queue columns win over the default
    names. The result queue always ends with the consumer, so replicas do not share it.
    """
    have = set(models.columns)
    blank = F.lit(None).cast("string")
    request = F.max(F.nullif(F.col("request_queue"), F.lit(""))) if "request_queue" in have else F.max(blank)
    result = F.max(F.nullif(F.col("result_queue"), F.lit(""))) if "result_queue" in have else F.max(blank)
    grouped = models.groupBy("pool").agg(
        F.count(F.lit(1)).alias("models"), F.min("model").alias("__a"), F.max("model").alias("__b"), request.alias("__q"), result.alias("__r")
    )
    clash = F.concat(
        F.lit('models "'), F.col("__a"), F.lit('" and "'), F.col("__b"), F.lit('" both map to pool "'), F.col("pool"),
        F.lit('": each pool must have a single consumer'),
    )
    return grouped.select(
        "pool",
        "models",
        F.when(F.col("models") > 1, clash).alias("error"),
        F.coalesce("__q", F.concat(F.lit(f"{prefix}requests:"), "pool")).alias("request_queue"),
        F.concat(F.coalesce("__r", F.concat(F.lit(f"{prefix}results:"), "pool")), F.lit(f":{consumer}")).alias(
            "result_queue"
        ),
    )


def job_headers(jobs: DataFrame) -> DataFrame:
    """Add the pass-through headers and the trace context kept in a job's tags."""

    def with_prefix(prefix: str):
        kept = F.map_filter("tags", lambda k, _: k.startswith(prefix))
        return F.transform_keys(kept, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))

    return jobs.withColumns(
        {"headers": with_prefix(V.TAG_HEADER_PREFIX), "trace_context": with_prefix(V.TAG_TRACE_PREFIX)}
    )


def build_headers(df: DataFrame, now: int, fairness: bool = False) -> DataFrame:
    """Complete `headers`: milliseconds to the deadline, objective, and fairness id.

    Needs headers, priority (deadline in microseconds, 0 for none), objective and tenant_id.
    Later maps win; the fairness id is put first so that a header of the caller is kept.
    """
    left = F.floor(F.col("priority") / 1000).cast("long") - F.lit(now * 1000).cast("long")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def entry(name: str, value, present):
        return F.when(present, F.create_map(F.lit(name), value)).otherwise(none)

    objective = F.coalesce("objective", F.lit(""))
    tenant = F.coalesce("tenant_id", F.lit(""))
    fair = entry(V.HEADER_FAIRNESS_ID, tenant, tenant != "") if fairness else none
    slo = entry(V.HEADER_SLO_TTFT_MS, left.cast("string"), (F.coalesce("priority", F.lit(0)) > 0) & (left >= 0))
    return df.withColumn(
        "headers",
        F.map_concat(fair, F.coalesce("headers", none), slo, entry(V.HEADER_OBJECTIVE, objective, objective != "")),
    )


PROMPT_KEY = "prompt_key"


def prompt_key(prompt: str = "system_prompt") -> Column:
    """Digest of a prompt, NULL when there is none."""
    return F.when(F.coalesce(F.col(prompt), F.lit("")) != "", F.sha2(prompt, 256))


def prompt_hashes(keyed: DataFrame, prompt: str = "system_prompt") -> DataFrame:
    """(prompt_key, __h): the prefix hash of every distinct prompt, written once."""
    distinct = keyed.filter(F.col(PROMPT_KEY).isNotNull()).groupBy(PROMPT_KEY).agg(F.any_value(prompt).alias("__p"))
    return lookup_table(distinct.select(PROMPT_KEY, S.fnv1a32("__p").alias("__h")), "prompts")


def with_prefix_hash(df: DataFrame, prompt: str = "system_prompt") -> DataFrame:
    """Add `prefix_hash` of the system prompt.

    Prompts repeat by design, so the byte-wise hash runs once per distinct prompt and is
    joined back. Rows meet it through a digest of their prompt: prompts can be long, and the
    rows then travel without them when the caller drops the column. A NULL or empty prompt
    has the no-prompt value.
    """
    keyed = df if PROMPT_KEY in df.columns else df.withColumn(PROMPT_KEY, prompt_key(prompt))
    joined = keyed.join(prompt_hashes(keyed, prompt), PROMPT_KEY, "left")
    return joined.select(*df.columns, F.coalesce("__h", F.lit(V.NO_PREFIX_HASH).cast("long")).alias("prefix_hash"))


def safe_names(lines: DataFrame) -> DataFrame:
    """One path-safe name per (job, model); clashes get `_2`, `_3` in order of first use.

    Lines are aggregated away first, and clashes are numbered in balanced ranges.
    """
    models = lines.groupBy("job_id", "model").agg(F.min("line_no").alias("first_line"))
    based = materialize(models.withColumn("base", S.safe_model_base("model")), "models")
    numbered = number_rows(based, ["job_id", "base"], ["first_line", "model"], "nth")
    suffix = F.when(F.col("nth") == 1, F.lit("")).otherwise(F.concat(F.lit("_"), F.col("nth").cast("string")))
    return numbered.select("job_id", "model", "first_line", F.concat("base", suffix).alias("safe_name"))


def plan_position(df: DataFrame, **cuts) -> DataFrame:
    """Add `position` within (job, model): by prefix hash, no-prompt rows last, then line."""
    return number_rows(df, ["job_id", "model"], ["prefix_hash", "line_no"], "position", **cuts)


def dispatch_order(df: DataFrame, tie: list[str], **cuts) -> DataFrame:
    """Add the global dispatch `position`: earliest deadline first, equal prompts together."""
    return number_rows(df, [], ["deadline", "prefix_hash", *tie], "position", **cuts)


def prefix_groups(df: DataFrame) -> DataFrame:
    """Per model: distinct prompts, requests, largest group, share of requests in shared groups."""
    sizes = df.groupBy("model", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("model").agg(
        F.count(F.lit(1)).alias("prompts"),
        F.sum("n").alias("requests"),
        F.max("n").alias("largest"),
        (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("shared"),
    )


def count_disorder(plan: DataFrame) -> DataFrame:
    """Per model: entries, line sum, and neighbouring rows of a written plan that are out of order.

    Rows of one file are compared with their predecessor, so it reads each file in its order.
    """
    placed = plan.withColumns({"__file": F.input_file_name(), "__seq": F.monotonically_increasing_id()})
    prev = F.lag(F.struct("prefix_hash", "line_no")).over(W.partitionBy("__file", "job_id", "model").orderBy("__seq"))
    wrong = prev.isNotNull() & (prev > F.struct("prefix_hash", "line_no"))
    return (
        placed.withColumn("__wrong", wrong)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.sum("line_no").alias("line_sum"),
            F.count_if("__wrong").alias("out_of_order"),
        )
    )


@dataclass(frozen=True)
class Plan:
    """A plan's entries without bodies, the rejected requests, and the lines that hold the bodies.

    `requests` are the routed lines with their text, prefix hash and request id: small tables are
    joined to the stored lines, so the text itself is not shuffled. `early` are requests rejected
    ahead of the first bad line of a file that fails, and `bad_files` those files.
    """

    entries: DataFrame
    rejected: DataFrame
    lines: DataFrame
    requests: DataFrame
    early: DataFrame
    bad_files: DataFrame

    def with_bodies(self) -> DataFrame:
        """Entries with the text of their line (`value`), joined by file and line."""
        bodies = self.lines.select("file_id", "line_no", "value")
        return self.entries.join(bodies, ["file_id", "line_no"])


def build_plan(
    lines: DataFrame,
    gateways: DataFrame,
    method: str = "model",
    use_global: bool = False,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> Plan:
    """Plan raw lines (job_id, file_id, line_no, value, byte_len and, if known, byte_offset).

    Files with a bad or repeated line are left out whole. Rejected lines still advance the
    byte offset of the lines behind them.

    Decoding the JSON is the dear step, so its columns are written once next to the text, by
    `store` where the caller wants its own layout. Every later step reads a few narrow columns
    of that table; request bodies are moved only when the plan is executed.
    """
    decoded = ingest.decode_requests(lines).withColumn(PROMPT_KEY, prompt_key())
    keep = store or (lambda df: materialize(df, "decoded"))
    stored = keep(ingest.validate_requests(decoded))
    narrow = stored.drop("value", "system_prompt")
    bad_lines = ingest.check_lines(narrow, validated=True).filter("error_rule IS NOT NULL")
    bad_files = lookup_table(bad_lines.groupBy("file_id").agg(F.min("line_no").alias("bad_line")), "bad-files")
    failed = bad_files.select("file_id")
    hashes = prompt_hashes(stored.select(PROMPT_KEY, "system_prompt"))

    def hashed(routed: DataFrame) -> DataFrame:
        joined = routed.join(hashes, PROMPT_KEY, "left")
        return joined.withColumn("prefix_hash", F.coalesce("__h", F.lit(V.NO_PREFIX_HASH).cast("long"))).drop("__h")

    good = narrow.join(failed, "file_id", "left_anti")
    placed = good if "byte_offset" in lines.columns else ingest.with_offsets(good)
    known, rejected = reject_unrouted(route(placed, gateways, method, use_global))
    ahead = narrow.join(bad_files, "file_id").filter(F.col("line_no") < F.col("bad_line")).drop("bad_line")
    _, early = reject_unrouted(route(ahead, gateways, method, use_global))
    texts = stored.drop("system_prompt").join(failed, "file_id", "left_anti")
    bodies, _ = reject_unrouted(route(texts, gateways, method, use_global))
    names = lookup_table(safe_names(known).select("job_id", "model", "safe_name"), "names")
    entries = plan_position(hashed(known)).join(names, ["job_id", "model"], "left")
    chosen = entries.select(
        "job_id",
        "file_id",
        "line_no",
        "custom_id",
        "url",
        "model",
        "safe_name",
        "route_key",
        "prefix_hash",
        "byte_offset",
        F.col("byte_len").cast("int").alias("byte_len"),
        "position",
    )
    requests = hashed(bodies).withColumn("request_id", S.request_id("job_id", "line_no"))
    return Plan(materialize(chosen, "plan"), rejected, stored, requests, early, bad_files)
