"""Request lines: decoding, validation, duplicates, offsets and per-file verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from ..session import lookup_table
from .order import running_sums

FILE = "file_id"
LINE = "line_no"


def _kind(variant: Column, path: str) -> Column:
    """Type name at a path of a variant; NULL when the path is absent."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def _is(kind: Column, *names: str) -> Column:
    """The type is one of `names`, JSON null, or the value is absent."""
    return F.coalesce(kind.isin("VOID", *names), F.lit(True))


def decode_requests(df: DataFrame, value: str = "value") -> DataFrame:
    """Add `custom_id, method, url, model, stream, system_prompt, decoded` from the JSON text.

    The decoder is strict like a typed one: `decoded` is false when the text is not JSON, is
    not an object, or a field has another type (for example a list as message content).
    JSON null counts as absent. Keys are matched by exact case, and an object that repeats
    a key is reported as undecodable.
    """
    v = F.col("__v")
    parsed = df.withColumn("__v", F.try_parse_json(value))
    # `$` itself has no path form that a variant accepts for its own type, so take it whole.
    top = F.schema_of_variant(v)
    strings = [_is(_kind(v, p), "STRING") for p in ("$.custom_id", "$.method", "$.url", "$.body.model")]
    messages = F.try_variant_get(v, "$.body.messages", "array<variant>")

    def message_ok(m: Column) -> Column:
        whole = F.schema_of_variant(m)
        shape = whole.startswith("OBJECT") | (whole == "VOID")
        return shape & _is(_kind(m, "$.role"), "STRING") & _is(_kind(m, "$.content"), "STRING")

    body_kind = _kind(v, "$.body")
    list_kind = _kind(v, "$.body.messages")
    ok = S.all_of(
        [
            v.isNotNull(),
            F.coalesce(top.startswith("OBJECT") | (top == "VOID"), F.lit(False)),
            *strings,
            _is(_kind(v, "$.body.stream"), "BOOLEAN"),
            F.coalesce(body_kind.startswith("OBJECT") | (body_kind == "VOID"), F.lit(True)),
            F.coalesce(list_kind.startswith("ARRAY") | (list_kind == "VOID"), F.lit(True)),
            F.coalesce(F.forall(messages, message_ok), F.lit(True)),
        ]
    )

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))

    prompts = F.transform(
        F.filter(
            messages,
            lambda m: (F.try_variant_get(m, "$.role", "string") == "system")
            & (F.coalesce(F.try_variant_get(m, "$.content", "string"), F.lit("")) != ""),
        ),
        lambda m: F.try_variant_get(m, "$.content", "string"),
    )
    return parsed.select(
        *df.columns,
        text("$.custom_id").alias("custom_id"),
        text("$.method").alias("method"),
        text("$.url").alias("url"),
        text("$.body.model").alias("model"),
        F.coalesce(F.try_variant_get(v, "$.body.stream", "boolean"), F.lit(False)).alias("stream"),
        F.get(prompts, F.lit(0)).alias("system_prompt"),
        F.coalesce(ok, F.lit(False)).alias("decoded"),
    )


# Validation rules in the order they are tried; the first one that fails names the line's error.
def _rules() -> list[tuple[str, Column, Column]]:
    c = F.col
    url = c("url")
    return [
        ("decode", ~c("decoded"), F.lit("request line is not a valid JSON request")),
        ("custom_id", c("custom_id") == "", F.lit("custom_id is required")),
        ("method_missing", c("method") == "", F.lit("method is required")),
        ("method", c("method") != "POST", F.concat(F.lit("invalid method: "), c("method"))),
        ("url_missing", url == "", F.lit("url is required")),
        (
            "url_relative",
            ~url.startswith("/") | url.startswith("//") | url.contains("://"),
            F.concat(F.lit("url must be a relative path: "), url),
        ),
        ("endpoint", ~url.isin(*V.ENDPOINTS), F.concat(F.lit("invalid endpoint: "), url)),
        ("model", c("model") == "", F.lit("model id is empty")),
        (
            "stream",
            c("stream"),
            F.concat(F.lit("streaming is not supported in batch requests (model: "), c("model"), F.lit(")")),
        ),
    ]


def validate_requests(df: DataFrame) -> DataFrame:
    """Add `error_rule` and `error_msg` (NULL on a good line) to decoded request lines."""
    rule, message = None, None
    for name, failed, text in _rules():
        rule = F.when(failed, F.lit(name)) if rule is None else rule.when(failed, F.lit(name))
        message = F.when(failed, text) if message is None else message.when(failed, text)
    return df.withColumns({"error_rule": rule, "error_msg": message})


def repeated_ids(df: DataFrame) -> DataFrame:
    """Custom ids used more than once in a file, with the first line and the number of uses."""
    return (
        df.groupBy(FILE, "custom_id")
        .agg(F.min(LINE).alias("first_line"), F.count(F.lit(1)).alias("uses"))
        .filter("uses > 1")
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Custom ids used more than once, exact text, per file."""
    return repeated_ids(df).select(FILE, "custom_id", "uses")


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Add `is_repeat`: the custom id already occurred on an earlier line of the file.

    Only ids that repeat are joined back, as a checked broadcast where they are few. The
    aggregation combines before its shuffle, so one id used by a third of all lines is
    harmless.
    """
    first = lookup_table(repeated_ids(df).select(FILE, "custom_id", "first_line"), "repeated")
    joined = df.join(first, [FILE, "custom_id"], "left")
    return joined.select(*df.columns, F.coalesce(F.col(LINE) > F.col("first_line"), F.lit(False)).alias("is_repeat"))


def check_lines(df: DataFrame, validated: bool = False) -> DataFrame:
    """Validation and duplicate check together: `error_rule`, `error_msg` per line.

    A repeat only counts against lines that pass the other rules, and only such lines are
    remembered as first uses. `validated` says the rules have been applied already.
    """
    checked = df if validated else validate_requests(df)
    kept = [c for c in checked.columns if c not in ("error_rule", "error_msg")]
    valid = checked.filter("error_rule IS NULL")
    first = lookup_table(repeated_ids(valid).select(FILE, "custom_id", "first_line"), "repeated")
    joined = checked.join(first, [FILE, "custom_id"], "left")
    repeat = F.col("error_rule").isNull() & F.coalesce(F.col(LINE) > F.col("first_line"), F.lit(False))
    message = F.concat(
        F.lit("line "), F.col(LINE).cast("string"), F.lit(': duplicate custom_id "'), F.col("custom_id"), F.lit('"')
    )
    return joined.select(
        *kept,
        F.when(repeat, F.lit("duplicate")).otherwise(F.col("error_rule")).alias("error_rule"),
        F.when(repeat, message).otherwise(F.col("error_msg")).alias("error_msg"),
    )


def file_verdict(checked: DataFrame) -> DataFrame:
    """One row per file: its first bad line fails the whole file."""
    bad = F.when(F.col("error_rule").isNotNull(), F.struct(LINE, "error_rule", "error_msg"))
    return (
        checked.groupBy(FILE)
        .agg(F.count(F.lit(1)).alias("lines"), F.min(bad).alias("bad"))
        .select(
            FILE,
            "lines",
            F.col("bad").isNull().alias("ok"),
            F.col(f"bad.{LINE}").alias("bad_line"),
            F.col("bad.error_rule").alias("error_rule"),
            F.when(
                F.col("bad.error_rule") == "duplicate", F.col("bad.error_msg")
            )
            .otherwise(
                F.concat(
                    F.lit("validate request at line "),
                    F.col(f"bad.{LINE}").cast("string"),
                    F.lit(": "),
                    F.col("bad.error_msg"),
                )
            )
            .alias("error_msg"),
        )
    )


def with_offsets(df: DataFrame, length: str = "byte_len", **cuts) -> DataFrame:
    """Add `byte_offset`: the bytes of all earlier lines of the file, rejected ones included."""
    return running_sums(df, [FILE], [LINE], {"byte_offset": F.col(length).cast("long")}, **cuts)


def line_length(value="value") -> Column:
    """Bytes of a line with its newline; an unterminated last line counts as terminated."""
    return F.octet_length(S.as_col(value)) + F.lit(1)


def file_stats(df: DataFrame, max_bytes: int = V.MAX_FILE_BYTES, max_lines: int = V.MAX_FILE_LINES) -> DataFrame:
    """Lines, bytes and the limit a file breaks; a limit of 0 is off.

    The number of models is counted in two steps so that no task sees all lines of a file.
    """
    per_model = df.groupBy(FILE, "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("byte_len").cast("long")).alias("b")
    )
    stats = per_model.groupBy(FILE).agg(
        F.sum("n").alias("lines"), F.sum("b").alias("bytes"), F.count(F.when(F.col("model") != "", 1)).alias("models")
    )
    breach = F
    if max_bytes > 0:
        breach = breach.when(F.col("bytes") > max_bytes, F.lit("bytes"))
    if max_lines > 0:
        breach = breach.when(F.col("lines") > max_lines, F.lit("lines"))
    return stats.withColumn("breach", F.lit(None).cast("string") if breach is F else breach)


def drop_oversized(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Lines of files that keep within their limits."""
    return df.join(stats.filter("breach IS NOT NULL").select(FILE), FILE, "left_anti")
