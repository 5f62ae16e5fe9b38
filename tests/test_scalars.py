"""Scalar helpers against values worked out by hand or by the standard library."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inferbatch.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def fnv(text):
    h = 2166136261
    for byte in text.encode():
        h = (h ^ byte) * 16777619 % 2**32
    return h


def test_fnv_known_values(spark):
    rows = spark.createDataFrame([("a",), ("foobar",), ("",), ("ß€😀",)], "s string").select("s", S.fnv1a32("s").alias("h")).collect()
    assert {r.s: r.h for r in rows} == {"a": 3826002220, "foobar": 3214735720, "": 2166136261, "ß€😀": fnv("ß€😀")}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=40).filter(lambda t: "\x00" not in t), min_size=1, max_size=20))
def test_fnv_property(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    assert [r.h for r in df.select("i", S.fnv1a32("s").alias("h")).orderBy("i").collect()] == [fnv(t) for t in texts]


DURATIONS = {
    "24h": 86400.0,
    "1h30m": 5400.0,
    "-1.5h": -5400.0,
    "250ms": 0.25,
    "1.5s": 1.5,
    ".5m": 30.0,
    "0": 0.0,
    "2µs": 2e-6,
    "": None,
    "1": None,
    "one day": None,
    "1d": None,
    "1h ": None,
}


def test_durations(spark):
    df = spark.createDataFrame([(k,) for k in DURATIONS], "s string")
    got = {r.s: r.v for r in df.select("s", S.duration_seconds("s").alias("v")).collect()}
    assert {k: (v if v is None else round(v, 9)) for k, v in got.items()} == DURATIONS


def test_tenant_folder(spark):
    assert one(spark, S.tenant_folder(F.lit("acme"))) == "t-" + hashlib.sha256(b"acme").hexdigest()[:61]
    with pytest.raises(Exception, match="cannot be empty"):
        one(spark, S.tenant_folder(F.lit("")))


def test_names(spark):
    names = {"x.tar.gz": ".gz", "x": ".jsonl", ".hidden": ".hidden", "a.b/c": ".jsonl", "x.": "."}
    df = spark.createDataFrame(list(names.items()), "n string, e string")
    assert all(r.got == "f" + r.e for r in df.select("e", S.storage_name(F.lit("f"), "n").alias("got")).collect())


def test_format_duration(spark):
    cases = {0: "0s", 59: "59s", 60: "1m", 3599: "59m", 3600: "1h", 4500: "1h 15m"}
    df = spark.createDataFrame([(k,) for k in cases], "s long")
    assert {r.s: r.t for r in df.select("s", S.format_duration("s").alias("t")).collect()} == cases


def test_error_mapping(spark):
    df = spark.createDataFrame([(s,) for s in (0, 400, 401, 403, 404, 422, 429, 500, 503, 599)], "s int")
    rows = df.select(
        "s",
        S.error_category("s").alias("c"),
        S.error_type(S.error_category("s")).alias("t"),
        S.api_error_type("s").alias("a"),
        S.is_retryable("s").alias("r"),
        S.is_retryable("s", F.lit("rejected-ttl-expired")).alias("d"),
    ).collect()
    got = {r.s: (r.c, r.t, r.a, r.r, r.d) for r in rows}
    assert got[0] == ("UNKNOWN", "unknown_error", "api_error", True, True)
    assert got[403] == ("AUTH_ERROR", "authentication_error", "permission_error", False, False)
    assert got[422] == ("UNKNOWN", "unknown_error", "invalid_request_error", False, False)
    assert got[429] == ("RATE_LIMIT", "rate_limit_error", "rate_limit_error", True, False)
    assert got[503][3:] == (True, False) and got[599][3:] == (True, True)


def test_error_body(spark):
    assert one(spark, S.parse_error_body(F.lit(400), F.lit('{"error":{"message":"no"}}'))) == "HTTP 400: no"
    assert one(spark, S.parse_error_body(F.lit(502), F.lit("bad gateway"))) == "HTTP 502: bad gateway"


def test_usage_counts_only_numbers(spark):
    u = one(spark, S.usage(F.lit('{"usage":{"prompt_tokens":"7","completion_tokens":3.0}}')))
    assert (u.prompt_tokens, u.completion_tokens, u.total_tokens) == (None, 3.0, None)


def test_deciles(spark):
    values = F.array(*[F.lit(float(v)) for v in range(0, 110, 10)])
    assert one(spark, S.interpolate_decile(values, 95)) == 95.0
    assert one(spark, S.interpolate_decile(values, 100)) == 100.0
    assert one(spark, S.interpolate_decile(F.array(F.lit(1.0)), 95)) == 0.0


def test_phase_names(spark):
    df = spark.createDataFrame([("burst-1",), ("idle",), ("pre-burst-x",)], "s string")
    got = [tuple(r) for r in df.select(S.phase_name("s"), S.phase_cycle("s")).collect()]
    assert got == [("burst", 1), ("idle", 0), ("pre-burst", 0)]


def test_sql_functions_agree_with_the_columns(spark):
    from inferbatch.functions import sql

    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    codes = [(s, n, t, f) for s, n, t, f in zip((0, 400, 403, 422, 429, 500, 503), (0, 59, 99, 100, 4500, 7200, 40000), ["a", "m/x:y", "///", "é", "b.c", "A-_", "z"], ["x.tar.gz", "x", "a.b/c", "y.jsonl", ".h", "n.", ""])]
    spark.createDataFrame(codes, "s int, n long, t string, f string").createOrReplaceTempView("codes")
    got = spark.sql(
        """SELECT error_category(s), error_type(error_category(s)), api_error_type(s), is_retryable(s, ''), size_bucket(n),
                  format_duration(n), tenant_folder(t), storage_name(t, f), safe_model_name(t), batch_error_message(t) FROM codes"""
    )
    category = S.error_category("s")
    want = spark.table("codes").select(
        category,
        S.error_type(category),
        S.api_error_type("s"),
        S.is_retryable("s"),
        S.size_bucket("n"),
        S.format_duration("n"),
        S.tenant_folder("t"),
        S.storage_name("t", "f"),
        S.safe_model_base("t"),
        S.batch_error_message("t"),
    )
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
