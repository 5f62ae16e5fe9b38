"""Inference attempts, result building, files and audits."""

import json
import re
import sys
import uuid
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from inferbatch.operators import infer as run
from inferbatch.operators import plan
from inferbatch.operators import results as res
from inferbatch.plans import flow, views
from inferbatch.plans.catalog import execution as catalog
from inferbatch.schemas import JOB
from inferbatch.sources import requests as src

# The scripted client below runs in tasks, which do not know this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTCOME = "request_id string, status_code int, body string, error_category string, error_message string, dropped_reason string"
CASES = [
    # status, body, category, message, dropped -> status, body, code
    (200, '{"a":1}', None, None, None, (200, '{"a":1}', None)),
    (200, "", None, None, None, (200, None, None)),
    (200, "null", None, None, None, (200, "null", None)),
    (200, "[1]", None, None, None, (None, None, "PARSE_ERROR")),
    (200, "{", None, None, None, (None, None, "PARSE_ERROR")),
    (0, None, "SERVER_ERROR", "timeout", None, (None, None, "SERVER_ERROR")),
    (0, None, None, None, None, (None, None, "SERVER_ERROR")),
    (429, "x", "RATE_LIMIT", None, "rejected-ttl-expired", (None, None, "batch_expired")),
    (429, "x", "RATE_LIMIT", None, None, (429, '{"error":{"message":"x","type":"rate_limit_error"}}', None)),
    (500, "", "SERVER_ERROR", None, None, (500, "{}", None)),
    (404, '{"error":{}}', None, None, None, (404, '{"error":{}}', None)),
]


def outcomes(spark):
    df = spark.createDataFrame([(str(i), *c[:5]) for i, c in enumerate(CASES)], OUTCOME)
    return df.withColumns({"job_id": F.lit("j"), "custom_id": F.concat(F.lit("c"), "request_id"), "route_key": F.lit("m")})


def test_direct_results(spark):
    rows = {int(r.request_id): r for r in res.to_results(outcomes(spark)).collect()}
    for i, case in enumerate(CASES):
        r = rows[i]
        got = (r.response and r.response.status_code, r.response and r.response.body, r.error and r.error.code)
        assert got == case[5], i
        assert (r.response is None) == (r.error is not None)


def test_results_of_line_items_are_compiled(spark):
    """A method of more than 8,000 bytes of bytecode stays interpreted."""
    types = {"l_orderkey": "long", "l_partkey": "long", "l_suppkey": "long", "l_linenumber": "int", "l_quantity": "double"}
    items = spark.range(10).select(
        *[F.col("id").cast(t).alias(n) for n, t in types.items()], F.lit("A").alias("l_returnflag"), F.lit("1995-01-01").cast("timestamp").alias("l_shipdate")
    )
    text = spark._jvm.PythonSQLUtils.explainString(res.to_results(views.outcomes_of(items))._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000, sizes


def test_capacity_flag_counts_only_for_success(spark):
    df = outcomes(spark).withColumn("had_capacity_retry", F.lit(True))
    flagged = {int(r.request_id) for r in res.to_results(df).filter("had_capacity_retry").collect()}
    assert flagged == {i for i, c in enumerate(CASES) if c[0] == 200}


ASYNC = [
    (None, 0, "deadline", None, (None, None, "deadline", "async request failed")),
    (None, 0, None, "gate drop", (None, None, "server_error", "gate drop")),
    ('{"a":1}', 0, None, None, (200, '{"a":1}', None, None)),
    (None, 200, None, None, (None, None, "server_error", "async response has no body")),
    (None, 403, None, None, (403, "{}", None, None)),
    ("oops", 201, None, None, (None, None, "parse_error", "response body could not be parsed")),
    ("oops", 502, None, None, (502, '{"error":{"message":"oops"}}', None, None)),
]


def test_async_results(spark):
    schema = "request_id string, payload string, status_code int, error_code string, error_message string"
    df = spark.createDataFrame([(str(i), *c[:4]) for i, c in enumerate(ASYNC)], schema)
    for r in res.to_async_results(df).collect():
        got = (r.response and r.response.status_code, r.response and r.response.body, r.error and r.error.code, r.error and r.error.message)
        assert got == ASYNC[int(r.request_id)][4]


def test_result_lines_keep_nulls_and_go_to_the_right_file(spark, tmp_path):
    results = res.to_results(outcomes(spark))
    lines = [json.loads(r.value) for r in src.result_lines(results).collect()]
    for one in lines:
        assert list(one) == ["id", "custom_id", "response", "error"]
        assert (one["response"] is None) != (one["error"] is None)
        if one["response"]:
            assert set(one["response"]) == {"status_code", "request_id", "body"}
        else:
            assert set(one["error"]) == {"code", "message"}
    path = str(tmp_path / "out")
    src.write_results(results, path)
    assert spark.read.text(f"{path}/kind=error").count() == 5
    assert spark.read.text(f"{path}/kind=output").count() == len(CASES) - 5  # other HTTP codes included
    (f,) = src.result_files(results).collect()
    assert f.output_rows + f.error_rows == len(CASES) and f.output_file_id.startswith("file_")


def test_written_results_move_as_numbers(spark, tmp_path, monkeypatch):
    """Line items and orders are joined and placed before any text is made of them."""
    d = str(tmp_path)
    items = [(i // 3, i, 7, i % 3, 2.0, "ANR"[i % 3]) for i in range(90)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").withColumn(
        "l_shipdate", F.to_timestamp(F.lit("1995-01-01"))
    ).write.parquet(f"{d}/lineitem.parquet")
    orders = spark.range(29).select(F.col("id").alias("o_orderkey"), F.to_timestamp(F.concat(F.lit("1995-0"), (F.col("id") % 3 + 1).cast("string"), F.lit("-02"))).alias("o_orderdate"))
    orders.write.parquet(f"{d}/orders.parquet")
    got = []
    write = src.write_results

    def kept(rows, out, **how):
        got.append((rows._jdf.queryExecution().optimizedPlan().toString(), how))
        write(rows, out, **how)

    monkeypatch.setattr(src, "write_results", kept)
    written = catalog.write_results(spark, d).collect()
    ((plan, how),) = got
    assert how == {"placed": True}
    below = plan[plan.index("RebalancePartitions") :]
    assert "Join Inner" in below and "batch_req_" not in below, plan
    assert sum(r["rows"] for r in written) == 87 and {r.job_id for r in written} == {f"month_1995-0{m}" for m in (1, 2, 3)}
    assert all(r.malformed == 0 for r in written)


def test_counts_and_codes(spark):
    results = res.to_results(outcomes(spark))
    (c,) = res.request_counts(results).collect()
    assert (c.total, c.completed, c.failed) == (11, 3, 8)
    codes = {r.code: r.failures for r in res.failure_codes(results).collect()}
    assert codes == {"PARSE_ERROR": 2, "SERVER_ERROR": 2, "batch_expired": 1, "http_429": 1, "http_500": 1, "http_404": 1}
    assert res.errors_by_model(results).collect()[0].errors == 8


def test_token_usage_rules(spark):
    bodies = [
        '{"usage":{"prompt_tokens":5,"completion_tokens":2}}',
        '{"usage":{"prompt_tokens":5}}',
        '{"usage":{"prompt_tokens":-1,"completion_tokens":9}}',
        '{"usage":{"prompt_tokens":"5"}}',
        '{"usage":{}}',
        "{}",
    ]
    df = spark.createDataFrame([(str(i), 200, b, None, None, None) for i, b in enumerate(bodies)], OUTCOME)
    df = df.withColumns({"job_id": F.lit("j"), "custom_id": F.lit("c"), "route_key": F.lit("m")})
    (u,) = res.token_usage(res.to_results(df)).collect()
    assert (u.requests, u.prompt_tokens, u.generation_tokens) == (2, 10.0, 2.0)


def test_first_result_wins_and_open_requests_are_drained(spark):
    asked = spark.createDataFrame([(f"r{i}", f"c{i}", "j", "m") for i in range(4)], "request_id string, custom_id string, job_id string, route_key string")
    got = spark.createDataFrame([("r0", 5, "late"), ("r0", 1, "first"), ("r1", 2, "x"), ("other", 0, "y")], "request_id string, seq long, v string")
    rows = {r.request_id: r.v for r in res.resolve_results(asked, got, ["seq"]).collect()}
    assert rows == {"r0": "first", "r1": "x"}
    open_ = res.drain_unresolved(asked, got, "batch_cancelled").collect()
    assert {r.request_id for r in open_} == {"r2", "r3"}
    assert open_[0].error.message == "This request was not executed because the batch was cancelled."


def test_audit_and_members(spark):
    asked = spark.createDataFrame([("j", "a"), ("j", "b"), ("j", "c")], "job_id string, request_id string")
    got = spark.createDataFrame([("j", "a"), ("j", "a"), ("j", "z")], "job_id string, request_id string")
    (r,) = res.audit_results(asked, got).collect()
    assert (r.requests, r.missing, r.foreign, r.repeated) == (3, 2, 1, 1)
    assert [x.same for x in res.same_members(asked, asked, "job_id", "request_id").collect()] == [True]
    assert [x.same for x in res.same_members(asked, got, "job_id", "request_id").collect()] == [False]


def test_backoff_rules():
    assert run.backoff_seconds(1, 1, 60, 0.5) == 1
    assert run.backoff_seconds(4, 1, 60, 0.5) == 8
    assert run.backoff_seconds(9, 1, 60, 0.5) == 60
    assert run.backoff_seconds(1, 1, 60, 0.0) == 0.5
    wait = lambda status, attempt=1, header=None: run.wait_seconds(status, attempt, header, 1, 60, 0.5, 0.0)
    assert wait(429) == 3 and wait(429, 1, "7") == 7 and wait(429, 1, "0") == 1 and wait(429, 1, "900") == 60
    assert wait(503, 9) == 30 and wait(500, 9) == 60 and wait(None) == 1
    assert run.retry_after_seconds("Thu, 01 Jan 1970 00:01:00 GMT", 10.0) == 50.0
    assert run.retry_after_seconds("soon", 0.0) is None


def scripted():
    """Answers by request: a list of status codes, one per attempt; the last one repeats."""
    seen = {}

    def call(batch):
        codes = []
        for ident, script in zip(batch["request_id"], batch["value"]):
            n = seen[ident] = seen.get(ident, -1) + 1
            steps = [int(s) for s in script.split(",")]
            codes.append(steps[min(n, len(steps) - 1)])
        return pd.DataFrame({"request_id": batch["request_id"], "status_code": codes, "body": "{}"})

    return call


@pytest.mark.parametrize("parallelism", [1, 4])
def test_retries_and_capacity_flag(spark, parallelism):
    scripts = {"a": "200", "b": "429,200", "c": "0,200", "d": "500", "e": "400", "f": "0,0,503,429"}
    data = [(k, "j", f"c{k}", "m", 1, i, v) for i, (k, v) in enumerate(scripts.items())]
    plan = spark.createDataFrame(data, "request_id string, job_id string, custom_id string, route_key string, prefix_hash long, line_no long, value string")
    attempts = run.infer(plan, scripted, max_retries=3, sleep=lambda s: None, parallelism=parallelism).cache()
    got = {r.request_id: (r.attempts, r.had_capacity_retry) for r in run.capacity_retry(attempts).collect()}
    assert got == {"a": (1, False), "b": (2, True), "c": (2, False), "d": (4, True), "e": (1, False), "f": (4, True)}
    last = run.final_outcomes(attempts).collect()
    assert {r.request_id: (r.attempts, r.had_capacity_retry) for r in last} == got
    final = {r.request_id: r.status_code for r in last}
    assert final == {"a": 200, "b": 200, "c": 200, "d": 500, "e": 400, "f": 429}
    assert run.remaining(plan, attempts.filter("request_id < 'c'")).count() == 4


def test_whole_flow_accounts_for_every_request(spark):
    lines = []
    for i in range(40):
        body = {"model": f"m{i % 3}", "messages": [{"role": "user", "content": "x" * i}]}
        lines.append((f"job{i % 2}", f"f{i % 2}", i // 2 + 1, json.dumps({"custom_id": f"c{i}", "method": "POST", "url": "/v1/responses", "body": body})))
    df = spark.createDataFrame(lines, "job_id string, file_id string, line_no long, value string")
    df = df.withColumn("byte_len", F.octet_length("value") + 1)
    gw = spark.createDataFrame([("m0", "u"), ("m1", "u")], "route_key string, url string")
    done = flow.run_jobs(df, gw, run.echo_client)
    counts = {r.job_id: (r.total, r.failed) for r in res.request_counts(done.results, done.rejected).collect()}
    assert counts["job0"][0] == counts["job1"][0] == 20
    assert counts["job0"][1] + counts["job1"][1] == 13
    errors = res.all_errors(done.rejected, done.results)
    assert {r.error.code for r in errors.collect()} == {"model_not_found"}
    again = flow.run_jobs(df, gw, run.echo_client)
    key = lambda t: sorted((r.request_id, r.custom_id) for r in t.collect())
    assert key(done.results) == key(again.results)


def _end_lines(spark):
    """Jobs a to e, eight lines each; d has an unrouted line ahead of a bad one."""
    rows = []
    for j, job in enumerate("abcde"):
        for i in range(1, 9):
            model = "m9" if i == 2 else "m0"
            method = "GET" if job == "d" and i == 5 else "POST"
            body = {"model": model, "messages": [{"role": "user", "content": "x" * i}]}
            text = json.dumps({"custom_id": f"c{i}", "method": method, "url": "/v1/responses", "body": body})
            rows.append((job, f"f{job}", i, text))
    df = spark.createDataFrame(rows, "job_id string, file_id string, line_no long, value string")
    return df.withColumn("byte_len", F.octet_length("value") + 1)


def _end_jobs(spark):
    """a and e run, b is cancelled, c is late, d has a bad file; z ended long ago."""
    now = 1000
    rows = []
    for job, state, cancelled, deadline in [
        ("a", "in_progress", None, 2000), ("b", "cancelling", 900, 2000), ("c", "in_progress", None, 999),
        ("d", "in_progress", None, 2000), ("e", "validating", None, 0), ("z", "completed", None, 2000),
    ]:
        status = {f.name: None for f in JOB["status"].dataType} | {"status": state, "cancelling_at": cancelled}
        row = {f.name: None for f in JOB} | {"id": job, "tenant_id": "t", "tags": {"pth:x-a": job}}
        rows.append(tuple((row | {"status": status, "priority": deadline * 1000000}).values()))
    return spark.createDataFrame(rows, JOB), now


def logging_client(folder, break_at=None):
    """Logs every request it is sent; breaks on requests of one job while a mark file exists."""

    def make():
        inner = run.echo_client()

        def call(batch):
            if break_at and (Path(folder) / "broken").exists() and (batch["job_id"] == break_at).any():
                raise RuntimeError("lost")
            with open(Path(folder) / f"log-{uuid.uuid4().hex}", "w") as f:
                f.writelines(f"{i} {dict(h).get('x-a')} {dict(h).get('x-slo-ttft-ms')}\n" for i, h in zip(batch["request_id"], batch["headers"]))
            return inner(batch)

        return call

    return make


def _logged(folder):
    return [line.split() for p in Path(folder).glob("log-*") for line in p.read_text().splitlines()]


def test_jobs_reach_their_end_state(spark, tmp_path):
    jobs, now = _end_jobs(spark)
    gw = spark.createDataFrame([("m0", "u")], "route_key string, url string")
    done = flow.finish_jobs(jobs, _end_lines(spark), gw, logging_client(str(tmp_path)), str(tmp_path / "out"), now, waves=3)
    got = {r.id: (r.status.status, r.status.request_counts and tuple(r.status.request_counts)) for r in done.jobs.collect()}
    assert got == {
        "a": ("completed", (8, 7, 1)), "b": ("cancelled", (8, 0, 8)), "c": ("expired", (8, 0, 8)),
        "d": ("failed", None), "e": ("completed", (8, 7, 1)),
    }
    codes = Counter((r.job_id, r.error and r.error.code) for r in done.results.collect())
    assert codes == {
        ("a", None): 7, ("a", "model_not_found"): 1, ("b", "batch_cancelled"): 7, ("b", "model_not_found"): 1,
        ("c", "batch_expired"): 7, ("c", "model_not_found"): 1, ("d", "model_not_found"): 1,
        ("e", None): 7, ("e", "model_not_found"): 1,
    }
    sent = _logged(tmp_path)
    assert Counter((h, ms) for _, h, ms in sent) == {("a", "1000000"): 7, ("e", "None"): 7}
    lines = spark.read.schema("value string, kind string, job_id string").text(str(tmp_path / "out/results"))
    assert lines.filter("kind = 'error' AND job_id = 'b'").count() == 8
    by_id = {r.id: r.status for r in done.jobs.collect()}
    assert by_id["b"].output_file_id is None and by_id["d"].error_file_id and by_id["a"].output_file_id


def test_broken_run_resumes_behind_committed_waves(spark, tmp_path):
    jobs, now = _end_jobs(spark)
    gw = spark.createDataFrame([("m0", "u")], "route_key string, url string")
    out, mark = str(tmp_path / "out"), tmp_path / "broken"
    lines = _end_lines(spark)
    wave = lambda f, n: spark.range(1).select(F.pmod(F.xxhash64(F.lit(f), F.lit(0).cast("bigint")), F.lit(n))).first()[0]
    waves = next(n for n in range(2, 20) if wave("fa", n) != wave("fe", n))
    last = max("ae", key=lambda job: wave(f"f{job}", waves))
    mark.touch()
    with pytest.raises(Exception, match="lost"):
        flow.finish_jobs(jobs, lines, gw, logging_client(str(tmp_path), last), out, now, waves=waves)
    assert len(_logged(tmp_path)) == 7
    mark.unlink()
    # Another number of waves is ignored: the first run fixed it.
    done = flow.finish_jobs(jobs, lines, gw, logging_client(str(tmp_path), last), out, now, waves=waves + 1)
    sent = Counter(i for i, _, _ in _logged(tmp_path))
    assert len(sent) == 14 and set(sent.values()) == {1}
    # A finished folder is only read.
    again = flow.finish_jobs(jobs, lines, gw, logging_client(str(tmp_path)), out, now)
    assert len(_logged(tmp_path)) == 14
    key = lambda t: sorted((r.request_id, r.custom_id) for r in t.collect())
    assert key(done.results) == key(again.results) and done.results.count() == 33


def test_run_without_any_line(spark, tmp_path):
    jobs, now = _end_jobs(spark)
    gw = spark.createDataFrame([("m0", "u")], "route_key string, url string")
    done = flow.finish_jobs(jobs, _end_lines(spark).limit(0), gw, run.echo_client, str(tmp_path / "out"), now)
    assert done.results.count() == 0
    assert {r.id: r.status.status for r in done.jobs.collect()}["a"] == "completed"


def test_bodies_cross_one_exchange(spark):
    gw = spark.createDataFrame([("m0", "u")], "route_key string, url string")
    made = plan.build_plan(_end_lines(spark), gw)
    text = run.infer(made.requests.select(*flow.SENT), run.echo_client)._jdf.queryExecution().executedPlan().toString()
    # The texts meet the small tables by broadcast and are moved by the one asked-for exchange.
    assert text.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" not in text and "rangepartitioning" not in text


def stopping_client(log, stops):
    """Answers 200 and writes down what it sends; its first call cancels job e."""

    def make():
        def call(batch):
            import os

            import pandas as pd

            with open(f"{log}/calls", "a") as f:
                f.writelines(f"{j}\n" for j in batch["job_id"])
            if not os.path.exists(f"{stops}/e.parquet"):
                os.makedirs(stops, exist_ok=True)
                pd.DataFrame({"job_id": ["e", "e"], "cause": ["expired", "cancelled"], "ts": [9, 5]}).to_parquet(f"{stops}/e.parquet")
            return pd.DataFrame({"request_id": batch["request_id"], "status_code": 200, "body": "{}"})

        return call

    return make


def test_a_job_cancelled_between_two_waves_stops(spark, tmp_path):
    jobs, now = _end_jobs(spark)
    gw = spark.createDataFrame([("m0", "u")], "route_key string, url string")
    wave = lambda f, n: spark.range(1).select(F.pmod(F.xxhash64(F.lit(f), F.lit(0).cast("bigint")), F.lit(n))).first()[0]
    waves = next(n for n in range(2, 40) if wave("fa", n) < wave("fe", n))
    log, stops = str(tmp_path), str(tmp_path / "stops")
    done = flow.finish_jobs(jobs, _end_lines(spark), gw, stopping_client(log, stops), str(tmp_path / "out"), now, waves=waves, stops=stops)
    assert Counter((tmp_path / "calls").read_text().split()) == {"a": 7}
    got = {r.id: (r.status.status, tuple(r.status.request_counts)) for r in done.jobs.filter("id IN ('a', 'e')").collect()}
    assert got == {"a": ("completed", (8, 7, 1)), "e": ("cancelled", (8, 0, 8))}
    codes = Counter(r.error and r.error.code for r in done.results.filter("job_id = 'e'").collect())
    assert codes == {"batch_cancelled": 7, "model_not_found": 1}


def test_a_job_cancelled_while_it_is_sent_stops_before_its_retries(tmp_path):
    import pandas as pd

    batch = pd.DataFrame({"request_id": list("abcd"), "job_id": ["x", "x", "y", "y"], "custom_id": "c", "route_key": "r"}, index=[5, 6, 7, 8])
    causes, calls = {}, []

    def client(rows):
        calls.append(list(rows["request_id"]))
        causes["y"] = "batch_cancelled"
        return pd.DataFrame({"request_id": rows["request_id"], "status_code": [503 if i in "ad" else 200 for i in rows["request_id"]], "retry_after": None})

    out = pd.concat(run._attempts(batch, client, 2, 1.0, 60.0, lambda s: None, lambda: dict(causes)))
    assert calls == [["a", "b", "c", "d"], ["a"], ["a"]]
    final = out[out["final"]].set_index("request_id")
    assert final["attempt"].to_dict() == {"a": 3, "b": 1, "c": 1, "d": 0}
    assert final.loc["d", "error_category"] == "batch_cancelled" and bool(final.loc["d", "had_capacity_retry"])
    assert out.groupby("request_id").size().to_dict() == {"a": 3, "b": 1, "c": 1, "d": 2}
