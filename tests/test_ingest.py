"""Request files: decoding rules one by one, duplicates, offsets over several splits, planning."""

import json
import os

import pytest
from pyspark.sql import functions as F

from inferbatch.operators import ingest, plan
from inferbatch.sources import requests as src

GOOD = {"custom_id": "a", "method": "POST", "url": "/v1/chat/completions", "body": {"model": "m", "messages": []}}


def line(**changes):
    return json.dumps({**GOOD, **changes})


def check(spark, *texts):
    data = [("f", i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "file_id string, line_no long, value string")
    return ingest.check_lines(ingest.decode_requests(df))


CASES = [
    (line(), None),
    ("", "decode"),
    ("[1]", "decode"),
    ('{"custom_id": 1}', "decode"),
    (line(body={"model": "m", "messages": [{"role": "user", "content": ["x"]}]}), "decode"),
    (line(body={"model": "m", "stream": "yes"}), "decode"),
    (line(body="text"), "decode"),
    (line(body={"model": "m", "messages": {"role": "user"}}), "decode"),
    ("null", "custom_id"),
    (line(custom_id=""), "custom_id"),
    (line(custom_id=None), "custom_id"),
    (line(method=""), "method_missing"),
    (line(method="GET"), "method"),
    (line(url=""), "url_missing"),
    (line(url="v1/responses"), "url_relative"),
    (line(url="//v1/responses"), "url_relative"),
    (line(url="/x?u=http://y"), "url_relative"),
    (line(url="/v1/files"), "endpoint"),
    (line(body={"model": ""}), "model"),
    (line(body=None), "model"),
    (line(body={"model": "m", "stream": True}), "stream"),
    (line(body={"model": "m", "stream": False}), None),
    (line(body={"model": "m", "stream": None, "messages": None, "extra": [1, {"content": 2}]}), None),
    (line(body={"model": "m", "messages": [None, {"role": "system", "content": None}]}), None),
]


def test_first_failing_rule_names_the_line(spark):
    data = [(f"f{i}", 1, text) for i, (text, _) in enumerate(CASES)]
    df = spark.createDataFrame(data, "file_id string, line_no long, value string")
    got = {r.file_id: r.error_rule for r in ingest.check_lines(ingest.decode_requests(df)).collect()}
    assert got == {f"f{i}": rule for i, (_, rule) in enumerate(CASES)}


def test_messages(spark):
    rows = {r.line_no: r.error_msg for r in check(spark, line(), line(), line(method="PUT")).collect()}
    assert rows == {1: None, 2: 'line 2: duplicate custom_id "a"', 3: "invalid method: PUT"}


def test_verdict_reports_the_first_bad_line(spark):
    texts = (line(), line(custom_id="b"), "{", line(custom_id="b"))
    (v,) = ingest.file_verdict(check(spark, *texts)).collect()
    assert (v.ok, v.bad_line, v.error_rule) == (False, 3, "decode")
    assert v.error_msg.startswith("validate request at line 3: ")


def test_invalid_line_does_not_count_as_first_use(spark):
    rows = check(spark, line(method="GET"), line()).collect()
    assert [r.error_rule for r in sorted(rows, key=lambda r: r.line_no)] == ["method", None]


def test_system_prompt_is_the_first_that_is_not_empty(spark):
    messages = [
        {"role": "user", "content": "u"},
        {"role": "system", "content": ""},
        {"role": "system", "content": "one"},
        {"role": "system", "content": "two"},
    ]
    df = check(spark, line(body={"model": "m", "messages": messages}), line(custom_id="z"))
    assert [r.system_prompt for r in df.orderBy("line_no").collect()] == ["one", None]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
@pytest.mark.parametrize("ending", ["", "\n"])
def test_line_numbers_and_offsets_over_splits(spark, tmp_path, split, ending):
    lines = [f"line {i} " + "ä" * (i % 40) for i in range(300)]
    lines[7] = ""
    lines[9] = "with return\r"
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("\n".join(lines) + ending, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        name = lambda p: F.element_at(F.split(p, "/"), -1)
        rows = src.read_requests(spark, str(tmp_path), name).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, offset = {}, 0
    for i, text in enumerate(lines):
        size = len(text.encode()) + 1
        want[i + 1] = (offset, size, text)
        offset += size
    for file in ("a.jsonl", "b.jsonl"):
        assert {r.line_no: (r.byte_offset, r.byte_len, r.value) for r in rows if r.file_id == file} == want


def test_file_limits(spark):
    data = [("a", 1, "m", 10), ("a", 2, "n", 10), ("b", 1, "", 100)]
    df = spark.createDataFrame(data, "file_id string, line_no long, model string, byte_len int")

    def breach(**limits):
        return {r.file_id: (r.lines, r.bytes, r.models, r.breach) for r in ingest.file_stats(df, **limits).collect()}

    assert breach(max_bytes=50, max_lines=1) == {"a": (2, 20, 2, "lines"), "b": (1, 100, 0, "bytes")}
    assert {v[3] for v in breach(max_bytes=0, max_lines=0).values()} == {None}


def lines_for_plan(spark, prompts):
    data = []
    for i, (model, prompt) in enumerate(prompts):
        messages = [{"role": "system", "content": prompt}] if prompt is not None else []
        text = line(custom_id=f"c{i}", body={"model": model, "messages": messages})
        data.append(("job", "f", i + 1, text))
    df = spark.createDataFrame(data, "job_id string, file_id string, line_no long, value string")
    return df.withColumn("byte_len", ingest.line_length())


def test_plan_groups_equal_prompts_and_puts_missing_last(spark):
    gw = spark.createDataFrame([("m", "u")], "route_key string, url string")
    df = lines_for_plan(spark, [("m", None), ("m", "one"), ("x", "one"), ("m", "two"), ("m", "one"), ("m", "")])
    made = plan.build_plan(df, gw)
    rows = sorted(made.entries.collect(), key=lambda r: r.position)
    assert [r.prefix_hash for r in rows][-2:] == [4294967295] * 2
    assert [r.line_no for r in rows if r.prefix_hash != 4294967295] in ([2, 5, 4], [4, 2, 5])
    (rejected,) = made.rejected.collect()
    assert rejected.error.message == 'model "x" is not configured in any gateway'
    texts = [r.value for r in df.orderBy("line_no").collect()]
    for r in rows:  # rejected lines advance the offset as well
        assert r.byte_offset == sum(len(t.encode()) + 1 for t in texts[: r.line_no - 1])
    assert made.with_bodies().count() == 5


def test_bad_line_leaves_the_whole_file_out(spark):
    gw = spark.createDataFrame([("m", "u")], "route_key string, url string")
    df = lines_for_plan(spark, [("m", None), ("", None)])
    assert plan.build_plan(df, gw).entries.count() == 0


def test_hot_prompt_and_id_do_not_change_results(spark):
    """A third of the lines share one prompt, another third one custom id."""
    n = 3000
    df = spark.range(n).select(
        F.lit("f").alias("file_id"),
        (F.col("id") + 1).alias("line_no"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("custom_id"),
        F.when(F.col("id") % 3 == 1, F.lit("hot prompt")).otherwise(F.concat(F.lit("p"), "id")).alias("system_prompt"),
    )
    marked = ingest.mark_duplicates(df)
    assert marked.filter("is_repeat").count() == n // 3 - 1
    hashed = plan.with_prefix_hash(df)
    assert hashed.count() == n
    assert hashed.filter("system_prompt = 'hot prompt'").select("prefix_hash").distinct().count() == 1


def test_safe_names(spark):
    data = [("j", 1, "meta/llama-3.1:8b"), ("j", 2, "meta:llama-3.1/8b"), ("j", 3, "meta llama-3.1 8b"), ("j", 4, ""), ("j", 5, "meta/llama-3.1:8b")]
    df = spark.createDataFrame(data, "job_id string, line_no long, model string")
    got = {r.model: r.safe_name for r in plan.safe_names(df).collect()}
    assert got == {
        "meta/llama-3.1:8b": "meta_llama-3.1_8b",
        "meta:llama-3.1/8b": "meta_llama-3.1_8b_2",
        "meta llama-3.1 8b": "meta_llama-3.1_8b_3",
        "": "unknown",
    }


def test_headers_keep_the_callers_fairness_id(spark):
    data = [({"x-gateway-inference-fairness-id": "mine"}, 2_000_000, "fast", "t"), ({}, 500_000, None, "t"), (None, 0, "", "")]
    df = spark.createDataFrame(data, "headers map<string,string>, priority long, objective string, tenant_id string")
    got = [r.headers for r in plan.build_headers(df, 1, fairness=True).collect()]
    assert got[0] == {
        "x-gateway-inference-fairness-id": "mine",
        "x-slo-ttft-ms": "1000",
        "x-gateway-inference-objective": "fast",
    }
    assert got[1] == {"x-gateway-inference-fairness-id": "t"}
    assert got[2] == {}


def test_written_plan_is_in_order(spark, tmp_path):
    gw = spark.createDataFrame([("m", "u")], "route_key string, url string")
    made = plan.build_plan(lines_for_plan(spark, [("m", f"p{i % 7}") for i in range(200)]), gw)
    path = str(tmp_path / "plan")
    src.write_plan(made.entries, path)
    (row,) = plan.count_disorder(spark.read.parquet(path)).collect()
    assert (row.entries, row.out_of_order) == (200, 0)
    assert any(f.endswith(".parquet") for f in os.listdir(path))


def test_gateways_must_be_one_row_per_key(spark):
    df = spark.createDataFrame([("m", 1)], "model string, n long")
    schema = "route_key string, url string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([("m", "u")], schema)
    two = spark.createDataFrame([("m", "u"), ("m", "w")], schema)
    for wrong in (none, two):
        with pytest.raises(ValueError, match="exactly one gateway"):
            plan.route(df, wrong, use_global=True)
    assert [r.gateway.url for r in plan.route(df, one, use_global=True).collect()] == ["u"]
    assert [r.gateway.url for r in plan.route(df, one).collect()] == ["u"]
    assert [r.gateway for r in plan.route(df, none).collect()] == [None]
    with pytest.raises(Exception, match="repeated route key m"):
        plan.route(df, two).collect()
