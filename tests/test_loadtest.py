"""Load-test analysis and workload generation."""

import json
import math
import statistics

from pyspark.sql import functions as F

from inferbatch.operators import loadtest as T
from inferbatch.operators import workload as W
from inferbatch.sources import loadtest as src
from inferbatch.sources import requests as req

HEADS = [
    ["", "Request Counts", "Request Counts", "Request Counts", "Time to First Token", "Time to First Token", "Request Latency", "Timings"],
    ["", "Successful", "Errored", "Total", "Successful ms", "Successful ms", "Successful Sec", "Duration"],
    ["", "", "", "", "Median", "Percentiles", "Median", "Sec"],
]


def write(path, row):
    quoted = [f'"{c}"' if "," in c else c for c in row]
    path.write_text("\n".join(",".join(line) for line in [*HEADS, quoted]) + "\n")


def test_phase_files(spark, tmp_path):
    deciles = str([float(10 * i) for i in range(11)])
    write(tmp_path / "burst-1.csv", ["run", "90", "10", "100", "42.5", deciles, "1.5", "50"])
    write(tmp_path / "idle-2.csv", ["run", "x", "", "0", "n/a", "[1, 2]", "", "0"])
    (tmp_path / "warm.csv").write_text("a\nb\n")
    rows = {(r.phase, r.cycle): r for r in src.read_phase_csv(spark, str(tmp_path)).collect()}
    b = rows[("burst", 1)]
    assert (b.ttft_p50, b.ttft_p95, b.ttft_p99, b.req_latency_p50) == (42.5, 95.0, 99.0, 1500.0)
    assert (b.completed, b.errors, b.error_rate, b.ok_rps, b.err_rps) == (90, 10, 0.1, 1.8, 0.2)
    i = rows[("idle", 2)]
    assert (i.ttft_p50, i.ttft_p99, i.ok_rps, i.error_rate, i.completed) == (0.0, 0.0, 0.0, 0.0, 0)
    assert rows[("warm", 0)].completed == 0


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for n in (0, 1):
        (tmp_path / f"scenario-{n}").mkdir()
        write(tmp_path / f"scenario-{n}" / "burst-1.csv", ["run", str(90 + n), "10", "100", "1", "[]", "1", "50"])
    rows = src.read_phase_csv(spark, f"{tmp_path}/scenario-*").collect()
    got = {(r.folder.rsplit("/", 1)[1], r.phase, r.cycle, r.completed) for r in rows}
    assert got == {("scenario-0", "burst", 1, 90), ("scenario-1", "burst", 1, 91)}


def phases(spark, rows):
    base = {c: 0.0 for c in T.PERCENTILES}
    data = [{**base, "scenario": 0, "phase": "burst", "cycle": 1, "ok_rps": 0.0, "error_rate": 0.0, "completed": 0, "errors": 0, **r} for r in rows]
    cols = "scenario long, phase string, cycle long, ok_rps double, error_rate double, completed long, errors long, "
    return spark.createDataFrame(data, cols + ", ".join(f"{c} double" for c in T.PERCENTILES))


def test_trials(spark):
    df = phases(spark, [{"ttft_p99": v, "completed": c} for v, c in ((1.0, 3), (2.0, 4), (6.0, 4))] + [{"cycle": 2, "ttft_p99": 5.0}])
    rows = {r.cycle: r for r in T.aggregate_trials(df).collect()}
    assert rows[1].completed == 3 and rows[1].ttft_p99 == 3.0
    assert math.isclose(rows[1].ttft_p99_ci, 1.96 * statistics.stdev([1.0, 2.0, 6.0]) / math.sqrt(3))
    assert rows[2].ttft_p99_ci == 0.0


def test_baseline_and_summary(spark):
    df = phases(
        spark,
        [
            {"scenario": 0, "ttft_p99": 100.0},
            {"scenario": 2, "ttft_p99": 150.0, "error_rate": 0.5},
            {"scenario": 2, "phase": "idle", "completed": 90},
        ],
    )
    change = {r.scenario: r.change_percent for r in T.vs_baseline(T.aggregate_phases(df, "burst")).collect()}
    assert change == {0: 0.0, 2: 50.0}
    rows = {r.scenario: r for r in T.scenario_summary(df, 90, 4, 2).collect()}
    assert rows[0].idle_rps == "N/A" and rows[2].idle_rps == "0.50" and rows[2].burst_error_percent == 50.0
    assert rows[2].ttft_burst == "0 / 0 / 150"


def test_progress_lines(spark):
    lines = [
        ("a", 1, "completed=1/10 x"),
        ("a", 2, "completed=4/10"),
        ("a", 3, "completed=soon"),
        ("b", 1, "completed=9/10"),
        ("b", 2, "Terminal: completed"),
        ("c", 1, "starting"),
    ]
    df = spark.createDataFrame(lines, "job string, ts long, text string")
    got = {r.job: (r.completed, r.total, r.status) for r in T.latest_progress(df).collect()}
    assert got == {"a": (4, 10, "in_progress"), "b": (0, 0, "completed"), "c": (0, 0, "in_progress")}
    assert tuple(T.progress_total(T.latest_progress(df)).first()) == (4, 10)


def test_slo(spark):
    done = spark.createDataFrame([(2, "job-a", 1801), (2, "job-b", 60)], "scenario long, job string, elapsed long")
    scenarios = spark.createDataFrame([(2,), (3,)], "scenario long")
    report = T.slo_report(done, scenarios)
    got = {(r.scenario, r.job): r.summary for r in report.collect()}
    assert got[(2, "job-a")] == "A: ✗ 30m/30m" and got[(2, "job-b")] == "B: ✓ 1m/2h" and got[(3, "job-c")] == "C: — /24h"
    final = spark.createDataFrame([(2, 5, 10), (3, 0, 0)], "scenario long, completed long, total long")
    rates = {r.scenario: (r.finished, r.met, r.completion) for r in T.slo_rate(report, final).collect()}
    assert rates == {2: (2, 1, 50.0), 3: (0, 0, None)}


def probe(rate, ttft=10.0, err=0.0, completed=5, failed=False, scenario=1):
    return (scenario, rate, ttft, err, completed, failed)


def test_saturation(spark):
    rows = [
        probe(1), probe(5, 30.0), probe(10, 31.0),
        probe(1, scenario=2), probe(5, err=0.06, scenario=2), probe(10, 99.0, scenario=2),
        probe(1, scenario=3), probe(5, scenario=3),
        probe(1, err=0.5, scenario=4), probe(5, scenario=4),
        probe(1, scenario=5), probe(5, completed=0, scenario=5), probe(40, completed=0, failed=True, scenario=5),
    ]
    df = spark.createDataFrame(rows, "scenario long, rate long, ttft_p99 double, error_rate double, completed long, failed boolean")
    got = {r.scenario: r.saturating_rate for r in T.saturating_rate(df).collect()}
    assert got == {1: 5, 2: 1, 3: 5, 4: 1, 5: 35}


def test_lengths_are_repeatable_and_bounded(spark):
    df = spark.range(20000)
    length = W.sample_length("lognormal", 1500, 1200, F.lit(42), "id", "in", 16, 4096)
    one = df.select("id", length.alias("n"))
    two = df.repartition(7).select("id", length.alias("n"))
    assert one.exceptAll(two).count() == 0
    row = one.agg(F.min("n"), F.max("n"), F.avg(F.when(F.col("n") < 4096, F.col("n")))).first()
    assert row[0] >= 16 and row[1] == 4096 and 1200 < row[2] < 1500
    normal = df.select(W.sample_length("normal", 500, 100, F.lit(1), "id", "x").alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(normal[0] - 500) < 5 and abs(normal[1] - 100) < 5


def test_conversations(spark):
    rows = [
        ("a", 0, "system", ""), ("a", 1, "system", "S"), ("a", 2, "human", ""), ("a", 3, "human", "U"), ("a", 4, "system", "late"),
        ("b", 0, "human", "only"),
        ("c", 0, "gpt", "x"), ("c", 1, "gpt", "y"),
        ("d", 0, "human", "U"), ("d", 1, "system", "after"),
    ]
    df = spark.createDataFrame(rows, "conversation_id string, turn long, role string, text string")
    got = {r.conversation_id: (r.system_prompt, r.user_prompt) for r in W.conversation_pairs(df).collect()}
    assert got == {"a": ("S", "U"), "d": ("You are a helpful assistant.", "U")}


def test_generated_lines(spark):
    personas = spark.createDataFrame([(0, "[Persona 000] A"), (1, "[Persona 001] B")], "persona long, system_prompt string")
    df = W.generate_requests(spark.range(12000).filter("id in (0, 3, 11999)"), "id", "m", personas=personas, input_length=("fixed", 20, 0, None))
    lines = {json.loads(r.value)["custom_id"]: json.loads(r.value) for r in req.request_lines(df).collect()}
    assert sorted(lines) == ["req-0000", "req-0003", "req-11999"]
    one = lines["req-0003"]
    assert one["body"]["messages"][0] == {"role": "system", "content": "[Persona 001] B"}
    assert len(one["body"]["messages"][1]["content"].split()) == 20
    assert list(one) == ["custom_id", "method", "url", "body"] and one["body"]["max_tokens"] >= 1
    jobs = W.generate_jobs(spark.range(3), "id", "m")
    assert {(r.job_id, r.completion_window) for r in jobs.collect()} == {("job-a", "30m"), ("job-b", "2h"), ("job-c", "24h")}


def test_persona_prompt_is_cut(spark):
    df = spark.createDataFrame([(7, "x" * 100), (1234, "y")], "n long, t string")
    got = [r.p for r in df.select(W.persona_prompt("n", "t", 8).alias("p")).collect()]
    assert got == ["[Persona 007] " + "x" * 18, "[Persona 1234] y"]


def test_personas_are_numbered_whatever_the_corpus(spark):
    corpus = spark.createDataFrame([(100, "C"), (7, "A"), (7, "B"), (None, "x"), (500, None), (900, "D")], "n long, t string")
    personas = W.system_prompts(corpus, "n", "t", 3, 64)
    want = {0: "[Persona 000] A", 1: "[Persona 001] B", 2: "[Persona 002] C"}
    assert {r.persona: r.system_prompt for r in personas.collect()} == want
    few = W.system_prompts(corpus, "n", "t", 50, 64)
    made = W.generate_requests(spark.range(9), "id", "m", personas=few, input_length=("fixed", 5, 0, None)).collect()
    assert {r.line_no: r.system_prompt[-1] for r in made} == {i: "ABCD"[i % 4] for i in range(9)}
