"""The parallel replay of the adaptive limit against a plain loop."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inferbatch.operators import adaptive as A

ORDER = ["ts", "id"]
SCHEMA = "endpoint string, ts long, id string, signal string"


def signals(n, seed, fail=0.1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        endpoint = "hot" if rng.random() < 0.6 else f"e{rng.randrange(5)}"
        bad = rng.random() < fail
        out.append((endpoint, rng.randrange(n // 3 + 1), f"r{i:06d}", rng.choice(["429", "5xx", "capacity_retry"]) if bad else "success"))
    return out


def replay(data, limits, state=None):
    state = dict(state or {})
    trace = {}
    for endpoint, ts, ident, signal in sorted(data, key=lambda r: (r[1], r[2])):
        limit, run = state.get(endpoint, limits.start)
        raised = False
        if signal == "success":
            run += 1
            if run >= limit:
                new = min(limit + limits.increment, limits.maximum)
                raised, limit, run = new != limit, new, 0
        else:
            limit, run = max(limits.minimum, int(limit * limits.factor)), 0
        state[endpoint] = (limit, run)
        trace[ident] = (limit, raised)
    return trace, state


@pytest.mark.parametrize("ranges", [1, 5, 40])
@pytest.mark.parametrize(
    "limits,fail",
    [
        (A.Limits(), 0.1),
        (A.Limits(minimum=1, maximum=40, factor=0.7, increment=3, initial=100), 0.02),
        (A.Limits(minimum=2, maximum=6, initial=1), 0.0),
        (A.Limits(), 0.6),
    ],
)
def test_trace_and_state_match_the_loop(spark, ranges, limits, fail):
    data = signals(1500, 7, fail)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    trace = A.aimd_trace(df, ORDER, limits, ranges=ranges, min_rows=1)
    want, state = replay(data, limits)
    assert {r.id: (r.limit, r.raised) for r in trace.collect()} == want
    assert {r.endpoint: (r.limit, r.run) for r in A.aimd_state(trace, ORDER, limits).collect()} == state


def test_state_carries_over(spark):
    data = signals(900, 8)
    data.sort(key=lambda r: (r[1], r[2]))
    first, second = data[:400], data[400:]
    limits = A.Limits()
    one = A.aimd_trace(spark.createDataFrame(first, SCHEMA), ORDER, limits, ranges=4, min_rows=1)
    state = A.aimd_state(one, ORDER, limits)
    two = A.aimd_trace(spark.createDataFrame(second, SCHEMA), ORDER, limits, state, ranges=6, min_rows=1)
    _, mid = replay(first, limits)
    want, end = replay(second, limits, mid)
    assert {r.id: (r.limit, r.raised) for r in two.collect()} == want
    got = {r.endpoint: (r.limit, r.run) for r in A.aimd_state(two, ORDER, limits, state).collect()}
    assert got == end


def test_signals_ignore_results_without_response(spark):
    data = [("e", 1, (200,), False), ("e", 2, None, True), ("e", 3, (429,), False), ("e", 4, (200,), True), ("e", 5, (503,), True), ("e", 6, (400,), False)]
    df = spark.createDataFrame(data, "endpoint string, ts long, response struct<status_code:int>, had_capacity_retry boolean")
    signals = A.signals(df, ["ts"])
    got = [r.signal for r in signals.orderBy("ts").collect()]
    assert got == ["success", None, "429", "capacity_retry", "5xx", "success"]
    assert sorted(r.ts for r in A.aimd_trace(signals, ["ts"]).collect()) == [1, 3, 4, 5, 6]


def test_decreases_count_at_the_floor(spark):
    data = [("e", i, f"{i}", "429") for i in range(6)] + [("e", 10 + i, f"s{i}", "success") for i in range(5)]
    trace = A.aimd_trace(spark.createDataFrame(data, SCHEMA), ORDER)
    got = {(r.kind, r.signal): r.events for r in A.aimd_signals(trace).collect()}
    assert got == {("decrease", "429"): 6, ("increase", None): 1}
    assert trace.agg(F.min("limit")).first()[0] == 5


def test_state_does_not_shuffle_the_trace(spark):
    trace = spark.range(3000).select(
        F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("endpoint"),
        (F.col("id") % 50).alias("ts"),
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 31 == 0, F.lit("429")).otherwise(F.lit("success")).alias("signal"),
        F.lit(7).cast("long").alias("limit"),
        F.lit(False).alias("raised"),
    )
    # Joins too large for a broadcast by size alone.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = A.aimd_state(trace, ORDER)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "rightHint=(strategy=broadcast)" in plan, plan


def test_large_traces_have_more_ranges_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(A, "RANGE_ROWS", 50)
    data = signals(1500, 9)
    seen = []
    cut = A.with_range
    monkeypatch.setattr(A, "with_range", lambda df, g, o, ranges, least: seen.append(ranges) or cut(df, g, o, ranges, least))
    trace = A.aimd_trace(spark.createDataFrame(data, SCHEMA), ORDER, min_rows=1)
    want, _ = replay(data, A.Limits())
    assert {r.id: (r.limit, r.raised) for r in trace.collect()} == want
    assert seen == [30]


@pytest.mark.parametrize("rows", [6000, 24000])
def test_tasks_of_a_trace_are_even_and_bounded(spark, monkeypatch, rows):
    monkeypatch.setattr(A, "RANGE_ROWS", 1000)
    data = [(f"e{i % 3}", i // 7, f"r{i:06d}", "429" if i % 31 == 0 else "success") for i in range(rows)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    # As in a stream: partitions are not brought together afterwards.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        trace = A.aimd_trace(spark.createDataFrame(data, SCHEMA), ORDER, min_rows=1)
        got = [(r.id, r.task, r.limit, r.raised) for r in trace.withColumn("task", F.spark_partition_id()).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    per_task = Counter(task for _, task, _, _ in got)
    assert len(per_task) == max(spark.sparkContext.defaultParallelism, rows // 1000)
    assert max(per_task.values()) < 2 * rows / len(per_task)
    assert {ident: (limit, raised) for ident, _, limit, raised in got} == replay(data, A.Limits())[0]
