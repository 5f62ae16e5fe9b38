"""Ordered operators against brute force, with many cut points and one hot group."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inferbatch.operators import order


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}"
        out.append((group, rng.randrange(200), i, rng.randrange(1, 50)))
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_running_sums_match_brute_force(spark, ranges):
    data = rows()
    df = spark.createDataFrame(data, "g string, a long, b long, v long").repartition(5)
    got = order.running_sums(df, ["g"], ["a", "b"], {"before": F.col("v")}, ranges=ranges, min_rows=1)
    want, sums = {}, defaultdict(int)
    for g, a, b, v in sorted(data):
        want[(g, a, b)] = sums[g]
        sums[g] += v
    assert {(r.g, r.a, r.b): r.before for r in got.collect()} == want


@pytest.mark.parametrize("group", [["g"], []])
def test_row_numbers(spark, group):
    data = rows(1500, 2)
    df = spark.createDataFrame(data, "g string, a long, b long, v long")
    got = order.number_rows(df, group, ["a", "b"], ranges=13, min_rows=1)
    seen, want = defaultdict(int), {}
    for g, a, b, _ in sorted(data, key=lambda r: (r[0] if group else "", r[1], r[2])):
        key = g if group else ""
        seen[key] += 1
        want[(g, a, b)] = seen[key]
    assert {(r.g, r.a, r.b): r.position for r in got.collect()} == want


def test_previous_value_crosses_cut_points(spark):
    data = rows(2000, 3)
    df = spark.createDataFrame(data, "g string, a long, b long, v long")
    got = order.previous_value(df, ["g"], ["a", "b"], "v", "p", ranges=50, min_rows=1)
    last, want = {}, {}
    for g, a, b, v in sorted(data):
        want[(g, a, b)] = last.get(g)
        last[g] = v
    assert {(r.g, r.a, r.b): r.p for r in got.collect()} == want


def test_cut_points_are_stable_bounded_and_balanced(spark):
    df = spark.range(40000).select((F.col("id") % 2).alias("g"), "id")
    points, _ = order.cut_points(df, ["g", "id"], 16, min_rows=1)
    again, _ = order.cut_points(df.repartition(11), ["g", "id"], 16, min_rows=1)
    assert points == again and 0 < len(points) < 16
    sizes = order.with_range(df, ["g"], ["id"], 16, 1).groupBy(order.RANGE).count().collect()
    assert max(r["count"] for r in sizes) < 3 * 40000 / 16


def test_small_and_empty_inputs_are_not_cut(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), "id")
    assert order.cut_points(df, ["g", "id"], 8)[0] == []
    assert order.number_rows(df.limit(0), ["g"], ["id"]).count() == 0


def test_carry_is_a_bounded_broadcast(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("g"), "id")
    plan = order.number_rows(df, ["g"], ["id"], ranges=8, min_rows=1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(g" in plan


def test_null_groups_are_groups(spark):
    data = [(None if i % 2 else "g", i, i % 7 + 1) for i in range(400)]
    df = spark.createDataFrame(data, "g string, a long, v long").repartition(3)
    sums = order.running_sums(df, ["g"], ["a"], {"before": F.col("v")}, ranges=9, min_rows=1)
    want, total, last = {}, defaultdict(int), {}
    for g, a, v in data:
        want[a] = (total[g], last.get(g))
        total[g] += v
        last[g] = v
    assert {r.a: r.before for r in sums.collect()} == {a: w[0] for a, w in want.items()}
    before = order.previous_value(df, ["g"], ["a"], "v", ranges=9, min_rows=1)
    assert {r.a: r.previous for r in before.collect()} == {a: w[1] for a, w in want.items()}
