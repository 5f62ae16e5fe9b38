"""Histograms, rates, sustained conditions and panels against small worked examples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inferbatch.functions import scalars as S
from inferbatch.operators import observe as O
from inferbatch.plans import dashboards as D

INF = float("inf")


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 9.0), ("a", None), ("b", 2.0)], "g string, v double")
    rows = {(r.g, r.le): r["count"] for r in O.histogram(df, "v", [1.0, 2.0], ["g"]).collect()}
    assert rows == {("a", 1.0): 2, ("a", 2.0): 2, ("a", INF): 3, ("b", 1.0): 0, ("b", 2.0): 1, ("b", INF): 1}


def quantile(buckets, q):
    top, total, low, below = 0.0, buckets[-1][1], 0.0, 0.0
    rank = q * total
    best = 0.0
    for le, n in buckets:
        best = max(best, n)
        if best >= rank:
            return low if le == INF else low + (le - low) * (rank - below) / (best - below)
        low, below = le, best
    return top


@pytest.mark.parametrize("q", [0.0001, 0.5, 0.95, 0.99, 1.0])
def test_quantiles_match_a_scan(spark, q):
    rng = random.Random(4)
    data = {}
    for g in range(20):
        n, buckets = 0, []
        for le in (0.1, 0.5, 2.0, INF):
            n += rng.randrange(0, 9)
            buckets.append((le, n))
        if n:
            data[g] = buckets
    rows = [(g, le, float(n)) for g, b in data.items() for le, n in b]
    df = spark.createDataFrame(rows, "g int, le double, count double").repartition(3)
    name = f"p{round(q * 100):02d}"
    got = {r.g: r[name] for r in O.histogram_quantile(df, [q], ["g"]).collect()}
    for g, buckets in data.items():
        assert math.isclose(got[g], quantile(buckets, q), rel_tol=1e-9), (g, buckets)


def test_empty_histogram_has_no_quantile_and_dips_are_raised(spark):
    rows = [("empty", 1.0, 0.0), ("empty", INF, 0.0), ("dip", 1.0, 5.0), ("dip", 2.0, 3.0), ("dip", INF, 6.0)]
    df = spark.createDataFrame(rows, "g string, le double, count double")
    got = {r.g: r.p50 for r in O.histogram_quantile(df, [0.5], ["g"]).collect()}
    assert got == {"empty": None, "dip": 0.6}


@pytest.mark.parametrize("ranges", [1, 9])
def test_exact_quantiles(spark, ranges):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(4)}", float(rng.randrange(300))) for _ in range(2000)]
    df = spark.createDataFrame(data, "g string, v double")
    cuts = {"ranges": ranges, "min_rows": 1}
    got = {r.g: (r.p00, r.p37, r.p95, r.p100) for r in O.exact_quantiles(df, "v", [0, 0.37, 0.95, 1], ["g"], **cuts).collect()}

    def at(values, q):
        rank = q * (len(values) - 1)
        lo, hi = values[math.floor(rank)], values[math.ceil(rank)]
        return lo + (hi - lo) * (rank - math.floor(rank))

    for g in {g for g, _ in data}:
        values = sorted(v for k, v in data if k == g)
        assert got[g] == pytest.approx([at(values, q) for q in (0, 0.37, 0.95, 1)])
    whole = sorted(v for _, v in data)
    assert O.exact_quantiles(df, "v", [0.5], **cuts).first().p50 == at(whole, 0.5)


def test_counter_resets_and_windows(spark):
    data = [("s", 10, 1, 5.0), ("s", 70, 2, 8.0), ("s", 130, 3, 2.0), ("s", 190, 4, 2.0), ("x", 60, 5, 4.0), ("x", 61, 6, 9.0)]
    df = spark.createDataFrame(data, "series string, ts long, seq long, value double")
    deltas = {(r.series, r.ts): r.delta for r in O.counter_deltas(df, ["series"], step=60).collect()}
    assert deltas == {("s", 10): 0.0, ("s", 70): 3.0, ("s", 130): 2.0, ("s", 190): 0.0, ("x", 60): 0.0, ("x", 61): 5.0}
    inc = {(r.series, r.t): r.increase for r in O.counter_increase(df, ["series"], ["series"], 120, 60).collect()}
    assert inc[("s", 120)] == 3.0 and inc[("s", 180)] == 5.0 and inc[("s", 240)] == 2.0
    assert inc[("x", 120)] == 5.0 and ("x", 240) not in inc
    with pytest.raises(ValueError):
        O.over_window(df, [], 100, 60)


def test_sustained_needs_every_step(spark):
    on = [60, 120, 180, 300, 360, 420, 480]
    df = spark.createDataFrame([(t, t in on) for t in range(60, 540, 60)], "t long, on boolean")
    rows = {r.t: (r.since, r.fires) for r in O.sustained(df, "on", 120, 60).collect()}
    assert rows == {60: (60, False), 120: (60, False), 180: (60, True), 300: (300, False), 360: (300, False), 420: (300, True), 480: (300, True)}


def test_ratio_floor(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, 0.0)], "g string, u double, t double")
    assert [r.ratio for r in O.utilisation(df, "u", "t", ["g"], 1.0).orderBy("g").collect()] == [1.0, 0.0]
    assert [r.ratio for r in O.utilisation(df, "u", "t", ["g"]).orderBy("g").collect()] == [2.0, None]


def sample_rows(metric, labels, points, le=None):
    return [(metric, labels, ts, i, le, float(v)) for i, (ts, v) in enumerate(points)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, ts long, seq long, le double, value double")


def test_failure_alert(spark):
    rows = []
    for result, per_step in (("failed", 3), ("success", 7)):
        rows += sample_rows("jobs_processed_total", {"result": result, "pod": "a"}, [(300 * i, per_step * i) for i in range(1, 9)])
    df = frame(spark, rows + sample_rows("other", {"result": "failed"}, [(300, 1), (600, 900)]))
    fired = {r.t: r.fires for r in D.high_failure_rate(df).collect()}
    assert fired[600] is False and fired[900] is False and fired[1200] is True
    assert D.expired_jobs(df).count() == 0


def test_rate_sums_series_and_filters_labels(spark):
    rows = []
    for pod in "ab":
        for status in ("200", "404", "500"):
            rows += sample_rows("http_requests_total", {"status": status, "pod": pod}, [(0, 0), (300, 30)])
    got = {r.status: r.rate for r in D.panel(frame(spark, rows), "d10", "errors").collect() if r.t == 300}
    assert got == {"404": 0.2, "500": 0.2}


def test_all_panels_run(spark):
    for dashboard, panels in D.PANELS.items():
        for name, spec in panels.items():
            le = 1.0 if spec.kind == "quantile" else None
            rows = sample_rows(spec.metric, {k: "v" for k in spec.by}, [(10, 1), (20, 2)], le)
            if spec.total:
                rows += sample_rows(spec.total, {}, [(10, 4), (20, 4)])
            D.panel(frame(spark, rows), dashboard, name).collect()


def test_latency_and_size_buckets(spark):
    sizes = spark.createDataFrame([(n,) for n in (99, 100, 999, 9999, 29999, 30000)], "n long")
    got = [r.b for r in sizes.select(S.size_bucket("n").alias("b")).collect()]
    assert got == ["100", "1000", "1000", "10000", "30000", "large"]
    assert S.exponential_bounds(1, 3, 4) == [1, 3, 9, 27]


def test_series_points_drop_nan(spark):
    df = spark.createDataFrame([("m", 1, 1, 2.0), ("m", 2, 2, float("nan")), ("m", 3, 3, 4.0)], "metric string, ts long, seq long, value double")
    assert [(r.position, r.value) for r in O.series_points(df, ["metric"]).orderBy("position").collect()] == [(1, 2.0), (2, 4.0)]
    assert O.series_stats(df, ["metric"]).select(F.col("avg"), "samples").first() == (3.0, 2)


def test_quantiles_of_the_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", 5.0)], "g string, v double")
    assert {r.g: r.p50 for r in O.exact_quantiles(df, "v", [0.5], ["g"]).collect()} == {None: 2.0, "g": 5.0}


def test_reconciler_alert_does_not_join_two_series(spark):
    """Two counters that grow in turns hold nothing alone; one that keeps growing does."""
    grow = {"a": [1, 0, 0, 1, 0, 0], "b": [0, 1, 1, 0, 1, 1], "c": [1] * 6}
    rows = []
    for pod, steps in grow.items():
        value = 0.0
        rows.append(("batch_reconciler_errors_total", {"pod": pod}, 0, 0, None, value))
        for k, n in enumerate(steps, 1):
            value += n
            rows.append(("batch_reconciler_errors_total", {"pod": pod}, 300 * k, k, None, value))
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts long, seq long, le double, value double")
    got = D.reconciler_errors(df, window=300, hold=600).filter("fires")
    assert {(r.series, r.t) for r in got.collect()} == {('{"pod":"c"}', 300 * k) for k in range(3, 7)}
