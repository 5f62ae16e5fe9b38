"""Streams against the batch operators, over several micro-batches."""

import json

import pytest
from pyspark.sql import functions as F

from inferbatch.operators import adaptive as A
from inferbatch.sources import streams as feeds
from inferbatch.streaming import operators as X
from inferbatch.streaming.sinks import append_table, each_batch, finish, newest, read_batches, upsert_table, write_batch

ORDER = ["ts", "id"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SIGNAL = "endpoint string, ts long, id string, signal string"




def test_adaptive_limit_over_batches_equals_one_batch(spark, tmp_path):
    data = [("e" if i % 3 else "f", i, f"r{i:04d}", "429" if i % 17 == 0 else "success") for i in range(400)]
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")
    for n in range(4):
        spark.createDataFrame(data[n * 100 : n * 100 + 100], SIGNAL).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(feed)
    finish(X.aimd_stream(stream, ORDER, root))
    got = spark.read.schema(f"{SIGNAL}, limit long, raised boolean").parquet(f"{root}/data/batch=*")
    want = A.aimd_trace(spark.createDataFrame(data, SIGNAL), ORDER)
    assert got.exceptAll(want).count() == 0 and got.count() == 400
    state = newest(read_batches(spark, f"{root}/state", "endpoint string, `limit` long, run long, batch int"), ["endpoint"])
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in A.aimd_state(want, ORDER).collect()}
    assert read_batches(spark, f"{root}/state", "endpoint string, batch int").select("batch").distinct().count() == 4


def test_progress_accumulates_over_batches(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")
    schema = "job_id string, ts long, response struct<status_code:int>"
    for n in range(3):
        rows = [("j", n, (200,)), ("j", n, (500,)), ("j", n, None), (f"k{n}", n, (200,))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    finish(X.progress_stream(stream, root, interval=None))
    rows = newest(read_batches(spark, f"{root}/data", f"{X.SLOTTED}, batch int"), ["job_id", "slot"])
    got = {r.job_id: (r.total, r.completed, r.failed) for r in X.live_progress(rows, 0).collect()}
    assert got == {"j": (9, 3, 6), "k0": (1, 1, 0), "k1": (1, 1, 0), "k2": (1, 1, 0)}
    assert {r.job_id for r in X.live_progress(rows, 10, ttl=9).collect()} == {"j", "k2"}


def run_batches(spark, tmp_path, schema, files, start):
    """Run a stream file by file and return the state rows after each batch."""
    feed = str(tmp_path / "feed")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
    query = start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed))
    finish(query, 120)
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


SECONDS = F.timestamp_seconds  # the tests' clock: a column of seconds


def test_progress_state_expires_and_a_late_result_starts_afresh(spark, tmp_path):
    schema, root = "job_id string, ts long, response struct<status_code:int>", str(tmp_path / "out")
    files = [[(f"j{n}-{k}", n * 100, (200,)) for k in range(20)] + [("back", n * 100, (500,))] * (n in (1, 2, 5)) for n in range(1, 7)]

    rows = run_batches(spark, tmp_path, schema, files, lambda s: X.progress_stream(s, root, None, 150, SECONDS("ts")))
    # A file brings 20 jobs; those of the slots that are over are gone.
    assert max(rows) <= 62 and rows[-1] <= 41, rows
    slots = newest(read_batches(spark, f"{root}/data", f"{X.SLOTTED}, batch int"), ["job_id", "slot"])
    # Two slots of a job that was never silent add up; one that came back after its time to live starts afresh.
    early = X.live_progress(slots.filter("last_ts < 500"), 0, ttl=150).filter("job_id = 'back'").first()
    late = X.live_progress(slots, 0, ttl=150).filter("job_id = 'back'").first()
    assert early.asDict() == {"job_id": "back", "total": 2, "completed": 0, "failed": 2, "last_ts": 200}
    assert late.asDict() == {"job_id": "back", "total": 1, "completed": 0, "failed": 1, "last_ts": 500}
    assert {r.job_id for r in X.live_progress(slots, 700, ttl=150).collect()} == {f"j6-{k}" for k in range(20)}


def test_stop_causes_expire(spark, tmp_path):
    schema, root = "job_id string, cause string, ts long", str(tmp_path / "out")
    jobs = spark.createDataFrame([("a", 0), ("b", 7_000_000)], "job_id string, deadline long")
    files = [[("a", "cancelled", 10), ("a", "shutdown", 5), ("b", "cancelled", 9)], [("a", "cancelled", 8), ("b", "shutdown", 6), (None, "cancelled", 11)], [("a", "shutdown", 300)]]
    arrival = F.when(F.col("ts").isin(5, 7), 20).when(F.col("ts") == 300, 320).otherwise(30)
    start = lambda s: upsert_table(X.stateful.live_causes(X.stateful.partial_causes(X.causes(s, jobs)), 60, SECONDS(arrival)), root)
    rows = run_batches(spark, tmp_path, schema, files, start)
    batches = read_batches(spark, f"{root}/data", "job_id string, ts long, cause string, batch int").collect()
    got = sorted((str(r.job_id), r.ts, r.cause) for r in batches)
    assert got == [("None", 11, "cancelled"), ("a", 5, "shutdown"), ("a", 300, "shutdown"), ("b", 6, "shutdown"), ("b", 7, "expired")]
    assert rows[1] >= 3 and rows[-1] == 1


def numbered(job, seq, kind, at=1):
    return (job, kind, at, 0, seq)


NUMBERED = "job_id string, type string, ts long, ttl long, seq long"


def released(spark, tmp_path, files, patience):
    root = str(tmp_path / "out")
    act = lambda df, n: write_batch(df.withColumn("at", F.monotonically_increasing_id()), f"{root}/data", n)
    run_batches(spark, tmp_path, NUMBERED, files, lambda s: each_batch(X.stateful.in_order(s, patience, 3600, SECONDS("ts")), root, act))
    rows = read_batches(spark, f"{root}/data", f"{X.stateful.ORDERED}, at long, batch int").orderBy("batch", "at").collect()
    per_job = {}
    for r in rows:
        per_job.setdefault(r.job_id, []).append((r.seq, r.type))
    return per_job


def test_events_come_out_in_the_order_of_their_job(spark, tmp_path):
    files = [
        [numbered("a", 3, "cancel"), numbered("a", 1, "pause"), numbered("b", 2, "resume")],
        [numbered("b", 1, "pause", 2), numbered("a", 1, "pause", 2), numbered("c", 2, "cancel", 2), numbered(None, 1, "cancel", 2), numbered("d", None, "cancel", 2)],
        [numbered("a", 2, "resume", 3), numbered("b", 2, "resume", 3), numbered("a", 4, "resume", 3)],
    ]
    # The cancellation waits for the resumption before it; what was never numbered or is still awaited stays away.
    assert released(spark, tmp_path, files, 600) == {"a": [(1, "pause"), (2, "resume"), (3, "cancel"), (4, "resume")], "b": [(1, "pause"), (2, "resume")]}


def test_a_lost_event_holds_the_others_for_a_while_only(spark, tmp_path):
    files = [[numbered("a", 2, "pause"), numbered("a", 5, "cancel")], [numbered("z", 1, "cancel", 30)], [numbered("z", 2, "cancel", 31)],
             [numbered("a", 1, "late", 40), numbered("a", 3, "resume", 40)], [numbered("a", 4, "resume", 41)]]
    # Number 1 is given up after a while; 2 goes, then 3 to 5 as soon as 3 and 4 have come.
    assert released(spark, tmp_path, files, 20)["a"] == [(2, "pause"), (3, "resume"), (4, "resume"), (5, "cancel")]


def test_repeated_results_and_foreign_ones_drop_out(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for n, ids in enumerate((["a", "b", "a"], ["b", "c", "zz"])):
        text = "\n".join(json.dumps({"request_id": i, "payload": "{}", "status_code": 200, "ts": f"2024-01-01T00:0{n}:00Z"}) for i in ids)
        (feed / f"{n}.json").write_text(text)
    stream = feeds.read_results_stream(spark, str(feed), files_per_batch=1)
    known = spark.createDataFrame([("a", "j1"), ("b", "j1"), ("c", "j2")], "request_id string, job_id string")
    finish(append_table(X.fan_out(X.dedupe_results(stream, "1 hour"), known), str(tmp_path / "out")))
    out = spark.read.schema("request_id string, job_id string").parquet(str(tmp_path / "out" / "data"))
    assert sorted(tuple(r) for r in out.select("request_id", "job_id").collect()) == [("a", "j1"), ("b", "j1"), ("c", "j2")]


def test_unanswered_requests_expire(spark, tmp_path):
    ask = "request_id string, ts timestamp, deadline timestamp"
    got = "request_id string, res_ts timestamp"
    hour = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"

    def frame(rows, schema):
        names = [c.split()[0] for c in schema.split(", ")]
        df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
        return df.select(*[F.col(n).cast(c.split()[1]).alias(n) for n, c in zip(names, schema.split(", "))])

    asked = [("fast", hour(0), hour(5)), ("late", hour(1), hour(3)), ("never", hour(2), hour(4)), ("end", hour(200), hour(205))]
    answered = [("fast", hour(1)), ("fast", hour(2)), ("late", hour(4)), ("other", hour(4)), ("end", hour(201))]
    frame(asked, ask).coalesce(1).write.parquet(str(tmp_path / "asked"))
    frame(answered, got).coalesce(1).write.parquet(str(tmp_path / "answered"))
    joined = X.correlate_stream(
        spark.readStream.schema(ask).parquet(str(tmp_path / "asked")),
        spark.readStream.schema(got).parquet(str(tmp_path / "answered")),
        "1 minute",
    )
    finish(append_table(joined, str(tmp_path / "out")))
    out = spark.read.schema("request_id string, error_code string").parquet(str(tmp_path / "out" / "data"))
    codes = {r.request_id: r.error_code for r in out.collect()}
    assert codes == {"fast": None, "late": "batch_expired", "never": "batch_expired", "end": None}
    assert out.count() == 4


def test_deadlines_of_any_length_and_late_repeats(spark, tmp_path):
    """Files arrive one by one; every request comes out once, whatever its deadline."""
    ask, got = "request_id string, ts timestamp, deadline timestamp", "request_id string, res_ts timestamp"
    at = lambda m: f"2024-01-0{1 + m // 1440} {m // 60 % 24:02d}:{m % 60:02d}:00"
    asked = [[("long", at(0), at(2000)), ("exact", at(0), at(30)), ("early", at(0), at(30))], [("lost", at(60), at(90))],
             [("none", at(61), None), ("after", at(61), at(70))], [("close", at(5000), at(5001))]]
    came = [[("exact", at(30)), ("early", at(1)), ("stranger", at(2))], [("early", at(62)), ("long", at(63))],
            [("after", at(71)), ("none", at(300))], [("long", at(4000)), ("end", at(5000))]]
    for name, files, schema in (("asked", asked, ask), ("came", came, got)):
        columns = [c.split(" ") for c in schema.split(", ")]
        for rows in files:
            df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n, _ in columns))
            df = df.select(*[F.col(n).cast(t).alias(n) for n, t in columns])
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, s in (("asked", ask), ("came", got))]
    finish(append_table(X.correlate_stream(*streams, "1 minute"), str(tmp_path / "out")))
    out = spark.read.schema("request_id string, error_code string").parquet(str(tmp_path / "out" / "data")).collect()
    expired = "batch_expired"
    want = {"long": None, "exact": None, "early": None, "lost": expired, "none": None, "after": expired}
    assert sorted((r.request_id, r.error_code) for r in out) == sorted(want.items())


def test_first_cause_wins(spark):
    events = spark.createDataFrame([("a", "cancelled", 10), ("a", "shutdown", 5), ("b", "cancelled", 10), ("c", "cancelled", 10)], "job_id string, cause string, ts long")
    jobs = spark.createDataFrame([("a", 0), ("b", 9_000_000), ("c", 11_000_000)], "job_id string, deadline long")
    got = {r.job_id: (r.ts, r.cause) for r in X.first_causes(events, jobs).collect()}
    assert got == {"a": (5, "shutdown"), "b": (9, "expired"), "c": (10, "cancelled")}


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_files_are_planned_as_they_arrive(spark, tmp_path, files_per_batch):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    line = lambda i, **more: json.dumps({"custom_id": f"c{i}", "method": "POST", "url": "/v1/responses", "body": {"model": "m"}, **more})
    (inbox / "good.jsonl").write_text("\n".join(line(i) for i in range(5)))
    (inbox / "bad.jsonl").write_text(line(0) + "\n" + line(0) + "\n")
    gw = spark.createDataFrame([("m", "u")], "route_key string, url string")
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    finish(X.ingest_stream(spark, str(inbox), root, gw, name, files_per_batch))
    verdict = read_batches(spark, f"{root}/verdict", "file_id string, ok boolean, bad_line long, batch int")
    assert {(r.file_id, r.ok, r.bad_line) for r in verdict.collect()} == {("good.jsonl", True, None), ("bad.jsonl", False, 2)}
    plan = read_batches(spark, f"{root}/plan", "file_id string, line_no long, batch int")
    assert {(r.file_id, r.line_no) for r in plan.collect()} == {("good.jsonl", i) for i in range(1, 6)}


def test_event_ttl(spark):
    df = spark.createDataFrame([("a", 10, 5), ("b", 10, 0), ("c", 10, 50)], "job_id string, ts long, ttl long")
    assert sorted(r.job_id for r in feeds.live_events(df, 20).collect()) == ["b", "c"]


def test_late_results(spark):
    got = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "request_id string, ts long")
    closed = spark.createDataFrame([("a", 4), ("b", 6)], "request_id string, closed_at long")
    assert {r.request_id: r.late for r in X.late_results(got, closed).collect()} == {"a": True, "b": False, "c": False}
