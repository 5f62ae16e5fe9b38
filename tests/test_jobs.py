"""Job and file tables: state rules, fencing, paging, recovery and expiry."""

import json

import pytest
from pyspark.sql import functions as F

from inferbatch.functions import values as V
from inferbatch.operators import jobs as J
from inferbatch.operators import lifecycle as L
from inferbatch.schemas import JOB, JOB_STATUS
from inferbatch.sources import tables as tab

NOW = 1_000_000


def status(state, **more):
    base = {f.name: None for f in JOB_STATUS}
    return {**base, "status": state, "request_counts": (0, 0, 0), **more}


def job(ident, state="validating", owner=None, priority=(NOW + 500) * 10**6, epoch=1, attempts=0, created=NOW - 100, **more):
    spec = ("batch", "/v1/responses", "file_1", "24h", {"k": "v"}, created)
    return (ident, "t", 0, {"a": "1"}, spec, tuple(status(state, **more).values()), owner, priority, epoch, attempts)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), JOB)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_stored_json_has_all_null_fields(spark):
    row = tab.encode_batch(frame(spark, job("b1"))).first()
    stored = json.loads(row.status)
    assert list(stored) == [f.name for f in JOB_STATUS]
    assert stored["output_file_id"] is None and stored["request_counts"] == {"total": 0, "completed": 0, "failed": 0}
    assert (row.expiry, row.priority) == (0, (NOW - 100 + 86400) * 10**6)


def test_batch_round_trip(spark):
    df = frame(spark, job("b1", "completed", "p", completed_at=5, usage=(1, (2,), 3, (4,), 5)))
    back = tab.decode_batch(tab.encode_batch(df)).first()
    assert back.status == df.first().status and back.spec == df.first().spec


def test_cancel_decisions(spark):
    df = frame(
        spark,
        job("queued"),
        job("owned", owner="p"),
        job("running", "in_progress", "p"),
        job("twice", "cancelling", "p"),
        job("done", "cancelled"),
        job("late", "finalizing", "p"),
        job("over", "completed"),
    )
    rows = {r.id: r for r in J.cancel_jobs(df, df.select("id"), NOW).collect()}
    assert {k: r.action for k, r in rows.items()} == {
        "queued": "cancelled",
        "owned": "cancelling",
        "running": "cancelling",
        "twice": "resend_event",
        "done": "noop",
        "late": "reject",
        "over": "reject",
    }
    assert rows["queued"].status.cancelled_at == NOW and rows["queued"].epoch == 2
    assert rows["running"].status.cancelling_at == NOW and rows["running"].epoch == 1
    events = J.cancel_events(J.cancel_jobs(df, df.select("id"), NOW), NOW)
    assert sorted(r.job_id for r in events.collect()) == ["owned", "running", "twice"]


def test_transition_stamps_and_refuses(spark):
    df = frame(spark, job("a", "in_progress", expires_at=7))
    for state, field in V.STATUS_TIMESTAMP.items():
        got = J.transition(df, state, NOW).first().status
        assert got.status == state and got[field] == NOW and got.expires_at == 7
    assert J.transition(df, "validating", NOW).first().status.expires_at == NOW + 500
    with pytest.raises(Exception, match="deadline is required"):
        J.transition(frame(spark, job("a", priority=0)), "validating", NOW).collect()
    with pytest.raises(Exception, match="invalid status: paused"):
        J.transition(df.withColumn("s", F.lit("paused")), "s", NOW).collect()


def test_claim_takes_earliest_deadlines(spark):
    df = frame(spark, job("c", priority=3), job("a", priority=5), job("b", priority=3), job("n", priority=None), job("own", owner="p", priority=1))
    rows = J.claim(df, "me", 3).collect()
    assert [r.id for r in sorted(rows, key=lambda r: (r.priority, r.id))] == ["b", "c", "a"]
    assert {(r.processor_id, r.epoch, r.recovery_attempts) for r in rows} == {("me", 2, 0)}
    assert ids(J.claim(df, "me", 10)) == ["a", "b", "c", "n"]


def test_requeue_and_claim_owned(spark):
    df = frame(spark, job("a", "in_progress", "p"), job("b", "completed", "p"), job("c"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "id string")
    rows = {r.id: r for r in J.requeue(df, asked).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {"a": "requeued", "b": "conflict", "c": "conflict", "x": "missing"}
    assert (rows["a"].processor_id, rows["a"].status.status, rows["a"].epoch) == (None, "validating", 2)
    mine = J.claim_owned(frame(spark, job("a", "in_progress", "p", None), job("b", "failed", "p")), "p").collect()
    assert [(r.id, r.priority, r.epoch, r.recovery_attempts) for r in mine] == [("a", 0, 2, 1)]


def test_fenced_update(spark):
    df = frame(spark, job("ok", "in_progress", "p"), job("epoch", "in_progress", "p"), job("state", "in_progress", "p"), job("same"))
    rows = []
    for ident, state, epoch in (("ok", "in_progress", 1), ("epoch", "in_progress", 0), ("state", "failed", 1), ("gone", "failed", 1)):
        rows.append((ident, tuple(status(state).values()), epoch, tuple(status("completed").values()), True))
    updates = spark.createDataFrame(
        rows,
        JOB_STATUS.__class__().add("id", "string").add("expected_status", JOB_STATUS).add("expected_epoch", "long").add("new_status", JOB_STATUS).add("bump_epoch", "boolean"),
    )
    table, outcome = J.cas_update(df, updates)
    assert {r.id: r.outcome for r in outcome.collect()} == {"ok": "updated", "epoch": "conflict", "state": "conflict", "gone": "missing"}
    assert {r.id: (r.status.status, r.epoch) for r in table.collect()} == {
        "ok": ("completed", 2),
        "epoch": ("in_progress", 1),
        "state": ("in_progress", 1),
        "same": ("validating", 1),
    }


def test_filters(spark):
    df = frame(spark, job("a"), job("b", "failed", "p"))
    assert ids(J.query_items(df)) == []
    assert ids(J.query_items(df, ids=["a", "z"])) == ["a"]
    assert ids(J.query_items(df, tags={"a": "1", "b": "2"})) == []
    assert ids(J.query_items(df, tags={"a": "1", "b": "2"}, any_tag=True)) == ["a", "b"]
    assert ids(J.query_items(df, has_processor=True)) == ["b"]
    assert ids(J.query_items(df, non_terminal=True)) == ["a"]
    assert "spec" not in J.query_items(df, tenant="t", include_static=False).columns


@pytest.mark.parametrize("near", [100, 1])
def test_pages_cover_the_table_once(spark, near):
    df = spark.range(23).select(F.format_string("id%02d", "id").alias("id"))
    seen, start, more = [], 0, True
    while more:
        rows = sorted(J.page(df, start, 10, near).collect())
        seen += [r.id for r in rows]
        more, start = rows[0].has_more, start + 10
    assert seen == [f"id{i:02d}" for i in range(23)]
    assert J.page(df, 50, 10, near).collect() == []


def test_list_rules(spark):
    files = spark.createDataFrame([(f"f{i}", "t", "batch") for i in range(5)], "id string, tenant_id string, purpose string")
    assert [r.id for r in J.list_files(files, "t", 0, 2, "desc").collect()] == ["f1", "f0"]
    assert [r.id for r in J.list_files(files, "t", 2, 2, "asc").collect()] == ["f2", "f3"]
    for bad in (lambda: J.list_files(files, "t", limit=10001), lambda: J.list_batches(files, "t", limit=101), lambda: J.list_batches(files, "t", after=-1), lambda: J.list_files(files, "t", order="up"), lambda: J.list_files(files, "t", purpose="x")):
        with pytest.raises(ValueError):
            bad()


def test_progress_replaces_counts_only_in_progress(spark):
    df = frame(spark, job("a", "in_progress"), job("b", "completed"), job("c", "in_progress"))
    live = spark.createDataFrame([("a", (9, 8, 1)), ("b", (9, 8, 1))], "job_id string, counts struct<total:long,completed:long,failed:long>")
    got = {r.id: r.status.request_counts.total for r in J.merge_progress(df, live).collect()}
    assert got == {"a": 9, "b": 0, "c": 0}


def test_orphans_need_a_snapshot(spark):
    df = frame(
        spark,
        job("live", "in_progress", "p1"),
        job("stop", "cancelling", "p2"),
        job("late", "in_progress", "p2", (NOW - 1) * 10**6),
        job("back", "in_progress", "p2"),
        job("lost", "in_progress", "p2", 0),
        job("over", "completed", "p2"),
        job("queued"),
    )
    live = spark.createDataFrame([("p1",)], "processor_id string")
    rows = {r.id: (r.action, r.changes) for r in L.triage_orphans(df, live, NOW).collect()}
    assert rows == {"stop": ("cancelled", True), "late": ("failed", True), "back": ("re_enqueued", True), "lost": ("error", False)}
    assert L.triage_orphans(df, None, NOW).count() == 0
    assert {r.changes for r in L.triage_orphans(df, live, NOW, dry_run=True).collect()} == {False}
    (s,) = L.reconcile_summary(L.triage_orphans(df, live, NOW)).collect()
    assert (s.expired, s.re_enqueued, s.conflicts, s.errors) == (2, 1, 0, 1)


def test_recovery_routes(spark):
    late = (NOW - 1) * 10**6
    df = frame(
        spark,
        job("fin", "finalizing", "p"),
        job("can", "cancelling", "p", request_counts=(3, 1, 0)),
        job("can0", "cancelling", "p"),
        job("part", "in_progress", "p"),
        job("fresh", "in_progress", "p"),
        job("late", "validating", "p", late),
        job("none", "validating", "p", 0),
        job("spec", "validating", "p", 0, expires_at=NOW + 5),
        job("spent", "finalizing", "p", attempts=4),
        job("over", "completed", "p"),
    )
    out = spark.createDataFrame([("part",)], "job_id string")
    rows = {r.id: (r.action, r.cancel_phase) for r in L.recover(df, out, NOW).collect()}
    assert rows == {
        "fin": ("finalized", None),
        "can": ("cancelled", "in_progress"),
        "can0": ("cancelled", "queued"),
        "part": ("failed", None),
        "fresh": ("re_enqueued", None),
        "late": ("expired", None),
        "none": ("failed", None),
        "spec": ("re_enqueued", None),
        "spent": ("failed", None),
        "over": ("cleaned_up", None),
    }


def test_dry_run_reports_only(spark):
    jobs = spark.createDataFrame([("a", 5), ("b", 0), ("c", NOW + 1)], "id string, expiry long")
    files = spark.createDataFrame([("f", "t", 5, ("x.txt",))], "id string, tenant_id string, expiry long, spec struct<filename:string>")
    rows = [(r.kind, r.id, r.outcome) for r in L.collect_expired(jobs, files, NOW, dry_run=True).collect()]
    assert sorted(rows) == [("batch", "a", "found"), ("file", "f", "found")]


def test_snapshot_without_success_marker_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tab.latest_snapshot(spark, root) is None
    one = tab.write_snapshot(spark.range(1), root, 1)
    tab.write_snapshot(spark.range(2), root, 2)
    (tmp_path / "t" / "version=000000000002" / "_SUCCESS").unlink()
    assert tab.latest_snapshot(spark, root).endswith(one[len(root) :])


def test_filters_and_pruning_reach_the_scan(spark, tmp_path):
    root = str(tmp_path / "jobs")
    assert tab.read_table(spark, root, JOB).count() == 0
    tab.write_snapshot(frame(spark, job("a"), job("b", "failed", "p")), root, 1)
    table = J.query_items(tab.read_table(spark, root, JOB), tenant="t", include_static=False)
    found = J.queued(table).select("id", "priority")
    assert [r.id for r in found.collect()] == ["a"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")
    assert "EqualTo(tenant_id,t)" in pushed[0] and "IsNull(processor_id)" in pushed[0]
    assert "spec" not in pushed[1] and "tags" not in pushed[1] and "request_counts" not in pushed[1]
