"""The bucketed job table: layout, merges that rewrite only what they touch, and their publication."""

import re

import pytest
from pyspark.sql import functions as F

from inferbatch.operators import jobs as J
from inferbatch.schemas import JOB
from inferbatch.sources import buckets as B


def job(i, tenant, status="in_progress", epoch=1):
    row = dict.fromkeys(JOB.names) | {"id": f"j{i:03d}", "tenant_id": tenant, "tags": {}, "epoch": epoch, "priority": i}
    return row | {"status": {f.name: None for f in JOB["status"].dataType} | {"status": status}}


def jobs_of(spark, rows):
    return spark.createDataFrame(rows, JOB)


@pytest.fixture
def table(spark, tmp_path):
    rows = [job(i, f"t{i % 20}", "completed" if i % 4 == 0 else "in_progress") for i in range(200)] + [job(500, None)]
    return B.create(spark, str(tmp_path / "jobs"), JOB, 32).append(jobs_of(spark, rows))


def fenced(spark, rows):
    kind = f"id string, expected_status {JOB['status'].dataType.simpleString()}, expected_epoch long, new_status {JOB['status'].dataType.simpleString()}, bump_epoch boolean"
    state = lambda s: {f.name: None for f in JOB["status"].dataType} | {"status": s}
    return spark.createDataFrame([(i, None, epoch, state(new), True) for i, epoch, new in rows], kind)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tenant_and_state_class_prune_folders(table):
    mine = J.for_tenant(table.read(), "t3").filter("open")
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", plan_of(mine))[1]
    assert "tenant_bucket" in filters and "open" in filters
    assert sorted(r.id for r in mine.collect()) == [f"j{i:03d}" for i in range(3, 200, 20) if i % 4]
    asked = J.query_items(table.read(), tenant="t3", non_terminal=True)
    assert "tenant_bucket" in re.search(r"PartitionFilters: \[(.*?)\], ", plan_of(asked))[1] and asked.count() == 10
    assert table.read().count() == 201


def test_merge_rewrites_only_touched_partitions(spark, table):
    before = {(r.id, r.status.status, r.epoch) for r in table.read().collect()}
    updates = fenced(spark, [("j003", 1, "completed"), ("j023", 0, "completed"), ("none", 1, "failed")])
    after, outcomes = table.merge(updates, B.fenced)
    assert {tuple(r) for r in outcomes.collect()} == {("j003", "updated"), ("j023", "conflict"), ("none", "missing")}
    # The open partition of one bucket is replaced, the ended one of that bucket only grows.
    kept = set(table.parts) & set(after.parts)
    bucket = spark.range(1).select(B.bucket_of(F.lit("t3"), 32)).first()[0]
    assert set(table.parts) - kept == {(bucket, True, 1)}
    assert set(after.parts) - kept == {(bucket, True, 2), (bucket, False, 2)}
    now = {(r.id, r.status.status, r.epoch) for r in after.read().collect()}
    assert now == before - {("j003", "in_progress", 1)} | {("j003", "completed", 2)}
    # The version before can still be read, and the newest is found again.
    assert table.read().count() == 201 and B.load(spark, table.root, JOB).parts == after.parts


def test_merges_of_one_version_do_not_both_publish(spark, table):
    first, _ = table.merge(fenced(spark, [("j001", 1, "failed")]), B.fenced)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        table.merge(fenced(spark, [("j002", 1, "failed")]), B.fenced)
    assert B.load(spark, table.root, JOB).version == first.version


def test_an_unpublished_merge_is_not_read(spark, table):
    table._write(B._plain(jobs_of(spark, [job(900, "t1")]), JOB), table.version + 1)
    assert B.load(spark, table.root, JOB).read().count() == 201


def test_replace_delete_and_compact(spark, table):
    claimed = table.read().drop(*B.PARTS).filter("id = 'j005'").withColumn("processor_id", F.lit("p1"))
    table, done = table.merge(claimed, B.replaced)
    assert [tuple(r) for r in done.collect()] == [("j005", "updated")]
    table, done = table.merge(spark.createDataFrame([("j005",), ("j004",), ("x",)], "id string"), B.deleted)
    assert {tuple(r) for r in done.collect()} == {("j005", "deleted"), ("j004", "deleted"), ("x", "missing")}
    assert table.read().filter("id IN ('j004', 'j005')").count() == 0 and table.read().count() == 199
    for n in range(3):
        table = table.append(jobs_of(spark, [job(600 + n, "t1")]))
    small = table.compact(most=1)
    assert small.read().drop("tags", "spec").exceptAll(table.read().drop("tags", "spec")).count() == 0 and small.read().count() == 202
    assert max(sum(p[:2] == q[:2] for q in small.parts) for p in small.parts) == 1
    nothing, done = small.merge(spark.createDataFrame([("x",)], "id string"), B.deleted)
    assert nothing.parts == small.parts and [tuple(r) for r in done.collect()] == [("x", "missing")]


def test_an_empty_table(spark, tmp_path):
    table = B.create(spark, str(tmp_path / "jobs"), JOB)
    assert table.read().count() == 0 and "tenant_bucket" in table.read().columns
    after, done = table.merge(fenced(spark, [("a", 1, "failed")]), B.fenced)
    assert after.read().count() == 0 and [tuple(r) for r in done.collect()] == [("a", "missing")]


def test_keyset_pages_cover_the_table(spark):
    df = spark.createDataFrame([(f"i{k:02d}", k) for k in range(23)], "id string, n int")
    last, seen, more = None, [], True
    while more:
        rows = J.page_after(df, last, 5).orderBy("id").collect()
        seen += [r.n for r in rows]
        last, more = rows[-1].id, rows[-1].has_more
    assert seen == list(range(23)) and J.page_after(df, "z", 5).count() == 0
