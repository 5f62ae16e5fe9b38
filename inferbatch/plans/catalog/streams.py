"""Streaming queries: each reads a whole table as a stream, runs until it is read, and returns the sink."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions import values as V
from ...operators import adaptive
from ...operators import results as res
from ...session import scratch_path
from ...sources import requests as src
from ...sources import streams as feeds
from ...streaming import operators as X
from ...streaming import stateful
from ...streaming.sinks import append_table, each_batch, finish, newest, read_batches, write_batch
from .. import views
from . import query
from .ingest import gateways
from .metrics import AIMD, ORDER
from .sqlviews import sql


@query(
    "stream_progress",
    sql(
        """SELECT job_id, count(*)::BIGINT AS total, count(*) FILTER (http_code = 200)::BIGINT AS completed,
             (count(*) - count(*) FILTER (http_code = 200))::BIGINT AS failed, max(ts) AS last_ts
           FROM results GROUP BY job_id HAVING max(ts) + 86400 * 365 > 978307200""",
        "results",
    ),
)
def stream_progress(spark, d):
    """Progress of all jobs after the stream of results, as far as it is still alive."""
    root = scratch_path(spark, "progress")
    results = res.to_results(views.outcomes_of(views.stream(spark, d, "lineitem")))
    finish(X.progress_stream(results, root, interval=None))
    slots = newest(read_batches(spark, f"{root}/data", f"{X.SLOTTED}, batch int"), ["job_id", "slot"])
    return X.live_progress(slots, 978307200, ttl=86400 * 365)


def event_stream(spark, d):
    return views.stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def answers(e):
    """Results of nine in ten events, later by `value` seconds; every seventh comes twice."""
    copies = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        e.filter("event_id % 10 <> 0")
        .withColumn("copy", F.explode(copies))
        .select(
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
            F.timestamp_micros(
                F.unix_micros("ts") + F.round(F.col("value") * 6e6).cast("long") + F.col("copy") * 1000000
            ).alias("res_ts"),
        )
    )


CLOSING = -1


def closed_events(spark, d):
    """The whole events table as a stream, with one event long after the others at its end.

    Without it, what the last events open would wait for ever for time to go on.
    """
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = e.agg(F.max("ts")).scalar()
    last = spark.range(1).select(
        F.lit(CLOSING).cast("long").alias("event_id"),
        (end + F.expr("INTERVAL 10 DAYS")).alias("ts"),
        F.lit("closing").alias("event_type"),
        F.lit(0.0).alias("value"),
    )
    feed = scratch_path(spark, "closed-events")
    e.select(last.columns).unionByName(last).write.parquet(feed)
    return spark.readStream.schema(last.schema).parquet(feed)


# Every eleventh request may wait for two days.
WAIT = "300 + event_id % 300 + CASE WHEN event_id % 11 = 0 THEN 172800 ELSE 0 END"


@query(
    "stream_correlate",
    f"""SELECT 'r' || event_id AS request_id, CASE WHEN NOT answered THEN 'batch_expired' END AS error_code,
          CASE WHEN NOT answered THEN '{V.NOT_COLLECTED_MESSAGE}' END AS error_message
        FROM (SELECT event_id, event_id % 10 <> 0 AND round(value * 6e6) <= ({WAIT}) * 1e6 AS answered FROM events)""",
)
def stream_correlate(spark, d):
    """Requests with their results as both streams arrive; the rest expires at its deadline."""
    root = scratch_path(spark, "correlate")
    feed = closed_events(spark, d)
    asked = feed.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        "ts",
        F.timestamp_micros(F.unix_micros("ts") + F.expr(WAIT) * 1000000).alias("deadline"),
    )
    finish(append_table(X.correlate_stream(asked, answers(feed), "1 hour"), root))
    out = spark.read.schema("request_id string, error_code string, error_message string").parquet(f"{root}/data")
    return out.filter(F.col("request_id") != f"r{CLOSING}")


@query(
    "stream_dedupe",
    "SELECT 'r' || event_id AS request_id FROM events WHERE event_id % 10 <> 0",
)
def stream_dedupe(spark, d):
    root = scratch_path(spark, "dedupe")
    finish(append_table(X.dedupe_results(answers(event_stream(spark, d)), "1 hour", "res_ts"), root))
    return spark.read.schema("request_id string").parquet(f"{root}/data")


@query(
    "stream_aimd",
    sql('SELECT endpoint, st[1] AS "limit", st[2] AS run, st[5] AS limit_sum FROM a', "results", ctes=f"a AS ({AIMD})"),
)
def stream_aimd(spark, d):
    """State and trace of the adaptive limit after the stream of results."""
    root = scratch_path(spark, "aimd")
    rows = adaptive.signals(res.to_results(views.outcomes_of(views.stream(spark, d, "lineitem"))), ORDER)
    finish(X.aimd_stream(rows, ORDER, root))
    state = newest(read_batches(spark, f"{root}/state", "endpoint string, `limit` long, run long, batch int"), ["endpoint"])
    trace = spark.read.schema("endpoint string, `limit` long").parquet(f"{root}/data/batch=*")
    sums = trace.groupBy("endpoint").agg(F.sum("limit").alias("limit_sum"))
    return state.join(sums, "endpoint")


CAUSES = """
 SELECT 'batch_' || (event_id % 4000) AS job_id, CASE WHEN event_type = 'error' THEN 'shutdown' ELSE 'cancelled' END AS cause,
        epoch(ts)::BIGINT - 200000000 + event_id AS ts FROM events"""


def stop_events(e):
    return e.select(
        F.concat(F.lit("batch_"), (F.col("event_id") % 4000).cast("string")).alias("job_id"),
        F.when(F.col("event_type") == "error", F.lit("shutdown")).otherwise(F.lit("cancelled")).alias("cause"),
        (F.unix_seconds("ts") - 200000000 + F.col("event_id")).alias("ts"),
    )


@query(
    "stream_causes",
    sql(
        """SELECT job_id, min(eff) AS ts, arg_min(c, (eff, c)) AS cause FROM (
             SELECT e.job_id, CASE WHEN d <= ts THEN d ELSE ts END AS eff, CASE WHEN d <= ts THEN 'expired' ELSE cause END AS c
             FROM (SELECT job_id, cause, ts FROM causes) e
             LEFT JOIN (SELECT id, CASE WHEN priority > 0 THEN priority // 1000000 END AS d FROM jobs) j ON j.id = e.job_id)
           GROUP BY job_id""",
        "jobs",
        ctes=f"causes AS ({CAUSES.replace('epoch(ts)::BIGINT', 'floor(epoch(ts))::BIGINT')})",
    ),
)
def stream_causes(spark, d):
    root = scratch_path(spark, "causes")
    jobs = views.jobs(spark, d).select(F.col("id").alias("job_id"), F.col("priority").alias("deadline"))
    finish(X.cause_stream(stop_events(event_stream(spark, d)), jobs, root))
    return newest(read_batches(spark, f"{root}/data", "job_id string, ts long, cause string, batch int"), ["job_id"])


@query(
    "stream_rate",
    """SELECT epoch(s)::BIGINT AS start, event_type, round(count(*) / 3600.0, 8) AS rate
       FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s
             FROM events)
       GROUP BY s, event_type""",
)
def stream_rate(spark, d):
    """Events per second in one-hour windows sliding by 30 minutes."""
    root = scratch_path(spark, "rate")
    rates = X.rate_stream(closed_events(spark, d), ["event_type"], "1 hour", "30 minutes", "1 hour", 3600.0)
    finish(append_table(rates, root))
    out = spark.read.schema("start timestamp, event_type string, rate double").parquet(f"{root}/data")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", F.round("rate", 8).alias("rate"))


@query(
    "stream_fan_out",
    """SELECT 'job_' || (user_id % 50) AS job_id, sum(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END)::BIGINT AS results
       FROM events WHERE event_id % 10 <> 0 GROUP BY 1""",
)
def stream_fan_out(spark, d):
    from .execution import event_requests

    root = scratch_path(spark, "fan-out")
    finish(append_table(X.fan_out(answers(event_stream(spark, d)), event_requests(spark, d)), root))
    out = spark.read.schema("request_id string, job_id string").parquet(f"{root}/data")
    return out.groupBy("job_id").agg(F.count(F.lit(1)).alias("results"))


@query(
    "stream_late_results",
    """SELECT late, count(*)::BIGINT AS results FROM (
         SELECT unnest(CASE WHEN event_id % 7 = 0 THEN [round(value * 6e6), round(value * 6e6) + 1e6] ELSE [round(value * 6e6)] END)
                > (CASE WHEN event_id % 3 = 0 THEN 300e6 ELSE 1e12 END) AS late
         FROM events WHERE event_id % 10 <> 0) GROUP BY late""",
)
def stream_late_results(spark, d):
    """Results that arrive after their request was given up are told apart and counted."""
    root = scratch_path(spark, "late")
    closed = views.table(spark, d, "events").filter("event_id % 3 = 0").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + 300000000).alias("closed_at"),
    )
    stream = answers(event_stream(spark, d)).withColumnRenamed("res_ts", "ts")
    finish(append_table(X.late_results(stream, closed), root))
    out = spark.read.schema("late boolean").parquet(f"{root}/data")
    return out.groupBy("late").agg(F.count(F.lit(1)).alias("results"))


@query(
    "stream_result_messages",
    """SELECT CASE WHEN event_id % 5 = 0 THEN 'deadline' END AS error_code, count(*)::BIGINT AS results FROM events GROUP BY 1""",
)
def stream_result_messages(spark, d):
    """Result messages written as JSON files, read as a stream and turned into results."""
    e = views.table(spark, d, "events")
    feed, root = scratch_path(spark, "messages"), scratch_path(spark, "results")
    gone = F.col("event_id") % 5 == 0
    e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(~gone, F.col("props")).alias("payload"),
        F.when(gone, 0).otherwise(200).alias("status_code"),
        F.when(gone, F.lit("deadline")).alias("error_code"),
        F.col("ts").cast("timestamp").alias("ts"),
    ).write.json(feed)
    finish(append_table(res.to_async_results(feeds.read_results_stream(spark, feed)), root))
    out = spark.read.schema("error struct<code: string, message: string>").parquet(f"{root}/data")
    return out.groupBy(F.col("error.code").alias("error_code")).agg(F.count(F.lit(1)).alias("results"))


@query(
    "stream_events",
    """SELECT 'job_' || user_id AS job_id, event_type AS type, min(floor(epoch(ts))::BIGINT) AS first_ts, count(*)::BIGINT AS events
       FROM events WHERE floor(epoch(ts))::BIGINT + 864000 > 1706400000 GROUP BY 1, 2""",
)
def stream_events(spark, d):
    """Job events of every type from JSON files as a stream; those past their time to live do not count."""
    feed, root = scratch_path(spark, "events"), scratch_path(spark, "live")
    job_events(spark, d).drop("seq").write.json(feed)
    live = feeds.live_events(feeds.read_events_stream(spark, feed), 1706400000)
    finish(append_table(live, root))
    out = spark.read.schema("job_id string, type string, ts long").parquet(f"{root}/data")
    return out.groupBy("job_id", "type").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("events"))


def job_events(spark, d):
    """The events table as job events; each job numbers its own from 1."""
    own = W.partitionBy("user_id").orderBy("event_id")
    return views.table(spark, d, "events").select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_type").alias("type"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.lit(864000).cast("long").alias("ttl"),
        F.row_number().over(own).cast("long").alias("seq"),
    )


@query(
    "stream_events_in_order",
    """SELECT job_id, seq, event_type AS type, ts, sum(seq) OVER (PARTITION BY job_id ORDER BY seq)::BIGINT AS seen FROM (
         SELECT 'job_' || user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type,
                floor(epoch(ts))::BIGINT AS ts FROM events)""",
)
def stream_events_in_order(spark, d):
    """Numbered job events that arrive out of order, in the order they leave the stream: `seen` adds up the numbers."""
    feed, root = scratch_path(spark, "numbered"), scratch_path(spark, "ordered")
    job_events(spark, d).orderBy(F.xxhash64("job_id", "seq")).write.json(feed)
    events = feeds.read_events_stream(spark, feed, numbered=True)
    act = lambda rows, n: write_batch(rows.withColumn("at", F.monotonically_increasing_id()), f"{root}/data", n)
    finish(each_batch(stateful.in_order(events, 3600, V.EVENT_TTL), root, act))
    out = read_batches(spark, f"{root}/data", f"{stateful.ORDERED}, at long, batch int")
    upto = W.partitionBy("job_id").orderBy("batch", "at").rowsBetween(W.unboundedPreceding, 0)
    return out.select("job_id", "seq", "type", "ts", F.sum("seq").over(upto).alias("seen"))


@query(
    "stream_ingest",
    sql(
        """SELECT v.file_id, v.lines, v.ok, CASE WHEN v.ok THEN p.entries END AS entries FROM (
             SELECT file_id, count(*)::BIGINT AS lines, count(error_rule) = 0 AS ok FROM checked GROUP BY 1) v
           LEFT JOIN (SELECT file_id, count(*) FILTER (model IN ('m0', 'm1'))::BIGINT AS entries FROM requests GROUP BY 1) p
             ON p.file_id = v.file_id""",
        "checked",
    ),
)
def stream_ingest(spark, d):
    """Request files land in a folder and are validated and planned file by file."""
    feed, root = scratch_path(spark, "inbox"), scratch_path(spark, "ingested")
    lines = src.request_lines(views.requests(spark, d))
    placed = lines.repartitionByRange("file_id").sortWithinPartitions("file_id", "line_no")
    placed.select("file_id", "value").write.partitionBy("file_id").text(feed)
    name = lambda p: F.regexp_extract(p, "file_id=([^/]+)", 1)
    finish(X.ingest_stream(spark, f"{feed}/*", root, gateways(spark), name))
    verdict = read_batches(spark, f"{root}/verdict", "file_id string, lines long, ok boolean, batch int")
    plan = read_batches(spark, f"{root}/plan", "file_id string, batch int")
    entries = plan.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"))
    return verdict.join(entries, "file_id", "left").select("file_id", "lines", "ok", "entries")
