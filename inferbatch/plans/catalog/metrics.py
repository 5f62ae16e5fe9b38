"""Queries over metrics: counts, histograms, rates, dashboards, alerts, adaptive limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import scalars as S
from ...functions import values as V
from ...operators import adaptive
from ...operators import observe as O
from ...session import materialize
from .. import dashboards as D
from .. import views
from . import query
from .execution import results
from .sqlviews import sql

STEP = 21600  # events are minutes apart at the small scale: panels are evaluated every 6 hours


def _bounds(layout) -> list[float]:
    return S.exponential_bounds(*layout) if isinstance(layout, tuple) else layout


def _labelled(df):
    """Bucket bounds as text, the last one as +Inf."""
    le = F.when(F.col("le") == O.INF, F.lit("+Inf")).otherwise(F.round("le", 6).cast("string"))
    return df.withColumn("le", le)


def histogram_sql(source: str, value: str, layout, by: str) -> str:
    """Cumulative buckets in SQL: every bound against every group's values."""
    bounds = ", ".join(f"({b!r}::DOUBLE, '{round(b, 6)}')" for b in _bounds(layout))
    group = f"{by}, " if by else ""
    return f"""SELECT {group}le, count(*) FILTER (v <= bound)::BIGINT AS count, round(sum(v), 3) AS sum
      FROM (SELECT {group}{value}::DOUBLE AS v FROM {source} WHERE {value} IS NOT NULL),
           (VALUES {bounds}, ('Infinity'::DOUBLE, '+Inf')) AS b(bound, le)
      GROUP BY {group}le"""


LATENCY = """
 SELECT id, status, k, CASE status WHEN 'completed' THEN 1200 WHEN 'failed' THEN 300 WHEN 'expired' THEN 172800
          WHEN 'cancelled' THEN 900 END::BIGINT AS e2e, k % 500 AS queue_wait FROM jobs WHERE created_at > 0"""


def latencies(spark, d):
    j = views.jobs(spark, d)
    claimed = F.col("spec.created_at") + F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 500
    return O.job_latency(j.withColumn("claimed_at", claimed), "claimed_at")


@query("job_latency", sql("SELECT id, status, e2e, queue_wait FROM l", "jobs", ctes=f"l AS ({LATENCY})"))
def job_latency(spark, d):
    return latencies(spark, d)


@query(
    "histogram_queue_wait",
    sql(histogram_sql("l", "queue_wait", V.QUEUE_WAIT_BUCKETS, ""), "jobs", ctes=f"l AS ({LATENCY})"),
)
def histogram_queue_wait(spark, d):
    h = O.histogram(latencies(spark, d), "queue_wait", _bounds(V.QUEUE_WAIT_BUCKETS))
    return _labelled(h).withColumn("sum", F.round("sum", 3))


@query(
    "histogram_e2e",
    sql(histogram_sql("l", "e2e", V.E2E_BUCKETS, "status"), "jobs", ctes=f"l AS ({LATENCY})"),
)
def histogram_e2e(spark, d):
    h = O.histogram(latencies(spark, d), "e2e", _bounds(V.E2E_BUCKETS), ["status"])
    return _labelled(h).withColumn("sum", F.round("sum", 3))


@query(
    "histogram_processing_by_size",
    histogram_sql(
        """(SELECT o_totalprice AS v0, CASE WHEN o_custkey * 37 < 100 THEN '100' WHEN o_custkey * 37 < 1000 THEN '1000'
              WHEN o_custkey * 37 < 10000 THEN '10000' WHEN o_custkey * 37 < 30000 THEN '30000' ELSE 'large' END AS size_bucket
            FROM orders)""",
        "v0",
        V.PROCESSING_BUCKETS,
        "size_bucket",
    ),
)
def histogram_processing_by_size(spark, d):
    o = views.table(spark, d, "orders").select(
        F.col("o_totalprice").alias("v0"), S.size_bucket(F.col("o_custkey") * 37).alias("size_bucket")
    )
    h = O.histogram(o, "v0", _bounds(V.PROCESSING_BUCKETS), ["size_bucket"])
    return _labelled(h).withColumn("sum", F.round("sum", 3))


@query(
    "histogram_request_duration",
    histogram_sql("(SELECT event_type AS model, value FROM events)", "value", V.PROCESSING_BUCKETS, "model"),
)
def histogram_request_duration(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_type").alias("model"), "value")
    return _labelled(O.histogram(e, "value", _bounds(V.PROCESSING_BUCKETS), ["model"])).withColumn("sum", F.round("sum", 3))


@query(
    "histogram_reconcile",
    histogram_sql("events", "value", V.RECONCILE_BUCKETS, ""),
)
def histogram_reconcile(spark, d):
    e = views.table(spark, d, "events")
    return _labelled(O.histogram(e, "value", _bounds(V.RECONCILE_BUCKETS))).withColumn("sum", F.round("sum", 3))


@query(
    "histogram_http",
    histogram_sql("(SELECT event_type AS path, value / 50 AS value FROM events)", "value", V.HTTP_BUCKETS, "path"),
)
def histogram_http(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_type").alias("path"), (F.col("value") / 50).alias("value"))
    return _labelled(O.histogram(e, "value", _bounds(V.HTTP_BUCKETS), ["path"])).withColumn("sum", F.round("sum", 3))


def quantile_sql(buckets: str, by: str, quantiles) -> str:
    """Quantiles from cumulative (by, bound, n) rows, one aggregate per quantile."""
    parts = []
    for q in quantiles:
        parts.append(
            f"""min_by(CASE WHEN bound = 'Infinity' THEN low ELSE low + (bound - low) * ({q} * total - below) / (n - below) END,
                bound) FILTER (n >= {q} * total AND total > 0) AS p{round(q * 100):02d}"""
        )
    key = by or "1"
    group = f"{by}, " if by else ""
    out = ", ".join(f"round({p.rsplit(' AS ', 1)[0]}, 6) AS {p.rsplit(' AS ', 1)[1]}" for p in parts)
    return f"""SELECT {group}{out} FROM (
      SELECT *, max(n) OVER (PARTITION BY {key}) AS total,
             coalesce(lag(n) OVER (PARTITION BY {key} ORDER BY bound), 0) AS below,
             coalesce(lag(bound) OVER (PARTITION BY {key} ORDER BY bound), 0) AS low
      FROM (SELECT * REPLACE (max(n) OVER (PARTITION BY {key} ORDER BY bound) AS n) FROM {buckets}))
      {'GROUP BY ' + by if by else ''}"""


def buckets_cte(source: str, value: str, layout, by: str) -> str:
    bounds = ", ".join(f"({b!r}::DOUBLE)" for b in _bounds(layout))
    group = f"{by}, " if by else ""
    return f"""buckets AS (SELECT {group}bound, count(*) FILTER ({value} <= bound)::DOUBLE AS n
      FROM {source}, (VALUES {bounds}, ('Infinity'::DOUBLE)) AS b(bound) GROUP BY {group}bound)"""


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "histogram_quantile",
    sql(
        quantile_sql("buckets", "event_type", (0.5, 0.95, 0.99)),
        ctes=buckets_cte("events", "value", V.PROCESSING_BUCKETS, "event_type"),
    ),
)
def histogram_quantile(spark, d):
    e = views.table(spark, d, "events")
    h = O.histogram(e, "value", _bounds(V.PROCESSING_BUCKETS), ["event_type"])
    return rounded(O.histogram_quantile(h, (0.5, 0.95, 0.99), ["event_type"]), "p50", "p95", "p99")


@query(
    "exact_quantiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
         round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
       FROM lineitem GROUP BY l_returnflag""",
)
def exact_quantiles(spark, d):
    li = views.table(spark, d, "lineitem")
    q = O.exact_quantiles(li, "l_extendedprice", (0.5, 0.95, 0.99), ["l_returnflag"])
    return q.withColumns({n: F.round(n, 4) for n in ("p50", "p95", "p99")})


@query(
    "cancellations",
    sql("SELECT 'in_progress' AS phase, count(*)::BIGINT AS jobs FROM jobs WHERE status = 'cancelled'", "jobs"),
)
def cancellations(spark, d):
    return O.cancellations(views.jobs(spark, d))


@query(
    "storage_ops",
    """SELECT event_type AS operation, 'c' || (user_id % 3) AS component,
         CASE WHEN event_id % 9 = 0 THEN 'retry' ELSE 'success' END AS status, count(*)::BIGINT AS operations
       FROM events GROUP BY 1, 2, 3""",
)
def storage_ops(spark, d):
    e = views.table(spark, d, "events").select(
        F.col("event_type").alias("operation"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("component"),
        F.when(F.col("event_id") % 9 == 0, F.lit("retry")).otherwise(F.lit("success")).alias("status"),
    )
    return O.storage_ops(e)


def http_rows(spark, d):
    k = F.col("event_id")
    return views.table(spark, d, "events").select(
        views.pick(k % 2, "GET", "POST").alias("method"),
        F.concat(F.lit("/v1/"), "event_type").alias("path"),
        views.pick(k % 6, "200", "200", "200", "404", "429", "500").alias("status"),
    )


HTTP = """
 SELECT (['GET', 'POST'])[(event_id % 2 + 1)::INT] AS method, '/v1/' || event_type AS path,
        (['200', '200', '200', '404', '429', '500'])[(event_id % 6 + 1)::INT] AS status FROM events"""


@query(
    "http_traffic",
    sql("SELECT method, path, status, count(*)::BIGINT AS requests FROM h GROUP BY 1, 2, 3", ctes=f"h AS ({HTTP})"),
)
def http_traffic(spark, d):
    return O.http_traffic(http_rows(spark, d))


@query(
    "http_error_share",
    sql(
        """SELECT path, count(*)::BIGINT AS requests, count(*) FILTER (status <> '200')::BIGINT AS errors,
             round(count(*) FILTER (status <> '200') / count(*), 6) AS share FROM h GROUP BY path""",
        ctes=f"h AS ({HTTP})",
    ),
)
def http_error_share(spark, d):
    return rounded(O.http_error_share(http_rows(spark, d)), "share")


@query(
    "utilisation",
    """SELECT p_brand AS pool, sum(p_size)::BIGINT AS used, sum(p_size + p_partkey % 7)::BIGINT AS total,
         round(sum(p_size) / greatest(sum(p_size + p_partkey % 7), 100.0), 6) AS ratio FROM part GROUP BY p_brand""",
)
def utilisation(spark, d):
    p = views.table(spark, d, "part").select(
        F.col("p_brand").alias("pool"),
        F.col("p_size").cast("long").alias("active"),
        (F.col("p_size") + F.col("p_partkey") % 7).alias("capacity"),
    )
    return rounded(O.utilisation(p, "active", "capacity", ["pool"], floor=100.0), "ratio")


# Reset-aware growth per sample of the event counters.
DELTAS = """
 SELECT *, CASE WHEN before IS NULL THEN 0 WHEN value >= before THEN value - before ELSE value END AS delta
 FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, seq) AS before FROM samples)"""


def windowed(source: str, by: str, window: int, step: int, value: str = "delta") -> str:
    """Sums of `value` over a window at every step that sees a sample."""
    group = f"{by}, " if by else ""
    return f"""SELECT {group}t0 + a AS t, sum({value}) AS increase FROM (
        SELECT {group}(ceil(ts / {step}::DOUBLE) * {step})::BIGINT AS t0, sum({value}) AS {value} FROM {source} GROUP BY ALL),
        (SELECT unnest(range(0, {window}, {step})) AS a) GROUP BY ALL"""


@query(
    "counter_deltas",
    sql("SELECT series, ts, seq, value, delta FROM deltas", "samples", ctes=f"deltas AS ({DELTAS})"),
)
def counter_deltas(spark, d):
    return O.counter_deltas(views.samples(spark, d), ["series"]).select("series", "ts", "seq", "value", "delta")


@query(
    "counter_increase",
    sql(windowed("deltas", "series", 2 * STEP, STEP), "samples", ctes=f"deltas AS ({DELTAS})"),
)
def counter_increase(spark, d):
    return O.counter_increase(views.samples(spark, d), ["series"], ["series"], 2 * STEP, STEP)


@query(
    "counter_rate",
    sql(
        f"SELECT t, round(increase / {STEP}, 6) AS rate FROM ({windowed('deltas', '', STEP, STEP)})",
        "samples",
        ctes=f"deltas AS ({DELTAS})",
    ),
)
def counter_rate(spark, d):
    """Growth per second summed over all series."""
    return rounded(O.counter_rate(views.samples(spark, d), ["series"], [], STEP, STEP), "rate")


def sustained_sql(evaluated: str, hold: int, step: int, by: str = "") -> str:
    """Runs of consecutive true evaluations: (by, t, since, fires)."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {keys}t, since, t - since >= {hold} AS fires FROM (
        SELECT {keys}t, min(t) OVER (PARTITION BY {keys}t - n * {step}) AS since FROM (
          SELECT {keys}t, row_number() OVER ({part}ORDER BY t) AS n FROM ({evaluated}) WHERE on_))"""


@query(
    "sustained",
    sql(
        sustained_sql(f"SELECT t, increase > 700 AS on_ FROM ({windowed('deltas', '', 2 * STEP, STEP)})", 3 * STEP, STEP),
        "samples",
        ctes=f"deltas AS ({DELTAS})",
    ),
)
def sustained(spark, d):
    inc = O.counter_increase(views.samples(spark, d), ["series"], [], 2 * STEP, STEP)
    return O.sustained(inc.withColumn("on_", F.col("increase") > 700), "on_", 3 * STEP, STEP)


GAUGE = "SELECT event_type AS metric, 'p' || (user_id % 3) AS priority, epoch(ts)::BIGINT AS ts, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events"


def gauges(spark, d):
    e = views.table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("metric"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("priority"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )


@query(
    "series_stats",
    sql(
        """SELECT metric, priority, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*)::BIGINT AS samples
           FROM g WHERE NOT isnan(value) GROUP BY metric, priority""",
        ctes=f"g AS ({GAUGE})",
    ),
)
def series_stats(spark, d):
    return rounded(O.series_stats(gauges(spark, d), ["metric", "priority"]), "avg")


@query(
    "series_points",
    sql(
        """SELECT metric, seq, value, row_number() OVER (PARTITION BY metric ORDER BY seq) AS position
           FROM g WHERE NOT isnan(value)""",
        ctes=f"g AS ({GAUGE})",
    ),
)
def series_points(spark, d):
    return O.series_points(gauges(spark, d), ["metric"], ["seq"])


# --- dashboards and alerts over a sample table made from events --------------------


def counter(spark, d, metric: str, labels: dict):
    """One counter metric: a series per distinct label set, reset every 1,000 events."""
    e = views.table(spark, d, "events")
    return e.select(
        F.lit(metric).alias("metric"),
        D.label_map(labels).alias("labels"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.lit(None).cast("double").alias("le"),
        (F.col("event_id") % 1000).cast("double").alias("value"),
    )


def gauge(spark, d, metric: str, labels: dict, value):
    return counter(spark, d, metric, labels).withColumn("value", value)


def bucketed(spark, d, metric: str, labels: dict, layout):
    """One histogram metric: bucket i of n holds the share (i+1)/n of the running count."""
    bounds = [*_bounds(layout), O.INF]
    n = len(bounds)
    rows = counter(spark, d, metric, labels)
    buckets = F.array(
        *[
            F.struct(F.lit(b).alias("le"), F.floor(F.col("value") * (i + 1) / n).cast("double").alias("value"))
            for i, b in enumerate(bounds)
        ]
    )
    return rows.select("metric", "labels", "ts", "seq", F.inline(buckets))


def counter_sql(labels: dict[str, str], where: str = "true") -> str:
    """The counter samples as SQL with labels as columns and `series` over all labels."""
    cols = ", ".join(f"{e} AS {n}" for n, e in labels.items())
    ident = " || '|' || ".join(f"({e})" for e in labels.values()) or "''"
    return f"""samples AS (SELECT {cols + ', ' if cols else ''}{ident} AS series, floor(epoch(ts))::BIGINT AS ts, event_id AS seq,
      (event_id % 1000)::DOUBLE AS value FROM events WHERE {where}), deltas AS ({DELTAS})"""


def rate_sql(labels: dict[str, str], by: list[str], where: str = "true", step: int = STEP) -> str:
    group = ", ".join(by)
    keys = f"{group}, " if by else ""
    return sql(
        f"SELECT {keys}t, round(increase / {step}, 6) AS rate FROM ({windowed('deltas', group, step, step)})",
        ctes=counter_sql(labels, where),
    )


def quantile_panel_ctes(labels: dict[str, str], by: str, layout, step: int) -> str:
    bounds = [*_bounds(layout), float("inf")]
    n = len(bounds)
    values = ", ".join(f"({'Infinity' if b == float('inf') else repr(b)!s}, {i + 1})" for i, b in enumerate(bounds)).replace(
        "Infinity", "'Infinity'::DOUBLE"
    )
    cols = ", ".join(f"{e} AS {name}" for name, e in labels.items())
    ident = " || '|' || ".join(f"({e})" for e in labels.values()) or "''"
    group = f"{by}, " if by else ""
    return f"""samples AS (SELECT {cols + ', ' if cols else ''}{ident} || '|' || i AS series, bound, floor(epoch(ts))::BIGINT AS ts,
        event_id AS seq, floor(event_id % 1000 * i / {n}.0) AS value FROM events, (VALUES {values}) AS b(bound, i)),
      deltas AS ({DELTAS}),
      buckets AS (SELECT {group}t, bound, increase AS n FROM ({windowed('deltas', group + 'bound', step, step)}))"""


def quantile_panel_sql(labels: dict[str, str], by: str, layout, quantiles=(0.5, 0.95, 0.99), step: int = STEP) -> str:
    keys = f"{by}, t" if by else "t"
    return sql(quantile_sql("buckets", keys, quantiles), ctes=quantile_panel_ctes(labels, by, layout, step))


def last_sql(labels: dict[str, str], by: list[str], value: str = "value", step: int = STEP) -> str:
    group = "".join(f"{b}, " for b in by)
    return sql(
        f"""SELECT {group}t, sum(value) AS value FROM (
              SELECT {group}series, (ceil(ts / {step}::DOUBLE) * {step})::BIGINT AS t, max_by({value}, (ts, seq)) AS value
              FROM samples GROUP BY ALL) GROUP BY ALL""",
        ctes=counter_sql(labels),
    )


def user_mod(n: int):
    return F.concat(F.lit("u"), (F.col("user_id") % n).cast("string"))


JOB_RESULT = ["success", "failed", "expired"]
JOB_LABELS = {
    "result": "(['success', 'failed', 'expired'])[(user_id % 3 + 1)::INT]",
    "reason": "CASE WHEN user_id % 3 = 0 THEN 'none' ELSE 'system_error' END",
}


def job_counter(spark, d):
    u = F.col("user_id") % 3
    reason = F.when(u == 0, F.lit("none")).otherwise(F.lit("system_error"))
    return counter(spark, d, "jobs_processed_total", {"result": views.pick(u, *JOB_RESULT), "reason": reason})


OPTIONS = {"window": STEP, "step": STEP}


@query("dashboard_jobs", rate_sql(JOB_LABELS, ["result", "reason"]))
def dashboard_jobs(spark, d):
    return rounded(D.panel(job_counter(spark, d), "d1", "jobs", **OPTIONS), "rate")


def _quantile_query(name, dashboard, panel, metric, layout, labels=None, by="", quantiles=(0.5, 0.95, 0.99)):
    sql_labels = {"model": "event_type"} if by == "model" else {"status": "event_type"} if by == "status" else {}

    @query(name, quantile_panel_sql(sql_labels, by, layout, quantiles))
    def build(spark, d):
        rows = bucketed(spark, d, metric, {by: "event_type"} if by else {}, layout)
        return rounded(D.panel(rows, dashboard, panel, **OPTIONS), *[f"p{round(q * 100):02d}" for q in quantiles])

    return build


_quantile_query("dashboard_processing", "d2", "processing", "job_processing_duration_seconds_bucket", V.PROCESSING_BUCKETS)
_quantile_query("dashboard_queue_wait", "d2", "queue_wait", "job_queue_wait_duration_seconds_bucket", V.QUEUE_WAIT_BUCKETS)
_quantile_query("dashboard_plan_build", "d2", "plan_build", "plan_build_duration_seconds_bucket", V.PROCESSING_BUCKETS)
_quantile_query("dashboard_e2e", "d3", "e2e", "batch_job_e2e_latency_seconds_bucket", V.E2E_BUCKETS, by="status")
_quantile_query(
    "dashboard_request_duration",
    "d4",
    "duration",
    "model_request_execution_duration_seconds_bucket",
    V.PROCESSING_BUCKETS,
    by="model",
    quantiles=(0.95,),
)
_quantile_query("dashboard_reconcile_cycle", "d9", "cycle", "batch_reconciler_cycle_duration_seconds_bucket", V.RECONCILE_BUCKETS)
_quantile_query("dashboard_http_latency", "d10", "latency", "http_request_duration_seconds_bucket", V.HTTP_BUCKETS)


def user_label():
    return user_mod(3)


def _columns(labels: dict) -> dict:
    """Label columns; functions are called here because columns need a running session."""
    return {name: make() if callable(make) else make for name, make in labels.items()}


def _curves(spec: D.Panel, labels: dict) -> list[str]:
    """The labels that tell a panel's curves apart."""
    return list(labels) if spec.each else list(spec.by)


def _named(rows, spec: D.Panel, labels: dict):
    """A curve per series has the series' labels as columns."""
    if not spec.each:
        return rows
    return rows.withColumns({name: F.get_json_object("series", f"$.{name}") for name in labels}).drop("series")


def _rate_query(name, dashboard, panel, labels: dict, sql_labels: dict, where: str = "true"):
    spec = D.PANELS[dashboard][panel]

    @query(name, rate_sql(sql_labels, _curves(spec, sql_labels), where))
    def build(spark, d):
        rows = counter(spark, d, spec.metric, _columns(labels))
        return rounded(_named(D.panel(rows, dashboard, panel, **OPTIONS), spec, labels), "rate")

    return build


def _last_query(name, dashboard, panel, labels: dict, sql_labels: dict):
    spec = D.PANELS[dashboard][panel]

    @query(name, last_sql(sql_labels, _curves(spec, sql_labels)))
    def build(spark, d):
        return _named(D.panel(counter(spark, d, spec.metric, _columns(labels)), dashboard, panel, step=STEP), spec, labels)

    return build


U3, U3_SQL = user_label, "'u' || (user_id % 3)"
_rate_query("dashboard_model_errors", "d4", "errors", {"model": "event_type"}, {"model": "event_type"})
_last_query("dashboard_model_inflight", "d4", "inflight", {"model": "event_type", "pod": U3}, {"model": "event_type", "pod": U3_SQL})
_rate_query(
    "dashboard_storage_retries",
    "d6",
    "storage_retries",
    {
        "operation": "event_type",
        "status": lambda: views.pick(F.col("user_id") % 2, "retry", "success"),
        "component": lambda: F.lit("processor"),
    },
    {"operation": "event_type"},
    "user_id % 2 = 0",
)
_last_query(
    "dashboard_recoveries",
    "d6",
    "recoveries",
    {"status": "event_type", "action": U3},
    {"status": "event_type", "action": U3_SQL},
)
_rate_query("dashboard_cancellations", "d6", "cancellations", {"phase": U3}, {"phase": U3_SQL})
_rate_query("dashboard_prompt_tokens", "d7", "prompt", {"model": U3}, {"model": U3_SQL})
_rate_query("dashboard_generation_tokens", "d7", "generation", {"model": "event_type"}, {"model": "event_type"})
_last_query("dashboard_limit", "d8", "limit", {"endpoint": U3, "pod": "event_type"}, {"endpoint": U3_SQL, "pod": "event_type"})
_rate_query(
    "dashboard_limit_decreases",
    "d8",
    "decreases",
    {"endpoint": U3, "signal": "event_type"},
    {"endpoint": U3_SQL, "signal": "event_type"},
)
_rate_query("dashboard_limit_increases", "d8", "increases", {"endpoint": U3}, {"endpoint": U3_SQL})
_rate_query("dashboard_orphans_rate", "d9", "recovered_rate", {"action": "event_type"}, {"action": "event_type"})
_last_query("dashboard_orphans_total", "d9", "recovered_total", {"action": "event_type"}, {"action": "event_type"})
_rate_query("dashboard_reconciler_errors", "d9", "errors", {"pod": U3}, {"pod": U3_SQL})
_rate_query("dashboard_conflicts", "d9", "conflicts", {"pod": U3}, {"pod": U3_SQL})
_rate_query("dashboard_cleanups", "d9", "cleanups", {"pod": U3}, {"pod": U3_SQL})

HTTP_LABELS = {
    "method": lambda: views.pick(F.col("user_id") % 2, "GET", "POST"),
    "path": "event_type",
    "status": lambda: views.pick(F.col("user_id") % 4, "200", "404", "429", "500"),
}
HTTP_SQL = {
    "method": "(['GET', 'POST'])[(user_id % 2 + 1)::INT]",
    "path": "event_type",
    "status": "(['200', '404', '429', '500'])[(user_id % 4 + 1)::INT]",
}
_rate_query("dashboard_http_traffic", "d10", "traffic", HTTP_LABELS, HTTP_SQL)
_rate_query("dashboard_http_errors", "d10", "errors", HTTP_LABELS, HTTP_SQL, "user_id % 4 > 0")
_last_query("dashboard_http_inflight", "d10", "inflight", {"path": "event_type"}, {"path": "event_type"})

RATIO = """
 SELECT t, round(sum(a) / {denominator}, 6) AS ratio FROM (
   SELECT 'u' || (user_id % 3) AS series, (ceil(floor(epoch(ts)) / {step}::DOUBLE) * {step})::BIGINT AS t,
          max_by(floor(value), (floor(epoch(ts))::BIGINT, event_id)) AS a,
          max_by(floor(value) + event_id % 4, (floor(epoch(ts))::BIGINT, event_id)) AS b
   FROM events GROUP BY 1, 2) GROUP BY t"""


def workers(spark, d, used: str, total: str):
    v = F.floor("value").cast("double")
    active = views.table(spark, d, "events")
    base = active.select(
        D.label_map({"pod": user_label()}).alias("labels"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.lit(None).cast("double").alias("le"),
        F.array(
            F.struct(F.lit(used).alias("metric"), v.alias("value")),
            F.struct(F.lit(total).alias("metric"), (v + F.col("event_id") % 4).alias("value")),
        ).alias("m"),
    )
    return base.select("labels", "ts", "seq", "le", F.inline("m"))


@query("dashboard_workers", RATIO.format(denominator="nullif(sum(b), 0)", step=STEP))
def dashboard_workers(spark, d):
    rows = workers(spark, d, "active_workers", "total_workers")
    return rounded(D.panel(rows, "d5", "workers", step=STEP), "ratio")


@query("dashboard_inflight", RATIO.format(denominator="nullif(sum(b), 0)", step=STEP))
def dashboard_inflight(spark, d):
    rows = workers(spark, d, "processor_inflight_requests", "processor_max_inflight_concurrency")
    return rounded(D.panel(rows, "d5", "inflight", step=STEP), "ratio")


# Alerts are evaluated every hour; thresholds are set to where the sample data crosses them.
HOUR = 3600


@query(
    "alert_queue_wait",
    sql(
        sustained_sql(
            f"SELECT t, p95 > 45 AS on_ FROM ({quantile_sql('buckets', 't', (0.95,))})", 3 * HOUR, HOUR
        ),
        ctes=quantile_panel_ctes({}, "", V.QUEUE_WAIT_BUCKETS, HOUR),
    ),
)
def alert_queue_wait(spark, d):
    rows = bucketed(spark, d, "job_queue_wait_duration_seconds_bucket", {}, V.QUEUE_WAIT_BUCKETS)
    return D.high_queue_wait(rows, threshold=45.0, hold=3 * HOUR, step=HOUR, window=HOUR)


def share_sql(result: str, threshold: float, hold: int) -> str:
    rates = f"SELECT t, result, increase / 600 AS rate FROM ({windowed('deltas', 'result', 600, 300)})"
    share = f"""SELECT t, sum(CASE WHEN result = '{result}' THEN rate ELSE 0 END) / greatest(sum(rate), 0.001) > {threshold} AS on_
      FROM ({rates}) GROUP BY t"""
    return sql(sustained_sql(share, hold, 300), ctes=counter_sql(JOB_LABELS))


@query("alert_failure_rate", share_sql("failed", 0.1, 600))
def alert_failure_rate(spark, d):
    return D.high_failure_rate(job_counter(spark, d))


@query("alert_expired_jobs", share_sql("expired", 0.03, 600))
def alert_expired_jobs(spark, d):
    return D.expired_jobs(job_counter(spark, d))


@query(
    "alert_workers",
    sustained_sql(
        f"SELECT t, ratio > 0.9 AS on_ FROM ({RATIO.format(denominator='greatest(sum(b), 1)', step=HOUR)})", 3 * HOUR, HOUR
    ),
)
def alert_workers(spark, d):
    rows = workers(spark, d, "active_workers", "total_workers")
    return D.workers_saturated(rows, hold=3 * HOUR, step=HOUR)


@query(
    "alert_reconciler",
    sql(
        sustained_sql(
            f"SELECT series, t, increase > 0 AS on_ FROM ({windowed('deltas', 'series', 3900, 300)})", 300, 300, "series"
        ),
        ctes=counter_sql({"pod": "'u' || (user_id % 10)"}),
    ),
)
def alert_reconciler(spark, d):
    """Ten series, each judged on its own."""
    pod = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))
    rows = views.table(spark, d, "events").select(
        F.lit("batch_reconciler_errors_total").alias("metric"),
        D.label_map({"pod": pod}).alias("labels"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.lit(None).cast("double").alias("le"),
        (F.col("event_id") % 1000).cast("double").alias("value"),
    )
    return D.reconciler_errors(rows).withColumn("series", F.get_json_object("series", "$.pod"))


# --- adaptive limit ---------------------------------------------------------------

# The fold keeps [limit, run, increases, failures, sum of limits]; signals are 1 for success.
AIMD = """
 SELECT endpoint, list_reduce(list_prepend([10, 0, 0, 0, 0]::BIGINT[], list([s, 0, 0, 0, 0]::BIGINT[] ORDER BY ts, request_id)),
   lambda a, x: CASE
     WHEN x[1] = 0 THEN [greatest(5, a[1] // 2), 0, a[3], a[4] + 1, a[5] + greatest(5, a[1] // 2)]
     WHEN a[2] + 1 >= a[1] THEN [least(a[1] + 1, 10), 0, a[3] + CASE WHEN a[1] < 10 THEN 1 ELSE 0 END, a[4], a[5] + least(a[1] + 1, 10)]
     ELSE [a[1], a[2] + 1, a[3], a[4], a[5] + a[1]] END) AS st
 FROM (SELECT endpoint, ts, request_id, CASE WHEN http_code = 429 OR http_code >= 500 OR (had_capacity_retry AND http_code = 200) THEN 0 ELSE 1 END AS s
       FROM results WHERE http_code IS NOT NULL) GROUP BY endpoint"""

ORDER = ["ts", "request_id"]


def trace(spark, d):
    return adaptive.aimd_trace(adaptive.signals(results(spark, d), ORDER), ORDER)


@query(
    "aimd_trace",
    sql(
        """SELECT endpoint, st[3] AS increases, st[4] AS failures, st[5] AS limit_sum FROM a""",
        "results",
        ctes=f"a AS ({AIMD})",
    ),
)
def aimd_trace(spark, d):
    """The limit after every result; summed per endpoint so that any wrong step shows."""
    return trace(spark, d).groupBy("endpoint").agg(
        F.count_if("raised").alias("increases"),
        F.count_if(F.col("signal") != adaptive.SUCCESS).alias("failures"),
        F.sum("limit").alias("limit_sum"),
    )


@query(
    "aimd_state",
    sql('SELECT endpoint, st[1] AS "limit", st[2] AS run FROM a', "results", ctes=f"a AS ({AIMD})"),
)
def aimd_state(spark, d):
    # The trace is read twice; written once, it is replayed once.
    return adaptive.aimd_state(materialize(trace(spark, d), "trace"), ORDER)


@query(
    "aimd_signals",
    sql(
        """SELECT endpoint, 'increase' AS kind, NULL AS signal, st[3] AS events FROM a WHERE st[3] > 0
           UNION ALL SELECT endpoint, 'decrease', CASE WHEN http_code = 429 THEN '429' WHEN http_code >= 500 THEN '5xx'
             ELSE 'capacity_retry' END, count(*)::BIGINT FROM results
           WHERE http_code IS NOT NULL AND (http_code = 429 OR http_code >= 500 OR (had_capacity_retry AND http_code = 200)) GROUP BY 1, 2, 3""",
        "results",
        ctes=f"a AS ({AIMD})",
    ),
)
def aimd_signals(spark, d):
    return adaptive.aimd_signals(trace(spark, d))
