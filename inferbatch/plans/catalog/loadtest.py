"""Queries over load-test results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import scalars as S
from ...operators import loadtest as T
from ...operators.observe import exact_quantiles
from ...session import scratch_path
from ...sources import loadtest as src
from .. import views
from . import query
from .sqlviews import sql

DECILES = [i / 10 for i in range(11)]

# Phases made from events: burst in even hours, idle in odd ones, the cycle is the day, the
# scenario and the trial come from the user.
PHASES = """
 SELECT user_id % 7 AS scenario, user_id % 3 AS trial,
        CASE WHEN hour(ts) % 2 = 0 THEN 'burst' ELSE 'idle' END AS phase, day(ts)::BIGINT AS cycle, {cols}
        count(*) FILTER (event_type <> 'error') / 60.0 AS ok_rps, count(*) FILTER (event_type = 'error') / 60.0 AS err_rps,
        count(*) FILTER (event_type = 'error') / count(*) AS error_rate,
        count(*) FILTER (event_type <> 'error')::BIGINT AS completed, count(*) FILTER (event_type = 'error')::BIGINT AS errors
 FROM events GROUP BY 1, 2, 3, 4"""
FACTORS = {"ttft": 1.0, "tpot": 0.5, "itl": 0.25, "req_latency": 10.0}
PHASES = PHASES.format(
    cols="".join(
        f"quantile_cont(value, {q}) * {f} AS {name}_{p}, "
        for name, f in FACTORS.items()
        for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    )
)


def phases(spark, d):
    e = views.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    bad = F.col("event_type") == "error"
    keys = ["scenario", "trial", "phase", "cycle"]
    rows = e.select(
        (F.col("user_id") % 7).alias("scenario"),
        (F.col("user_id") % 3).alias("trial"),
        F.when(F.hour(ts) % 2 == 0, F.lit("burst")).otherwise(F.lit("idle")).alias("phase"),
        F.day(ts).cast("long").alias("cycle"),
        "value",
        bad.alias("bad"),
    )
    counts = rows.groupBy(*keys).agg(F.count_if(~F.col("bad")).alias("completed"), F.count_if("bad").alias("errors"))
    grouped = counts.join(exact_quantiles(rows, "value", (0.5, 0.95, 0.99), keys), keys)
    return grouped.select(
        *keys,
        *[(F.col(p) * f).alias(f"{n}_{p}") for n, f in FACTORS.items() for p in ("p50", "p95", "p99")],
        (F.col("completed") / 60.0).alias("ok_rps"),
        (F.col("errors") / 60.0).alias("err_rps"),
        (F.col("errors") / (F.col("completed") + F.col("errors"))).alias("error_rate"),
        "completed",
        "errors",
    )


def rounded(df, *names, digits=8):
    return df.withColumns({n: F.round(n, digits) for n in names})


def sql_rounded(names, agg="{}"):
    return ", ".join(f"round({agg.format(n)}, 8) AS {n}" for n in names)


@query(
    "aggregate_phases",
    sql(
        f"""SELECT scenario, {sql_rounded(T.PHASE_MEANS, 'avg({})')}, sum(completed)::BIGINT AS completed,
             sum(errors)::BIGINT AS errors, round(avg(error_rate), 8) AS error_rate
           FROM p WHERE phase LIKE '%burst%' GROUP BY scenario""",
        ctes=f"p AS ({PHASES})",
    ),
)
def aggregate_phases(spark, d):
    return rounded(T.aggregate_phases(phases(spark, d), "burst"), *T.PHASE_MEANS, "error_rate")


MEANS = [*T.PERCENTILES, "ok_rps", "error_rate"]


@query(
    "aggregate_trials",
    sql(
        f"""SELECT scenario, phase, cycle, count(*)::BIGINT AS trials, {sql_rounded(MEANS, 'avg({})')},
             (sum(completed) // count(*))::BIGINT AS completed, (sum(errors) // count(*))::BIGINT AS errors,
             round(CASE WHEN count(*) < 2 THEN 0 ELSE 1.96 * sqrt(var_samp(ttft_p99) / count(*)) END, 8) AS ttft_p99_ci,
             round(CASE WHEN count(*) < 2 THEN 0 ELSE 1.96 * sqrt(var_samp(tpot_p99) / count(*)) END, 8) AS tpot_p99_ci
           FROM p GROUP BY scenario, phase, cycle""",
        ctes=f"p AS ({PHASES})",
    ),
)
def aggregate_trials(spark, d):
    return rounded(T.aggregate_trials(phases(spark, d)), *MEANS, "ttft_p99_ci", "tpot_p99_ci")


def trials(spark, d):
    e = views.table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 7).alias("scenario"), (F.col("user_id") % 3).alias("trial")).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("user_id") % 21 > 8).alias("metrics")
    )


@query(
    "pick_trial",
    """SELECT scenario, arg_max(trial, points * 1000 - trial) AS timeline_trial,
         min(CASE WHEN metrics > 0 THEN trial END) AS metrics_trial
       FROM (SELECT user_id % 7 AS scenario, user_id % 3 AS trial, count(*) AS points,
               count(*) FILTER (user_id % 21 > 8) AS metrics FROM events GROUP BY 1, 2) GROUP BY scenario""",
)
def pick_trial(spark, d):
    return T.pick_trial(trials(spark, d))


LINES = """
 SELECT 'job-' || (user_id % 40) AS job, event_id AS ts, event_id AS n,
   CASE WHEN event_type = 'signup' AND user_id % 40 < 30 THEN 'end'
        WHEN event_type IN ('click', 'view') THEN 'progress' END AS kind, user_id % 40 AS j
 FROM events"""


def log_lines(spark, d):
    e = views.table(spark, d, "events")
    j = F.col("user_id") % 40
    n = F.col("event_id").cast("string")
    status = F.when(j % 2 == 0, F.lit("completed")).otherwise(F.lit("failed"))
    return e.select(
        F.concat(F.lit("job-"), j.cast("string")).alias("job"),
        F.col("event_id").alias("ts"),
        F.when((F.col("event_type") == "signup") & (j < 30), F.concat(F.lit("[batch] Terminal: "), status))
        .when(F.col("event_type").isin("click", "view"), F.concat(F.lit("poll completed="), n, F.lit("/20000 failed=0")))
        .when(F.col("event_type") == "error", F.lit("completed=none yet"))
        .otherwise(F.lit("waiting"))
        .alias("text"),
    )


LATEST = f"""
 SELECT job, CASE WHEN kind = 'progress' THEN n ELSE 0 END AS completed,
        CASE WHEN kind = 'progress' THEN 20000 ELSE 0 END::BIGINT AS total,
        CASE WHEN kind = 'end' THEN CASE WHEN j % 2 = 0 THEN 'completed' ELSE 'failed' END ELSE 'in_progress' END AS status
 FROM ({LINES}) WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC) = 1"""


@query("latest_progress", sql(LATEST))
def latest_progress(spark, d):
    return T.latest_progress(log_lines(spark, d))


@query(
    "progress_total",
    sql("SELECT sum(completed)::BIGINT AS completed, sum(total)::BIGINT AS total FROM l", ctes=f"l AS ({LATEST})"),
)
def progress_total(spark, d):
    return T.progress_total(T.latest_progress(log_lines(spark, d)))


COMPLETIONS = """
 SELECT user_id AS scenario, (['job-a', 'job-b', 'job-c'])[(event_id % 3 + 1)::INT] AS job,
        min(event_id * 40 + (event_id % 3) * 1000) AS elapsed
 FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""


def completions(spark, d):
    e = views.table(spark, d, "events")
    seen = e.select(
        F.col("user_id").alias("scenario"),
        views.pick(F.col("event_id") % 3, "job-a", "job-b", "job-c").alias("job"),
        (F.col("event_id") * 40 + F.col("event_id") % 3 * 1000).alias("elapsed"),
        F.when(F.col("event_type") == "purchase", F.lit("completed")).otherwise(F.lit("in_progress")).alias("status"),
    )
    return T.completion_times(seen, ["scenario", "job"])


@query("completion_times", sql("SELECT scenario, job, elapsed FROM c", ctes=f"c AS ({COMPLETIONS})"))
def completion_times(spark, d):
    return completions(spark, d)


REPORT = f"""c AS ({COMPLETIONS}),
 w(job, label, display, seconds) AS (VALUES ('job-a', 'A', '30m', 1800::BIGINT), ('job-b', 'B', '2h', 7200), ('job-c', 'C', '24h', 86400)),
 r AS (SELECT s.scenario, w.job, c.elapsed, w.seconds, c.elapsed <= w.seconds AS met, label, display
       FROM (SELECT DISTINCT user_id AS scenario FROM events) s CROSS JOIN w
       LEFT JOIN c ON c.scenario = s.scenario AND c.job = w.job)"""


def report(spark, d):
    scenarios = views.table(spark, d, "events").select(F.col("user_id").alias("scenario"))
    return T.slo_report(completions(spark, d), scenarios)


@query(
    "slo_report",
    sql(
        """SELECT scenario, job, elapsed, seconds, met, CASE WHEN elapsed IS NULL THEN label || ': — /' || display ELSE
             label || ': ' || CASE WHEN met THEN '✓' ELSE '✗' END || ' ' ||
             CASE WHEN elapsed < 60 THEN elapsed || 's' WHEN elapsed < 3600 THEN (elapsed // 60) || 'm'
                  WHEN elapsed // 60 % 60 = 0 THEN (elapsed // 3600) || 'h'
                  ELSE (elapsed // 3600) || 'h ' || (elapsed // 60 % 60) || 'm' END || '/' || display END AS summary FROM r""",
        ctes=REPORT,
    ),
)
def slo_report(spark, d):
    return report(spark, d)


@query(
    "slo_rate",
    sql(
        """SELECT f.scenario, count(elapsed)::BIGINT AS finished, count(*) FILTER (met)::BIGINT AS met,
             round(any_value(f.completion), 8) AS completion
           FROM (SELECT user_id AS scenario, count(*) FILTER (event_type = 'purchase') / count(*) * 100 AS completion
                 FROM events GROUP BY 1) f LEFT JOIN r ON r.scenario = f.scenario GROUP BY f.scenario""",
        ctes=REPORT,
    ),
)
def slo_rate(spark, d):
    final = views.table(spark, d, "events").groupBy(F.col("user_id").alias("scenario")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count(F.lit(1)).alias("total")
    )
    return rounded(T.slo_rate(report(spark, d), final), "completion")


@query(
    "vs_baseline",
    sql(
        """SELECT scenario, round(ttft_p99, 8) AS ttft_p99, round((ttft_p99 - base) / base * 100, 8) AS change_percent
           FROM a, (SELECT ttft_p99 AS base FROM a WHERE scenario = 0)""",
        ctes=f"a AS MATERIALIZED (SELECT scenario, avg(ttft_p99) AS ttft_p99 FROM ({PHASES}) WHERE phase = 'burst' GROUP BY 1)",
    ),
)
def vs_baseline(spark, d):
    burst = T.aggregate_phases(phases(spark, d), "burst")
    return rounded(T.vs_baseline(burst), "ttft_p99", "change_percent")


def triple_sql(name):
    parts = " || ' / ' || ".join(
        f"printf('%.0f', avg({name}_{p}) FILTER (phase = 'burst'))" for p in ("p50", "p95", "p99")
    )
    return parts


@query(
    "scenario_summary",
    sql(
        f"""SELECT scenario, {triple_sql('ttft')} AS ttft_burst, {triple_sql('itl')} AS itl_burst,
             printf('%.2f', sum(completed) FILTER (phase = 'idle') / 180.0) AS idle_rps,
             round(avg(error_rate) FILTER (phase = 'burst') * 100, 8) AS burst_error_percent,
             round(avg(error_rate) FILTER (phase = 'idle') * 100, 8) AS idle_error_percent
           FROM p GROUP BY scenario""",
        ctes=f"p AS ({PHASES})",
    ),
)
def scenario_summary(spark, d):
    out = T.scenario_summary(phases(spark, d), idle_seconds=90, cycles=4, warmup_cycles=2)
    return rounded(out, "burst_error_percent", "idle_error_percent")


PROBES = """
 SELECT user_id % 5 AS scenario, user_id % 9 * 5 + 1 AS rate, round(max(value) * (1 + user_id % 9 * (user_id % 5) / 8.0), 3) AS ttft_p99,
        count(*) FILTER (event_type = 'error') / count(*) / 6 AS error_rate,
        CASE WHEN user_id % 5 = 4 AND user_id % 9 = 6 THEN 0 ELSE count(*) END::BIGINT AS completed,
        user_id % 5 = 4 AND user_id % 9 = 6 AS failed FROM events GROUP BY user_id % 5, user_id % 9"""


def probes(spark, d):
    e = views.table(spark, d, "events")
    g = e.groupBy((F.col("user_id") % 5).alias("scenario"), (F.col("user_id") % 9).alias("r")).agg(
        F.max("value").alias("m"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count(F.lit(1)).alias("n")
    )
    failed = (F.col("scenario") == 4) & (F.col("r") == 6)
    return g.select(
        "scenario",
        (F.col("r") * 5 + 1).alias("rate"),
        F.round(F.col("m") * (1 + F.col("r") * F.col("scenario") / 8.0), 3).alias("ttft_p99"),
        (F.col("bad") / F.col("n") / 6).alias("error_rate"),
        F.when(failed, F.lit(0)).otherwise(F.col("n")).cast("long").alias("completed"),
        failed.alias("failed"),
    )


@query(
    "saturating_rate",
    sql(
        """SELECT scenario, CASE WHEN bool_or(breach) THEN greatest(min(CASE WHEN breach THEN rate END) - 5, 1)
             ELSE max(rate) END::BIGINT AS saturating_rate
           FROM (SELECT *, (completed > 0 AND ((rate > first_rate AND base > 0 AND ttft_p99 > 3 * base) OR error_rate > 0.05))
                        OR (completed = 0 AND failed) AS breach
             FROM (SELECT *, min(rate) FILTER (completed > 0) OVER w AS first_rate,
                     min_by(ttft_p99, rate) FILTER (completed > 0) OVER w AS base FROM p WINDOW w AS (PARTITION BY scenario)))
           GROUP BY scenario""",
        ctes=f"p AS ({PROBES})",
    ),
)
def saturating_rate(spark, d):
    return T.saturating_rate(probes(spark, d))


# Result files of a sweep: the rate is the cycle, the file the trial; some completed nothing.
SWEEP = f"""
 SELECT scenario, cycle AS rate, trial AS file, * EXCLUDE (scenario, cycle, trial, completed, phase),
        CASE WHEN trial = 0 AND cycle % 2 = 0 THEN 0 ELSE completed END AS completed FROM ({PHASES}) WHERE phase = 'burst'"""
POINTS = f"""
 SELECT s.scenario, s.rate, {", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in T.SWEEP)}, coalesce(f.ok_rps, 0) AS throughput,
        coalesce(f.error_rate, 0) AS error_rate
 FROM (SELECT DISTINCT scenario, rate FROM s) s LEFT JOIN (
   SELECT * FROM s WHERE completed > 0 QUALIFY row_number() OVER (PARTITION BY scenario, rate ORDER BY file) = 1) f
   ON f.scenario = s.scenario AND f.rate = s.rate"""


def sweep(spark, d):
    p = phases(spark, d).filter("phase = 'burst'")
    silent = (F.col("trial") == 0) & (F.col("cycle") % 2 == 0)
    files = p.withColumns(
        {
            "rate": F.col("cycle"),
            "file": F.col("trial"),
            "completed": F.when(silent, F.lit(0)).otherwise(F.col("completed")),
        }
    )
    return T.sweep_points(files)


@query(
    "sweep_points",
    sql(
        f"SELECT scenario, rate, {sql_rounded([*T.SWEEP, 'throughput', 'error_rate'])} FROM pt",
        ctes=f"s AS ({SWEEP}), pt AS ({POINTS})",
    ),
)
def sweep_points(spark, d):
    return rounded(sweep(spark, d), *T.SWEEP, "throughput", "error_rate")


@query(
    "sweep_table",
    sql(
        "SELECT scenario, " + ", ".join(f"round(max(ttft_p99) FILTER (rate = {r}), 8) AS rate_{r}" for r in range(1, 11))
        + " FROM pt GROUP BY scenario",
        ctes=f"s AS ({SWEEP}), pt AS ({POINTS})",
    ),
)
def sweep_table(spark, d):
    out = T.sweep_table(sweep(spark, d), range(1, 11))
    return rounded(out, *[f"rate_{r}" for r in range(1, 11)])


@query(
    "sweep_rows",
    sql(
        """SELECT 'S' || scenario AS scenario, count(*)::BIGINT AS points, sum(rate)::BIGINT AS rates,
             round(sum(ttft_p99), 4) AS ttft FROM pt GROUP BY 1""",
        ctes=f"s AS ({SWEEP}), pt AS ({POINTS})",
    ),
)
def sweep_rows(spark, d):
    """Write the sweep as JSON lines per scenario and sum the points up on the way back."""
    path = scratch_path(spark, "sweep")
    T.write_sweep(sweep(spark, d), path)
    back = spark.read.schema("value string, scenario string").text(path)
    point = F.from_json("value", "rate long, ttft_p99_ms double")
    return back.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(point["rate"]).alias("rates"),
        F.round(F.sum(point["ttft_p99_ms"]), 4).alias("ttft"),
    )


def deciles(rows, by):
    """The 11 decile values of `value` per group, as the array `q`."""
    found = exact_quantiles(rows, "value", DECILES, by)
    return found.select(*by, F.array(*[F.col(f"p{round(q * 100):02d}") for q in DECILES]).alias("q"))


def deciles_sql(factor: float) -> str:
    return "[" + ", ".join(f"quantile_cont(value, {q}) * {factor}" for q in DECILES) + "]"


CSV_SQL = f"""
 SELECT phase, cycle, round(quantile_cont(value, 0.5), 8) AS ttft_p50,
        round(p90 + 0.5 * (p100 - p90), 8) AS ttft_p95, round(p90 + 0.9 * (p100 - p90), 8) AS ttft_p99,
        round(quantile_cont(value, 0.5) / 10 * 1000, 4) AS req_latency_p50,
        round((p90 + 0.9 * (p100 - p90)) / 10 * 1000, 4) AS req_latency_p99, 0.0::DOUBLE AS itl_p99,
        n_ok AS completed, n - n_ok AS errors, round((n - n_ok) / n, 8) AS error_rate, round(n_ok / 90.0, 8) AS ok_rps
 FROM (SELECT phase, cycle, list(value) AS vs, quantile_cont(value, 0.9) AS p90, max(value) AS p100, count(*) AS n,
              count(*) FILTER (event_type <> 'error') AS n_ok FROM (
         SELECT *, CASE WHEN hour(ts) % 2 = 0 THEN 'burst' ELSE 'idle' END AS phase, day(ts)::BIGINT AS cycle FROM events)
       GROUP BY 1, 2), unnest(vs) AS u(value) GROUP BY ALL"""


@query("read_phase_csv", CSV_SQL)
def read_phase_csv(spark, d):
    """Write one summary file per phase of the events, then read them as the analysis does."""
    e = views.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    phase = F.when(F.hour(ts) % 2 == 0, F.lit("burst")).otherwise(F.lit("idle"))
    rows = e.select(F.concat_ws("-", phase, F.day(ts)).alias("stem"), "event_type", "value")
    counts = rows.groupBy("stem").agg(
        F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("bad")
    )
    g = counts.join(deciles(rows, ["stem"]), "stem")

    def listing(divisor):
        return F.concat(
            F.lit('"['), F.array_join(F.transform("q", lambda v: (v / divisor).cast("string")), ", "), F.lit(']"')
        )

    def median(divisor):
        return (F.col("q")[5] / divisor).cast("string")

    heads = [
        "Run,Request Counts,Request Counts,Request Counts,Timings,Time to First Token,Time to First Token,Request Latency,Request Latency",
        "Info,Successful,Errored,Total,Duration,Successful ms,Successful ms,Successful Sec,Successful Sec",
        "Name,,,,Sec,Median,Percentiles,Median,Percentiles",
    ]
    data = F.concat_ws(
        ",",
        F.lit("run"),
        F.col("ok").cast("string"),
        F.col("bad").cast("string"),
        (F.col("ok") + F.col("bad")).cast("string"),
        F.lit("90.0"),
        median(1),
        listing(1),
        median(10),
        listing(10),
    )
    path = scratch_path(spark, "phases")
    text = F.concat(F.lit("\n".join(heads) + "\n"), data)
    g.select("stem", text.alias("value")).write.partitionBy("stem").text(path)
    out = src.read_phase_csv(spark, f"{path}/stem=*", lambda p: F.regexp_extract(p, "stem=([^/]+)", 1))
    kept = ["ttft_p50", "ttft_p95", "ttft_p99", "error_rate", "ok_rps", "itl_p99"]
    late = ["req_latency_p50", "req_latency_p99"]
    return rounded(rounded(out, *kept), *late, digits=4).select("phase", "cycle", *kept, *late, "completed", "errors")


@query(
    "read_samples",
    """SELECT event_type AS metric, count(*)::BIGINT AS samples, round(sum(value), 4) AS total FROM events
       WHERE event_id % 13 <> 0 GROUP BY 1""",
)
def read_samples(spark, d):
    from .metrics import gauges

    path = scratch_path(spark, "samples")
    rows = gauges(spark, d).select(
        "metric", F.create_map(F.lit("priority"), "priority").alias("labels"), "ts", "seq", F.lit(None).cast("double").alias("le"), "value"
    )
    rows.write.parquet(path)
    return src.read_samples(spark, path).groupBy("metric").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "interpolate_decile",
    f"""SELECT event_type, round(d[10] + 0.5 * (d[11] - d[10]), 8) AS p95, round(d[1 + 2] + 0.5 * (d[1 + 3] - d[1 + 2]), 8) AS p25
       FROM (SELECT event_type, {deciles_sql(1.0)} AS d FROM events GROUP BY event_type)""",
)
def interpolate_decile(spark, d):
    e = views.table(spark, d, "events")
    return deciles(e, ["event_type"]).select(
        "event_type",
        F.round(S.interpolate_decile("q", 95), 8).alias("p95"),
        F.round(S.interpolate_decile("q", 25), 8).alias("p25"),
    )
