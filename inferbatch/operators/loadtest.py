"""Analysis of load tests: phases, trials, scenarios, deadlines, saturation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V

FAMILIES = ("ttft", "tpot", "itl", "req_latency")
PERCENTILES = [f"{f}_{p}" for f in FAMILIES for p in ("p50", "p95", "p99")]
PHASE_MEANS = [c for c in PERCENTILES if not c.startswith("req_latency")]


def aggregate_phases(phases: DataFrame, like: str | None = None, by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Mean percentiles and error rate, summed counts, over phases whose name contains `like`."""
    kept = phases.filter(F.col("phase").contains(like)) if like else phases
    return kept.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in PHASE_MEANS],
        F.sum("completed").alias("completed"),
        F.sum("errors").alias("errors"),
        F.avg("error_rate").alias("error_rate"),
    )


def aggregate_trials(phases: DataFrame, by: Sequence[str] = ("scenario", "phase", "cycle")) -> DataFrame:
    """Means over trials with 95 % confidence half-widths of the TTFT and TPOT p99.

    The half-width is 1.96 standard errors, 0 below two trials. Counts are floor means.
    """
    n = F.count(F.lit(1))

    def half_width(c: str) -> Column:
        return F.when(n < 2, F.lit(0.0)).otherwise(1.96 * F.sqrt(F.var_samp(c) / n))

    return phases.groupBy(*by).agg(
        n.alias("trials"),
        *[F.avg(c).alias(c) for c in [*PERCENTILES, "ok_rps", "error_rate"]],
        *[F.floor(F.sum(c) / n).cast("long").alias(c) for c in ("completed", "errors")],
        half_width("ttft_p99").alias("ttft_p99_ci"),
        half_width("tpot_p99").alias("tpot_p99_ci"),
    )


def pick_trial(trials: DataFrame) -> DataFrame:
    """Per scenario: the trial with the longest timeline and the first one with metrics.

    `trials` has scenario, trial, points (timeline length) and metrics (number of samples).
    Of equally long timelines the first counts.
    """
    return trials.groupBy("scenario").agg(
        F.max_by("trial", F.struct("points", -F.col("trial"))).alias("timeline_trial"),
        F.min(F.when(F.col("metrics") > 0, F.col("trial"))).alias("metrics_trial"),
    )


# --- progress lines ---------------------------------------------------------------


def latest_progress(lines: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """State of each job from its log lines (job, order columns, text).

    The last line that reports progress (`completed=3/10`) or the end (`Terminal: <status>`)
    counts; an ended job reports its status and no counts.
    """
    text = F.col("text")
    token = F.regexp_extract(text, r"completed=(\S+)", 1)
    ended = F.trim(F.substring_index(F.substring(text, F.locate("Terminal:", text) + 9, F.length(text)), "Terminal:", 1))
    terminal = text.contains("Terminal:")
    progress = token.contains("/")
    done = F.split(token, "/").getItem(0).try_cast("long")
    total = F.split(token, "/").getItem(1).try_cast("long")
    state = F.struct(
        F.when(terminal, F.lit(0)).otherwise(done).cast("long").alias("completed"),
        F.when(terminal, F.lit(0)).otherwise(total).cast("long").alias("total"),
        F.when(terminal, ended).otherwise(F.lit("in_progress")).alias("status"),
    )
    at = F.when(terminal | progress, F.struct(*order))
    last = lines.groupBy("job").agg(F.max_by(state, at).alias("s"))
    return last.select(
        "job",
        F.coalesce("s.completed", F.lit(0)).alias("completed"),
        F.coalesce("s.total", F.lit(0)).alias("total"),
        F.coalesce("s.status", F.lit("in_progress")).alias("status"),
    )


def progress_total(progress: DataFrame) -> DataFrame:
    """Progress over all jobs."""
    return progress.agg(
        F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")
    )


def completion_times(observations: DataFrame, by: Sequence[str] = ("job",)) -> DataFrame:
    """First time (elapsed seconds) each job is seen completed."""
    return observations.filter(F.col("status") == "completed").groupBy(*by).agg(
        F.min("elapsed").cast("long").alias("elapsed")
    )


# --- deadlines and scenarios ------------------------------------------------------


def slo_report(completions: DataFrame, scenarios: DataFrame, windows: Sequence[tuple] = V.JOB_WINDOWS) -> DataFrame:
    """Every scenario and job with its elapsed time, window and verdict; unfinished ones too.

    `windows` lists (job, label, display, seconds).
    """
    fields = ("job", "label", "display", "seconds")
    jobs = F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, w)]) for w in windows])
    expected = scenarios.select("scenario").distinct().select("scenario", F.inline(jobs))
    joined = expected.join(completions.select("scenario", "job", "elapsed"), ["scenario", "job"], "left")
    seconds = F.col("seconds").cast("long")
    met = F.col("elapsed") <= seconds
    actual = S.format_duration("elapsed")
    text = F.when(
        F.col("elapsed").isNotNull(),
        F.concat(F.col("label"), F.lit(": "), F.when(met, F.lit("✓")).otherwise(F.lit("✗")), F.lit(" "), actual, F.lit("/"), F.col("display")),
    ).otherwise(F.concat(F.col("label"), F.lit(": — /"), F.col("display")))
    return joined.select("scenario", "job", "elapsed", seconds.alias("seconds"), met.alias("met"), text.alias("summary"))


def slo_rate(report: DataFrame, final: DataFrame) -> DataFrame:
    """Per scenario: finished jobs, those within their window, and completion percent.

    `final` has scenario, completed and total of the last progress point.
    """
    jobs = report.groupBy("scenario").agg(
        F.count("elapsed").alias("finished"), F.count_if(F.coalesce("met", F.lit(False))).alias("met")
    )
    percent = F.when(F.col("total") > 0, F.col("completed") / F.col("total") * 100)
    return final.select("scenario", percent.alias("completion")).join(jobs, "scenario", "left").select(
        "scenario",
        F.coalesce("finished", F.lit(0)).alias("finished"),
        F.coalesce("met", F.lit(0)).alias("met"),
        "completion",
    )


def vs_baseline(burst: DataFrame, baseline: int = 0, metric: str = "ttft_p99") -> DataFrame:
    """Change in percent of each scenario's burst metric against the baseline scenario.

    Without a baseline row, or with a zero one, the change is NULL.
    """
    base = burst.filter(F.col("scenario") == baseline).agg(F.max(metric)).scalar()
    change = F.when(base != 0, (F.col(metric) - base) / base * 100)
    return burst.select("scenario", metric, change.alias("change_percent"))


def scenario_summary(phases: DataFrame, idle_seconds: int, cycles: int, warmup_cycles: int) -> DataFrame:
    """Per scenario: burst TTFT and ITL texts, idle rate, burst and idle error percent."""
    kind = F.when(F.col("phase").contains("burst"), F.lit("burst")).when(F.col("phase").contains("idle"), F.lit("idle"))
    split = aggregate_phases(phases.withColumn("__kind", kind), by=("scenario", "__kind"))
    one = F.first
    shown = {
        f"burst_{c}": one(F.when(F.col("__kind") == "burst", F.col(c)), ignorenulls=True)
        for c in ("ttft_p50", "ttft_p95", "ttft_p99", "itl_p50", "itl_p95", "itl_p99", "error_rate")
    }
    shown["idle_completed"] = one(F.when(F.col("__kind") == "idle", F.col("completed")), ignorenulls=True)
    shown["idle_error_rate"] = one(F.when(F.col("__kind") == "idle", F.col("error_rate")), ignorenulls=True)
    wide = split.groupBy("scenario").agg(*[c.alias(n) for n, c in shown.items()])
    measured = max(1, idle_seconds * (cycles - warmup_cycles))

    def triple(name: str) -> Column:
        parts = [F.format_string("%.0f", F.col(f"burst_{name}_{p}")) for p in ("p50", "p95", "p99")]
        return F.when(F.col(f"burst_{name}_p50").isNotNull(), F.concat_ws(" / ", *parts)).otherwise(F.lit("N/A"))

    return wide.select(
        "scenario",
        triple("ttft").alias("ttft_burst"),
        triple("itl").alias("itl_burst"),
        F.when(F.col("idle_completed").isNotNull(), F.format_string("%.2f", F.col("idle_completed") / measured))
        .otherwise(F.lit("N/A"))
        .alias("idle_rps"),
        (F.coalesce("burst_error_rate", F.lit(0.0)) * 100).alias("burst_error_percent"),
        (F.coalesce("idle_error_rate", F.lit(0.0)) * 100).alias("idle_error_percent"),
    )


# --- rate sweeps ------------------------------------------------------------------


def saturating_rate(probes: DataFrame, back_off: int = 5) -> DataFrame:
    """Highest sustainable rate per scenario.

    Going up the rates, saturation is a TTFT p99 above three times that of the first rate, an
    error rate above 5 %, or a failed probe; the answer is then `back_off` below that rate,
    at least 1. Without saturation it is the last rate. `probes` has scenario, rate,
    ttft_p99, error_rate, completed and failed.
    """
    ok = F.col("completed") > 0
    base = probes.groupBy("scenario").agg(
        F.min(F.when(ok, F.col("rate"))).alias("__first"),
        F.min_by("ttft_p99", F.when(ok, F.col("rate"))).alias("__base"),
        F.max("rate").alias("__last"),
    )
    slow = (F.col("rate") > F.col("__first")) & (F.col("__base") > 0) & (F.col("ttft_p99") > 3 * F.col("__base"))
    breach = (ok & (slow | (F.col("error_rate") > 0.05))) | (~ok & F.col("failed"))
    judged = probes.join(base, "scenario")
    stop = F.min(F.when(breach, F.col("rate")))
    answer = F.when(stop.isNotNull(), F.greatest(stop - back_off, F.lit(1))).otherwise(F.max("__last"))
    return judged.groupBy("scenario").agg(answer.cast("long").alias("saturating_rate"))


SWEEP = ["ttft_p50", "ttft_p95", "ttft_p99", "tpot_p50", "tpot_p95", "tpot_p99"]


def sweep_points(files: DataFrame) -> DataFrame:
    """One point per (scenario, rate): the first result file that completed any request."""
    used = F.when(F.col("completed") > 0, F.col("file"))
    values = F.struct(*SWEEP, F.col("ok_rps").alias("throughput"), "error_rate")
    picked = files.groupBy("scenario", "rate").agg(F.min_by(values, used).alias("p"))
    return picked.select(
        "scenario", "rate", *[F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).alias(c) for c in [*SWEEP, "throughput", "error_rate"]]
    )


def sweep_table(points: DataFrame, rates: Sequence[int], metric: str = "ttft_p99") -> DataFrame:
    """One metric as a table: scenarios down, the given rates across."""
    return points.groupBy("scenario").pivot("rate", list(rates)).agg(F.first(metric)).select(
        "scenario", *[F.col(str(r)).alias(f"rate_{r}") for r in rates]
    )


def sweep_rows(points: DataFrame) -> DataFrame:
    """Sweep results as JSON points keyed `S<scenario>`, one row per point in rate order."""
    point = F.to_json(
        F.struct(
            "rate",
            F.col("ttft_p99").alias("ttft_p99_ms"),
            F.col("tpot_p99").alias("tpot_p99_ms"),
            F.col("throughput").alias("throughput_rps"),
            "error_rate",
        )
    )
    keyed = points.select(F.concat(F.lit("S"), F.col("scenario").cast("string")).alias("scenario"), "rate", point.alias("point"))
    return keyed.orderBy("scenario", "rate")


def write_sweep(points: DataFrame, path: str) -> None:
    """Sweep results as JSON lines in one folder per scenario, in rate order."""
    rows = sweep_rows(points).repartitionByRange("scenario", "rate").sortWithinPartitions("scenario", "rate")
    rows.select("scenario", F.col("point").alias("value")).write.mode("error").partitionBy("scenario").text(path)
