"""Dashboard panels and alert rules over a table of metric samples.

A sample row is (metric, labels, ts, seq, le, value): counters and gauges have NULL `le`,
histogram counters one series per bucket bound. Panels are described by data and evaluated by
a handful of functions; every panel reads only the samples of its own metric.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import observe as O

FIVE_MINUTES = 300
QUANTILES = (0.50, 0.95, 0.99)


@dataclass(frozen=True)
class Panel:
    """`kind` is rate, quantile, last or ratio; `by` are the labels kept. With `each`, a rate or a last value is a
    curve per series, named by all its labels, instead of their sum."""

    kind: str
    metric: str
    by: tuple[str, ...] = ()
    where: dict[str, str] = field(default_factory=dict)
    quantiles: tuple[float, ...] = QUANTILES
    total: str = ""
    each: bool = False

    @property
    def keys(self) -> list[str]:
        return [*self.by, "series"] if self.each else list(self.by)


# The panels and the metric names they read.
PANELS: dict[str, dict[str, Panel]] = {
    "d1": {"jobs": Panel("rate", "jobs_processed_total", ("result", "reason"))},
    "d2": {
        "processing": Panel("quantile", "job_processing_duration_seconds_bucket"),
        "queue_wait": Panel("quantile", "job_queue_wait_duration_seconds_bucket"),
        "plan_build": Panel("quantile", "plan_build_duration_seconds_bucket"),
    },
    "d3": {"e2e": Panel("quantile", "batch_job_e2e_latency_seconds_bucket", ("status",))},
    "d4": {
        "duration": Panel("quantile", "model_request_execution_duration_seconds_bucket", ("model",), quantiles=(0.95,)),
        "errors": Panel("rate", "request_errors_by_model_total", ("model",)),
        "inflight": Panel("last", "model_inflight_requests", ("model",)),
    },
    "d5": {
        "workers": Panel("ratio", "active_workers", total="total_workers"),
        "inflight": Panel("ratio", "processor_inflight_requests", total="processor_max_inflight_concurrency"),
    },
    "d6": {
        "storage_retries": Panel(
            "rate", "file_storage_operations_total", ("operation",), {"status": "retry", "component": "processor"}
        ),
        "recoveries": Panel("last", "batch_startup_recovery_total", ("status", "action")),
        "cancellations": Panel("rate", "batch_cancellation_total", ("phase",)),
    },
    "d7": {
        "prompt": Panel("rate", "batch_request_prompt_tokens_total", ("model",)),
        "generation": Panel("rate", "batch_request_generation_tokens_total", ("model",)),
    },
    "d8": {
        "limit": Panel("last", "batch_processor_aimd_concurrency_limit", ("endpoint",), each=True),
        "decreases": Panel("rate", "batch_processor_aimd_decreases_total", ("endpoint", "signal")),
        "increases": Panel("rate", "batch_processor_aimd_increases_total", ("endpoint",)),
    },
    "d9": {
        "recovered_rate": Panel("rate", "batch_reconciler_orphans_recovered_total", ("action",)),
        "recovered_total": Panel("last", "batch_reconciler_orphans_recovered_total", ("action",)),
        "cycle": Panel("quantile", "batch_reconciler_cycle_duration_seconds_bucket"),
        "errors": Panel("rate", "batch_reconciler_errors_total", each=True),
        "conflicts": Panel("rate", "batch_reconciler_cas_conflicts_total", each=True),
        "cleanups": Panel("rate", "batch_reconciler_stale_cleanup_total", each=True),
    },
    "d10": {
        "traffic": Panel("rate", "http_requests_total", ("method", "path", "status")),
        "errors": Panel("rate", "http_requests_total", ("status",), {"status": "^[45]"}),
        "latency": Panel("quantile", "http_request_duration_seconds_bucket"),
        "inflight": Panel("last", "http_requests_in_flight"),
    },
}


def samples_of(samples: DataFrame, metric: str, by: tuple[str, ...] = (), where: dict[str, str] | None = None) -> DataFrame:
    """Samples of one metric with the wanted labels as columns and the full series identity.

    A label condition that starts with ^ is a pattern, as in the error panel.
    """
    kept = samples.filter(F.col("metric") == metric)
    for label, value in (where or {}).items():
        have = F.col("labels")[label]
        kept = kept.filter(have.rlike(value) if value.startswith("^") else have == value)
    identity = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return kept.select(
        *[F.coalesce(F.col("labels")[label], F.lit("")).alias(label) for label in by],
        identity.alias("series"),
        "ts",
        "seq",
        F.coalesce("le", F.lit(-1.0)).alias("le"),
        "value",
    )


def rate_panel(samples: DataFrame, panel: Panel, window: int = FIVE_MINUTES, step: int = FIVE_MINUTES) -> DataFrame:
    rows = samples_of(samples, panel.metric, panel.by, panel.where)
    return O.counter_rate(rows, [*panel.by, "series"], panel.keys, window, step)


def quantile_panel(samples: DataFrame, panel: Panel, window: int = FIVE_MINUTES, step: int = FIVE_MINUTES) -> DataFrame:
    rows = samples_of(samples, panel.metric, panel.by, panel.where)
    by = [*panel.by, "le"]
    grown = O.counter_increase(rows, [*panel.by, "series", "le"], by, window, step)
    return O.histogram_quantile(grown, panel.quantiles, [*panel.by, "t"], "increase")


def last_panel(samples: DataFrame, panel: Panel, step: int = FIVE_MINUTES) -> DataFrame:
    """The last sample of each series in each step, or their sum."""
    rows = samples_of(samples, panel.metric, panel.by, panel.where)
    last = rows.groupBy(*panel.by, "series", O.step_end(step).alias("t")).agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value")
    )
    return last.groupBy(*panel.keys, "t").agg(F.sum("value").alias("value"))


def ratio_panel(samples: DataFrame, panel: Panel, step: int = FIVE_MINUTES, floor: float | None = None) -> DataFrame:
    """Sum of one gauge over the sum of another, at each step where both were sampled."""
    used = last_panel(samples, Panel("last", panel.metric, panel.by), step).withColumnRenamed("value", "used")
    total = last_panel(samples, Panel("last", panel.total, panel.by), step).withColumnRenamed("value", "total")
    keys = [*panel.by, "t"]
    joined = used.join(total, keys)
    return O.utilisation(joined, "used", "total", keys, floor).select(*keys, "ratio")


def panel(samples: DataFrame, dashboard: str, name: str, **options) -> DataFrame:
    """One panel of a dashboard."""
    spec = PANELS[dashboard][name]
    draw = {"rate": rate_panel, "quantile": quantile_panel, "last": last_panel, "ratio": ratio_panel}[spec.kind]
    return draw(samples, spec, **options)


# --- alerts: (evaluation, threshold, hold) ----------------------------------------


def _fire(df: DataFrame, value: str, threshold: float, hold: int, step: int, by: tuple[str, ...] = ()) -> DataFrame:
    judged = df.select(*by, "t", (F.col(value) > threshold).alias("on"))
    return O.sustained(judged, "on", hold, step, by)


def high_queue_wait(
    samples: DataFrame, threshold: float = 300.0, hold: int = 900, step: int = FIVE_MINUTES, window: int = FIVE_MINUTES
) -> DataFrame:
    """p95 queue wait over 5 minutes above the threshold, held."""
    spec = Panel("quantile", "job_queue_wait_duration_seconds_bucket", quantiles=(0.95,))
    return _fire(quantile_panel(samples, spec, window, step), "p95", threshold, hold, step)


def _job_share(samples: DataFrame, result: str, threshold: float, hold: int, step: int) -> DataFrame:
    """Share of one result among processed jobs over 10 minutes; the rate below counts as 0.001."""
    rows = samples_of(samples, "jobs_processed_total", ("result",))
    rates = O.counter_rate(rows, ["result", "series"], ["result"], 600, step)
    share = rates.groupBy("t").agg(
        (
            F.sum(F.when(F.col("result") == result, F.col("rate")).otherwise(0.0))
            / F.greatest(F.sum("rate"), F.lit(0.001))
        ).alias("share")
    )
    return _fire(share, "share", threshold, hold, step)


def high_failure_rate(samples: DataFrame, threshold: float = 0.1, hold: int = 600, step: int = FIVE_MINUTES) -> DataFrame:
    return _job_share(samples, "failed", threshold, hold, step)


def expired_jobs(samples: DataFrame, threshold: float = 0.03, hold: int = 600, step: int = FIVE_MINUTES) -> DataFrame:
    return _job_share(samples, "expired", threshold, hold, step)


def workers_saturated(samples: DataFrame, threshold: float = 0.9, hold: int = 900, step: int = FIVE_MINUTES) -> DataFrame:
    """Active over total workers above the threshold, held; the denominator is at least 1."""
    spec = Panel("ratio", "active_workers", total="total_workers")
    return _fire(ratio_panel(samples, spec, step, floor=1.0), "ratio", threshold, hold, step)


def reconciler_errors(samples: DataFrame, window: int = 3900, hold: int = 300, step: int = FIVE_MINUTES) -> DataFrame:
    """Any growth of one series of the reconciler's error counter over 65 minutes, held by that series."""
    rows = samples_of(samples, "batch_reconciler_errors_total")
    grown = O.counter_increase(rows, ["series"], ["series"], window, step)
    return _fire(grown, "increase", 0.0, hold, step, ("series",))


def label_map(labels: dict[str, object]):
    """Labels as a map column, for building sample tables."""
    entries = [x for name, value in labels.items() for x in (F.lit(name), S.as_col(value))]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
