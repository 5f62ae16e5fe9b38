"""Metrics over job, request and sample tables: counts, histograms, rates and sustained alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import lookup_table, materialize
from .jobs import STATE, is_terminal
from .order import join_null_safe, number_rows, running_sums

INF = float("inf")


# --- plain counts -----------------------------------------------------------------


def _count(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def jobs_processed(df: DataFrame) -> DataFrame:
    """Jobs by (result, reason)."""
    return _count(df, ["result", "reason"], "jobs")


def storage_ops(df: DataFrame) -> DataFrame:
    """Storage operations by (operation, component, status)."""
    return _count(df, ["operation", "component", "status"], "operations")


def http_traffic(df: DataFrame) -> DataFrame:
    """API requests by (method, path, status)."""
    return _count(df, ["method", "path", "status"], "requests")


def http_error_share(df: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Share of 4xx and 5xx answers."""
    bad = F.col("status").rlike("^[45]")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(bad).alias("errors"),
        (F.count_if(bad) / F.count(F.lit(1))).alias("share"),
    )


def cancellations(jobs: DataFrame) -> DataFrame:
    """Cancelled jobs by the phase the cancel reached them in: queued, in_progress, finalizing."""
    started = F.col("status.in_progress_at").isNotNull() | (F.coalesce("status.request_counts.total", F.lit(0)) > 0)
    phase = (
        F.when(F.col("status.finalizing_at").isNotNull(), F.lit("finalizing"))
        .when(started, F.lit("in_progress"))
        .otherwise(F.lit("queued"))
    )
    return _count(jobs.filter(F.col(STATE) == "cancelled").withColumn("phase", phase), ["phase"], "jobs")


def job_latency(jobs: DataFrame, claimed_at: str | None = None) -> DataFrame:
    """Seconds from creation to the end, and to the claim; jobs without creation time are skipped.

    Needs finished jobs for `e2e`; `claimed_at` names a column of claim times.
    """
    created = F.col("spec.created_at")
    end = S.lookup(F.col(STATE), {s: s for s in ("completed", "failed", "expired", "cancelled")})
    ended = F.coalesce(*[F.when(end == s, F.col(f"status.{s}_at")) for s in ("completed", "failed", "expired", "cancelled")])
    wait = (F.col(claimed_at) - created) if claimed_at else F.lit(None).cast("long")
    return jobs.filter(created > 0).select(
        "id", F.col(STATE).alias("status"), F.when(is_terminal(), ended - created).alias("e2e"), wait.alias("queue_wait")
    )


def utilisation(df: DataFrame, used: str, total: str, by: Sequence[str] = (), floor: float | None = None) -> DataFrame:
    """Sum over sum; with `floor` the denominator is at least that, as the alert wants it."""
    whole = F.sum(total)
    denominator = F.greatest(whole, F.lit(floor)) if floor is not None else whole
    return df.groupBy(*by).agg(
        F.sum(used).alias("used"), whole.alias("total"), F.try_divide(F.sum(used), denominator).alias("ratio")
    )


# --- histograms -------------------------------------------------------------------


def histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets per group: `le` (the last one +Inf), `count`, and `sum` of all values.

    One conditional count per bound in a single aggregation, so rows are not multiplied.
    """
    v = F.col(value)
    counted = df.filter(v.isNotNull()).groupBy(*by).agg(
        *[F.count_if(v <= le).alias(f"__b{i}") for i, le in enumerate(bounds)],
        F.count(F.lit(1)).alias("__all"),
        F.sum(v.cast("double")).alias("sum"),
    )
    rows = [F.struct(F.lit(float(le)).alias("le"), F.col(f"__b{i}").alias("count")) for i, le in enumerate(bounds)]
    rows.append(F.struct(F.lit(INF).alias("le"), F.col("__all").alias("count")))
    return counted.select(*by, "sum", F.inline(F.array(*rows))).filter("count IS NOT NULL")


def histogram_quantile(buckets: DataFrame, quantiles: Sequence[float], by: Sequence[str], count: str = "count") -> DataFrame:
    """Quantiles read from cumulative buckets, linear inside the bucket that holds the rank.

    The lowest bucket starts at 0 and the +Inf bucket answers with the highest finite bound.
    Buckets of several sources are summed per bound first; what is then collected per group
    is one small array with an entry per bound of the layout. Samples taken at slightly
    different moments may leave a bucket below the one before it; it is raised to that.
    """
    summed = buckets.groupBy(*by, "le").agg(F.sum(count).cast("double").alias("__n"))
    packed = summed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("le", "__n"))).alias("__b"))

    def raised(x: Column, i: Column) -> Column:
        so_far = F.slice("__b", F.lit(1), i + 1)
        return F.struct(x["le"].alias("le"), F.array_max(F.transform(so_far, lambda y: y["__n"])).alias("__n"))

    packed = packed.withColumn("__b", F.transform("__b", raised))
    b = F.col("__b")
    total = F.element_at(b, -1)["__n"]

    def quantile(q: float) -> Column:
        rank = F.lit(q) * total
        at = F.size(F.filter(b, lambda x: x["__n"] < rank))
        here, before = F.get(b, at), F.get(b, at - 1)
        low, below = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["__n"], F.lit(0.0))
        inside = low + (here["le"] - low) * (rank - below) / (here["__n"] - below)
        return F.when(total > 0, F.when(here["le"] == INF, before["le"]).otherwise(inside))

    return packed.select(*by, *[quantile(q).alias(f"p{round(q * 100):02d}") for q in quantiles])


def exact_quantiles(
    df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = (), **cuts
) -> DataFrame:
    """Exact quantiles of raw values, linear between neighbours.

    Values are counted per distinct value and the counts summed up in order, so the values at
    the wanted ranks are picked out where they lie; no task holds the values of a group.
    """
    kept = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    counted = materialize(kept.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n")), "value-counts")
    below = running_sums(counted, by, ["__v"], {"__below": F.col("__n")}, **cuts)
    sizes = counted.groupBy(*by).agg(F.sum("__n").alias("__size"))
    placed = join_null_safe(below, lookup_table(sizes, "group-sizes"), by) if by else below.withColumn("__size", sizes.scalar())
    picked = []
    for q in quantiles:
        rank = F.lit(float(q)) * (F.col("__size") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("__below") <= at) & (at < F.col("__below") + F.col("__n"))
            picked.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}{q}"))
    found = placed.groupBy(*by).agg(F.max("__size").alias("__size"), *picked)

    def between(q: float) -> Column:
        rank = F.lit(float(q)) * (F.col("__size") - 1)
        lo, hi = F.col(f"`__lo{q}`"), F.col(f"`__hi{q}`")
        return lo + (hi - lo) * (rank - F.floor(rank))

    return found.select(*by, *[between(q).alias(f"p{round(q * 100):02d}") for q in quantiles])


# --- counters ---------------------------------------------------------------------


def _growth(value: Column, before: Column) -> Column:
    """Growth from one sample to the next: a smaller value means a reset and counts in full."""
    return F.when(before.isNull(), F.lit(0.0)).when(value >= before, value - before).otherwise(value)


def _steps(samples: DataFrame, series: Sequence[str], step: int) -> tuple[DataFrame, DataFrame]:
    """Samples with the one before them in their step (`__in`), and per step the last value before it.

    Windows run per (series, step), so a task holds a series for the time of a step only. What
    is then ordered per series has one row per step in which it was sampled.
    """
    order = F.struct("ts", "seq")
    inside = W.partitionBy(*series, "t").orderBy("ts", "seq")
    rows = samples.withColumn("t", step_end(step)).withColumn("__in", F.lag("value").over(inside))
    steps = rows.groupBy(*series, "t").agg(
        F.min_by("value", order).alias("__first"),
        F.max_by("value", order).alias("__last"),
        F.sum(_growth(F.col("value"), F.col("__in"))).alias("__inside"),
    )
    before = F.lag("__last").over(W.partitionBy(*series).orderBy("t"))
    return rows, steps.withColumn("__before", before)


def counter_deltas(samples: DataFrame, series: Sequence[str], step: int = 3600) -> DataFrame:
    """Add `delta` to counter samples (ts, seq, value): growth since the previous sample.

    A smaller value means the counter was reset, and then counts in full; the first sample of
    a series has no growth. A series of any length is worked on in pieces of `step` seconds.
    """
    rows, steps = _steps(samples, series, step)
    joined = join_null_safe(rows, steps.select(*series, "t", "__before"), [*series, "t"])
    first = F.row_number().over(W.partitionBy(*series, "t").orderBy("ts", "seq")) == 1
    before = F.when(first, F.col("__before")).otherwise(F.col("__in"))
    return joined.withColumn("delta", _growth(F.col("value"), before)).select(*samples.columns, "delta")


def step_end(step: int, ts="ts") -> Column:
    """End of the evaluation step a second falls into; a step holds (end - step, end]."""
    return (F.ceil(S.as_col(ts) / F.lit(step)) * F.lit(step)).cast("long")


def over_window(steps: DataFrame, keys: Sequence[str], window: int, step: int, value: str = "increase") -> DataFrame:
    """Sums per step to sums over the window ending at each step (`t`).

    Every step sum is handed to the evaluation times that see it; only step sums are
    multiplied, never samples.
    """
    if window % step:
        raise ValueError("the window must be a multiple of the step")
    later = F.explode(F.sequence(F.lit(0), F.lit(window - step), F.lit(step)))
    spread = steps.select(*keys, value, "t", later.alias("__ahead"))
    return spread.groupBy(*keys, (F.col("t") + F.col("__ahead")).alias("t")).agg(F.sum(value).alias(value))


def counter_increase(samples: DataFrame, series: Sequence[str], by: Sequence[str], window: int, step: int) -> DataFrame:
    """Growth of counters over a window, at every step: (by..., t, increase).

    Growth is summed over the series that share `by`. Reset-aware differences are summed and
    not extrapolated to the window's edges.
    """
    grown = F.col("__inside") + _growth(F.col("__first"), F.col("__before"))
    steps = _steps(samples, series, step)[1].withColumn("__grown", grown)
    return over_window(steps.groupBy(*by, "t").agg(F.sum("__grown").alias("increase")), by, window, step)


def counter_rate(samples: DataFrame, series: Sequence[str], by: Sequence[str], window: int, step: int) -> DataFrame:
    """Growth per second over a window, at every step."""
    grown = counter_increase(samples, series, by, window, step)
    return grown.select(*by, "t", (F.col("increase") / F.lit(float(window))).alias("rate"))


def sustained(df: DataFrame, condition: str, hold: int, step: int, by: Sequence[str] = ()) -> DataFrame:
    """Evaluations at which the condition holds, with `since` and whether it `fires`.

    The condition must have held at every step for `hold` seconds. A false or missing
    evaluation ends the run. Runs are found by numbering the true evaluations: within a run,
    time minus number of steps is constant. There is one row per group and step, so a window
    over a group grows with time, not with the samples.
    """
    group = [F.col(c) for c in by] or [F.lit(0)]
    nth = F.row_number().over(W.partitionBy(*group).orderBy("t"))
    runs = df.filter(F.col(condition)).select(*by, "t").withColumn("__run", F.col("t") - nth * step)
    since = F.min("t").over(W.partitionBy(*group, "__run"))
    return runs.withColumn("since", since).select(*by, "t", "since", (F.col("t") - F.col("since") >= hold).alias("fires"))


# --- gauges -----------------------------------------------------------------------


def series_stats(samples: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Average, minimum, maximum and number of samples per series; NaN samples do not count."""
    kept = samples.filter(~F.isnan(value) & F.col(value).isNotNull())
    return kept.groupBy(*by).agg(
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("samples")
    )


def series_points(samples: DataFrame, by: Sequence[str], order: Sequence[str] = ("ts", "seq"), value: str = "value", **cuts) -> DataFrame:
    """The ordered points of each series as rows with their `position`, NaN dropped.

    Rows instead of one list per series: a list would put a long series into a single row.
    """
    kept = samples.filter(~F.isnan(value) & F.col(value).isNotNull())
    return number_rows(kept, by, order, "position", **cuts).select(*by, "position", *order, value)
