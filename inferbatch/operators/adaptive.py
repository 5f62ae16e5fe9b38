"""Replay of the adaptive concurrency limit from results, exact and in parallel.

The limit of an endpoint is a small state machine (limit, successes since the last change)
driven by its results in completion order. A hot endpoint may hold a third of all results, so
its sequence is cut into ranges. What a range does to *any* starting state can be written
down briefly: it starts with some successes, and from the first failure on only the limit at
that point matters. So each range is summarised by the number of leading successes and, per
possible limit, the state at its end. Chaining these few summaries gives every range its
starting state, and the ranges are then replayed independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import lookup_table, materialize
from .order import MIN_ROWS, RANGE, default_ranges, with_range

SUCCESS = "success"
# Rows of a task, about. A longer trace is cut into more ranges and tasks than there are shuffle
# partitions, so what one task reads does not grow with the trace.
RANGE_ROWS = 250_000


@dataclass(frozen=True)
class Limits:
    """Bounds and steps of the adaptive limit."""

    minimum: int = V.AIMD_MIN
    maximum: int = V.AIMD_MAX
    factor: float = V.AIMD_FACTOR
    increment: int = V.AIMD_INCREMENT
    initial: int = V.AIMD_MAX

    @property
    def start(self) -> tuple[int, int]:
        return min(max(self.initial, self.minimum), self.maximum), 0

    def step(self, limit: int, run: int, good: bool) -> tuple[int, int]:
        """State after one more result."""
        if not good:
            return max(self.minimum, int(limit * self.factor)), 0
        if run + 1 < limit:
            return limit, run + 1
        return min(limit + self.increment, self.maximum), 0

    def after_successes(self, limit: int, run: int, n: int) -> tuple[int, int]:
        """State after n successes; n may be large, the loop runs once per limit change."""
        while n > 0:
            need = max(1, limit - run)
            if n < need:
                return limit, run + n
            raised = min(limit + self.increment, self.maximum)
            n, run = n - need, 0
            if raised == limit:
                return limit, n % max(1, limit)
            limit = raised
        return limit, run


def signals(results: DataFrame, order: list[str]) -> DataFrame:
    """(endpoint, order..., signal) of results; the signal is NULL without a response.

    A result without response says nothing about the endpoint's load. The replay leaves such
    rows out after it has written the signals: a filter here would be pushed below the
    construction of the results and evaluate it twice.
    """
    status = F.col("response.status_code")
    signal = (
        F.when(status.isNull(), F.lit(None).cast("string"))
        .when(status == 429, F.lit("429"))
        .when(status >= 500, F.lit("5xx"))
        .when(F.col("had_capacity_retry"), F.lit("capacity_retry"))
        .otherwise(F.lit(SUCCESS))
    )
    return results.select("endpoint", *order, signal.alias("signal"))


class _Summary:
    """Effect of one range on every possible starting limit."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.lead = 0
        self.states: dict[tuple[int, int], list[int]] | None = None

    def add(self, good: list[bool]) -> None:
        begin = 0
        if self.states is None:
            begin = next((i for i, g in enumerate(good) if not g), len(good))
            self.lead += begin
            if begin == len(good):
                return
            self.states = {(limit, 0): [limit] for limit in range(self.limits.minimum, self.limits.maximum + 1)}
        # Different starts soon meet in the same state; from then on they are followed together.
        step = self.limits.step
        for at in range(begin, len(good)):
            if len(self.states) == 1:
                (state, origins), = self.states.items()
                for g in good[at:]:
                    state = step(*state, g)
                self.states = {state: origins}
                return
            merged: dict[tuple[int, int], list[int]] = {}
            for state, origins in self.states.items():
                merged.setdefault(step(*state, good[at]), []).extend(origins)
            self.states = merged

    def row(self, endpoint: str, number: int) -> dict:
        ends = [] if self.states is None else sorted(
            (origin, *state) for state, origins in self.states.items() for origin in origins
        )
        return {
            "endpoint": endpoint,
            RANGE: number,
            "lead": self.lead,
            "ends": [v for _, limit, run in ends for v in (limit, run)],
        }


def _pieces(batch: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of the same (endpoint, range)."""
    change = (batch["endpoint"].ne(batch["endpoint"].shift()) | batch[RANGE].ne(batch[RANGE].shift())).cumsum()
    for _, piece in batch.groupby(change.to_numpy(), sort=False):
        yield (piece["endpoint"].iat[0], int(piece[RANGE].iat[0])), piece


def _summaries(limits: Limits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, summary = None, None
        for batch in batches:
            done = []
            for k, piece in _pieces(batch):
                if k != key:
                    if summary is not None:
                        done.append(summary.row(*key))
                    key, summary = k, _Summary(limits)
                summary.add((piece["signal"] == SUCCESS).tolist())
            if done:
                yield pd.DataFrame(done)
        if summary is not None:
            yield pd.DataFrame([summary.row(*key)])

    return run


def _chain(limits: Limits):
    """Starting state of every range of one endpoint, from the summaries in range order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RANGE)
        limit, run = int(pdf["limit0"].iat[0]), int(pdf["run0"].iat[0])
        starts = []
        for lead, ends in zip(pdf["lead"], pdf["ends"]):
            starts.append((limit, run))
            limit, run = limits.after_successes(limit, run, int(lead))
            if len(ends):
                at = 2 * (limit - limits.minimum)
                limit, run = int(ends[at]), int(ends[at + 1])
        out = pdf[["endpoint", RANGE]].copy()
        out["limit0"], out["run0"] = [s[0] for s in starts], [s[1] for s in starts]
        return out

    return run


def _replay_piece(limits: Limits, good: list[bool], limit: int, run: int):
    """(limit after each row, limit raised at the row, end state)."""
    after, raised = [], []
    for g in good:
        before = limit
        limit, run = limits.step(limit, run, g)
        after.append(limit)
        raised.append(g and limit != before)
    return after, raised, limit, run


def _replays(limits: Limits, kept: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limit, successes = None, 0, 0
        for batch in batches:
            parts = []
            for k, piece in _pieces(batch):
                if k != key:
                    key, limit, successes = k, int(piece["limit0"].iat[0]), int(piece["run0"].iat[0])
                good = (piece["signal"] == SUCCESS).tolist()
                after, raised, limit, successes = _replay_piece(limits, good, limit, successes)
                part = piece[kept].copy()
                part["limit"], part["raised"] = after, raised
                parts.append(part)
            if parts:
                yield pd.concat(parts)

    return run


def aimd_trace(
    sig: DataFrame,
    order: list[str],
    limits: Limits = Limits(),
    state: DataFrame | None = None,
    ranges: int | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """The limit after every signal: the input rows with `limit` and `raised`.

    `sig` has endpoint, order columns (unique together) and signal, see `signals`. `state`
    (endpoint, limit, run) carries the state of an earlier stretch over.
    """
    start_limit, start_run = limits.start
    # Four passes read the signals; write the narrow rows once instead of rebuilding results.
    sig = materialize(sig, "signals").filter("signal IS NOT NULL")
    count = sig.count()
    ranges = ranges or max(default_ranges(sig), count // RANGE_ROWS)
    cut = with_range(sig, ["endpoint"], order, ranges, min_rows)
    kept = sig.columns
    placed_by = ["endpoint", RANGE]
    tasks = min(ranges, max(sig.sparkSession.sparkContext.defaultParallelism, ceil(count / RANGE_ROWS)))

    def placed(df: DataFrame) -> DataFrame:
        # Ranges are dealt in turn: by hash, several of them fall on one task and none on others.
        return df.repartitionById(tasks, RANGE).sortWithinPartitions(*placed_by, *order)

    # An endpoint inside one range needs no chaining. Each cut point lies in at most one
    # endpoint, so the endpoints that do are fewer than the ranges.
    spread = cut.groupBy("endpoint").agg(F.min(RANGE).alias("__lo"), F.max(RANGE).alias("__hi"))
    chained = F.broadcast(spread.filter("__lo < __hi").select("endpoint"))
    narrow = cut.join(chained, "endpoint", "left_semi").select("endpoint", RANGE, *order, "signal")
    summary = placed(narrow).mapInPandas(
        _summaries(limits), f"endpoint string, {RANGE} int, lead long, ends array<int>"
    )
    first = {"limit0": F.lit(start_limit).cast("long"), "run0": F.lit(start_run).cast("long")}
    if state is None:
        rows, summary = cut.withColumns(first), summary.withColumns(first)
    else:
        carried = state.select("endpoint", F.col("limit").alias("limit0"), F.col("run").alias("run0"))
        rows, summary = (
            df.join(carried, "endpoint", "left").withColumns({c: F.coalesce(c, v) for c, v in first.items()})
            for df in (cut, summary)
        )
    starts = summary.groupBy("endpoint").applyInPandas(
        _chain(limits), f"endpoint string, {RANGE} int, limit0 long, run0 long"
    )
    at = F.broadcast(starts.select("endpoint", RANGE, F.col("limit0").alias("__l"), F.col("run0").alias("__r")))
    rows = rows.join(at, placed_by, "left").select(
        *kept, RANGE, F.coalesce("__l", "limit0").alias("limit0"), F.coalesce("__r", "run0").alias("run0")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sig.schema.fields)
    return placed(rows).mapInPandas(_replays(limits, kept), f"{fields}, limit long, raised boolean")


def aimd_state(trace: DataFrame, order: list[str], limits: Limits = Limits(), state: DataFrame | None = None) -> DataFrame:
    """(endpoint, limit, run) after the last signal of a trace, to continue from later.

    The run is the number of successes since the limit last changed, a failure happened, or a
    full window passed at the highest limit.
    """
    key = F.struct(*order)
    moved = F.col("raised") | (F.col("signal") != SUCCESS)
    last = trace.groupBy("endpoint").agg(
        F.max_by("limit", key).alias("limit"), F.max(F.when(moved, key)).alias("__moved"), F.count(F.lit(1)).alias("__n")
    )
    # One row per endpoint: broadcast, the trace stays where it is. Shuffled by endpoint, it would fill one task each.
    last = lookup_table(last, "last-signals")
    tail = trace.join(last.select("endpoint", "__moved"), "endpoint").filter(
        F.col("__moved").isNull() | (key > F.col("__moved"))
    )
    runs = tail.groupBy("endpoint").agg(F.count(F.lit(1)).alias("__tail"))
    joined = last.join(runs, "endpoint", "left")
    before = F.lit(0).cast("long")
    if state is not None:
        joined = joined.join(state.select("endpoint", F.col("run").alias("__run0")), "endpoint", "left")
        before = F.when(F.col("__moved").isNull(), F.coalesce("__run0", F.lit(0))).otherwise(F.lit(0))
    run = (F.coalesce("__tail", F.lit(0)) + before) % F.col("limit")
    now = joined.select("endpoint", "limit", run.cast("long").alias("run"))
    if state is None:
        return now
    return now.unionByName(state.join(now, "endpoint", "left_anti").select("endpoint", "limit", "run"))


def aimd_signals(trace: DataFrame) -> DataFrame:
    """Decreases by (endpoint, signal), counted at the floor as well, and real increases."""
    failed = F.col("signal") != SUCCESS
    kind = F.when(failed, F.lit("decrease")).when(F.col("raised"), F.lit("increase"))
    rows = trace.select("endpoint", kind.alias("kind"), F.when(failed, F.col("signal")).alias("signal"))
    return rows.filter("kind IS NOT NULL").groupBy("endpoint", "kind", "signal").agg(F.count(F.lit(1)).alias("events"))
