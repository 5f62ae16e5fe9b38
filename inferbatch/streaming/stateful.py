"""Keyed state with timers and a time to live, for what Spark's own stateful operators cannot say.

Each processor holds one small row of state per key and lives in the tasks of `transformWithState`. Rows of a hot
key are combined per task before they meet their state, so a key's task sees one row per task, not its rows.
Times to live count from the arrival of rows: the time of their micro-batch is the event time of these
operators (or a `clock` of the caller's), so no row is ever late. State that nothing has written for its time to live is removed by its
timer with the next arrivals, and a later row of the key starts afresh even if it comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _arriving(rows: DataFrame, clock: Column | None) -> DataFrame:
    """Rows with their time of arrival in milliseconds, `now`, which also moves the watermark."""
    timed = rows.withColumn("at", F.current_timestamp() if clock is None else clock).withColumn("now", F.unix_millis("at"))
    return timed.withWatermark("at", "0 seconds")


class Expiring(StatefulProcessor):
    """One row of state per key with an end: `fields` of the state, and the time of arrival it lives until."""

    fields: str

    def __init__(self, ttl: float):
        self.life = int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.fields}, until long")

    def living(self, now: int) -> tuple | None:
        """The state's fields, unless its time is over; and the end that a timer stands at."""
        held = self.held.get()
        self.end = held[-1] if held else None
        return tuple(held[:-1]) if held and held[-1] > now else None

    def keep(self, values: tuple, until: int) -> None:
        self.held.update((*values, until))
        if self.end is not None:
            self.handle.deleteTimer(self.end)
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


# --- stop causes ------------------------------------------------------------------

CAUSE = "job_id string, ts long, cause string"


def partial_causes(causes: DataFrame) -> DataFrame:
    """The first cause per job of each task's rows (job_id, ts, cause)."""

    def first(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("job_id", "ascending"), ("ts", "ascending"), ("cause", "ascending")])
        codes = pc.fill_null(rows["job_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        return rows.take(np.flatnonzero(np.diff(codes, prepend=-2)))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept = first(rows if kept is None else pa.concat_tables([kept, rows]))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return causes.select("job_id", F.col("ts").cast("long").alias("ts"), "cause").mapInArrow(combine, CAUSE)


class FirstCause(Expiring):
    """The first cause of a job, forgotten `ttl` seconds after the last event that changed it came in."""

    fields = "ts long, cause string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        now = max(r.now for r in rows)
        held = self.living(now)
        best = min([*([held] if held else []), *((r.ts, r.cause) for r in rows)])
        if best != held:
            self.keep(best, now + self.life)
            yield Row(job_id=key[0], ts=best[0], cause=best[1])


def live_causes(partial: DataFrame, ttl: float, clock: Column | None = None) -> DataFrame:
    """New or earlier first causes per job, from rows of `partial_causes`, with state that expires."""
    return _arriving(partial, clock).groupBy("job_id").transformWithState(FirstCause(ttl), CAUSE, "Update", "EventTime")


# --- requests and results ---------------------------------------------------------

SETTLED = "request_id string, ts long, deadline long, res_ts long"


class Settle(StatefulProcessor):
    """Requests: answered by their first result in time, else expired by the watermark.

    The state of a bucket holds its open requests and the results that came before their request, and its one
    timer stands at the first of their ends, so reading and writing state is paid per bucket, not per request.
    Rows have `request_id`, `micros`, `deadline` (microseconds) and `asked`. A timer counts milliseconds and fires
    once the watermark is past it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        request = "struct<id: string, ts: long, deadline: long, came: array<long>>"
        self.held = handle.getValueState("open", f"requests array<{request}>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        open_, timer = self._open()
        touched = {}
        for r in rows:
            entry = touched[r.request_id] = open_.setdefault(r.request_id, [None, None, []])
            if r.asked:
                entry[:2] = r.micros, r.deadline
            else:
                entry[2].append(r.micros)
        for request_id, entry in touched.items():
            ts, deadline, came = entry
            if ts is None:
                entry[2] = sorted(set(came))
                continue
            in_time = [c for c in came if ts <= c and (deadline is None or c <= deadline)]
            if in_time:
                del open_[request_id]
                yield Row(request_id=request_id, ts=ts, deadline=deadline, res_ts=min(in_time))
            # Results outside the time of a known request cannot count any more.
            entry[2] = []
        self._keep(open_, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        open_, _ = self._open()
        now = timerValues.getCurrentWatermarkInMs()
        for request_id, (ts, deadline, came) in list(open_.items()):
            until = self._until(ts, deadline, came)
            if until is not None and until <= now:
                del open_[request_id]
                if ts is not None:
                    yield Row(request_id=request_id, ts=ts, deadline=deadline, res_ts=None)
        self._keep(open_, None, now)

    def _open(self) -> tuple[dict[str, list], int | None]:
        held = self.held.get()
        if held is None:
            return {}, None
        return {i: [ts, deadline, list(came)] for i, ts, deadline, came in held[0]}, held[1]

    def _keep(self, open_: dict[str, list], timer: int | None, now: int) -> None:
        ends = [u for u in (self._until(*entry) for entry in open_.values()) if u is not None]
        first = max(min(ends), now + 1) if ends else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and first != timer:
            self.handle.registerTimer(first)
        if open_:
            self.held.update(([(i, *entry) for i, entry in open_.items()], first))
        else:
            self.held.clear()

    @staticmethod
    def _until(ts: int | None, deadline: int | None, came: list[int]) -> int | None:
        """When an entry ends, in milliseconds: at the deadline, or behind the last result of an unknown request."""
        last = deadline if ts is not None else came[-1]
        return None if last is None else -(-last // 1000) + 1

    def close(self) -> None:
        pass


def settled(rows: DataFrame, buckets: int) -> DataFrame:
    """Answered and expired requests, from rows as `Settle` reads them with a watermark."""
    bucket = F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int")
    rows = rows.filter("request_id IS NOT NULL").withColumn("bucket", bucket)
    return rows.groupBy("bucket").transformWithState(Settle(), SETTLED, "Append", "EventTime")


# --- events in order --------------------------------------------------------------

ORDERED = "job_id string, seq long, type string, ts long, ttl long"


class InOrder(Expiring):
    """Events of a job by their sequence numbers, from 1 without gaps, each released once.

    An event waits until all before it have come. If one stays away for `patience` seconds after the last
    arrival, those that wait are released with the next arrivals, and the gap is given up; what comes behind its
    turn, or again, is dropped. The state of a job is forgotten `ttl` seconds after its last event came in.
    """

    fields = "turn long, waiting array<struct<seq: long, type: string, ts: long, ttl: long>>, due long"

    def __init__(self, patience: float, ttl: float):
        super().__init__(ttl)
        self.patience = int(patience * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        now = max(r.now for r in rows)
        turn, waiting, due = self.living(now) or (1, [], None)
        held = {w[0]: tuple(w) for w in waiting}
        if due is not None and due <= now:
            yield from self._released(key, turn := min(held), held)
            turn = self._next(turn, held)
        for r in rows:
            if r.seq >= turn:
                held.setdefault(r.seq, (r.seq, r.type, r.ts, r.ttl))
        yield from self._released(key, turn, held)
        self._rest(self._next(turn, held), held, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = self.held.get()
        if held is None:
            return
        turn, waiting, due, self.end = held
        if due is None or due > now:
            self.held.clear()
            return
        waiting = {w[0]: tuple(w) for w in waiting}
        turn = min(waiting)
        yield from self._released(key, turn, waiting)
        self.end = None
        self._rest(self._next(turn, waiting), waiting, now)

    @staticmethod
    def _next(turn: int, held: dict[int, tuple]) -> int:
        """The number behind the released ones, which leave `held`."""
        while turn in held:
            del held[turn]
            turn += 1
        return turn

    @staticmethod
    def _released(key, turn: int, held: dict[int, tuple]) -> Iterator[Row]:
        while turn in held:
            seq, kind, ts, ttl = held[turn]
            yield Row(job_id=key[0], seq=seq, type=kind, ts=ts, ttl=ttl)
            turn += 1

    def _rest(self, turn: int, held: dict[int, tuple], now: int) -> None:
        due = now + self.patience if held else None
        self.keep((turn, [held[k] for k in sorted(held)], due), now + self.life if due is None else min(due, now + self.life))


def in_order(events: DataFrame, patience: float, ttl: float, clock: Column | None = None) -> DataFrame:
    """Events (job_id, seq, type, ts, ttl) in the order of their sequence numbers per job."""
    rows = events.select("job_id", F.col("seq").cast("long").alias("seq"), "type", F.col("ts").cast("long").alias("ts"), F.col("ttl").cast("long").alias("ttl"))
    rows = rows.filter("job_id IS NOT NULL AND seq IS NOT NULL")
    return _arriving(rows, clock).groupBy("job_id").transformWithState(InOrder(patience, ttl), ORDERED, "Append", "EventTime")
