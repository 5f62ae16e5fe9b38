"""Running the user's inference function over a plan, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from email.utils import parsedate_to_datetime
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions import values as V
from ..schemas import ATTEMPT

# Job ids that are to stop by now, each with the code of its cause (batch_cancelled, batch_expired).
Stopped = Callable[[], Mapping[str, str]]

# A client maps a pandas batch of requests to one outcome row per request.
Client = Callable[[pd.DataFrame], pd.DataFrame]

# Lines of one job that stay together for the sake of their common system prompt.
RUN_LINES = 1024

CARRIED = ["job_id", "custom_id", "route_key"]
OUTCOME = ["status_code", "body", "error_category", "error_message", "dropped_reason", "retry_after"]


def backoff_seconds(attempt: int, base: float, cap: float, u: float) -> float:
    """Wait before retry number `attempt`: doubling from `base` up to `cap`, +-50 % jitter from u."""
    interval = base
    for _ in range(attempt - 1):
        interval = cap if interval >= cap / 2 else interval * 2
    return interval * (0.5 + u)


def retry_after_seconds(header, now: float) -> float | None:
    """A Retry-After header as seconds: a whole number or an HTTP date; None if unusable."""
    if not isinstance(header, str):
        return None if header is None or header != header or header < 0 else float(header)
    if header.isdigit():
        return float(header)
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except (TypeError, ValueError):
        return None


def wait_seconds(status, attempt: int, header, initial: float, cap: float, u: float, now: float) -> float:
    """Wait by kind of failure, kept between the initial and the longest backoff.

    429 follows the server's Retry-After or starts three times as high; 502, 503 and 504 are
    capped at half the longest wait.
    """
    if status == 429:
        told = retry_after_seconds(header, now)
        wait = told if told is not None else backoff_seconds(attempt, 3 * initial, cap, u)
    elif status in (502, 503, 504):
        wait = backoff_seconds(attempt, initial, cap / 2, u)
    else:
        wait = backoff_seconds(attempt, initial, cap, u)
    return min(max(wait, initial), cap)


def _jitter(request_id: str, attempt: int) -> float:
    return int.from_bytes(md5(f"{request_id}:{attempt}".encode()).digest()[:4], "big") / 2**32


def _retryable(status: np.ndarray, dropped: np.ndarray) -> np.ndarray:
    """No answer, a server error, or a capacity limit that did not drop the request for its age."""
    limited = (status == 429) | (status == 503)
    return (status <= 0) | (limited & ~dropped) | ((status >= 500) & ~limited)


def _attempts(
    batch: pd.DataFrame, client: Client, retries: int, initial: float, cap: float, sleep, stopped: Stopped | None = None
) -> Iterator[pd.DataFrame]:
    """All attempts for one Arrow batch; only retryable failures are sent again.

    Before each call, requests of jobs that are to stop by then are taken out and answered.
    """
    pending, attempt = batch, 1
    strained = pd.Series(False, index=batch.index)  # an earlier attempt failed for capacity
    while len(pending):
        causes = stopped() if stopped else {}
        if causes:
            ends = pending["job_id"].isin(list(causes))
            if ends.any():
                yield _stopped_rows(pending[ends], causes, strained)
                pending = pending[~ends]
                continue
        out = client(pending).set_index("request_id").reindex(pending["request_id"])
        out = out.reindex(columns=OUTCOME)
        rows = pending[["request_id", *CARRIED]].reset_index(drop=True).astype(object)
        for c in OUTCOME:
            rows[c] = out[c].astype(object).to_numpy()
        status = pd.to_numeric(rows["status_code"], errors="coerce").fillna(0).to_numpy(np.float64)
        retry = _retryable(status, (rows["dropped_reason"] == V.DROPPED_TTL_EXPIRED).to_numpy()) & (attempt <= retries)
        waits, now = np.zeros(len(rows)), time.time()
        for k in np.flatnonzero(retry):
            jitter = _jitter(rows["request_id"][k], attempt)
            waits[k] = wait_seconds(status[k], attempt, rows["retry_after"][k], initial, cap, jitter, now)
        rows["attempt"] = attempt
        rows["wait_seconds"] = waits
        rows["final"] = ~retry
        rows["had_capacity_retry"] = strained.loc[pending.index].to_numpy()
        rows["retry_after"] = pd.to_numeric(rows["retry_after"], errors="coerce")
        rows["status_code"] = status.astype("int32")
        yield rows
        strained.loc[pending.index] |= (status == 429) | (status >= 500)
        pending = pending[retry]
        if len(pending):
            sleep(float(waits.max()))
        attempt += 1


def _stopped_rows(pending: pd.DataFrame, causes: Mapping[str, str], strained: pd.Series) -> pd.DataFrame:
    """Attempt rows, numbered 0 and final, for requests whose job stopped before they were sent (again)."""
    rows = pending[["request_id", *CARRIED]].reset_index(drop=True).astype(object)
    codes = [causes[j] for j in rows["job_id"]]
    made = {"status_code": 0, "body": None, "error_category": codes, "error_message": [V.BATCH_ERROR_MESSAGE.get(c, V.BATCH_ERROR_MESSAGE_DEFAULT) for c in codes],
            "dropped_reason": None, "retry_after": np.nan, "attempt": 0, "wait_seconds": 0.0, "final": True}
    rows = rows.assign(**made)
    rows["status_code"] = rows["status_code"].astype("int32")
    rows["had_capacity_retry"] = strained.loc[pending.index].to_numpy()
    return rows


def stops_in(folder: str) -> Stopped:
    """Reads a folder of stop causes again at every call: Parquet files with job_id, cause and ts.

    The first cause of a job counts. For `infer(stopped=...)`; the folder must be one that tasks can reach.
    """

    def read() -> dict[str, str]:
        from pyarrow import dataset, fs

        store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files = [f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.path.endswith(".parquet")]
        if not files:
            return {}
        rows = dataset.dataset(files, filesystem=store, format="parquet").to_table(columns=["job_id", "cause", "ts"]).to_pylist()
        first: dict[str, tuple] = {}
        for r in rows:
            if r["job_id"] not in first or (r["ts"], r["cause"]) < first[r["job_id"]]:
                first[r["job_id"]] = (r["ts"], r["cause"])
        return {job: f"batch_{cause}" for job, (_, cause) in first.items()}

    return read


def infer(
    plan: DataFrame,
    make_client: Callable[[], Client],
    max_retries: int = 3,
    initial_backoff: float = 1.0,
    max_backoff: float = 60.0,
    parallelism: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    stopped: Stopped | None = None,
) -> DataFrame:
    """One row per attempt of every planned request.

    `plan` has request_id, job_id, custom_id, route_key, prefix_hash, line_no, url and value.
    Rows meet by route key, job, prefix hash and runs of `RUN_LINES` lines, so equal system prompts
    sit next to each other while a hot model, job or prompt still spreads over many tasks. This is
    the one exchange that carries bodies, and it needs no sampling pass over them.
    `parallelism` is the number of partitions and so bounds concurrent calls. `make_client`
    runs once per partition; `prepare` adds the columns it wants to the placed rows, so that they
    are not shuffled. A retried Spark task calls the client again; give it the
    requests that `remaining` leaves when resuming. `stopped` is asked in the tasks before every call, so a
    job that is cancelled while its requests are being sent stops with the next batch.
    """
    n = parallelism or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run_of_lines = F.floor(F.col("line_no") / RUN_LINES)
    placed = plan.repartition(n, "route_key", "job_id", "prefix_hash", run_of_lines).sortWithinPartitions(
        "route_key", "prefix_hash", "line_no", "request_id"
    )
    fields = [T.StructField(c, T.StringType()) for c in CARRIED]
    schema = T.StructType([*fields, *ATTEMPT.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            for rows in _attempts(batch, client, max_retries, initial_backoff, max_backoff, sleep, stopped):
                yield rows[schema.names]

    return (prepare(placed) if prepare else placed).mapInPandas(run, schema)


def not_dispatched(requests: DataFrame, code: str = "cause") -> DataFrame:
    """Attempt rows, numbered 0 and final, for requests that are answered without a call.

    `cause` names the error: `batch_expired`, `batch_cancelled` or `batch_failed`.
    """
    made = {
        "attempt": F.lit(0),
        "status_code": F.lit(0),
        "error_category": F.col(code),
        "error_message": S.batch_error_message(F.col(code)),
        "wait_seconds": F.lit(0.0),
        "final": F.lit(True),
        "had_capacity_retry": F.lit(False),
    }
    kept = [*CARRIED, "request_id"]
    return requests.select(
        *CARRIED,
        *[
            (F.col(f.name) if f.name in kept else made.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name)
            for f in ATTEMPT.fields
        ],
    )


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned requests without a written result: where a re-run picks up."""
    return plan.join(done.select("request_id").distinct(), "request_id", "left_anti")


def capacity_retry(attempts: DataFrame) -> DataFrame:
    """Per request: number of attempts and whether any retried one failed for capacity."""
    flag = S.is_capacity_signal("status_code") & ~F.col("final")
    return attempts.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.coalesce(F.max(flag), F.lit(False)).alias("had_capacity_retry")
    )


def final_outcomes(attempts: DataFrame) -> DataFrame:
    """The last attempt of each request with the number of attempts.

    Each attempt carries the capacity flag over the ones before it, so bodies need no join.
    """
    return attempts.filter("final").withColumnRenamed("attempt", "attempts")


def echo_client() -> Client:
    """Deterministic stand-in for a model: answers 200 with character counts as tokens."""

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        texts = batch["user_prompt"].fillna("")
        return pd.DataFrame(
            {
                "request_id": batch["request_id"],
                "status_code": 200,
                "body": [
                    '{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"total_tokens":%d}}' % (len(t), len(t) // 2, len(t) + len(t) // 2)
                    for t in texts
                ],
                "error_category": None,
                "error_message": None,
                "dropped_reason": None,
                "retry_after": None,
            }
        )

    return call
