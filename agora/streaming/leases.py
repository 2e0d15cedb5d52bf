"""Jobs that workers hold on lease: claims, heartbeats and ends as events of a stream, with state per job.

A worker that claims a free job holds it for the length of a lease; each heartbeat starts the lease anew. A lease that runs out
gives the job back to the queue, or ends it if it has been tried often enough; what its worker sends later is refused. Times
are those of the events: a stream learns that a lease ran out when its watermark passes it, or from the job's next event.
State is in the checkpoint, so that a stream which stops and starts again goes on with the leases that it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOMES = "job_id long, at double, event string, worker string, outcome string, attempts int"
STATE = "status string, worker string, until double, attempts int"


class Lease(NamedTuple):
    status: str = "queued"
    worker: str | None = None
    until: float = 0.0
    attempts: int = 0


def expired(lease: Lease, now: float, most: int) -> Lease | None:
    """What becomes of a lease that ran out before ``now``; null if it hasn't."""
    if lease.status != "running" or now <= lease.until:
        return None
    return Lease("queued" if lease.attempts < most else "failed", None, lease.until, lease.attempts)


def after(lease: Lease, at: float, event: str, worker: str | None, length: float) -> tuple[Lease, str]:
    """The lease after a worker's event (claim, heartbeat, succeeded, failed), and what came of the event."""
    if event == "claim":
        if lease.status != "queued":
            return lease, "refused"
        return Lease("running", worker, at + length, lease.attempts + 1), "claimed"
    if lease.status != "running" or lease.worker != worker:
        return lease, "refused"
    if event == "heartbeat":
        return lease._replace(until=at + length), "kept"
    return Lease(event, worker, lease.until, lease.attempts), event


def told(job_id: int, events: pd.DataFrame, lease: Lease, length: float, most: int) -> tuple[Lease, list[tuple]]:
    """A job's events in order of time (of one time: of their ids), and what came of each and of leases that ran out between them."""
    rows = []
    for e in events.sort_values(["at", "event_id"], kind="stable").itertuples():
        gone = expired(lease, e.at, most)
        if gone:
            rows.append((job_id, lease.until, "expiry", lease.worker, gone.status, lease.attempts))
            lease = gone
        lease, outcome = after(lease, e.at, e.event, e.worker, length)
        rows.append((job_id, e.at, e.event, e.worker, outcome, lease.attempts))
    return lease, rows


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job_id", "at", "event", "worker", "outcome", "attempts"])


def seconds(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp").cast("double"))


def leases(events: DataFrame, length: float, most: int) -> DataFrame:
    """What came of all events (event_id, job_id, ts, event, worker) of a batch, up to its last one: see OUTCOMES."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return frame(told(int(key[0]), group, Lease(), length, most)[1])

    return seconds(events).select("event_id", "job_id", "at", "event", "worker").groupBy("job_id").applyInPandas(run, OUTCOMES)


def leased(events: DataFrame, length: float, most: int, late: str = "10 minutes") -> DataFrame:
    """The same of a stream, and leases that ran out although nothing more was heard of their jobs."""

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job_id, lease = int(key[0]), Lease(*state.get) if state.exists else Lease()
        if state.hasTimedOut:
            now, rows = state.getCurrentWatermarkMs() / 1000, []
            gone = expired(lease, now, most)
            if gone:
                rows, lease = [(job_id, lease.until, "expiry", lease.worker, gone.status, lease.attempts)], gone
        else:
            lease, rows = told(job_id, pd.concat(list(groups)), lease, length, most)
        state.update(tuple(lease))
        if lease.status == "running":
            state.setTimeoutTimestamp(max(int(lease.until * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield frame(rows)

    timed = seconds(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)).select("event_id", "job_id", "ts", "at", "event", "worker")
    return timed.groupBy("job_id").applyInPandasWithState(run, OUTCOMES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def job_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch's outcomes once, under its number."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
