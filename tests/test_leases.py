"""Leases: a stream gives what a batch gives, and passes a job on when its worker falls silent, restarts included."""

from __future__ import annotations

import random

from agora.streaming import leases

SCHEMA = "event_id long, job_id long, ts timestamp, event string, worker string"


def rows(spark, *events):
    from datetime import datetime, timedelta

    return spark.createDataFrame([(k, job, datetime(2024, 1, 1) + timedelta(seconds=at), event, worker) for k, job, at, event, worker in events], SCHEMA)


def test_rules(spark):
    events = [(0, 1, 0, "claim", "a"), (1, 1, 5, "claim", "b"), (2, 1, 9, "heartbeat", "a"), (3, 1, 19, "heartbeat", "a"), (4, 1, 30, "heartbeat", "a"), (5, 1, 31, "claim", "b"), (6, 1, 32, "succeeded", "a"), (7, 1, 33, "succeeded", "b"), (8, 1, 34, "claim", "c"), (9, 2, 0, "heartbeat", "a"), (10, 2, 1, "claim", "a"), (11, 2, 50, "claim", "a"), (12, 2, 99, "claim", "a"), (13, 2, 200, "claim", "b")]
    got = sorted((r.job_id, r.at % 86400, r.event, r.worker, r.outcome, r.attempts) for r in leases.leases(rows(spark, *events), 10.0, 3).collect())
    assert got == sorted(
        [
            (1, 0, "claim", "a", "claimed", 1), (1, 5, "claim", "b", "refused", 1), (1, 9, "heartbeat", "a", "kept", 1), (1, 19, "heartbeat", "a", "kept", 1), (1, 29, "expiry", "a", "queued", 1), (1, 30, "heartbeat", "a", "refused", 1),
            (1, 31, "claim", "b", "claimed", 2), (1, 32, "succeeded", "a", "refused", 2), (1, 33, "succeeded", "b", "succeeded", 2), (1, 34, "claim", "c", "refused", 2), (2, 0, "heartbeat", "a", "refused", 0), (2, 1, "claim", "a", "claimed", 1),
            (2, 11, "expiry", "a", "queued", 1), (2, 50, "claim", "a", "claimed", 2), (2, 60, "expiry", "a", "queued", 2), (2, 99, "claim", "a", "claimed", 3), (2, 109, "expiry", "a", "failed", 3), (2, 200, "claim", "b", "refused", 3),
        ]
    )


def drain(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = leases.leased(stream, 60.0, 3, late="0 seconds").writeStream.foreachBatch(leases.job_sink(f"{tmp_path}/out")).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("job_id", "event", "worker", "outcome", "attempts").collect()]


def test_a_silent_worker_s_lease_passes_on(spark, tmp_path):
    send = lambda *events: rows(spark, *events).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    send((0, 1, 0, "claim", "a"), (1, 1, 30, "heartbeat", "a"))
    assert sorted(drain(spark, tmp_path)) == [(1, "claim", "a", "claimed", 1), (1, "heartbeat", "a", "kept", 1)]
    # the stream stopped between two heartbeats; another job's event tells that the lease is over
    send((2, 2, 500, "claim", "b"))
    assert (1, "expiry", "a", "queued", 1) in drain(spark, tmp_path)
    send((3, 1, 510, "heartbeat", "a"), (4, 1, 511, "claim", "b"), (5, 1, 520, "succeeded", "b"))
    got = drain(spark, tmp_path)
    assert {(1, "heartbeat", "a", "refused", 1), (1, "claim", "b", "claimed", 2), (1, "succeeded", "b", "succeeded", 2)} <= set(got) and len(got) == 7


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    rng = random.Random(3)
    events = [(k, rng.randrange(4), 9 * k, rng.choice(["claim", "claim", "heartbeat", "succeeded", "failed"]), rng.choice("ab")) for k in range(60)]
    for lo in range(0, 60, 20):
        rows(spark, *events[lo : lo + 20]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = drain(spark, tmp_path)
    wanted = [(r.job_id, r.event, r.worker, r.outcome, r.attempts) for r in leases.leases(rows(spark, *events), 60.0, 3).collect()]
    extra = [x for x in got if x not in wanted]
    assert sorted(x for x in got if x[1] != "expiry") == sorted(x for x in wanted if x[1] != "expiry") and all(x[1] == "expiry" for x in extra)
