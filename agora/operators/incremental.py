"""Incremental work: merges, claims, budgets, change detection, compare-and-swap, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _renamed(rows: DataFrame, mark: str = "_new_") -> DataFrame:
    return rows.select(*[F.col(c).alias(mark + c) for c in rows.columns])


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], update: bool = True) -> DataFrame:
    """The table after a merge by key: changed rows replace or, without ``update``, leave those there; others are added.

    A null in a change is a value like any other. Changes must have one row per key.
    """
    new = _renamed(changes)
    joined = current.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys], "full_outer")
    takes = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(update))
    return joined.select(*[F.when(takes, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in current.columns])


def patched(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the values of the changes that aren't null."""
    new = _renamed(changes)
    return current.join(new, F.col(key) == F.col(f"_new_{key}"), "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in current.columns])


def replaced(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the keys in ``fresh`` replaced by those there."""
    keys = fresh.select(F.col(key).alias("_k")).distinct()
    return current.join(keys, F.col(key) == F.col("_k"), "left_anti").unionByName(fresh)


def claim(jobs: DataFrame, worker: str, now: str, kinds: Sequence[int] | None = None, count: int = 1) -> DataFrame:
    """The next jobs: queued, attempts left, no other of the same source running; by priority, then age, then id.

    One writer claims at a time (a foreachBatch sink), which takes the place of row locks.
    """
    running = jobs.where("status = 'running'").select(F.col("municipality_id").alias("_m"), F.col("source_id").alias("_s"))
    free = jobs.where("status = 'queued' and attempts < max_attempts")
    if kinds is not None:
        free = free.where(F.col("kind").isin(list(kinds)))
    free = free.join(running, (F.col("municipality_id") == F.col("_m")) & (F.col("source_id") == F.col("_s")), "left_anti")
    taken = free.orderBy(F.col("priority").desc(), "requested_at", "id").limit(count)
    return taken.withColumn("status", F.lit("running")).withColumn("worker", F.lit(worker)).withColumn("started_at", F.lit(now).cast("timestamp_ntz")).withColumn("attempts", F.col("attempts") + 1)


def within_budget(requests: DataFrame, day: str, order: Sequence[str], limit: int) -> DataFrame:
    """Adds allowed and remaining: the n-th request of a day is allowed if n is at most the limit."""
    if limit is None or limit < 0:
        raise ValueError("the limit is a number of requests")
    n = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return requests.withColumn("_n", n).withColumn("allowed", F.col("_n") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("_n"))).drop("_n")


def changed(known: DataFrame, seen: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change of rows that are new, gone or of another digest."""
    s = seen.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    both = known.select(F.col(key).alias("_key"), F.col(digest).alias("_old")).join(s, F.col("_key") == F.col("_k"), "full_outer")
    change = F.when(F.col("_key").isNull(), "new").when(F.col("_k").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_d")), "changed")
    return both.select(F.coalesce("_key", "_k").alias(key), change.alias("change")).where("change is not null")


def reasons(rows: DataFrame, tests: dict[str, object]) -> DataFrame:
    """Adds reasons, the names of the tests that hold, in order; rows without any are left out."""
    named = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return rows.withColumn("reasons", named).where(F.size("reasons") > 0)


def compare_and_swap(current: DataFrame, writes: DataFrame, receipts: DataFrame, key: str, value: str) -> DataFrame:
    """key, status of every write (key, expected, value, input_hash) against the current values and earlier receipts.

    already_applied: a receipt of the same input, and the value there is what it wrote. conflict: the value isn't the one
    expected. protected: the row is verified. else applied.
    """
    c = current.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col("verified").alias("_verified"))
    r = receipts.select(F.col("input_hash").alias("_h"), F.col(value).alias("_after"))
    rows = writes.join(c, F.col(key) == F.col("_k"), "left").join(r, F.col("input_hash") == F.col("_h"), "left")
    same = F.col("_h").isNotNull() & F.col("_v").eqNullSafe(F.col("_after"))
    status = F.when(same, "already_applied").when(~F.col("_v").eqNullSafe(F.col("expected")), "conflict").when(F.coalesce("_verified", F.lit(False)), "protected").otherwise("applied")
    return rows.select(key, status.alias("status"))


def fresh_answers(cache: DataFrame, last_ingest: DataFrame, now: str) -> DataFrame:
    """Cached answers that haven't expired and are newer than the last ingest (one row)."""
    at = F.lit(now).cast("timestamp_ntz")
    newest = last_ingest.agg(F.max("updated_at").alias("_last"))
    return cache.crossJoin(newest).where((F.col("expires_at") > at) & (F.col("_last").isNull() | (F.col("created_at") > F.col("_last")))).drop("_last")


def reconciled(events: DataFrame, meetings: DataFrame, days: int) -> DataFrame:
    """event_id, meeting_id, status: bound if exactly one meeting of the organisation lies within some days, else held or created.

    Meetings are counted by day first, so that an event meets days and not meetings. Days go to buckets as wide as the
    window, and events ask three of them, so that the join is by equality.
    """
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days)
    m = meetings.groupBy(F.col("organization_id").alias("_o"), F.col("meeting_date").alias("_d")).agg(F.count("id").alias("_many"), F.min("id").alias("_first")).withColumn("_b", number("_d"))
    e = events.withColumn("_near", F.explode(F.array(*[number("event_date") + k for k in (-1, 0, 1)])))
    found = e.join(m, (F.col("organization_id") == F.col("_o")) & (F.col("_near") == F.col("_b")) & (F.abs(F.datediff("event_date", "_d")) <= days), "left")
    g = found.groupBy("event_id").agg(F.coalesce(F.sum("_many"), F.lit(0)).alias("_n"), F.min("_first").alias("_m"))
    return g.select("event_id", F.when(F.col("_n") == 1, F.col("_m")).alias("meeting_id"), F.when(F.col("_n") == 1, "bound").when(F.col("_n") > 1, "held").otherwise("created").alias("status"))


def transition_errors(before: DataFrame, writes: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys where before, changed as intended, isn't what is there after."""
    expected = upsert(before.select(key, value), writes.select(key, value), [key]).select(F.col(key).alias("_k"), F.col(value).alias("_expected"))
    a = after.select(key, F.col(value).alias("_after"))
    both = expected.join(a, F.col("_k") == F.col(key), "full_outer")
    return both.where(~F.col("_expected").eqNullSafe(F.col("_after")) | F.col(key).isNull() | F.col("_k").isNull()).select(F.coalesce("_k", key).alias(key), "_expected", "_after").toDF(key, "expected", "actual")
