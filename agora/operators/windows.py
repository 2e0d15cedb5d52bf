"""Order-dependent operators as window functions: running states, gaps and islands, interpolation, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def item_ends(items: DataFrame, meeting_end: str) -> DataFrame:
    """Each timed item's end: the next timed start of its meeting, or the meeting's end."""
    order = Window.partitionBy("meeting_id").orderBy("start_time", "id")
    following = F.lead("start_time").over(order)
    return items.where("start_time is not null").withColumn("end_at", F.coalesce(following, F.col(meeting_end)))


def interpolated(items: DataFrame, least: float = 2.0) -> DataFrame:
    """Starts between anchored ones by linear interpolation over places; before the first anchor, null.

    A start is at least ``least`` seconds after the anchor before it, and just so long after the last one.
    """
    order = Window.partitionBy("meeting_id").orderBy("place")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.col("start_time").isNotNull()
    a_at, a_place = F.last("start_time", True).over(before), F.last(F.when(known, F.col("place")), True).over(before)
    b_at, b_place = F.first("start_time", True).over(after), F.first(F.when(known, F.col("place")), True).over(after)
    between = a_at + (b_at - a_at) * (F.col("place") - a_place) / (b_place - a_place)
    return items.withColumn("start_at", F.when(known, F.col("start_time")).otherwise(F.greatest(between, a_at + least)))


def turns(segments: DataFrame, gap: float | None = None) -> DataFrame:
    """Consecutive segments of one speaker in a meeting as one turn; a new one starts with another speaker or after a gap."""
    order = Window.partitionBy("meeting_id").orderBy("start_time", "id")
    changed = ~F.lag("speaker_id").over(order).eqNullSafe(F.col("speaker_id"))
    if gap is not None:
        changed |= F.col("start_time") - F.lag("end_time").over(order) > gap
    numbered = segments.withColumn("_new", changed.cast("int")).withColumn("turn", F.sum("_new").over(order))
    return numbered.groupBy("meeting_id", "turn").agg(F.first("speaker_id").alias("speaker_id"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("segments"))


def spread_sample(rows: DataFrame, keys: Sequence[str], day: str, score: str, low: str, high: str, buckets: int = 4, each: int = 2, total: int = 8) -> DataFrame:
    """Up to ``total`` rows of each group, spread over its time from ``low`` to ``high`` (dates of the group).

    The time is divided into equal parts, each of which gives its ``each`` best rows; the rest are the best of all others,
    with those that have no day or lie outside. Adds bucket, null for these. A group of up to ``total`` rows stays whole.
    """
    part = F.greatest(F.datediff(high, low), F.lit(1)) / buckets
    place = (F.datediff(day, low) / part).cast("int")
    placed = rows.withColumn("bucket", F.when(place >= 0, F.least(place, F.lit(buckets - 1))))
    inside = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(F.col(score).desc(), "id"))
    placed = placed.withColumn("_first", F.col("bucket").isNotNull() & (inside <= each))
    return first_of(placed, keys, [F.col("_first").desc(), F.col(score).desc(), F.col("id")], total).drop("_first")


def positional(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], top: float = 0.1, span: float = 0.09) -> DataFrame:
    """A score that falls from ``top`` by ``span`` over the rows of a list."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("score", top - (F.row_number().over(w.orderBy(*order)) - 1) / F.count(F.lit(1)).over(w) * span)


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Rows numbered by session: a new one after a pause longer than the gap."""
    order = Window.partitionBy(key).orderBy(time, "event_id")
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(order).cast("timestamp"))
    return events.withColumn("_new", F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("_new").over(order))
