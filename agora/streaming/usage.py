"""Event monitoring; every function takes a batch or a stream of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and values per hour and type; a stream drops what comes later than the watermark."""
    rows = timed(events).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "2 hours") -> DataFrame:
    rows = timed(events).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.approx_count_distinct("user_id").alias("users")).select("window.start", "window.end", "users")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "2 hours") -> DataFrame:
    rows = timed(events).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def files(spark, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drained(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is there and stops; started again it goes on where it stopped."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
