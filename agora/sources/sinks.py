"""Sinks: whole-key replacement by partition, append with idempotent batches, nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Overwrites the partitions of the keys that the rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_batch(path: str):
    """For foreachBatch: each batch is a partition of its own, so that a repeated batch replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def api_json(rows: DataFrame, key: str) -> DataFrame:
    """key and body, the row as JSON without null fields."""
    return rows.select(F.col(key), F.to_json(F.struct(*rows.columns)).alias("body"))


def sitemap(rows: DataFrame, base: str, prefix: str) -> DataFrame:
    """url entries, one a row, of things with an id and a day of change."""
    return rows.select("id", F.concat(F.lit(f"<url><loc>{base}/{prefix}-"), F.col("id").cast("string"), F.lit("</loc>"), F.when(F.col("day").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("day").cast("string"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>")).alias("entry"))
