"""An append-only ledger of published rows, written by a stream: each batch once, each chained to the one before.

``rows/batch=N`` has a batch's rows, ``heads/N`` names it: number of rows, digest, and the head, which is the digest of the
head before and the batch's own. A batch exists once its head does. Heads are created, never overwritten; so of two writers
that saw the same last head one fails, and a batch that is replayed finds its head and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.operators.evidence import batch_digest, chained

HEADS = "batch long, n long, digest string, before string, head string"


class LedgerConflict(RuntimeError):
    """Another writer has published since, or the batch is older than the last one."""


def _file(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def heads(spark: SparkSession, folder: str) -> DataFrame:
    """batch, n, digest, before, head: one row a batch; none for a ledger that hasn't begun."""
    fs, path = _file(spark, f"{folder}/heads")
    return spark.read.schema(HEADS).json(f"{folder}/heads") if fs.exists(path) else spark.createDataFrame([], HEADS)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of batches that have a head, with their batch; what a failed batch left behind isn't read."""
    fs, path = _file(spark, f"{folder}/rows")
    if not fs.exists(path):
        raise FileNotFoundError(path.toString())
    return spark.read.parquet(f"{folder}/rows").withColumn("batch", F.col("batch").cast("long")).join(heads(spark, folder).select("batch"), "batch", "left_semi")


def row_digest(rows: DataFrame):
    """The digest of a row: of its columns by name, as JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns) if c not in ("batch", "row_sha256")]), {"ignoreNullFields": "false"}), 256)


def publisher(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends the rows whose key isn't published yet; of rows with one key the first by digest."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = heads(spark, folder)
        last = known.orderBy(F.desc("batch")).limit(1).collect()
        if last and known.where(F.col("batch") == batch_id).count():
            return
        if last and last[0]["batch"] > batch_id:
            raise LedgerConflict(f"batch {batch_id} after batch {last[0]['batch']}")
        fresh = batch.withColumn("row_sha256", row_digest(batch))
        fresh = fresh.withColumn("_turn", F.row_number().over(Window.partitionBy(key).orderBy("row_sha256"))).where("_turn = 1").drop("_turn")
        if last:
            fresh = fresh.join(entries(spark, folder).select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")
        place = f"{folder}/rows/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(place)
        own = batch_digest(spark.read.schema(fresh.schema).parquet(place).select(F.lit(batch_id).cast("long").alias("batch"), F.col("row_sha256").alias("digest"))).first()
        n, digest, before = (own["n"], own["digest"], last[0]["head"] if last else "") if own else (0, "", last[0]["head"] if last else "")
        head = spark.range(1).select(F.sha2(F.lit(before + digest), 256)).first()[0]
        fs, path = _file(spark, f"{folder}/heads/{batch_id:020d}.json")
        text = json.dumps({"batch": batch_id, "n": n, "digest": digest, "before": before, "head": head}) + "\n"
        try:
            out = fs.create(path, False)
        except Exception as error:
            raise LedgerConflict(f"batch {batch_id} was published by another writer") from error
        out.write(bytearray(text.encode()))
        out.close()

    return publish


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """batch and status of every head: sound, rows_changed (they don't make its digest), or chain_broken (the head isn't theirs)."""
    known = heads(spark, folder)
    rows = entries(spark, folder)
    found = batch_digest(rows.select("batch", row_digest(rows.drop("row_sha256")).alias("digest"))).select("batch", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    links = chained(known.select("batch", "n", "digest")).select("batch", F.col("head").alias("_head"))
    lined = known.join(links, "batch").join(found, "batch", "left").withColumn("_prior", F.coalesce(F.lag("head").over(Window.orderBy("batch")), F.lit("")))
    same = (F.col("n") == F.coalesce("_n", F.lit(0))) & (F.col("digest") == F.coalesce("_digest", F.lit("")))
    return lined.select("batch", F.when(~same, "rows_changed").when((F.col("head") != F.col("_head")) | (F.col("before") != F.col("_prior")), "chain_broken").otherwise("sound").alias("status"))
