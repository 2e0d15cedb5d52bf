"""Intermediate tables that much is made of: planned and computed once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may do without, and has a temporary one set."""
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="agora-checkpoint-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read back, and where; what is made of it has none of its plan."""
    path = f"{folder(df.sparkSession)}/agora-{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except BaseException:
        remove(df.sparkSession, path)
        raise
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stays(df: DataFrame, name: str) -> DataFrame:
    """A table that is left in the folder, as what a query returns reads it."""
    return written(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that keeps a table until the end, however it ends: what is made of them must be ``written`` by then."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        back, path = written(df, name)
        paths.append(path)
        return back

    try:
        yield keep
    finally:
        for path in paths:
            remove(spark, path)
