"""What the operators of this subpackage share: shared-folder checkpoints, bounded Arrow chunks, id handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds at once in numpy form (a longer single text is held alone).
CHUNK_BYTES = 500_000
#: The tables written and not yet deleted in each ``scratch`` that is open in this context, the innermost last.
_open: ContextVar[tuple[set[str], ...]] = ContextVar("open scratches", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where every task runs on this
    machine, may do without: then a temporary folder is made once and set as the checkpoint folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(named)
        return named
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="agora-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table of the shared folder and read back: columnar, compressed, pruned on reading."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/agora-{name}-{uuid.uuid4().hex}"
    for tables in _open.get():
        tables.add(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.agora_path = path
    return back


def same_table(df: DataFrame, view: DataFrame) -> DataFrame:
    """``view``, which reads the table ``df`` alone and is released like it."""
    view.agora_path = df.agora_path
    return view


def remove(spark: SparkSession, *paths: str) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        for tables in _open.get():
            tables.discard(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, however it ends, the tables written in it: what is made of them must be written by then.

    Only those that this caller's thread or task wrote: others that run meanwhile keep theirs.
    """
    written: set[str] = set()
    token = _open.set((*_open.get(), written))
    try:
        yield
    finally:
        _open.reset(token)
        remove(spark, *written)


@contextmanager
def undone(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written in it if it fails; else they stay, since the result may read them."""
    written: set[str] = set()
    token = _open.set((*_open.get(), written))
    try:
        yield
    except BaseException:
        remove(spark, *written)
        raise
    finally:
        _open.reset(token)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``table`` wrote, once everything that reads them is written itself."""
    for df in tables:
        remove(df.sparkSession, df.agora_path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column, of the batch or else of its ``row``, with null as the empty text, in its 32-bit form."""
    at = batch.schema.get_field_index(column)
    found = batch.column(at) if at >= 0 else pc.struct_field(batch.column(batch.schema.get_field_index("row")), column)
    return pc.fill_null(found, "").cast(pa.string())


def in_rows(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` gathered in ``row``, whatever their names."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def keyed(docs: DataFrame) -> DataFrame:
    """row, id, text and row_key, which tells rows with one id but other texts apart."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.hash(docs["doc_id"], docs["text"]).alias("row_key"), docs["text"].alias("text"))


def offsets_of(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(text_of(batch, column))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def by_chunk(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A ``mapInArrow`` function that applies ``work`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, column):
            made = work(chunk)
            if made is not None and made.num_rows:
                yield made

    return run
