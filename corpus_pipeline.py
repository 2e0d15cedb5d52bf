"""A corpus pipeline: toxicity, line dedup, near-duplicate documents, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A null doc_id, a null text or repeated rows go through as
each operator defines it; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import line_dedup, packing, simhash, substring_dedup, toxicity
from agora.llm.queries import vocabulary_path
from agora.llm.runtime import read_table, remove, scratch, shared_folder

#: SQL can't express the first stage (a trained model); the tests hold the stages against brute force.
ORACLE_SQL = None


def with_text(found: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the text that an operator left and its length, where there is such a column."""
    kept = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[F.when(F.col("row.text").eqNullSafe(F.col("kept")), F.col(f"row.`{c}`")).otherwise(kept[c]).alias(c) if c in kept else F.col(f"row.`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, learned from the labels."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier ones up to one edit; a text may become empty."""
    return with_text(line_dedup.dedup(docs, bound=1), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash fingerprints linked at four differing bits or fewer, as ``op7_simhash`` links them)
    the one with the smallest doc_id; documents without an id stay."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"), shingle=4, radius=4)
    away = found.where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("away")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(away, F.col("row.doc_id") == F.col("away"), "left_anti").select("row.*")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that a document with a smaller doc_id has, too."""
    return with_text(substring_dedup.dedup(docs, length=50), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, emptied ones too, with the sequence and offset that each has."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; what each stage returns is written to the shared folder and read again.

    A stage's result is deleted once the next one's is written, and so is whatever the stage left in the folder.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            path = f"{shared_folder(spark).rstrip('/')}/agora-stage-{name}-{uuid.uuid4().hex}"
            made.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
