"""What goes to the driver, to Python or into one task is bounded, whatever the tables' size."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__
from agora.operators import documents
from agora.sources import civic
from tests.conftest import DATA


def test_canonical_motions_are_not_broadcast(spark):
    plan = __spark_entry__.queries()["rem16_canonical_motions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_far_texts_are_not_compared_by_ratio(spark, monkeypatch):
    """Blocks of like length with other letters, and blocks that hold the target, need no ratio."""
    words = ["abcdefghij" * 6, "klmnopqrst" * 6, "uvwxyzabcd" * 6]
    rows = [(1, k, w) for k, w in enumerate(words)] + [(2, 10, words[0]), (2, 11, words[0] + " now"), (3, 20, words[1]), (3, 21, "the " + words[1][:30] + words[1][30:])]
    blocks = spark.createDataFrame(rows, "doc long, place long, text string")
    motions = spark.createDataFrame([(d, k, t, None) for d, k, t in rows], "doc long, id long, text string, quote string")
    wanted = [(r.id, r.place) for r in documents.motion_sources(motions, blocks).orderBy("id").collect()]
    assert wanted == [(0, 0), (1, 1), (2, 2)]
    monkeypatch.setattr(documents, "ratio", lambda a, b, junk=True: F.raise_error(F.concat(a, b)).cast("double"))
    assert [(r.id, r.place) for r in documents.motion_sources(motions, blocks).orderBy("id").collect()] == wanted


def test_votes_of_a_large_table_are_dealt_to_more_tasks(spark, monkeypatch):
    counts = lambda: sorted(tuple(r) for r in __spark_entry__.queries()["agg09_complete_counts"](spark, DATA).collect())
    wanted = counts()
    monkeypatch.setattr(civic, "ROWS", 500)
    votes = civic.Civic(spark, DATA).votes
    assert votes.rdd.getNumPartitions() >= 10 and counts() == wanted
