"""Items of a meeting with very many segments: equal texts and titles meet once, times are looked up."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.operators import alignment


def test_markers_of_a_meeting_of_many_segments_and_items(spark):
    """Forty thousand segments and as many items, which would be 1.6 billion pairs."""
    n = 40_000
    k = F.col("id")
    said = F.when(k % 4 == 0, F.concat(F.lit("Next is item 7."), (k % 1000).cast("string"))).when(k % 4 == 1, "the Budget plan").when(k % 4 == 2, F.concat(F.lit("so much for "), k.cast("string")))
    segments = spark.range(n).select(F.lit(1).cast("long").alias("meeting_id"), "id", k.cast("double").alias("start_time"), said.alias("text"))
    number = F.when(k % 2 == 0, F.concat(F.lit("7."), (k % 1000).cast("string")))
    title = F.when(k % 4 == 3, "Plan").when(k % 4 == 1, "Budgets")
    items = spark.range(n).select(F.lit(1).cast("long").alias("meeting_id"), "id", number.alias("number"), title.alias("title"), F.when(k % 3 != 0, k + 0.5).alias("start_time"))
    got = {r.item_id: (r.at, r.score) for r in alignment.item_markers(items, segments).collect()}

    def wanted(i: int) -> tuple[float, float] | None:
        if i % 4 == 0:
            last = i % 1000  # the segments of this number are a thousand apart, and one is the item's own
            return (float(i) if i % 3 else float(last)), alignment.NAMED
        if i % 4 == 3:  # "plan" in every fourth segment from the second
            return (float(min(range(max(1, i - 2), min(n, i + 5)), key=lambda t: (t % 4 != 1, abs(t - i - 0.5), t))) if i % 3 else 1.0), alignment.WORDS
        return None

    assert got == {i: w for i in range(n) if (w := wanted(i))}


def test_words_and_numbers_within_longer_ones(spark):
    said = ["preplanning20245 it", "section 3 1.2 of it", "v3.1.2", "3.1.2.5", "1234567", "ITEM 12."]
    segments = spark.createDataFrame([(1, k, float(k), t) for k, t in enumerate(said)] + [(1, 9, 9.0, None)], "meeting_id long, id long, start_time double, text string")
    items = [(1, 1, "3.1.2", "none", None), (1, 2, None, "Planning 2024", 50.0), (1, 3, "1234567", "", None), (1, 4, "12", "", 3.0), (1, 5, "3.1.2.5", "", None), (1, 6, "3.1", "Budget, budget", None)]
    markers = alignment.item_markers(spark.createDataFrame(items, "meeting_id long, id long, number string, title string, start_time double"), segments)
    assert {r.item_id: (r.at, r.score) for r in markers.collect()} == {1: (1.0, 1.2), 2: (0.0, 0.8), 3: (4.0, 1.0), 4: (5.0, 1.2), 5: (3.0, 1.0)}
