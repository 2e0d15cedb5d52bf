"""Connected components of an edge table, wholly in Spark: stars, then pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.runtime import release, same_table, table


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b long): root is the least node reachable, itself included.

    Each round every node points to its least neighbour below it, and its other neighbours below are joined to that one;
    once no node has two, the pointers form a forest, whose depth doubling halves. Rows are pre-aggregated before each
    shuffle; no node's neighbours ever meet in one task. Null and self edges don't count; an empty table gives none. The
    result is a table of the shared folder, for the caller to release.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    edges = edges.where(known & (F.col("a") != F.col("b"))).select(high.alias("hi"), low.alias("lo")).distinct()
    edges = table(edges, "edges")
    while True:
        stars = table(edges.groupBy("hi").agg(F.min("lo").alias("lo"), F.max("lo").alias("most")), "stars")
        if stars.where("lo < most").isEmpty():
            break
        several = stars.where("lo < most").select(F.col("hi").alias("of"), F.col("lo").alias("least"))
        rest = edges.join(several, F.col("hi") == F.col("of")).where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        joined = table(stars.select("hi", "lo").union(rest).distinct(), "edges")
        release(edges, stars)
        edges = joined
    release(edges)
    roots = F.struct(F.col("lo").alias("node"), F.col("lo").alias("root"))
    up = table(stars.select(F.inline(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("root")), roots))).groupBy("node").agg(F.min("root").alias("root")), "roots")
    release(stars)
    while True:
        over = up.select(F.col("node").alias("via"), F.col("root").alias("higher"))
        jumped = table(up.join(over, F.col("root") == F.col("via")).select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")), "roots")
        release(up)
        up = jumped
        if up.where("moved").isEmpty():
            return same_table(up, up.drop("moved"))
