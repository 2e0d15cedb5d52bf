"""Entity resolution: candidate pairs, staged matching, ordered clustering, alignment chains."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.joins import overlapping

def complete_link(links: DataFrame, forbidden: DataFrame, component: str, least: float) -> DataFrame:
    """component, cluster, member: groups merged along links (a, b, confidence), the surest first, unless a pair of the two
    groups is forbidden. The order decides, so each connected component is one ordered pass.
    """
    pairs = lambda df, c: df.select(F.col(component), F.struct((-c).alias("turn"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("pair"))
    sure = pairs(links.where(F.col("confidence") >= least), F.col("confidence").cast("double"))
    grouped = sure.groupBy(component).agg(F.array_sort(F.collect_list("pair")).alias("links")).join(pairs(forbidden, F.lit(0.0)).groupBy(component).agg(F.collect_set("pair").alias("no")), component, "left")

    @F.pandas_udf("array<struct<cluster: long, member: long>>")
    def merge(links: pd.Series, no: pd.Series) -> pd.Series:
        return pd.Series([clusters([(x["a"], x["b"]) for x in a], set() if b is None else {(x["a"], x["b"]) for x in b}) for a, b in zip(links, no, strict=True)])

    return grouped.select(component, F.explode(merge("links", "no")).alias("_made")).select(component, "_made.cluster", "_made.member")


def clusters(links: list[tuple[int, int]], forbidden: set[tuple[int, int]]) -> list[dict]:
    """Members of each cluster of several, named by its least one; links come in the order in which they are tried.

    Each cluster keeps the members that its own may not meet, so that a link is judged by the smaller of the two.
    """
    owner: dict[int, int] = {}
    members: dict[int, set[int]] = {}
    foes: dict[int, set[int]] = {}
    for a, b in forbidden:
        foes.setdefault(a, set()).add(b)
        foes.setdefault(b, set()).add(a)
    for a, b in links:
        for x in (a, b):
            if x not in owner:
                owner[x], members[x] = x, {x}
                foes.setdefault(x, set())
        p, q = sorted((owner[a], owner[b]))
        if p == q or not foes[p].isdisjoint(members[q]):
            continue
        for x in members[q]:
            owner[x] = p
        members[p] |= members.pop(q)
        foes[p] = foes[p] | foes[q]
    return [{"cluster": k, "member": x} for k, v in members.items() if len(v) > 1 for x in sorted(v)]


def monotonic_chain(options: DataFrame, least: float = 2.0) -> DataFrame:
    """meeting_id, item, time, score of the heaviest choice of at most one option per item whose times never fall.

    The options of a meeting's agenda items are one ordered pass: the heaviest chain that ends by a time is looked up in a
    binary indexed tree, so that n options take n log n steps; of equals the first option by item and time.
    """

    def best(group: pd.DataFrame) -> pd.DataFrame:
        rows = group[group.score >= least].sort_values(["item", "time"], kind="stable").reset_index(drop=True)
        value = (rows.score - 1e-7 * rows.time).to_numpy(float)
        item, time = rows["item"].to_numpy(), rows["time"].to_numpy(float)
        total, back = value.copy(), [-1] * len(rows)
        turn = np.searchsorted(np.unique(time), time) + 1
        heaviest: list[tuple[float, int]] = [(0.0, 0)] * (len(rows) + 1)
        first = 0
        for k in range(len(rows)):
            if item[k] != item[first]:
                for j in range(first, k):
                    at, entry = turn[j], (total[j], -j)
                    while at <= len(rows):
                        heaviest[at] = max(heaviest[at], entry)
                        at += at & -at
                first = k
            at, found = turn[k], (0.0, 0)
            while at:
                found = max(found, heaviest[at])
                at &= at - 1
            if found[0] + value[k] > total[k]:
                total[k], back[k] = found[0] + value[k], -found[1]
        chosen = []
        k = int(total.argmax()) if len(rows) else -1
        while k >= 0:
            chosen.append(k)
            k = back[k]
        return rows.loc[chosen[::-1], ["meeting_id", "item", "time", "score"]]

    return options.groupBy("meeting_id").applyInPandas(best, "meeting_id long, item long, time double, score double")


def best_speaker(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """id, speaker, coverage, competing: whose turns cover a segment most (ties by name), and how far others do.

    Overlaps are clipped to the segment and united per speaker, so that a speaker's overlapping turns count once. A segment
    without length has no shares: NaN.
    """
    over = overlapping(segments.select("id", "meeting_id", "start_time", "end_time"), turns.select("meeting_id", "speaker", "start_time", "end_time"), ["meeting_id"])
    clipped = over.select("id", F.col("b_speaker").alias("speaker"), (F.col("end_time") - F.col("start_time")).alias("_len"), F.greatest("start_time", "b_start_time").alias("lo"), F.least("end_time", "b_end_time").alias("hi"))
    order = Window.partitionBy("id", "speaker").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(reach, F.col("lo"))))
    per = clipped.withColumn("_added", added).groupBy("id", "speaker").agg(F.when(F.max("_len") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum("_added"), F.max("_len"))).alias("share"))
    ranked = per.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.col("share").desc(), "speaker")))
    return ranked.groupBy("id").agg(F.max(F.when(F.col("_k") == 1, F.col("speaker"))).alias("speaker"), F.max("share").alias("coverage"), F.coalesce(F.max(F.when(F.col("_k") > 1, F.col("share"))), F.lit(0.0)).alias("competing"))


def merged_matters(pairs: DataFrame, matters: DataFrame) -> DataFrame:
    """cluster, canonical, merged, first_year, last_year: the earliest member (by year, id) stands for all."""
    rows = pairs.join(matters.select(F.col("id").alias("_i"), "year"), F.col("member") == F.col("_i"))
    return rows.groupBy("cluster").agg(F.min_by("member", F.struct("year", "member")).alias("canonical"), F.array_sort(F.collect_set("member")).alias("merged"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def unique_matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left_id, right_id of keys that exactly one row of each side has."""
    l = left.groupBy(*keys).agg(F.min("id").alias("left_id"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")  # noqa: E741
    r = right.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("id").alias("right_id"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return l.join(r, [F.col(k) == F.col(f"_{k}") for k in keys]).select("left_id", "right_id")
