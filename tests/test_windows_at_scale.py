"""Points in windows, overlaps and chains against brute force, and the work that they may take."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from agora.operators import alignment, documents, entities, joins, votes

INF, NAN = float("inf"), float("nan")


def at_least(a, b):
    """a >= b in the order in which NaN comes after all numbers."""
    return math.isnan(a) or not math.isnan(b) and a >= b


@pytest.mark.parametrize("closed", ["left", "both"])
def test_point_in_window_is_brute_force(spark, closed):
    dice = random.Random(5)
    points = [(k, dice.choice([1, 2, 3, None]), dice.choice([None, INF, -INF, NAN, 5.0, dice.uniform(-50, 50), dice.uniform(-50, 50), 1e300])) for k in range(150)]
    windows = []
    for k in range(60):
        start = dice.choice([dice.uniform(-60, 60), dice.uniform(-60, 60), 5.0, -INF, None])
        windows.append((k, dice.choice([1, 2, 4, None]), start, dice.choice([INF, NAN, None, 5.0] + [(start or 0.0) + dice.choice([0.0, 3.0, 900.0, -4.0])] * 4)))
    p, w = spark.createDataFrame(points, "id long, m long, start_time double"), spark.createDataFrame(windows, "w long, m long, start double, end double")
    wanted = set()
    for i, m, t in points:
        held = {(i, k) for k, n, a, b in windows if m is not None and m == n and None not in (t, a, b) and at_least(t, a) and (at_least(b, t) if closed == "both" else not at_least(t, b))}
        wanted |= held or {(i, None)}
    got = [(r.id, r.w_w) for r in joins.point_in_window(p, w, ["m"], closed=closed, how="left").select("id", "w_w").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    got = [(r.id, r.w_w) for r in joins.point_in_window(p, w, ["m"], closed=closed).select("id", "w_w").collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in wanted if x[1] is not None}


def test_overlaps_are_brute_force(spark):
    dice = random.Random(6)

    def spans(n):
        return [(k, dice.choice([1, 2]), (a := dice.choice([dice.uniform(0, 90), 30.0, 0.0])), a + dice.choice([0.0, 2.0, 9.0, 200.0, -5.0])) for k in range(n)]

    a, b = spans(70), spans(50)
    got = joins.overlapping(*[spark.createDataFrame(x, "id long, m long, start_time double, end_time double") for x in (a, b)], ["m"]).select("id", "b_id").collect()
    wanted = {(i, j) for i, m, s, e in a for j, n, t, f in b if m == n and s < f and e > t}
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_points_meet_the_windows_near_by_alone(spark):
    points = spark.range(2000).select(F.col("id"), F.lit(1).alias("m"), (F.col("id") * 12.0).alias("start_time"))
    windows = spark.range(400).select(F.lit(1).alias("m"), (F.col("id") * 60.0).alias("start"), (F.col("id") * 60.0 + 70).alias("end"), F.col("id").alias("w"))
    windows = windows.unionByName(spark.createDataFrame([(1, 0.0, 1e6, -1)], "m int, start double, end double, w long").select(F.col("m"), "start", "end", "w"))
    p, w = joins.bucketed(points, windows.withColumnRenamed("m", "n"), {"m": "n"}, "start_time", "start", "end")
    assert p.count() == 2000 and w.count() <= 3 * 401
    pairs = p.join(w, (F.col("m") == F.col("n")) & (F.col("_bucket") == F.col("_of_bucket"))).count()
    assert pairs < 2000 * 6 < 2000 * 401


def test_segments_without_length_have_no_shares(spark):
    segments = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 0.0, 10.0)], "id long, meeting_id long, start_time double, end_time double")
    turns = spark.createDataFrame([(1, "b", 0.0, 10.0), (1, "a", 2.0, 8.0)], "meeting_id long, speaker string, start_time double, end_time double")
    got = {r.id: r for r in entities.best_speaker(segments, turns).collect()}
    assert got[1].speaker == "a" and math.isnan(got[1].coverage) and math.isnan(got[1].competing)
    assert (got[2].speaker, got[2].coverage, got[2].competing) == ("b", 1.0, 0.6)


def chain_by_pairs(rows):
    rows = sorted((r for r in rows if r[2] >= 2), key=lambda r: r[:2])
    total, back = [s - 1e-7 * t for _, t, s in rows], [-1] * len(rows)
    for k in range(len(rows)):
        own = total[k]
        for j in range(k):
            if rows[j][0] < rows[k][0] and rows[j][1] <= rows[k][1] and total[j] + own > total[k]:
                total[k], back[k] = total[j] + own, j
    k, out = (total.index(max(total)) if rows else -1), []
    while k >= 0:
        out.append(rows[k])
        k = back[k]
    return out[::-1]


def test_chains_are_those_of_all_pairs(spark):
    dice = random.Random(7)
    options = [(m, dice.randrange(8), float(dice.randrange(-5, 40)), dice.choice([1.0, 2.0, 2.5, 3.0, 7.0, 4.125])) for m in range(40) for _ in range(dice.randrange(1, 40))]
    got: dict[int, list] = {}
    for r in entities.monotonic_chain(spark.createDataFrame(options, "meeting_id long, item long, time double, score double")).collect():
        got.setdefault(r.meeting_id, []).append((r["item"], r["time"], r.score))
    for m in range(40):
        assert got.get(m, []) == chain_by_pairs([o[1:] for o in options if o[0] == m])


def test_long_chains_take_few_steps(spark):
    options = spark.range(40_000).select(F.lit(1).cast("long").alias("meeting_id"), (F.col("id") % 11).alias("item"), (F.col("id") * 1.0).alias("time"), (F.col("id") % 97 + 2.0).alias("score"))
    began = time.time()
    assert 0 < entities.monotonic_chain(options).count() <= 11
    assert time.time() - began < 60


def test_voters_by_stays(spark):
    dice = random.Random(8)
    events = [(k, dice.choice([1, 2]), dice.choice([5, 6, 7, None]), dice.choice([None, *range(12)]), dice.choice([True, False, None])) for k in range(120)]
    polls = [(m, v, dice.choice([None, *range(-1, 14)])) for v in range(30) for m in (1, 2)]
    polls = [(m, v * 2 + m, at) for m, v, at in polls]
    wanted = set()
    for m, v, at in polls:
        last = {}
        for i, n, who, t, there in events:
            if n == m and None not in (t, at) and t < at:
                last[who] = max(last.get(who, ((-1, -1), None)), ((t, i), there), key=lambda x: x[0])
        wanted |= {(v, who) for who, (_, there) in last.items() if there}
    got = votes.eligible(spark.createDataFrame(events, "id long, meeting_id long, person_id long, offset long, present boolean"), spark.createDataFrame(polls, "meeting_id long, vote_id long, offset long")).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_circles_are_measured_once(spark):
    points = [(k, 48.0 + k % 3 / 20, -124.0 + k % 4 / 15) for k in range(60)]
    centres = [(k, 48.05 + k % 2 / 8, -123.9, 5.0 + k % 3 * 6) for k in range(30)]

    def km(a, b, c, d):
        h = math.sin(math.radians(a - c) / 2) ** 2 + math.cos(math.radians(c)) * math.cos(math.radians(a)) * math.sin(math.radians(b - d) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    got = joins.within_radius(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(centres, "id long, lat double, lon double, radius_km double"), cell=0.25)
    wanted = {(p[0], c[0]): km(p[1], p[2], c[1], c[2]) for p in points for c in centres if km(p[1], p[2], c[1], c[2]) <= c[3]}
    rows = got.collect()
    assert len(rows) == len(wanted) and all(abs(r.km - wanted[r.id, r.c_id]) < 1e-9 for r in rows)


def test_windows_of_items_hold_their_segments(spark):
    segments = spark.createDataFrame([(1, k, k * 10.0, k * 10.0 + 8, "x", f"s{k}") for k in range(30)], "meeting_id long, id long, start_time double, end_time double, speaker_name string, text string")
    items = spark.createDataFrame([(7, 1, "T", 100.0, 120.0), (8, 1, "U", 290.0, 290.0), (9, 1, "V", None, None)], "id long, meeting_id long, title string, start_time double, end_time double")
    assert {r.item_id: r.text for r in documents.discussion_text(items, segments).collect()} == {7: "T\n---\nx: s10\nx: s11\nx: s12", 8: "U\n---\nx: s29"}
    found = {r.item_id: (r.status, r.segments) for r in alignment.source_windows(items, segments).collect()}
    assert found == {7: ("ready", [10, 11]), 8: ("held", []), 9: ("held", [])}


def test_motions_are_marked_without_all_pairs(spark):
    """Four million pairs of motions and segments of one meeting; words said anywhere are looked up by text."""
    segments = spark.range(2000).select(F.lit(1).alias("meeting_id"), "id", (F.col("id") * 12.0).alias("start_time"), F.when(F.col("id") % 500 == 7, "the harbour lease").when(F.col("id") == 40, "so moved").otherwise("nothing here").alias("text"))
    motions = spark.range(2000).select(F.lit(1).alias("meeting_id"), "id", F.when(F.col("id") == 5, "Motion to adjourn harbour lease").otherwise("Harbour lease").alias("text"), F.when(F.col("id") == 3, 480.0).otherwise(3000.0).alias("start_at"), F.when(F.col("id") == 3, 500.0).otherwise(3010.0).alias("end_at"), F.lit(False).alias("closes"))
    got = {r.motion_id: r.at for r in alignment.motion_markers(motions, segments).collect()}
    assert len(got) == 2000 and got[3] == 480.0 and got[5] == 1507 * 12.0 and {v for k, v in got.items() if k not in (3, 5)} == {507 * 12.0}


def test_discussion_text_is_whole(spark):
    """A discussion of far more than eight thousand characters keeps its last words."""
    segments = spark.createDataFrame([(1, k, float(k), float(k + 1), "x", f"s{k} " + "word " * 100) for k in range(90)], "meeting_id long, id long, start_time double, end_time double, speaker_name string, text string")
    items = spark.createDataFrame([(7, 1, 0.0, 80.0, "T")], "id long, meeting_id long, start_time double, end_time double, title string")
    text = documents.discussion_text(items, segments).first().text
    assert text == "T\n---\n" + "\n".join(f"x: s{k} " + "word " * 100 for k in range(81)) and len(text) > 40_000
