"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.text import topic
from agora.operators import joins as ops
from agora.operators import vectors
from agora.plans.aggregates import topic_sql
from agora.plans.registry import query
from agora.sources.civic import Civic


@query("joi01_inner", "SELECT s.id, p.name, m.title FROM {segments} s JOIN {people} p ON p.id = s.person_id JOIN {meetings} m ON m.id = s.meeting_id")
def joi01(c: Civic) -> DataFrame:
    return c.segments.join(c.people.select(F.col("id").alias("p"), "name"), F.col("person_id") == F.col("p")).join(c.meetings.select(F.col("id").alias("m"), "title"), F.col("meeting_id") == F.col("m")).select("id", "name", "title")


ITEM = """
    SELECT s.id, i.id AS item_id, i.category FROM {segments} s LEFT JOIN {agenda_items} i
      ON (s.agenda_item_id IS NOT NULL AND i.id = s.agenda_item_id) OR (s.agenda_item_id IS NULL AND i.meeting_id = s.meeting_id AND s.start_time >= i.start_time AND s.start_time < i.end_time)"""


@query("joi04_item_of_segment", ITEM)
def joi04(c: Civic) -> DataFrame:
    return ops.item_of_segment(c.segments, c.agenda_items).select("id", F.col("w_id").alias("item_id"), F.col("w_category").alias("category"))


@query("agg04_speaking_by_topic", f"""
    SELECT {topic_sql('j.category')} AS topic, CAST(ROUND(SUM(CAST(s.end_time - s.start_time AS DECIMAL(18,3))), 1) AS DOUBLE) AS seconds, COUNT(*) AS segments
    FROM ({ITEM}) j JOIN {{segments}} s ON s.id = j.id WHERE s.person_id = 12 GROUP BY 1""")
def agg04(c: Civic) -> DataFrame:
    rows = ops.item_of_segment(c.segments.where("person_id = 12"), c.agenda_items)
    seconds = F.sum((F.col("end_time") - F.col("start_time")).cast("decimal(18,3)"))
    return rows.groupBy(topic("w_category").alias("topic")).agg(F.round(seconds, 1).cast("double").alias("seconds"), F.count(F.lit(1)).alias("segments"))


@query("joi05_discussion_segments", "SELECT s.id, i.id AS item_id FROM {segments} s JOIN {agenda_items} i ON i.meeting_id = s.meeting_id AND s.start_time >= i.start_time AND s.start_time <= i.end_time")
def joi05(c: Civic) -> DataFrame:
    windows = c.agenda_items.where("start_time is not null").select("meeting_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("id").alias("item"))
    return ops.point_in_window(c.segments, windows, ["meeting_id"], closed="both").select("id", F.col("w_item").alias("item_id"))


@query("joi06_interval_overlap", "SELECT s.id, i.id AS item_id FROM {segments} s JOIN {agenda_items} i ON i.meeting_id = s.meeting_id AND s.start_time < i.end_time AND s.end_time > i.start_time WHERE i.place < 3")
def joi06(c: Civic) -> DataFrame:
    return ops.overlapping(c.segments, c.agenda_items.where("place < 3").select("id", "meeting_id", "start_time", "end_time"), ["meeting_id"]).select("id", F.col("b_id").alias("item_id"))


@query("joi07_first_window", "SELECT s.id, MIN(i.place) AS place FROM {segments} s JOIN {agenda_items} i ON i.meeting_id = s.meeting_id AND s.start_time >= i.start_time AND s.start_time < i.end_time GROUP BY s.id")
def joi07(c: Civic) -> DataFrame:
    windows = c.agenda_items.where("start_time is not null").select("meeting_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"), "place")
    return ops.point_in_window(c.segments, windows, ["meeting_id"]).groupBy("id").agg(F.min("w_place").alias("place"))


@query("joi11_unclassified", "SELECT i.id FROM {agenda_items} i WHERE NOT EXISTS (SELECT 1 FROM {motions} m WHERE m.agenda_item_id = i.id)")
def joi11(c: Civic) -> DataFrame:
    return c.agenda_items.join(c.motions.select(F.col("agenda_item_id").alias("k")), F.col("id") == F.col("k"), "left_anti").select("id")


@query("joi13_not_running", "SELECT j.id FROM {jobs} j WHERE status = 'queued' AND attempts < max_attempts AND NOT EXISTS (SELECT 1 FROM {jobs} r WHERE r.status = 'running' AND r.municipality_id = j.municipality_id AND r.source_id = j.source_id)")
def joi13(c: Civic) -> DataFrame:
    running = c.jobs.where("status = 'running'").select(F.col("municipality_id").alias("m"), F.col("source_id").alias("s"))
    return c.jobs.where("status = 'queued' and attempts < max_attempts").join(running, (F.col("municipality_id") == F.col("m")) & (F.col("source_id") == F.col("s")), "left_anti").select("id")


@query("joi14_mover_or_seconder", "SELECT m.id, p.name FROM {motions} m JOIN {people} p ON p.id = m.mover_id OR p.id = m.seconder_id")
def joi14(c: Civic) -> DataFrame:
    return ops.either(c.motions.select("id", "mover_id", "seconder_id"), ["mover_id", "seconder_id"], c.people.select(F.col("id").alias("person"), "name"), "person").select("id", "name")


@query("joi15_vector_join", "SELECT q.vec_id AS q_id, e.vec_id, ROUND(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 5) AS similarity FROM {embeddings} q JOIN {embeddings} e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) > 0.25")
def joi15(c: Civic) -> DataFrame:
    return vectors.similar(c.embeddings, c.embeddings, "label", 0.25).withColumn("similarity", F.round("similarity", 5))


@query("joi16_within_radius", """
    WITH pts AS (SELECT c_custkey AS id, 48.0 + (c_custkey % 37) / 20.0 AS lat, -124.0 + (c_custkey % 41) / 15.0 AS lon FROM {customer}), ctr AS (SELECT s_suppkey AS c_id, 48.2 + (s_suppkey % 11) / 8.0 AS lat, -123.5 + (s_suppkey % 13) / 9.0 AS lon, 5.0 + s_suppkey % 20 AS r FROM {supplier}),
    d AS (SELECT id, c_id, r, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - c.lon) / 2), 2))) AS km FROM pts p CROSS JOIN ctr c)
    SELECT id, c_id, ROUND(km, 6) AS km FROM d WHERE km <= r""")
def joi16(c: Civic) -> DataFrame:
    points = c.customer.select(F.col("c_custkey").alias("id"), (48.0 + (F.col("c_custkey") % 37) / 20.0).alias("lat"), (-124.0 + (F.col("c_custkey") % 41) / 15.0).alias("lon"))
    s = F.col("s_suppkey")
    centres = c.supplier.select(s.alias("id"), (48.2 + (s % 11) / 8.0).alias("lat"), (-123.5 + (s % 13) / 9.0).alias("lon"), (5.0 + s % 20).alias("radius_km"))
    return ops.within_radius(points, centres, cell=0.25, digits=6)


@query("joi18_candidate_pairs", """
    WITH k AS (SELECT DISTINCT id, 'address' AS signal, address AS key FROM {matters} UNION SELECT id, 'identifier', identifier FROM {matters} WHERE identifier IS NOT NULL),
    s AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY signal, key) AS n FROM k) WHERE n BETWEEN 2 AND 8)
    SELECT x.id AS a, y.id AS b, string_agg(x.signal, ',' ORDER BY x.signal) AS signals FROM s x JOIN s y ON x.signal = y.signal AND x.key = y.key AND x.id < y.id GROUP BY 1, 2""")
def joi18(c: Civic) -> DataFrame:
    keys = c.matters.select("id", F.lit("address").alias("signal"), F.col("address").alias("key")).unionByName(c.matters.where("identifier is not null").select("id", F.lit("identifier").alias("signal"), F.col("identifier").alias("key")))
    return ops.candidate_pairs(keys, 8).withColumn("signals", F.array_join("signals", ","))


@query("joi19_alias_chase", """
    WITH RECURSIVE up AS (SELECT id, canonical_id AS root, 1 AS depth FROM {matters} WHERE canonical_id IS NOT NULL
      UNION ALL SELECT u.id, m.canonical_id, u.depth + 1 FROM up u JOIN {matters} m ON m.id = u.root WHERE m.canonical_id IS NOT NULL AND u.depth < 9)
    SELECT id, CASE WHEN MAX(depth) <= 8 THEN arg_max(root, depth) END AS root FROM up GROUP BY id""")
def joi19(c: Civic) -> DataFrame:
    return ops.canonical(c.matters.select("id", "canonical_id")).select("id", "root")


@query("joi20_story_graph", "WITH e AS (SELECT id AS a, id % 50 AS b FROM {matters} WHERE hidden IS NULL) SELECT DISTINCT id, near FROM (SELECT o.id, e.b AS near FROM {matters} o JOIN e ON e.a = o.id UNION ALL SELECT o.id, e.a FROM {matters} o JOIN e ON e.b = o.id) WHERE id <> near")
def joi20(c: Civic) -> DataFrame:
    edges = c.matters.where("hidden is null").select(F.col("id").alias("a"), (F.col("id") % 50).alias("b"))
    return ops.neighbours(edges, c.matters)


@query("joi21_person_statements", "SELECT id FROM {segments} WHERE person_id = 21 OR (meeting_id, speaker_name) IN (SELECT meeting_id, speaker_name FROM {segments} WHERE person_id = 31)")
def joi21(c: Civic) -> DataFrame:
    aliases = c.segments.where("person_id = 31").select(F.col("meeting_id").alias("m"), F.col("speaker_name").alias("s")).distinct()
    return c.segments.join(aliases, (F.col("meeting_id") == F.col("m")) & (F.col("speaker_name") == F.col("s")), "left").where((F.col("person_id") == 21) | F.col("m").isNotNull()).select("id")


@query("joi22_nested_embed", "SELECT i.id, COUNT(DISTINCT m.id) AS motions, COUNT(v.id) AS votes FROM {agenda_items} i LEFT JOIN {motions} m ON m.agenda_item_id = i.id LEFT JOIN {votes} v ON v.motion_id = m.id GROUP BY i.id")
def joi22(c: Civic) -> DataFrame:
    ballots = c.votes.groupBy(F.col("motion_id").alias("v")).agg(F.collect_list(F.struct("person_id", "vote")).alias("votes"))
    motions = c.motions.select("id", "agenda_item_id", "text").join(ballots, F.col("id") == F.col("v"), "left").groupBy(F.col("agenda_item_id").alias("i")).agg(F.collect_list(F.struct("id", "text", "votes")).alias("motions"))
    nested = c.agenda_items.select("id").join(motions, F.col("id") == F.col("i"), "left")
    count = F.aggregate(F.transform("motions", lambda m: F.coalesce(F.size(m["votes"]), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return nested.select("id", F.coalesce(F.size("motions"), F.lit(0)).cast("long").alias("motions"), F.coalesce(count, F.lit(0)).cast("long").alias("votes"))


@query("joi12_new_folders", "SELECT CAST(o_orderkey AS STRING) AS folder FROM {orders} WHERE CAST(o_orderkey AS STRING) NOT IN (SELECT CAST(meeting_id AS STRING) FROM {motions})")
def joi12(c: Civic) -> DataFrame:
    return c.orders.select(F.col("o_orderkey").cast("string").alias("folder")).join(c.motions.select(F.col("meeting_id").cast("string").alias("known")), F.col("folder") == F.col("known"), "left_anti")
