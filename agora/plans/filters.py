"""Filters, sorts, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import filters as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

day = lambda c: F.col(c).cast("string").alias(c)


@query("flt01_public_meetings", "SELECT id, CAST(meeting_date AS STRING) AS meeting_date, status FROM {meetings} WHERE COALESCE(has_agenda, FALSE) OR COALESCE(has_minutes, FALSE) OR COALESCE(has_transcript, FALSE) OR summary IS NOT NULL OR calendar_source_id IS NOT NULL")
def flt01(c: Civic) -> DataFrame:
    return c.meetings.where(ops.public_ready()).select("id", day("meeting_date"), "status")


@query("flt02_stats_meetings", "SELECT id FROM {meetings} WHERE COALESCE(has_agenda, FALSE) OR COALESCE(has_minutes, FALSE) OR COALESCE(has_transcript, FALSE) OR summary IS NOT NULL")
def flt02(c: Civic) -> DataFrame:
    return c.meetings.where(ops.public_ready(with_calendar=False)).select("id")


@query("flt03_optional_bounds", "SELECT id, municipality_id FROM {meetings} WHERE meeting_date >= DATE '1997-01-01' AND municipality_id = 1")
def flt03(c: Civic) -> DataFrame:
    return c.meetings.where(ops.between("meeting_date", low="1997-01-01") & ops.between("municipality_id", 1, 1)).select("id", "municipality_id")


@query("flt04_meeting_list", "SELECT id, title FROM {meetings} WHERE status = 'Completed' AND organization_id = 2 AND has_minutes AND meeting_date >= DATE '1996-01-01' AND meeting_date <= DATE '2000-12-31' ORDER BY meeting_date DESC, id DESC LIMIT 50")
def flt04(c: Civic) -> DataFrame:
    return ops.meeting_list(c.meetings, "Completed", 2, ["has_minutes"], "1996-01-01", "2000-12-31", 50).select("id", "title")


@query("flt05_date_bounds", "SELECT CAST(MIN(meeting_date) AS STRING) AS first_date, CAST(MAX(meeting_date) AS STRING) AS last_date FROM {meetings} WHERE status = 'Completed'")
def flt05(c: Civic) -> DataFrame:
    return ops.date_bounds(c.meetings.where("status = 'Completed'")).select(day("first_date"), day("last_date"))


@query("flt06_visible_matters", "SELECT id, title FROM {matters} WHERE canonical_id IS NULL AND hidden IS NULL")
def flt06(c: Civic) -> DataFrame:
    return ops.visible_matters(c.matters).select("id", "title")


@query("flt07_in_service", "SELECT m.id, m.host_id FROM {meetings} m WHERE EXISTS (SELECT 1 FROM {memberships} s WHERE s.person_id = m.host_id AND (s.start_date IS NULL OR s.start_date <= m.meeting_date) AND (s.end_date IS NULL OR m.meeting_date <= s.end_date))")
def flt07(c: Civic) -> DataFrame:
    return ops.in_service(c.meetings, c.memberships.withColumnRenamed("person_id", "host_id"), "meeting_date", ["host_id"]).select("id", "host_id")


@query("flt08_without_procedural", "SELECT id, text FROM {segments} WHERE " + " AND ".join(f"NOT contains(lower(text), '{p}')" for p in ops.PROCEDURAL))
def flt08(c: Civic) -> DataFrame:
    return ops.without_procedural(c.segments, "text", "who spoke about housing").select("id", "text")


@query("flt09_keyword_search", """
    (SELECT 'motion' AS type, id, text AS content FROM {motions} WHERE contains(lower(text), 'ring') ORDER BY id LIMIT 10)
    UNION ALL (SELECT 'matter', id, title FROM {matters} WHERE contains(lower(title), 'ring') ORDER BY id LIMIT 5)
    UNION ALL (SELECT 'item', id, title FROM {agenda_items} WHERE contains(lower(title), 'ring') ORDER BY id LIMIT 20)
    UNION ALL (SELECT 'segment', id, text FROM {segments} WHERE contains(lower(text), 'ring') ORDER BY id LIMIT 20)""")
def flt09(c: Civic) -> DataFrame:
    parts = [ops.keyword_match(df, [col], "RING", n, kind) for df, col, n, kind in ((c.motions, "text", 10, "motion"), (c.matters, "title", 5, "matter"), (c.agenda_items, "title", 20, "item"), (c.segments, "text", 20, "segment"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


NAMED = "CASE id % 5 WHEN 0 THEN speaker_name WHEN 1 THEN 'Ann Lee' WHEN 2 THEN ' Unknown caller' WHEN 3 THEN 'Speakers 4' ELSE 'Anonymously Yours' END"


@query("flt10_named_participants", f"SELECT id, speaker_name FROM (SELECT id, {NAMED} AS speaker_name FROM {{segments}}) WHERE NOT regexp_matches(lower(trim(speaker_name)), '^(unknown|anonymous|unidentified)\\b|^(speaker|participant|person)[ _-]*\\d+$')")
def flt10(c: Civic) -> DataFrame:
    return c.segments.withColumn("speaker_name", F.expr(NAMED)).where(ops.named_participant("speaker_name")).select("id", "speaker_name")


@query("flt13_matter_list", "SELECT id, title, status FROM {matters} WHERE category = 'ECONOMY' AND status IN ('Adopted', 'Completed') AND contains(lower(title || ' ' || COALESCE(identifier, '') || ' ' || address), 'widget')")
def flt13(c: Civic) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("identifier", F.lit("")), "address"))
    return c.matters.where((F.col("category") == "ECONOMY") & (ops.status_bucket() == "completed") & text.contains("widget")).select("id", "title", "status")


@query("flt14_status_counts", "SELECT CASE WHEN status = 'Active' THEN 'active' WHEN status IN ('Adopted', 'Completed') THEN 'completed' WHEN status IN ('Inactive', 'Denied', 'Repealed') THEN 'closed' ELSE 'other' END AS bucket, COUNT(*) AS n FROM {matters} GROUP BY 1")
def flt14(c: Civic) -> DataFrame:
    return c.matters.groupBy(ops.status_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("flt15_fiscal_items", "SELECT id, title, financial_cost FROM {agenda_items} WHERE financial_cost IS NOT NULL ORDER BY financial_cost DESC, id LIMIT 100")
def flt15(c: Civic) -> DataFrame:
    return c.agenda_items.where("financial_cost is not null").orderBy(F.col("financial_cost").desc(), "id").limit(100).select("id", "title", "financial_cost")


@query("flt15_hot_topics", "SELECT category, COUNT(*) AS n FROM {agenda_items} WHERE is_controversial GROUP BY category")
def flt15b(c: Civic) -> DataFrame:
    return c.agenda_items.where("is_controversial").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("flt16_recent_motions", """
    SELECT m.id, COUNT(*) FILTER (v.vote IN ('Yes', 'In Favour')) AS yes, COUNT(*) FILTER (v.vote IN ('No', 'Opposed')) AS no
    FROM (SELECT m.id FROM {motions} m JOIN {meetings} g ON g.id = m.meeting_id WHERE m.disposition <> 'Procedural' ORDER BY g.meeting_date DESC, m.id DESC LIMIT 15) m
    LEFT JOIN {votes} v ON v.motion_id = m.id GROUP BY m.id""")
def flt16(c: Civic) -> DataFrame:
    dated = c.motions.join(c.meetings.select(F.col("id").alias("g"), "meeting_date"), F.col("meeting_id") == F.col("g"))
    latest = dated.where("disposition <> 'Procedural'").orderBy(F.col("meeting_date").desc(), F.col("id").desc()).limit(15).select("id")
    voted = latest.join(c.votes.select("motion_id", "vote"), F.col("id") == F.col("motion_id"), "left")
    return voted.groupBy("id").agg(F.count_if(F.col("vote").isin("Yes", "In Favour")).alias("yes"), F.count_if(F.col("vote").isin("No", "Opposed")).alias("no"))


@query("flt16_next_meeting", "SELECT id, CAST(meeting_date AS STRING) AS meeting_date FROM {meetings} WHERE meeting_date >= DATE '2000-06-15' AND status <> 'Cancelled' ORDER BY meeting_date, id LIMIT 1")
def flt16b(c: Civic) -> DataFrame:
    return c.meetings.where(ops.between("meeting_date", low="2000-06-15") & (F.col("status") != "Cancelled")).orderBy("meeting_date", "id").limit(1).select("id", day("meeting_date"))


@query("flt17_about_counts", "SELECT COUNT(*) AS meetings, (SELECT COUNT(*) FROM {motions}) AS motions, (SELECT COUNT(*) FROM {matters}) AS matters, (SELECT COUNT(*) FROM {people}) AS people, CAST(ROUND(SUM(video_seconds) / 3600) AS BIGINT) AS hours FROM {meetings}")
def flt17(c: Civic) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = c.meetings.agg(F.count(F.lit(1)).alias("meetings"), F.round(F.sum("video_seconds") / 3600).cast("long").alias("hours"))
    return one.crossJoin(n(c.motions, "motions")).crossJoin(n(c.matters, "matters")).crossJoin(n(c.people, "people")).select("meetings", "motions", "matters", "people", "hours")  # single rows


@query("flt18_api_bylaws", "SELECT id, title, year FROM {matters} WHERE year = 1991 AND identifier IS NOT NULL AND status = 'Adopted'")
def flt18(c: Civic) -> DataFrame:
    return c.matters.where("year = 1991 and identifier is not null and status = 'Adopted'").select("id", "title", "year")


@query("flt20_unexpired", "SELECT id FROM {usage} WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-15 00:00:00'")
def flt20(c: Civic) -> DataFrame:
    return c.usage.where(F.col("ts") + F.expr("INTERVAL 30 DAYS") > F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")).select("id")


@query("flt21_row_policy", "SELECT id, user_id FROM {subscriptions} WHERE user_id = 42")
def flt21(c: Civic) -> DataFrame:
    return c.subscriptions.where(F.col("user_id") == 42).select("id", "user_id")


@query("srt02_nulls_last", "SELECT id, title, financial_cost FROM {agenda_items} ORDER BY financial_cost DESC NULLS LAST, id LIMIT 700")
def srt02(c: Civic) -> DataFrame:
    return c.agenda_items.orderBy(F.col("financial_cost").desc_nulls_last(), "id").limit(700).select("id", "title", "financial_cost")


@query("srt03_keyset_page", "SELECT id, place, has_more FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY meeting_date DESC, id DESC) AS place, COUNT(*) OVER () > 25 AS has_more FROM {meetings} WHERE (meeting_date < DATE '2000-05-01' OR (meeting_date = DATE '2000-05-01' AND id < 7000))) WHERE place <= 25")
def srt03(c: Civic) -> DataFrame:
    return ops.keyset_page(c.meetings, "meeting_date", 25, ops.cursor("2000-05-01", 7000)).select("id", F.col("place").cast("long").alias("place"), "has_more")


@query("srt04_offset_page", "SELECT id, name FROM {people} ORDER BY name, id LIMIT 20 OFFSET 40")
def srt04(c: Civic) -> DataFrame:
    return ops.offset_page(c.people, [F.col("name"), F.col("id")], 3, 20).select("id", "name")


@query("srt04_page_count", "SELECT CAST(GREATEST(1, CEIL(COUNT(*) / 30)) AS BIGINT) AS max_page, COUNT(*) AS total FROM {meetings}")
def srt04b(c: Civic) -> DataFrame:
    return ops.page_count(c.meetings, 30)


@query("srt05_person_votes", "SELECT v.motion_id, v.vote, CAST(g.meeting_date AS STRING) AS meeting_date FROM {votes} v JOIN {motions} m ON m.id = v.motion_id JOIN {meetings} g ON g.id = m.meeting_id WHERE v.person_id = 7 ORDER BY g.meeting_date DESC, v.motion_id DESC LIMIT 50 OFFSET 50")
def srt05(c: Civic) -> DataFrame:
    found = c.votes.where("person_id = 7").join(c.motions.select(F.col("id").alias("m"), "meeting_id"), F.col("motion_id") == F.col("m")).join(c.meetings.select(F.col("id").alias("g"), "meeting_date"), F.col("meeting_id") == F.col("g"))
    return ops.offset_page(found, [F.col("meeting_date").desc(), F.col("motion_id").desc()], 2, 50).select("motion_id", "vote", day("meeting_date"))
