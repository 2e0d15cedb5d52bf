"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.text import slug
from agora.operators import windows as ops
from agora.plans.registry import query
from agora.sources.civic import Civic


@query("win01_rank_list", "SELECT id, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY end_time - start_time DESC, id) AS rank FROM {segments}")
def win01(c: Civic) -> DataFrame:
    return ops.first_of(c.segments, ["meeting_id"], [(F.col("end_time") - F.col("start_time")).desc(), F.col("id")], 2**31 - 1).select("id", F.col("place").cast("long").alias("rank"))


@query("win03_slug_suffix", "SELECT id, slug || CASE WHEN k > 1 THEN '-' || CAST(k AS STRING) ELSE '' END AS slug FROM (SELECT id, slug, ROW_NUMBER() OVER (PARTITION BY slug ORDER BY id) AS k FROM (SELECT id, left(regexp_replace(lower(regexp_replace(trim(title), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), 80) AS slug FROM {agenda_items}))")
def win03(c: Civic) -> DataFrame:
    named = c.agenda_items.select("id", slug("title").alias("base"))
    rows = ops.first_of(named, ["base"], [F.col("id")], 2**31 - 1)
    return rows.select("id", F.when(F.col("place") > 1, F.concat_ws("-", "base", F.col("place").cast("string"))).otherwise(F.col("base")).alias("slug"))


@query("win04_top_categories", "SELECT meeting_id, category, n FROM (SELECT meeting_id, category, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY COUNT(*) DESC, category) AS k FROM {agenda_items} WHERE category IS NOT NULL GROUP BY meeting_id, category) WHERE k <= 5")
def win04(c: Civic) -> DataFrame:
    counts = c.agenda_items.where("category is not null").groupBy("meeting_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return ops.first_of(counts, ["meeting_id"], [F.col("n").desc(), F.col("category")], 5).select("meeting_id", "category", "n")


@query("win05_spread_sample", """
    WITH t AS (SELECT person_id, MIN(start_date) AS low, MAX(COALESCE(end_date, DATE '2002-12-31')) AS high FROM {memberships} GROUP BY person_id),
    r AS (SELECT s.person_id, s.id, s.end_time - s.start_time AS text_score, t.low, t.high, m.meeting_date AS day FROM {segments} s JOIN t ON t.person_id = s.person_id LEFT JOIN {meetings} m ON m.id = s.meeting_id + 200 * (s.id % 40)),
    b AS (SELECT *, CASE WHEN trunc((day - low) / (GREATEST(high - low, 1) / 4)) >= 0 THEN LEAST(CAST(trunc((day - low) / (GREATEST(high - low, 1) / 4)) AS INT), 3) END AS bucket FROM r),
    f AS (SELECT *, bucket IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY person_id, bucket ORDER BY text_score DESC, id) <= 2 AS first_ FROM b)
    SELECT person_id, id, CAST(bucket AS BIGINT) AS bucket FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY first_ DESC, text_score DESC, id) AS k FROM f) WHERE k <= 8""")
def win05(c: Civic) -> DataFrame:
    tenure = c.memberships.groupBy("person_id").agg(F.min("start_date").alias("low"), F.max(F.coalesce("end_date", F.lit("2002-12-31").cast("date"))).alias("high"))
    said = c.segments.join(tenure, "person_id").withColumn("_m", F.col("meeting_id") + 200 * (F.col("id") % 40))
    rows = said.join(c.meetings.select(F.col("id").alias("_m"), F.col("meeting_date").alias("day")), "_m", "left").select("person_id", "id", (F.col("end_time") - F.col("start_time")).alias("text_score"), "low", "high", "day")
    return ops.spread_sample(rows, ["person_id"], "day", "text_score", "low", "high").select("person_id", "id", F.col("bucket").cast("long").alias("bucket"))


@query("win06_item_ends", "SELECT id, COALESCE(LEAD(start_time) OVER (PARTITION BY meeting_id ORDER BY start_time, id), CAST(9999.0 AS DOUBLE)) AS end_at FROM {agenda_items} WHERE start_time IS NOT NULL")
def win06(c: Civic) -> DataFrame:
    return ops.item_ends(c.agenda_items.withColumn("video_end", F.lit(9999.0)), "video_end").select("id", "end_at")


@query("win07_interpolated_starts", """
    WITH w AS (SELECT id, place, start_time, LAST_VALUE(start_time IGNORE NULLS) OVER b AS a_at, LAST_VALUE(CASE WHEN start_time IS NOT NULL THEN place END IGNORE NULLS) OVER b AS a_place,
      FIRST_VALUE(start_time IGNORE NULLS) OVER f AS b_at, FIRST_VALUE(CASE WHEN start_time IS NOT NULL THEN place END IGNORE NULLS) OVER f AS b_place FROM {agenda_items}
      WINDOW b AS (PARTITION BY meeting_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY meeting_id ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT id, ROUND(CASE WHEN start_time IS NOT NULL THEN start_time ELSE GREATEST(a_at + (b_at - a_at) * (place - a_place) / NULLIF(b_place - a_place, 0), a_at + 2.0) END, 6) AS start_at FROM w""")
def win07(c: Civic) -> DataFrame:
    return ops.interpolated(c.agenda_items).select("id", F.round("start_at", 6).alias("start_at"))


@query("win08_positional_score", "SELECT id, ROUND(0.1 - (ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY start_time, id) - 1) / COUNT(*) OVER (PARTITION BY meeting_id) * 0.09, 9) AS score FROM {segments}")
def win08(c: Civic) -> DataFrame:
    return ops.positional(c.segments, ["meeting_id"], [F.col("start_time"), F.col("id")]).select("id", F.round("score", 9).alias("score"))


@query("rem23_turns", """
    SELECT meeting_id, CAST(turn AS BIGINT) AS turn, ANY_VALUE(speaker_id) AS speaker_id, MIN(start_time) AS start_time, MAX(end_time) AS end_time, COUNT(*) AS segments FROM (
      SELECT *, SUM(fresh) OVER (PARTITION BY meeting_id ORDER BY start_time, id) AS turn FROM (SELECT *, CASE WHEN LAG(speaker_id) OVER (PARTITION BY meeting_id ORDER BY start_time, id) IS NOT DISTINCT FROM speaker_id THEN 0 ELSE 1 END AS fresh FROM {segments}))
    GROUP BY meeting_id, turn""")
def rem23(c: Civic) -> DataFrame:
    return ops.turns(c.segments)


@query("ext01_event_sessions", "SELECT event_id, CAST(SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM {events})")
def ext01(c: Civic) -> DataFrame:
    return ops.sessions(c.events, "user_id", "ts", 7200).select("event_id", "session")


@query("srt09_first_per_key", "SELECT speaker_name, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY speaker_name ORDER BY end_time - start_time DESC, id) AS k FROM {segments}) WHERE k = 1")
def srt09(c: Civic) -> DataFrame:
    return ops.first_of(c.segments, ["speaker_name"], [(F.col("end_time") - F.col("start_time")).desc(), F.col("id")]).select("speaker_name", "id")
