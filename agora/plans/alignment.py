"""Items, motions and words in transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import alignment as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

#: What a segment says: now and then an item's number, a title, or a motion.
SAID = """CASE id % 9 WHEN 0 THEN 'next is item ' || CAST(1 + id % 7 AS STRING) || '.' || CAST(id % 3 AS STRING) WHEN 1 THEN 'now the small ring economy, as we said' WHEN 2 THEN 'I move receipt of the widget and anvil brand'
  WHEN 3 THEN 'so moved and carried' WHEN 4 THEN 'motion to adjourn the meeting' WHEN 5 THEN 'hot bolt, large rod' ELSE text END"""


def spoken(c: Civic) -> DataFrame:
    return c.segments.withColumn("text", F.expr(SAID)).select("meeting_id", "id", "start_time", "end_time", "text")


def listed(c: Civic) -> DataFrame:
    number = F.concat_ws(".", (F.col("place") + 1).cast("string"), (F.col("id") % 3).cast("string"))
    title = F.when(F.col("place") == 0, "Call to Order").when(F.col("id") % 50 == 49, "Adjournment").otherwise(F.col("title"))
    return c.agenda_items.select("meeting_id", "id", number.alias("number"), title.alias("title"), "start_time", "end_time")


def placed(c: Civic) -> DataFrame:
    s = spoken(c)
    bounds = s.groupBy("meeting_id").agg(F.min("start_time").alias("opens"), F.max("end_time").alias("closes"))
    return ops.placed_items(listed(c), ops.item_markers(listed(c), s), bounds)


@query("aln01_item_markers", None)
def aln01(c: Civic) -> DataFrame:
    return ops.item_markers(listed(c), spoken(c)).withColumn("score", F.round("score", 6))


@query("aln02_motion_markers", """
    WITH s AS (SELECT meeting_id, start_time AS said, replace(replace(trim(regexp_replace(lower(x), '[^a-z0-9\\s]', '', 'g')), 'move to seat', 'move receipt'), 'move receipt', 'move receive') AS t FROM (SELECT *, """ + SAID.replace("{", "{{") + """ AS x FROM {segments})),
    p AS (SELECT meeting_id, said, t, list_transform(list_filter(string_split_regex(t, '\\s+'), lambda w: length(w) >= 5), lambda w: left(w, 5)) AS starts FROM s),
    m AS (SELECT o.id, i.meeting_id, i.start_time AS a, i.end_time AS b, contains(lower(o.text), 'adjourn') OR contains(lower(o.text), 'terminate') OR i.id % 50 = 49 AS late, list_transform(list_filter(string_split_regex(trim(regexp_replace(lower(o.text), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda w: length(w) > 4), lambda w: left(w, 5)) AS keys FROM {motions} o JOIN {agenda_items} i ON i.id = o.agenda_item_id WHERE i.start_time IS NOT NULL),
    q AS (SELECT m.*, p.said, p.t, (len(list_filter(keys, lambda k: list_contains(starts, k))) + CASE WHEN late AND (contains(t, 'termi') OR contains(t, 'adjou')) THEN 2 ELSE 0 END) / len(keys) AS score, p.said BETWEEN GREATEST(0, a - 30) AND b + 30 AS near FROM m JOIN p ON p.meeting_id = m.meeting_id WHERE len(keys) > 0),
    r AS (SELECT *, CASE WHEN near AND (score > 0.4 OR (late AND score > 0.2)) THEN 1 WHEN near AND regexp_matches(t, 'move|second|carried|opposed|receipt|receive|recommend|unanimous') THEN 2 WHEN score > 0.4 OR (late AND score > 0.2) THEN 3 END AS kind FROM q),
    w AS (SELECT *, CASE kind WHEN 1 THEN score WHEN 3 THEN score * CASE WHEN said < 300 AND a >= 300 THEN 0.5 ELSE 1 END ELSE 0 END AS weight, CASE WHEN kind = 2 OR late THEN -said ELSE said END AS turn FROM r WHERE kind IS NOT NULL)
    SELECT id AS motion_id, said FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY kind, weight DESC, turn) AS k FROM w) WHERE k = 1""")
def aln02(c: Civic) -> DataFrame:
    i = c.agenda_items.where("start_time is not null").select(F.col("id").alias("i"), "meeting_id", F.col("start_time").alias("start_at"), F.col("end_time").alias("end_at"), (F.col("id") % 50 == 49).alias("closes"))
    motions = c.motions.select("id", "text", "agenda_item_id").join(i, F.col("agenda_item_id") == F.col("i"))
    return ops.motion_markers(motions, spoken(c)).withColumnRenamed("at", "said")


@query("aln03_placed_items", None)
def aln03(c: Civic) -> DataFrame:
    return placed(c).withColumns({k: F.round(k, 6) for k in ("start_at", "end_at")})


@query("aln09_word_turns", None)
def aln09(c: Civic) -> DataFrame:
    """A paragraph for every forty seconds of a meeting, a token for every segment."""
    parent = F.col("meeting_id") * 100_000 + F.floor(F.col("start_time") / 40)
    word = F.concat(F.when(F.col("id") % 3 == 0, "").otherwise(" "), F.lit("w"), F.col("id").cast("string"))
    tokens = c.segments.select(parent.alias("parent_id"), F.col("id").alias("k"), word.alias("text"), F.col("start_time").alias("start"), (F.col("start_time") + 3).alias("end"))
    parents = tokens.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))
    turns = c.segments.select(parent.alias("parent_id"), (F.col("id") % 4).cast("string").alias("speaker"), (F.col("start_time") - 1).alias("start"), (F.col("start_time") + 2 + F.col("id") % 3).alias("end"))
    return ops.word_turns(parents, tokens, turns.where("start >= 0"))


@query("rem05_source_windows", """
    WITH s AS (SELECT meeting_id, id, start_time, end_time, CASE WHEN id % 2 = 0 THEN 'moving on, next item' WHEN id % 5 = 0 THEN 'moving on because of it' ELSE text END AS text FROM {segments}),
    i AS (SELECT id, meeting_id, start_time AS a, CASE WHEN id % 30 = 1 THEN start_time ELSE end_time END AS b FROM {agenda_items}),
    met AS (SELECT i.id AS item_id, s.*, s.start_time < i.a - 0.01 OR s.end_time > i.b + 0.01 AS cut FROM i JOIN s ON s.meeting_id = i.meeting_id AND s.start_time < i.b AND s.end_time > i.a WHERE i.a >= 0 AND i.a < i.b),
    g AS (SELECT item_id, bool_or(cut AND NOT contains(text, 'next item')) AS cuts, string_agg(CAST(id AS STRING), ',' ORDER BY start_time, id) FILTER (NOT cut) AS segments, string_agg(CAST(id AS STRING), ',' ORDER BY start_time, id) FILTER (cut AND contains(text, 'next item')) AS excluded FROM met GROUP BY item_id),
    r AS (SELECT i.id AS item_id, CASE WHEN i.a IS NULL OR i.a >= i.b THEN 'missing_aligned_window' WHEN g.item_id IS NULL THEN 'no_source_transcript_in_window' WHEN cuts THEN 'window_cuts_unmeasured_source_segment' WHEN segments IS NULL THEN 'no_fully_bound_source_after_procedural_edges' END AS reason, segments, excluded FROM i LEFT JOIN g ON g.item_id = i.id)
    SELECT item_id, CASE WHEN reason IS NULL THEN 'ready' ELSE 'held' END AS status, reason, CASE WHEN reason IS NULL THEN COALESCE(segments, '') ELSE '' END AS segments, CASE WHEN reason IS NULL THEN COALESCE(excluded, '') ELSE '' END AS excluded FROM r""")
def rem05(c: Civic) -> DataFrame:
    text = F.when(F.col("id") % 2 == 0, "moving on, next item").when(F.col("id") % 5 == 0, "moving on because of it").otherwise(F.col("text"))
    items = c.agenda_items.withColumn("end_time", F.when(F.col("id") % 30 == 1, F.col("start_time")).otherwise(F.col("end_time")))
    found = ops.source_windows(items, c.segments.withColumn("text", text))
    return found.withColumns({k: F.array_join(F.transform(k, lambda x: x.cast("string")), ",") for k in ("segments", "excluded")})


@query("rem07_merged_reviews", """
    WITH c AS (SELECT l_orderkey AS item_id, l_linenumber % 3 AS chunk, l_partkey AS segment_id, l_linestatus = 'F' OR l_orderkey % 2 = 0 AS passed, l_orderkey % 5 = 1 AND l_linenumber = 1 AS twice, l_orderkey % 7 = 1 AND l_linenumber = 2 AS elsewhere FROM {lineitem}),
    r AS (SELECT item_id, chunk, bool_and(passed) AS passed FROM c GROUP BY 1, 2),
    cited AS (SELECT item_id, CASE WHEN elsewhere THEN chunk + 7 ELSE chunk END AS chunk, segment_id, SUM(CASE WHEN twice THEN 2 ELSE 1 END) AS n FROM c GROUP BY 1, 2, 3),
    k AS (SELECT DISTINCT item_id, chunk, segment_id FROM c),
    b AS (SELECT cited.item_id, bool_or(n > 1 OR k.item_id IS NULL) AS bad FROM cited LEFT JOIN k ON k.item_id = cited.item_id AND k.chunk = cited.chunk AND k.segment_id = cited.segment_id GROUP BY 1)
    SELECT r.item_id, CASE WHEN NOT bool_and(r.passed) THEN 'complete_reviewed_chunk_set_required' WHEN bool_or(COALESCE(b.bad, FALSE)) THEN 'chunk_evidence_overlap_or_wrong_source' ELSE 'merged' END AS status FROM r LEFT JOIN b ON b.item_id = r.item_id GROUP BY r.item_id""")
def rem07(c: Civic) -> DataFrame:
    rows = c.lineitem.select(F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") % 3).alias("chunk"), F.col("l_partkey").alias("segment_id"), ((F.col("l_linestatus") == "F") | (F.col("l_orderkey") % 2 == 0)).alias("passed"), F.col("l_linenumber").alias("n"))
    times = F.when((F.col("item_id") % 5 == 1) & (F.col("n") == 1), 2).otherwise(1)
    cited = rows.select("item_id", F.when((F.col("item_id") % 7 == 1) & (F.col("n") == 2), F.col("chunk") + 7).otherwise(F.col("chunk")).alias("chunk"), "segment_id", F.explode(F.array_repeat(F.lit(1), times)).alias("_")).drop("_")
    return ops.merged_reviews(rows.select("item_id", "chunk", "segment_id"), rows.select("item_id", "chunk", "passed"), cited)


@query("aln06_window_confidence", """
    WITH t AS (SELECT id, meeting_id, place, CASE WHEN id % 11 = 3 THEN start_time - 90 ELSE start_time END AS s, (id % 50) / 10 AS score, id % 13 = 0 AS linked FROM {agenda_items} WHERE start_time IS NOT NULL),
    n AS (SELECT a.id, arg_min(b.s, (b.place, b.id)) AS nxt FROM t a JOIN t b ON b.meeting_id = a.meeting_id AND (b.place, b.id) > (a.place, a.id) AND b.s >= a.s GROUP BY a.id)
    SELECT t.id, COALESCE(n.nxt, CASE WHEN 400 > t.s THEN CAST(400 AS DOUBLE) END) AS end_at, CASE WHEN linked OR score >= 3.5 THEN 'high' WHEN score >= 2.5 THEN 'medium' ELSE 'low' END AS confidence FROM t LEFT JOIN n ON n.id = t.id""")
def aln06(c: Civic) -> DataFrame:
    k = F.col("id")
    chosen = c.agenda_items.select("meeting_id", "id", "place", F.when(k % 11 == 3, F.col("start_time") - 90).otherwise(F.col("start_time")).alias("start_at"), ((k % 50) / 10).alias("score"), F.when(k % 13 == 0, "segment_link").otherwise("title_match").alias("method"), F.lit(400.0).alias("closes"))
    return ops.confident_windows(chosen)
