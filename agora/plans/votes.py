"""Voting agreement, key votes, ballots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import votes as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

CAST = "cast_votes AS (SELECT v.* FROM {votes} v WHERE v.vote IN ('Yes', 'In Favour', 'No', 'Opposed') AND EXISTS (SELECT 1 FROM {motions} m WHERE m.id = v.motion_id AND m.coverage IS DISTINCT FROM 'named_only'))"
COMPLETE = "roll AS (SELECT v.* FROM {votes} v WHERE v.vote IN ('Yes', 'No') AND EXISTS (SELECT 1 FROM {motions} m WHERE m.id = v.motion_id AND m.coverage = 'reconstructed_complete'))"
PAIRS = "pairs AS (SELECT x.person_id AS a, y.person_id AS b, COUNT(*) AS shared, COUNT(*) FILTER (x.vote = y.vote) AS matching FROM roll x JOIN roll y ON x.motion_id = y.motion_id AND x.person_id < y.person_id GROUP BY 1, 2)"


@query("agg11_cast_votes", f"WITH {CAST} SELECT motion_id, person_id, vote FROM cast_votes")
def agg11(c: Civic) -> DataFrame:
    return ops.cast_votes(c.votes, c.motions).select("motion_id", "person_id", "vote")


def dated(c: Civic) -> DataFrame:
    m = c.motions.select(F.col("id").alias("m"), "meeting_id").join(c.meetings.select(F.col("id").alias("g"), "meeting_date"), F.col("meeting_id") == F.col("g")).select("m", "meeting_date")
    return ops.cast_votes(c.votes, c.motions).join(m, F.col("motion_id") == F.col("m"))


@query("agg10_alignment", f"""
    WITH {CAST}, active AS (SELECT v.motion_id, v.person_id, v.vote FROM cast_votes v JOIN {{motions}} m ON m.id = v.motion_id JOIN {{meetings}} g ON g.id = m.meeting_id
      WHERE EXISTS (SELECT 1 FROM {{memberships}} s WHERE s.person_id = v.person_id AND (s.start_date IS NULL OR s.start_date <= g.meeting_date) AND (s.end_date IS NULL OR g.meeting_date <= s.end_date)))
    SELECT y.person_id, COUNT(*) AS total, COUNT(*) FILTER (x.vote = y.vote) AS matching, ROUND(COUNT(*) FILTER (x.vote = y.vote) / COUNT(*) * 100, 6) AS rate
    FROM active x JOIN active y ON x.motion_id = y.motion_id AND x.person_id = 17 AND y.person_id <> 17 GROUP BY y.person_id""")
def agg10(c: Civic) -> DataFrame:
    active = ops.serving(dated(c), c.memberships)
    return ops.alignment_of(17, ops.last_vote(active)).withColumn("rate", F.round("rate", 6)).orderBy(F.col("rate").desc(), "person_id")


@query("agg12_consensus", f"WITH {CAST} SELECT COUNT(*) AS motions, COUNT(*) FILTER (d = 1) AS agreed FROM (SELECT motion_id, COUNT(*) AS n, COUNT(DISTINCT vote) AS d FROM cast_votes GROUP BY motion_id) WHERE n > 1")
def agg12(c: Civic) -> DataFrame:
    return ops.consensus(ops.cast_votes(c.votes, c.motions))


@query("agg13_pairwise_alignment", f"WITH {COMPLETE}, {PAIRS}, both_ AS (SELECT a, b, shared, matching FROM pairs UNION ALL SELECT b, a, shared, matching FROM pairs) SELECT a, b, shared, ROUND(matching / shared, 6) AS rate FROM both_ WHERE shared >= 5")
def agg13(c: Civic) -> DataFrame:
    return ops.mirrored(ops.shared(ops.complete(c.votes, c.motions))).where("shared >= 5").select("a", "b", "shared", F.round(F.col("matching") / F.col("shared"), 6).alias("rate"))


@query("joi17_shared_motions", f"WITH {COMPLETE}, {PAIRS} SELECT * FROM pairs")
def joi17(c: Civic) -> DataFrame:
    return ops.shared(ops.complete(c.votes, c.motions))


KEY = f"""
    WITH {COMPLETE}, {PAIRS}, allies AS (SELECT a, b FROM pairs WHERE shared >= 5 AND matching / shared >= 0.8 UNION ALL SELECT b, a FROM pairs WHERE shared >= 5 AND matching / shared >= 0.8),
    tally AS (SELECT motion_id, COUNT(*) FILTER (vote = 'Yes') AS yes, COUNT(*) FILTER (vote = 'No') AS no FROM roll GROUP BY motion_id),
    breaks AS (SELECT x.motion_id, x.person_id, COUNT(*) AS n FROM roll x JOIN allies l ON l.a = x.person_id JOIN roll y ON y.motion_id = x.motion_id AND y.person_id = l.b AND y.vote <> x.vote GROUP BY 1, 2),
    facts AS (SELECT r.motion_id, r.person_id, r.vote, t.yes, t.no, COALESCE(b.n, 0) AS breaks,
      COALESCE((upper(m.result) IN ('CARRIED', 'CARRIED AS AMENDED') AND r.vote = 'No') OR (upper(m.result) IN ('DEFEATED', 'NOT CARRIED') AND r.vote = 'Yes'), FALSE) AS minority,
      CASE ABS(t.yes - t.no) WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.0 END AS closeness
      FROM roll r JOIN tally t ON t.motion_id = r.motion_id JOIN {{motions}} m ON m.id = r.motion_id LEFT JOIN breaks b ON b.motion_id = r.motion_id AND b.person_id = r.person_id),
    found AS (SELECT motion_id, person_id, vote, concat_ws(',', CASE WHEN minority THEN 'minority' END, CASE WHEN closeness > 0 THEN 'close_vote' END, CASE WHEN breaks > 0 THEN 'ally_break' END) AS detection,
      CAST(yes AS STRING) || '-' || CAST(no AS STRING) AS split, CAST(3 * CAST(minority AS INT) + 2 * closeness + breaks AS DOUBLE) AS score FROM facts WHERE minority OR closeness > 0 OR breaks > 0)"""


@query("prf01_key_votes", KEY + " SELECT * FROM found")
def prf01(c: Civic) -> DataFrame:
    return ops.key_votes(c.votes, c.motions)


@query("prf02_ranked_key_votes", KEY + " SELECT motion_id, person_id, detection, score, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY score DESC, motion_id) AS place FROM found) WHERE place <= 10")
def prf02(c: Civic) -> DataFrame:
    return ops.ranked(ops.key_votes(c.votes, c.motions), 10).select("motion_id", "person_id", "detection", "score", F.col("place").cast("long").alias("place"))


@query("mth01_key_vote_score", "SELECT motion_id, CAST(CASE ABS(yes - no) WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS closeness FROM (SELECT motion_id, COUNT(*) FILTER (vote = 'Yes') AS yes, COUNT(*) FILTER (vote = 'No') AS no FROM {votes} GROUP BY motion_id)")
def mth01(c: Civic) -> DataFrame:
    margin = F.abs(F.count_if(F.col("vote") == "Yes") - F.count_if(F.col("vote") == "No"))
    return c.votes.groupBy("motion_id").agg(F.when(margin == 0, 1.0).when(margin == 1, 0.75).when(margin == 2, 0.5).otherwise(0.0).alias("closeness"))


PRESENCE = "presence AS (SELECT event_id AS id, event_id % 200 AS meeting_id, user_id % 40 AS person_id, CAST(FLOOR(event_id / 200) AS BIGINT) AS tick, event_type IN ('click', 'view', 'signup') AS present FROM {events}), polls AS (SELECT p_partkey AS vote_id, p_partkey % 200 AS meeting_id, p_size AS tick FROM {part})"


@query("bal02_eligible_voters", f"WITH {PRESENCE} SELECT vote_id, person_id FROM (SELECT v.vote_id, e.person_id, arg_max(e.present, (e.tick, e.id)) AS present FROM presence e JOIN polls v ON v.meeting_id = e.meeting_id AND e.tick < v.tick GROUP BY 1, 2) WHERE present")
def bal02(c: Civic) -> DataFrame:
    events = c.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 200).alias("meeting_id"), (F.col("user_id") % 40).alias("person_id"), F.floor(F.col("event_id") / 200).alias("offset"), F.col("event_type").isin("click", "view", "signup").alias("present"))
    polls = c.part.select(F.col("p_partkey").alias("vote_id"), (F.col("p_partkey") % 200).alias("meeting_id"), F.col("p_size").alias("offset"))
    return ops.eligible(events, polls)


@query("bal05_merge_ballots", """
    WITH a AS (SELECT motion_id, person_id, vote FROM {votes} WHERE person_id % 3 < 2), b AS (SELECT motion_id, person_id, CASE WHEN motion_id % 5 = 0 AND person_id = 10 THEN 'Changed' ELSE vote END AS vote FROM {votes} WHERE person_id % 3 > 0),
    r AS (SELECT COALESCE(a.motion_id, b.motion_id) AS motion_id, COALESCE(a.person_id, b.person_id) AS person_id, COALESCE(b.vote, a.vote) AS vote, COALESCE(a.vote <> b.vote, FALSE) AS differs FROM a FULL JOIN b ON a.motion_id = b.motion_id AND a.person_id = b.person_id)
    SELECT r.motion_id, r.person_id, r.vote, h.held FROM r JOIN (SELECT motion_id, BOOL_OR(differs) AS held FROM r GROUP BY motion_id) h ON h.motion_id = r.motion_id""")
def bal05(c: Civic) -> DataFrame:
    v = c.votes.select("motion_id", "person_id", "vote")
    changed = F.when((F.col("motion_id") % 5 == 0) & (F.col("person_id") == 10), "Changed").otherwise(F.col("vote"))
    return ops.merge_ballots(v.where("person_id % 3 < 2"), v.where("person_id % 3 > 0").withColumn("vote", changed))


@query("win10_first_event", f"WITH {PRESENCE} SELECT meeting_id, person_id, MIN(tick) AS first_at, BOOL_OR(present) AS ever_present FROM presence GROUP BY 1, 2")
def win10(c: Civic) -> DataFrame:
    e = c.events.select((F.col("event_id") % 200).alias("meeting_id"), (F.col("user_id") % 40).alias("person_id"), F.floor(F.col("event_id") / 200).alias("at"), F.col("event_type").isin("click", "view", "signup").alias("present"))
    return e.groupBy("meeting_id", "person_id").agg(F.min("at").alias("first_at"), F.bool_or("present").alias("ever_present"))
