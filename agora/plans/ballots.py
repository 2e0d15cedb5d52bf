"""Presence within bounds and committee ballots over the events and parts of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from agora.operators import ballots as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

CHANGES = "SELECT event_id % 200 AS doc, user_id % 12 AS person, CAST(FLOOR(event_id / 200) AS BIGINT) * 12 AS low, CAST(FLOOR(event_id / 200) AS BIGINT) * 12 + CAST(FLOOR(value) AS BIGINT) % 9 AS high, event_type IN ('click', 'view', 'signup', 'purchase') AS present FROM {events}"
POLLS = "SELECT p_partkey AS vote, p_partkey % 200 AS doc, p_size * 11 AS low, p_size * 11 + p_partkey % 4 AS high FROM {part}"
ROSTER = """SELECT doc, person, CASE WHEN (doc + person) % 9 = 0 THEN NULL ELSE (doc * 3 + person) % 5 <> 0 END AS present, CASE WHEN doc % 19 = 3 AND person = 4 THEN 'unknown' WHEN person = 0 THEN 'mayor' WHEN person < 4 THEN 'councillor' WHEN person < 11 THEN 'citizen' ELSE 'visitor' END AS role, doc % 23 <> 5 OR person <> 2 AS proven, person IN (1, 2) AS chair
  FROM (SELECT DISTINCT event_id % 200 AS doc, user_id % 12 AS person FROM {events} WHERE event_id % 200 % 11 <> 7)"""
DECIDED = "SELECT p_partkey % 200 AS doc, p_partkey AS vote, CASE p_size % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'tabled' WHEN 2 THEN NULL ELSE 'passed' END AS outcome, p_partkey % 5 = 2 AS unanimous, p_partkey % 7 <> 1 AS rule, p_partkey % 29 = 4 AS threshold FROM {part}"
NAMED = """SELECT vote, person, choice FROM (SELECT p_partkey AS vote, (p_partkey + p_size) % 14 AS person, CASE WHEN p_partkey % 31 = 0 THEN 'Recused' WHEN p_partkey % 37 = 1 THEN NULL ELSE 'No' END AS choice FROM {part} WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, (p_partkey + p_size) % 14, 'Yes' FROM {part} WHERE p_partkey % 15 = 0) x"""
#: Of changes and votes by their bounds, each pair looked at.
STATES = """r AS (SELECT v.vote, v.doc, v.low, v.high, o.person, o.present AS first, o.role, o.proven, o.chair FROM v JOIN o ON o.doc = v.doc),
    j AS (SELECT r.vote, r.person, r.first, arg_max(c.present, (c.high, c.low, NOT c.present)) FILTER (c.high <= r.low) AS last, COUNT(*) FILTER (c.present AND c.low < r.high AND c.high > r.low) AS may_come, COUNT(*) FILTER (NOT c.present AND c.low < r.high AND c.high > r.low) AS may_go
      FROM r LEFT JOIN c ON c.doc = r.doc AND c.person = r.person GROUP BY r.vote, r.person, r.first),
    s AS (SELECT vote, person, CASE WHEN COALESCE(last, first) IS NULL OR (COALESCE(last, first) AND may_go > 0) OR (NOT COALESCE(last, first) AND may_come > 0) THEN 'unknown' WHEN COALESCE(last, first) THEN 'present' ELSE 'absent' END AS state FROM j)"""


def room(c: Civic) -> tuple[DataFrame, DataFrame]:
    roster = c.spark.sql(ROSTER, events=c.events)
    return roster, ops.presence_at(c.spark.sql(POLLS, part=c.part), roster, c.spark.sql(CHANGES, events=c.events))


@query("rem19_presence_at_votes", f"WITH v AS ({POLLS}), o AS ({ROSTER}), c AS ({CHANGES}), {STATES} SELECT r.doc, s.vote, s.person, s.state FROM s JOIN r ON r.vote = s.vote AND r.person = s.person")
def rem19(c: Civic) -> DataFrame:
    return room(c)[1]


BALLOTS = f"""WITH v AS ({POLLS}), o AS ({ROSTER}), c AS ({CHANGES}), {STATES}, n AS (SELECT vote, person, COUNT(DISTINCT choice) AS kinds, MIN(choice) AS choice FROM ({NAMED}) GROUP BY vote, person), d AS ({DECIDED}),
    e AS (SELECT r.vote, r.person, r.role, r.proven, r.chair, s.state, n.vote IS NOT NULL AS named, n.kinds, n.choice, s.state = 'present' AND r.role IN ('councillor', 'citizen', 'mayor') AS votes FROM r JOIN s ON s.vote = r.vote AND s.person = r.person LEFT JOIN n ON n.vote = r.vote AND n.person = r.person),
    p AS (SELECT vote, bool_or(role = 'councillor' AND NOT proven) AS office, bool_or(role = 'mayor' AND NOT proven) AS mayor, bool_or(role = 'unknown' AND state <> 'absent') AS stranger, bool_or(role IN ('councillor', 'citizen', 'mayor') AND state = 'unknown') AS unsure, COUNT(*) FILTER (votes) AS present, COUNT(*) FILTER (votes AND role <> 'mayor') AS appointed,
      bool_or(votes AND role = 'councillor' AND chair) AS chaired, bool_or(named AND NOT votes) AS away, bool_or(COALESCE(kinds > 1, false)) AS two, bool_or(named AND COALESCE(choice NOT IN ('Yes', 'No'), true)) AS special, bool_or(votes AND COALESCE(choice = 'No', false)) AS against, COUNT(*) FILTER (votes AND named) AS told, COUNT(*) FILTER (votes AND COALESCE(choice, 'Yes') = 'Yes') AS yes, COUNT(*) FILTER (votes AND choice = 'No') AS no FROM e GROUP BY vote),
    x AS (SELECT DISTINCT n.vote FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.vote = n.vote AND r.person = n.person)),
    t AS (SELECT d.vote, d.unanimous, p.yes, p.no, CASE WHEN COALESCE(d.outcome NOT IN ('passed', 'failed'), true) THEN 'not_a_yes_no_decision' WHEN p.vote IS NULL THEN 'committee_full_identity_not_proven' WHEN office THEN 'committee_councillor_office_not_proven' WHEN mayor THEN 'committee_exofficio_mayor_not_proven' WHEN stranger THEN 'committee_full_identity_not_proven'
      WHEN unsure THEN 'initial_presence_unknown' WHEN appointed < 5 OR present > 10 OR NOT chaired THEN 'committee_quorum_or_chair_not_proven' WHEN x.vote IS NOT NULL THEN 'unresolved_dissent_names' WHEN away THEN 'named_choice_voter_not_present' WHEN two THEN 'conflicting_named_source_choices' WHEN special THEN 'special_vote_or_recusal_needs_scope'
      WHEN unanimous AND against THEN 'unanimous_result_conflicts_with_named_choice' WHEN told <> present AND NOT unanimous AND NOT rule THEN 'recording_rule_not_refreshed' WHEN threshold THEN 'special_voting_threshold_needs_validation' WHEN (outcome = 'passed') <> (yes > no) THEN 'reconstructed_tally_conflicts_with_outcome' ELSE 'reconstructable_candidate' END AS status
      FROM d LEFT JOIN p ON p.vote = d.vote LEFT JOIN x ON x.vote = d.vote)"""


def told(c: Civic) -> tuple[DataFrame, DataFrame]:
    roster, states = room(c)
    return ops.committee_ballots(c.spark.sql(DECIDED, part=c.part), roster.select("doc", "person", "role", "proven", "chair"), states, c.spark.sql(NAMED, part=c.part))


@query("bal04_committee_motions", f"{BALLOTS} SELECT vote, status, CASE WHEN status = 'reconstructable_candidate' THEN yes END AS yes, CASE WHEN status = 'reconstructable_candidate' THEN no END AS no FROM t")
def bal04(c: Civic) -> DataFrame:
    return told(c)[0]


@query("bal04_committee_ballots", f"{BALLOTS} SELECT e.vote, e.person, COALESCE(e.choice, 'Yes') AS choice, CASE WHEN e.named THEN 'explicit_named' WHEN t.unanimous THEN 'inferred_explicit_unanimity' ELSE 'inferred_official_dissent_recording_rule' END AS evidence FROM e JOIN t ON t.vote = e.vote WHERE t.status = 'reconstructable_candidate' AND e.votes")
def bal04_ballots(c: Civic) -> DataFrame:
    return told(c)[1]
