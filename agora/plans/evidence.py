"""Formal motions, bound quotes, canonical motions and the ledger of what was published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import evidence as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

#: Every document's lines set as minutes: motions of each kind, without an outcome or a body, repeated ones, stray outcomes. {x}: the line.
SET_AS = """CASE ({i} + doc_id) % 8 WHEN 0 THEN concat('MOVED BY: A', chr(10), 'SECONDED BY: B', chr(10), {x}, chr(10), 'CARRIED UNANIMOUSLY.') WHEN 1 THEN concat('  On the Main Motion as amended:', chr(10), {x}, chr(10), 'Motion NOT CARRIED (2-5)')
  WHEN 2 THEN concat(' Seconded; C', chr(10), {x}) WHEN 3 THEN concat('**SECONDED: D', chr(10), '  ', chr(10), 'TABLED until May') WHEN 4 THEN concat('M', chr(10), chr(10), '  SECONDED: E', chr(10), 'That the meeting adjourn ', CAST(doc_id % 3 AS STRING), chr(10), 'Opposed: F, G', chr(10), 'Defeated')
  WHEN 5 THEN concat({x}, chr(10), 'carried') WHEN 6 THEN concat('Voting resumed on Main Motion', chr(10), {x}, chr(10), '**WITHDRAWN**') ELSE {x} END"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


MINUTES_SQL = f"SELECT doc_id AS doc, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {SET_AS.format(x='x', i='(i - 1)')}), chr(10)) AS text FROM {{documents}} WHERE text IS NOT NULL"
SPANS_SQL = f"""minutes AS ({MINUTES_SQL}), line AS (SELECT doc, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM minutes),
    at_ AS (SELECT *, SUM(length(l) + 1) OVER (PARTITION BY doc ORDER BY k) - length(l) - 1 AS off, CASE WHEN regexp_matches(l, {lit('(?i)^' + ops.SECONDED)}) THEN 'seconded_motion' WHEN regexp_matches(l, {lit('(?i)^' + ops.RESUMED)}) THEN 'resumed_main_motion' WHEN regexp_matches(l, {lit('(?i)^' + ops.OUTCOME)}) THEN 'outcome' END AS kind FROM line),
    solid AS (SELECT *, COALESCE(MAX(CASE WHEN trim(l, concat(' ', chr(9), chr(13))) <> '' THEN off END) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM at_),
    mark AS (SELECT *, lead(kind) OVER w AS next_kind, lead(off) OVER w AS next_off, lead(l) OVER w AS next_l FROM solid WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY k)),
    raw AS (SELECT doc, kind, off AS anchor_at, off + length(l) - length(ltrim(l, concat(' ', chr(9)))) AS named_at, off + length(l) + CASE kind WHEN 'seconded_motion' THEN 1 ELSE 0 END AS body_at, next_off AS outcome_at, next_off + length(next_l) AS outcome_end, CASE kind WHEN 'seconded_motion' THEN prior ELSE off END AS source_at, text, trim(next_l) AS outcome
      FROM mark WHERE kind <> 'outcome' AND next_kind = 'outcome'),
    cut AS (SELECT *, text[body_at + 1 : outcome_at] AS piece FROM raw),
    span AS (SELECT *, regexp_replace(regexp_replace(piece, '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') AS body, regexp_replace(lower(regexp_replace(piece, {lit(ops.DECLARED)}, chr(10), 'g')), '[^a-z0-9]', '', 'g') AS body_compact FROM cut)"""
BLOCKS_SQL = "block AS (SELECT doc, doc * 1000000 + outcome_at AS block, CASE WHEN outcome_at % 7 = 0 THEN 'resumed_main_motion' ELSE kind END AS kind, CASE WHEN outcome_at % 11 = 0 THEN named_at + 1 ELSE source_at END AS at, outcome_at + CASE WHEN outcome_at % 13 = 0 THEN 60 ELSE 3 END AS outcome_at, CASE WHEN outcome_at % 3 = 0 THEN body ELSE body_compact END AS text FROM m WHERE (anchor_at + doc) % 5 <> 0)"


def formal(c: Civic) -> DataFrame:
    lines = F.expr(f"array_join(transform(split(text, '\\n'), (x, i) -> {SET_AS.format(x='x', i='i')}), '\\n')")
    return ops.formal_motions(c.documents.where("text is not null").select(F.col("doc_id").alias("doc"), lines.alias("text")))


def parsed(c: Civic) -> tuple[DataFrame, DataFrame]:
    """Formal motions, and blocks as a parser that misses and mistakes some would cut them."""
    motions = formal(c)
    return motions, c.spark.sql(f"WITH {BLOCKS_SQL.replace('FROM m ', 'FROM {m} ')} SELECT doc, block, kind, CAST(at AS INT) AS at, CAST(outcome_at AS INT) AS outcome_at, text FROM block", m=motions)


@query("rem14_formal_motions", f"WITH {SPANS_SQL} SELECT doc, kind, anchor_at, named_at, body_at, outcome_at, outcome_end, source_at, md5(body) AS body_md5, md5(body_compact) AS compact_md5, outcome FROM span WHERE body <> ''")
def rem14(c: Civic) -> DataFrame:
    return formal(c).select("doc", "kind", "anchor_at", "named_at", "body_at", "outcome_at", "outcome_end", "source_at", F.md5("body").alias("body_md5"), F.md5("body_compact").alias("compact_md5"), "outcome")


OWNED_SQL = f"""WITH {SPANS_SQL}, m AS (SELECT * FROM span WHERE body <> ''), {BLOCKS_SQL}, b AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS words FROM block),
    met AS (SELECT b.doc, b.block, COUNT(m.doc) AS matching, COUNT(*) FILTER (m.kind = b.kind AND b.at <= m.named_at AND m.outcome_at <= b.outcome_at AND b.outcome_at < m.outcome_end) AS own,
      MIN(m.anchor_at) FILTER (m.kind = b.kind AND b.at <= m.named_at AND m.outcome_at <= b.outcome_at AND b.outcome_at < m.outcome_end) AS anchor_at FROM b LEFT JOIN m ON m.doc = b.doc AND m.body_compact = b.words GROUP BY b.doc, b.block)"""


@query("rem14_owned_motions", f"{OWNED_SQL} SELECT doc, block, matching, CAST(own AS INT) AS own, CASE WHEN matching = 1 AND own = 1 THEN 'unique' WHEN matching > 1 THEN 'repeated' ELSE 'unowned' END AS status FROM met")
def rem14_owned(c: Civic) -> DataFrame:
    return ops.owned_motions(*parsed(c))[0]


@query("rem14_unparsed_motions", f"{OWNED_SQL} SELECT m.doc, m.kind, m.anchor_at, met.doc IS NOT NULL AS owned FROM m LEFT JOIN met ON met.doc = m.doc AND met.anchor_at = m.anchor_at AND met.own = 1")
def rem14_unparsed(c: Civic) -> DataFrame:
    return ops.owned_motions(*parsed(c))[1].select("doc", "kind", "anchor_at", "owned")


# --- statements -----------------------------------------------------------------------------------------------------

#: The transcripts as they came: runs of one speaker, empty and endless segments, twins.
SOURCE = """SELECT id, person_id, meeting_id, 'sha ' || CAST(meeting_id AS STRING) AS sha, k, CASE WHEN CAST(FLOOR(k / 5) AS BIGINT) % 4 = 0 THEN 'The chair' ELSE 'speaker_' || CAST(CAST(FLOOR(k / 5) AS BIGINT) % 4 AS STRING) END AS speaker,
  CASE WHEN id % 97 = 5 THEN '  ' WHEN k % 40 IN (20, 21) THEN 'the  same words' ELSE text || ', no. ' || CAST(id % 1000 AS STRING) END AS text, CASE WHEN k % 40 IN (20, 21) THEN CAST(5 AS DOUBLE) ELSE start_time END AS start, CASE WHEN id % 89 = 7 THEN start_time WHEN k % 40 IN (20, 21) THEN CAST(6 AS DOUBLE) ELSE start_time + 10 END AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY id) - 1 AS k FROM {segments})"""
#: Their rows as kept: some are gone, some are there twice.
STORED = """SELECT id, meeting_id, CASE WHEN id % 41 = 1 THEN NULL ELSE CAST(FLOOR(k / 5) AS BIGINT) % 7 END AS person_id, CASE WHEN start > 1 THEN start - 1 ELSE start END AS start_time, stop + 1 AS end_time, 'so: ' || text || ' (sic)' AS text FROM s WHERE id % 53 <> 9
  UNION ALL SELECT id + 100000000, meeting_id, 3, start, stop, text FROM s WHERE id % 59 = 11"""
STATEMENTS = """SELECT id AS statement, meeting_id, CASE WHEN id % 17 = 4 THEN 'vote' ELSE 'transcript' END AS evidence, CASE WHEN id % 19 = 3 THEN 'old' ELSE sha END AS sha, k, id % 16 AS form, CASE WHEN id % 31 = 6 THEN 'rumour' WHEN id % 31 = 7 THEN NULL ELSE 'claim' END AS kind,
  CASE WHEN id % 29 = 2 THEN ' ' WHEN id % 23 = 6 THEN substring(trim(text), 2, 9) WHEN id % 23 = 7 THEN trim(text) || ' never' WHEN id % 16 IN (1, 5, 8, 9) THEN regexp_extract(text, '([0-9]+)$', 1) || '  ' || regexp_extract(following, '^([a-z]+)', 1) ELSE substring(text, 1, 5) END AS quote
  FROM (SELECT *, lead(text) OVER (PARTITION BY meeting_id ORDER BY k) AS following FROM s)"""
RECEIPTS = "SELECT id AS segment_id, meeting_id, CASE WHEN id % 37 = 2 THEN 99 ELSE CAST(FLOOR(k / 5) AS BIGINT) % 7 END AS person_id, CASE WHEN id % 43 = 3 THEN 'old' ELSE sha END AS sha, id % 47 <> 5 AS active FROM s"
PEOPLE = "SELECT id, name FROM {people} UNION ALL SELECT id + 1000000, '  ' || upper(name) FROM {people} WHERE id = 3"
#: The forms of a list of indexes around k.
INDEXES = "CASE form WHEN 1 THEN {a}k, k + 1{z} WHEN 5 THEN {a}k, k + 1, k + 2{z} WHEN 8 THEN {a}k, k + 1{z} WHEN 9 THEN {a}k, k + 1{z} WHEN 2 THEN {a}k + 1, k{z} WHEN 3 THEN {none} WHEN 4 THEN {a}k, k + 2{z} WHEN 6 THEN {a}k + 1000000{z} WHEN 7 THEN NULL WHEN 10 THEN {a}k, NULL{z} WHEN 11 THEN {a}k - 1000000{z} ELSE {a}k{z} END"
SPAN_SQL = "({0} IS NOT NULL AND {1} IS NOT NULL AND {0} >= 0 AND {0} < {1})"


def edged_sql(x: str) -> str:
    return f"regexp_replace({x}, '(\\w+)', chr(1) || '\\1' || chr(1), 'g')"


def spaced_sql(x: str) -> str:
    return f"trim(regexp_replace(COALESCE({x}, ''), '\\s+', ' ', 'g'))"


@query("rem15_bound_statements", f"""
    WITH s AS ({SOURCE}), kept AS ({STORED}), who AS ({PEOPLE}), receipt AS ({RECEIPTS}), st AS (SELECT *, {INDEXES.format(a='[', z=']', none='[]')} AS idx FROM ({STATEMENTS})),
    size AS (SELECT meeting_id, COUNT(*) AS n, MIN(sha) AS sha FROM s GROUP BY meeting_id),
    early AS (SELECT st.*, CASE WHEN evidence <> 'transcript' THEN 'spoken_statement_requires_transcript_not_recorded_vote_or_summary' WHEN size.n IS NULL THEN 'source_context_unavailable' WHEN st.sha <> size.sha THEN 'original_transcript_hash_missing_or_changed'
      WHEN idx IS NULL OR len(idx) = 0 OR len(list_filter(idx, lambda x: x IS NULL)) > 0 THEN 'source_indexes_required' WHEN idx <> range(idx[1], idx[1] + len(idx)) OR idx[1] < 0 OR idx[-1] >= size.n THEN 'source_indexes_not_unique_contiguous_in_range' END AS why FROM st LEFT JOIN size ON size.meeting_id = st.meeting_id),
    part AS (SELECT e.statement, e.meeting_id, e.quote, e.kind, unnest(idx) AS k FROM early e WHERE why IS NULL),
    seg AS (SELECT p.*, s.speaker, s.text, s.start, s.stop, COUNT(kept.id) AS n, MIN(kept.id) AS row_id, {SPAN_SQL.format('s.start', 's.stop')} AND {spaced_sql('s.text')} <> '' AS good FROM part p JOIN s ON s.meeting_id = p.meeting_id AND s.k = p.k
      LEFT JOIN kept ON kept.meeting_id = s.meeting_id AND {SPAN_SQL.format('s.start', 's.stop')} AND {SPAN_SQL.format('kept.start_time', 'kept.end_time')} AND kept.start_time <= s.start AND s.stop <= kept.end_time AND {spaced_sql('s.text')} <> '' AND contains({spaced_sql('kept.text')}, {spaced_sql('s.text')}) GROUP BY ALL),
    twin AS (SELECT meeting_id, start, stop, text, COUNT(*) AS n FROM s GROUP BY ALL),
    why AS (SELECT seg.*, CASE WHEN NOT good THEN 'invalid_original_segment' WHEN t.n > 1 THEN 'original_source_tuple_not_unique' WHEN seg.n <> 1 THEN 'persisted_source_tuple_missing_or_ambiguous' END AS bad FROM seg JOIN twin t ON t.meeting_id = seg.meeting_id AND t.start = seg.start AND t.stop = seg.stop AND t.text = seg.text),
    whole AS (SELECT statement, meeting_id, quote, kind, COUNT(DISTINCT speaker) AS speakers, MIN(speaker) AS label, {spaced_sql("string_agg(text, ' ' ORDER BY k)")} AS said, arg_min(start, k) AS start_time, arg_min(bad, k) FILTER (bad IS NOT NULL) AS bad, list_sort(list_distinct(list(row_id))) AS ids FROM why GROUP BY ALL),
    late AS (SELECT *, CASE WHEN speakers > 1 THEN 'source_quote_crosses_raw_speakers' WHEN {spaced_sql('quote')} = '' OR NOT contains({edged_sql('said')}, {edged_sql(spaced_sql('quote'))}) THEN 'exact_quote_absent_from_original_selected_segments' WHEN kind IS NULL OR kind <> 'claim' THEN 'unsupported_statement_type' ELSE bad END AS why FROM whole),
    row_ AS (SELECT statement, meeting_id, unnest(ids) AS id FROM late WHERE why IS NULL),
    sure AS (SELECT DISTINCT r.statement, r.id, k.person_id, x.person_id AS told FROM row_ r JOIN kept k ON k.id = r.id JOIN size ON size.meeting_id = r.meeting_id LEFT JOIN receipt x ON x.active AND x.segment_id = r.id AND x.meeting_id = r.meeting_id AND x.person_id = k.person_id AND x.sha = size.sha),
    person AS (SELECT statement, MIN(told) AS person_id FROM sure GROUP BY statement HAVING COUNT(*) = COUNT(told) AND COUNT(DISTINCT told) = 1),
    alone AS (SELECT id, name FROM (SELECT *, COUNT(*) OVER (PARTITION BY lower({spaced_sql('name')})) AS n FROM who) WHERE n = 1)
    SELECT e.statement, COALESCE(e.why, l.why, 'bound') AS status, CASE WHEN COALESCE(e.why, l.why) IS NULL THEN array_to_string(l.ids, ',') END AS segment_ids, CASE WHEN COALESCE(e.why, l.why) IS NULL THEN l.start_time END AS start_time, a.id AS person_id,
      CASE WHEN COALESCE(e.why, l.why) IS NULL THEN COALESCE(a.name, CASE WHEN regexp_matches(l.label, '(?i)^speaker_[0-9]+$') THEN l.label ELSE 'Unidentified speaker' END) END AS speaker_name
    FROM early e LEFT JOIN late l ON l.statement = e.statement LEFT JOIN person p ON p.statement = e.statement LEFT JOIN alone a ON a.id = p.person_id""")
def rem15(c: Civic) -> DataFrame:
    s = c.spark.sql(SOURCE, segments=c.segments)
    of = lambda text: c.spark.sql(text.replace("FROM s", "FROM {s}"), s=s)
    indexes = INDEXES.format(a="array(", z=")", none="CAST(array() AS array<bigint>)")
    statements = of(STATEMENTS).select("statement", "meeting_id", "evidence", "sha", F.expr(indexes).cast("array<bigint>").alias("indexes"), "quote", "kind")
    found = ops.bound_statements(statements, s.withColumnRenamed("stop", "end"), of(STORED), of(RECEIPTS), c.spark.sql(PEOPLE, people=c.people))
    return found.withColumn("segment_ids", F.array_join("segment_ids", ","))


# --- motions across versions -----------------------------------------------------------------------------------------

BLOCK = """SELECT id, meeting_id, 'v2-' || CAST(meeting_id AS STRING) AS sha, (id % 4) * 100 AS spot, id % 4 AS ord, id % 13 <> 5 AS own, CASE WHEN id % 23 IN (8, 9) THEN 'Receive the report' ELSE text END AS text FROM {motions}"""
KNOWN = """SELECT id * 10 AS id, meeting_id, CASE WHEN id % 18 IN (4, 12) THEN 'Another wording ' || CAST(id AS STRING) ELSE text END AS text, CASE WHEN id % 18 IN (1, 5, 12, 14) THEN NULL WHEN id % 18 = 3 THEN 'earlier ' || CAST(id AS STRING) ELSE key END AS key, CASE WHEN id % 18 = 3 THEN key END AS past FROM k WHERE id % 18 NOT IN (0, 9) AND (id % 18 <> 12 OR id % 5 = 0)
  UNION ALL SELECT id * 10 + 1, meeting_id, upper(text), NULL, NULL FROM k WHERE id % 18 = 5 UNION ALL SELECT id * 10 + 2, meeting_id, text, NULL, key FROM k WHERE id % 18 = 7 AND id % 4 = 3"""
DATED = "SELECT DISTINCT meeting_id AS id, DATE '2024-03-01' AS day, 'Council' AS body, meeting_id % 30 AS shift, CASE WHEN meeting_id % 14 = 3 THEN 'Committee' ELSE 'Council' END AS source_body FROM {motions} WHERE meeting_id % 31 <> 8"
KEY_SQL = "sha256(concat('{{\"meeting_id\": ', meeting_id, ', \"source_offset\": ', spot, ', \"source_order\": ', ord, ', \"source_sha256\": \"', sha, '\"}}'))"
WORDS_SQL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query("rem16_canonical_motions", f"""
    WITH b0 AS ({BLOCK}), b AS (SELECT *, {KEY_SQL} AS key, {WORDS_SQL} AS words, COUNT(*) OVER (PARTITION BY meeting_id, {WORDS_SQL}) AS bodies FROM b0), k AS (SELECT * FROM b), e0 AS ({KNOWN}),
    e AS (SELECT e0.id, e0.meeting_id, e0.key, e0.past, trim(regexp_replace(lower(e0.text), '[^a-z0-9]+', ' ', 'g')) AS words, b.key AS bound FROM e0 LEFT JOIN b ON b.meeting_id = e0.meeting_id AND b.key = e0.key AND b.own AND b.words = trim(regexp_replace(lower(e0.text), '[^a-z0-9]+', ' ', 'g'))),
    led AS (SELECT b.key, e.id FROM b JOIN e ON e.key = b.key OR e.past = b.key), pick AS (SELECT key, id FROM led UNION ALL SELECT b.key, e.id FROM b JOIN e ON e.meeting_id = b.meeting_id AND e.words = b.words WHERE b.key NOT IN (SELECT key FROM led)),
    fit AS (SELECT p.key, p.id FROM pick p JOIN b ON b.key = p.key JOIN e ON e.id = p.id WHERE e.bound IS NOT DISTINCT FROM b.key OR (b.bodies = 1 AND e.words = b.words)),
    n AS (SELECT key, COUNT(*) AS n, MIN(id) AS id FROM fit GROUP BY key), taker AS (SELECT id, COUNT(*) AS takers FROM n WHERE n = 1 GROUP BY id),
    state AS (SELECT e.meeting_id, COUNT(*) FILTER (t.id IS NULL) AS rest, bool_and(e.bound IS NOT NULL) AS every FROM e LEFT JOIN taker t ON t.id = e.id GROUP BY e.meeting_id),
    d AS ({DATED}), r AS (SELECT b.*, COALESCE(n.n, 0) AS n, n.id AS old, e.bound, e.words AS old_words, e.key AS old_key, e.past, COALESCE(t.takers, 0) AS takers, COALESCE(s.rest, 0) > 0 AS unresolved, COALESCE(s.every, true) AS every, d.shift, d.source_body
      FROM b LEFT JOIN n ON n.key = b.key LEFT JOIN e ON n.n = 1 AND e.id = n.id LEFT JOIN taker t ON n.n = 1 AND t.id = n.id LEFT JOIN state s ON s.meeting_id = b.meeting_id LEFT JOIN d ON d.id = b.meeting_id),
    f AS (SELECT *, n = 0 AND NOT unresolved AND every AS fresh, n = 1 AND COALESCE(bound = key, false) AS mine FROM r),
    v AS (SELECT *, CASE WHEN shift IS NULL OR shift - 20 > 1 THEN 'source_date_not_bound' WHEN source_body <> 'Council' THEN 'source_voting_body_not_bound' WHEN bodies > 1 AND NOT (fresh AND own) AND NOT mine THEN 'original_formal_occurrence_not_unique'
      WHEN n > 1 OR takers > 1 OR (bodies <> 1 AND NOT fresh AND NOT mine) THEN 'ambiguous_legacy_or_source_body' WHEN n = 0 AND unresolved THEN 'unmapped_legacy_records' WHEN n = 1 THEN 'kept' ELSE 'new' END AS status FROM f)
    SELECT meeting_id, ord, key, status, CASE WHEN status = 'kept' THEN old END AS motion_id, CASE WHEN status = 'kept' THEN array_to_string(list_sort(list_distinct(list_filter([past, CASE WHEN old_key <> key THEN old_key END], lambda x: x IS NOT NULL))), '|') END AS previous_keys FROM v""")
def rem16(c: Civic) -> DataFrame:
    b = c.spark.sql(BLOCK, motions=c.motions)
    k = b.select("id", "meeting_id", "text", ops.source_key(F.col("meeting_id"), F.col("sha"), F.col("spot"), F.col("ord")).alias("key"))
    known = c.spark.sql(KNOWN.replace("FROM k", "FROM {k}"), k=k).select("id", "meeting_id", "text", "key", F.when(F.col("past").isNotNull(), F.array("past")).alias("previous"))
    again = b.groupBy(F.col("meeting_id").alias("_m"), F.lower("text").alias("_t")).agg(F.count("*").alias("_n"))
    blocks = b.join(again.hint("merge"), (F.col("meeting_id") == F.col("_m")) & (F.lower("text") == F.col("_t"))).select("meeting_id", "sha", F.col("spot").alias("at"), "ord", "text", (F.col("_n") == 1).alias("unique"), F.col("own").cast("int").alias("own"))
    meetings = c.spark.sql(DATED, motions=c.motions).withColumn("source_day", F.expr("date_add(day, CAST(greatest(shift - 20, -1) AS INT))"))
    return ops.canonical_plan(blocks, known, meetings).withColumn("previous_keys", F.array_join("previous_keys", "|"))


# --- the ledger -----------------------------------------------------------------------------------------------------


@query("rem17_ledger_chain", """
    WITH RECURSIVE e AS (SELECT CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT) AS batch, sha256(concat(event_id, '|', user_id, '|', event_type)) AS digest FROM {events}),
    s AS (SELECT batch, digest, COUNT(*) OVER (PARTITION BY batch) AS n FROM e),
    slot AS (SELECT batch, n, CAST('0x' || digest[1:8] AS BIGINT) % CAST(CEIL(n / 64.0) AS BIGINT) AS slot, sha256(string_agg(digest, '' ORDER BY digest)) AS part FROM s GROUP BY ALL),
    head AS (SELECT batch, n, sha256(string_agg(part, '' ORDER BY slot)) AS digest, row_number() OVER (ORDER BY batch) AS k FROM slot GROUP BY batch, n),
    chain AS (SELECT batch, n, digest, k, sha256(digest) AS head FROM head WHERE k = 1 UNION ALL SELECT h.batch, h.n, h.digest, h.k, sha256(c.head || h.digest) FROM chain c JOIN head h ON h.k = c.k + 1)
    SELECT batch, n, digest, head FROM chain""")
def rem17(c: Civic) -> DataFrame:
    entry = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type"), 256)
    entries = c.events.select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("batch"), entry.alias("digest"))
    return ops.chained(ops.batch_digest(entries, of_group=64))
