"""Minutes, ballots, participation, schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import minutes as ops
from agora.functions.matters import PARENT, STREET
from agora.plans.matching import address_sql, bylaws_sql, identifiers_sql, lit
from agora.plans.registry import query
from agora.sources.civic import Civic


@query("str05_unique_slugs", None)
def str05(c: Civic) -> DataFrame:
    rows = c.matters.select("id", "municipality_id", F.when(F.col("id") % 50 == 1, "small-ring-2").otherwise(F.regexp_replace("title", " .*$", "-ring")).alias("base"))
    return ops.unique_slugs(rows, "municipality_id")


#: Summaries with fences, bold words, every mark, blank and plain lines around a matter's title.
SUMMARY = """CASE id % 4 WHEN 0 THEN concat('```markdown', chr(10)) WHEN 1 THEN concat('``` ', chr(10), chr(10)) WHEN 2 THEN concat('  ', chr(9)) ELSE '' END || concat('* **', title, '** and ', CAST(id AS STRING), chr(10), '   ', chr(10), CASE id % 7 WHEN 0 THEN '- ' WHEN 1 THEN '• ' WHEN 2 THEN CAST(id AS STRING) || ') ' WHEN 3 THEN '12.  '
  WHEN 4 THEN '– ' WHEN 5 THEN '-' ELSE '' END, title, chr(13), chr(10), '  *  second **a*b** ** c **', chr(12), 'plain ') || CASE id % 3 WHEN 0 THEN concat(chr(10), '```') WHEN 1 THEN '```' ELSE concat(chr(10), '``` x') END"""


@query("str24_bullets", rf"""
    WITH x AS (SELECT id, {SUMMARY} AS t FROM {{matters}}), a AS (SELECT id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS t FROM x),
    b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^```(?:markdown|md|text)?\s*\n?', ''), '\n?```$', ''), '^\s+', ''), '\s+$', ''), '\*\*([^*]+)\*\*', '\1', 'g') AS t FROM a),
    l AS (SELECT id, list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r\f]'), lambda y: trim(y, concat(' ', chr(9)))), lambda y: y <> '') AS ls FROM b)
    SELECT id, array_to_string(list_transform(ls, lambda y: regexp_replace(y, '^(?:[-*•]|\d+[.)])\s+', '- ')), chr(10)) AS text FROM l""")
def str24(c: Civic) -> DataFrame:
    return c.matters.select("id", ops.bullets(F.expr(SUMMARY)).alias("text"))


@query("doc11_minutes_blocks", "SELECT id AS doc, place, kind FROM {motions}, (VALUES (0, 'header'), (1, 'spacer'), (2, 'motion_meta'), (3, 'list_item'), (4, 'paragraph'), (5, 'result'), (6, 'divider')) t(place, kind)")
def doc11(c: Civic) -> DataFrame:
    text = F.concat(F.lit("3.1 Report\n\nMoved by A\n- first\nThat "), "text", F.lit("\nCARRIED\n-----"))
    return ops.minutes_blocks(c.motions.select(F.col("id").alias("doc"), text.alias("text"))).select("doc", "place", "kind")


@query("doc11_agenda_lines", "SELECT id AS doc, number, CASE number WHEN '1' THEN 'Call to order' ELSE title END AS title FROM {agenda_items}, (VALUES ('1'), ('2.1')) t(number)")
def doc11b(c: Civic) -> DataFrame:
    return ops.agenda_lines(c.agenda_items.select(F.col("id").alias("doc"), F.concat(F.lit("Agenda\n1. Call to order\n2.1\n"), "title").alias("text")))


@query("doc10_named_votes", "SELECT id AS motion_id, person, vote FROM {motions}, (VALUES ('Ann Lee', 'opposed'), ('Bo Li', NULL), ('Cy Oh', 'in favour')) t(person, vote)")
def doc10(c: Civic) -> DataFrame:
    return ops.named_votes(c.motions.select(F.col("id").alias("motion_id"), F.lit("Carried\nOpposed: Ann Lee and Bo Li.\nIn favour: Cy Oh, Bo Li").alias("text")))


@query("bal01_presence_events", "SELECT id AS doc, person, present, place FROM {people}, (VALUES ('Ann Lee', FALSE, 1), ('Ann Lee', TRUE, 2)) t(person, present, place)")
def bal01(c: Civic) -> DataFrame:
    return ops.presence_events(c.people.select(F.col("id").alias("doc"), F.lit("It began. At 7:05 p.m., Ann Lee left the meeting. Ann Lee returned to the meeting. End.").alias("text")))


@query("bal03_inferred_ballots", """
    WITH v AS (SELECT motion_id, list(person_id) AS present FROM {votes} WHERE person_id % 4 = 1 GROUP BY 1), o AS (SELECT motion_id, list(person_id) AS against FROM {votes} WHERE vote = 'No' AND person_id % 4 = 1 AND motion_id % 3 < 2 OR person_id = 2 AND motion_id % 7 = 0 GROUP BY 1),
    r AS (SELECT m.id, m.result, COALESCE(v.present, []) AS p, COALESCE(o.against, []) AS a FROM {motions} m LEFT JOIN v ON v.motion_id = m.id LEFT JOIN o ON o.motion_id = m.id),
    k AS (SELECT *, len(list_intersect(a, p)) AS no, len(p) - len(list_intersect(a, p)) AS yes FROM r),
    s AS (SELECT *, CASE WHEN result IS NULL THEN 'no_outcome' WHEN len(p) = 0 THEN 'no_voters' WHEN no < len(a) THEN 'unknown_name' WHEN NOT (CASE WHEN upper(result) IN ('CARRIED', 'CARRIED AS AMENDED') THEN yes > no ELSE no >= yes END) THEN 'conflict' ELSE 'inferred' END AS status FROM k)
    SELECT id AS motion_id, status, CASE WHEN status = 'inferred' THEN yes END AS yes, CASE WHEN status = 'inferred' THEN no END AS no FROM s""")
def bal03(c: Civic) -> DataFrame:
    present = c.votes.where("person_id % 4 = 1").select("motion_id", "person_id")
    against = c.votes.where("(vote = 'No' and person_id % 4 = 1 and motion_id % 3 < 2) or (person_id = 2 and motion_id % 7 = 0)").select("motion_id", "person_id")
    out = ops.inferred_ballots(c.motions.select("id", "result"), present, against)
    return out.withColumns({k: F.col(k).cast("long") for k in ("yes", "no")})


#: Matters with permits, amendments, proceedings and houses in streets, for pairs at one address.
PAIRED = """SELECT id, title || CASE id % 11 WHEN 0 THEN ' Amendment No. ' || CAST(id % 3 AS STRING) WHEN 1 THEN ' - committee report' WHEN 2 THEN ' at 12 & ' || CAST(14 + id % 4 AS STRING) || ' Oak Road' WHEN 3 THEN ' of Oak Road' WHEN 4 THEN ' Bylaw No. ' || CAST(id % 40 AS STRING) || ' amendment no 2' WHEN 5 THEN ' variance from Bylaw 7' ELSE '' END AS title,
  CASE id % 5 WHEN 0 THEN identifier WHEN 1 THEN 'TUP16-00' || CAST(10 + id % 3 AS STRING) || '; DVP17-0001' WHEN 2 THEN 'x' WHEN 3 THEN 'Bylaw 5; REZ20-1000; Z20-1000' ELSE NULL END AS identifier, CASE WHEN id % 3 = 0 THEN address ELSE address || ' W' END AS address, address AS block, id % 100 AS v FROM {matters}"""
PAIR_KEYS_SQL = f"""list_distinct(list_transform(list_concat(given, CASE WHEN len(list_filter(given, lambda x: starts_with(x, 'Bylaw '))) = 0 AND NOT regexp_matches(title, '{PARENT}') THEN {bylaws_sql('title')} ELSE [] END), lambda x: upper(x)))"""


@query("ent06_pair_verdicts", rf"""
    WITH p AS ({PAIRED}), g AS (SELECT *, list_filter({identifiers_sql('identifier')}, lambda x: regexp_matches(x, '^(Bylaw|TUP|DVP|DP|Z|OCP|ALR|LLP|REZ|SUB) ')) AS given FROM p),
    f AS (SELECT id, title, block, v, {address_sql('address')} AS place, {PAIR_KEYS_SQL} AS keys, list_distinct(list_transform(regexp_extract_all(title, {lit(STREET)}, 1), lambda x: lower(trim(x)))) AS streets,
      list_distinct(list_concat(CASE WHEN id % 11 = 2 THEN ['12', CAST(14 + id % 4 AS VARCHAR)] ELSE [] END, regexp_extract_all(address, '^(\d{{{{2,5}}}}) [A-Z][a-z]', 1))) AS houses, regexp_extract_all(title, '(?i)amendment\s+no\.?\s*(\d+)', 1) AS amends FROM g),
    x AS (SELECT a.id AS a, b.id AS b, a.keys AS ka, b.keys AS kb, list_filter(a.keys, lambda k: starts_with(k, 'BYLAW ')) AS la, list_filter(b.keys, lambda k: starts_with(k, 'BYLAW ')) AS lb, list_filter(a.keys, lambda k: NOT starts_with(k, 'BYLAW ')) AS pa, list_filter(b.keys, lambda k: NOT starts_with(k, 'BYLAW ')) AS pb,
      a.place = b.place AS placed, list_has_any(a.streets, b.streets) AS street, a.houses AS ha, b.houses AS hb, a.amends AS ma, b.amends AS mb, a.title AS ta, b.title AS tb, 1 - (a.v + b.v) % 40 / 100.0 AS vectors, (a.v * b.v) % 10 / 10.0 AS titles FROM f a JOIN f b ON a.block = b.block AND a.id < b.id)
    SELECT a, b, CASE WHEN (len(ka) = 1 AND ka = kb) OR (list_has_any(pa, pb) AND len(ka) <= 2 AND len(kb) <= 2) THEN 'same_matter'
      WHEN regexp_matches(ta, '{ops.PROCEEDINGS}') OR regexp_matches(tb, '{ops.PROCEEDINGS}') OR (len(ma) > 0 AND len(mb) > 0 AND NOT list_has_any(ma, mb)) OR (len(la) > 0 AND len(lb) > 0 AND NOT list_has_any(la, lb) AND NOT placed)
        OR (len(pa) > 0 AND len(pb) > 0 AND NOT list_has_any(pa, pb)) OR (len(ha) > 0 AND len(hb) > 0 AND NOT list_has_any(ha, hb) AND NOT list_has_any(ka, kb)) THEN 'different'
      WHEN list_has_any(ka, kb) OR placed OR (street AND titles >= 0.72) OR vectors >= 0.9 OR (vectors >= 0.86 AND street) THEN 'judge' ELSE 'unrelated' END AS verdict FROM x""")
def ent06(c: Civic) -> DataFrame:
    rows = c.spark.sql(PAIRED, matters=c.matters).withColumn("addresses", F.array("address"))
    near = F.lit(1) - ((F.col("v_a") + F.col("v_b")) % 40) / 100.0
    return ops.block_verdicts(rows, ["v"], near, (F.col("v_a") * F.col("v_b")) % 10 / 10.0)


#: Resolutions in every form that a final action has or hasn't. The matter of a motion is 40 ids away.
RESOLVED = """SELECT id, (id * 7) % 90 AS matter_id, CASE WHEN id % 6 = 0 THEN ' passed' WHEN id % 6 = 1 THEN 'Adopted' ELSE upper(result) END AS result, CASE WHEN id % 13 = 0 THEN 'Amendment' ELSE disposition END AS disposition, meeting_id,
  CASE id % 15 WHEN 0 THEN 'THAT Council adopt Bylaw No. ' WHEN 1 THEN 'That  Council Repeal Bylaw ' WHEN 2 THEN 'THAT Council adopt the report on Bylaw No. ' WHEN 3 THEN 'THAT Council adopt, once funded, Bylaw No. ' WHEN 4 THEN 'THAT the clerk adopt Bylaw No. ' WHEN 5 THEN 'THAT Council adopt Bylaws Nos. 5, 6 and '
    WHEN 6 THEN 'THAT Council repeal Bylaw No. 1; AND THAT Council adopt Bylaw No. ' WHEN 7 THEN 'THAT staff be thanked and that Council adopt Bylaw ' WHEN 8 THEN 'THAT Council adopt the minutes and authorize Bylaw ' WHEN 9 THEN 'THAT Council adopt Bylaw 3 and direct staff to file Bylaw '
    WHEN 10 THEN 'THAT Council adopt Bylaw 4 and refer Bylaw ' WHEN 11 THEN 'THAT Council not adopt Bylaw ' WHEN 12 THEN 'Council adopts Bylaw ' WHEN 13 THEN 'THAT Council adopt Bylaw 5; Council adopt Bylaw ' ELSE 'I recommend that Council adopt Bylaw ' END || CAST((id * 7) % 90 % CASE WHEN id % 4 = 0 THEN 3000 ELSE 300 END AS STRING) || CASE WHEN id % 10 = 9 THEN ' and further that all be well' ELSE '' END AS text FROM {motions}"""
STATED = "SELECT id, CASE WHEN id % 4 = 1 THEN identifier || '; Bylaw 5' WHEN id % 4 = 2 THEN NULL ELSE identifier END AS identifier, CASE WHEN id % 8 < 4 THEN title || ' Bylaw No. ' || CAST(id AS STRING) ELSE title END AS title FROM {matters} WHERE id < 90"


@query("ent11_lifecycle", rf"""
    WITH r AS ({RESOLVED}), s AS ({STATED}), k0 AS (SELECT id, title, list_distinct(list_filter({identifiers_sql('identifier')}, lambda x: starts_with(x, 'Bylaw '))) AS own FROM s), k AS (SELECT id, CASE WHEN len(own) > 0 THEN own ELSE {bylaws_sql('title')} END AS own FROM k0),
    f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM r WHERE upper(trim(result)) IN ('CARRIED', 'PASSED', 'ADOPTED') AND NOT COALESCE(lower(disposition) IN ('procedural', 'amended', 'amendment'), false)),
    c AS (SELECT id, unnest(string_split_regex(x, '{ops.CLAUSE}')) AS clause FROM f WHERE NOT regexp_matches(x, '{ops.NOT_FINAL}')),
    o AS (SELECT id, lower(regexp_extract(clause, '{ops.ACTION}', 1)) AS verb, string_split_regex(regexp_extract(clause, '{ops.ACTION}', 2), '{ops.OBJECT_END}')[1] AS object_ FROM c WHERE regexp_matches(clause, '{ops.ACTION}')),
    a AS (SELECT id, verb, {bylaws_sql('object_')} AS laws FROM o WHERE regexp_matches(object_, '(?i)\bBylaws?\b') AND NOT regexp_matches(string_split_regex(object_, '(?i)\bBylaws?\b')[1], '{ops.INDIRECT}') AND NOT regexp_matches(object_, '{ops.SECOND_VERB}')),
    g AS (SELECT id, MIN(verb) AS verb, flatten(list(laws)) AS laws FROM a GROUP BY id HAVING COUNT(DISTINCT verb) = 1),
    e AS (SELECT f.matter_id, g.verb, f.id, f.meeting_id FROM g JOIN f ON f.id = g.id JOIN k ON k.id = f.matter_id WHERE len(k.own) > 0 AND list_has_all(g.laws, k.own))
    SELECT matter_id, CASE arg_max(verb, meeting_id * 1000000 + id) WHEN 'repeal' THEN 'Repealed' ELSE 'Adopted' END AS state, arg_max(id, meeting_id * 1000000 + id) AS motion_id FROM e GROUP BY matter_id""")
def ent11(c: Civic) -> DataFrame:
    motions = c.spark.sql(RESOLVED, motions=c.motions).withColumn("meeting_date", F.lpad(F.col("meeting_id").cast("string"), 12, "0"))
    return ops.lifecycle(c.spark.sql(STATED, matters=c.matters), motions)


@query("ent10_open_adoptions", "SELECT i.id FROM {agenda_items} i WHERE i.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM {motions} m WHERE m.agenda_item_id = i.id AND m.result IS NOT NULL)")
def ent10(c: Civic) -> DataFrame:
    items = c.agenda_items.withColumn("title", F.concat("title", F.when(F.col("id") % 2 == 0, " Adoption").otherwise("")))
    return ops.open_adoptions(items, c.motions).select("id")


@query("rem04_attachments", None)
def rem04(c: Civic) -> DataFrame:
    files = c.agenda_items.select(F.col("id").alias("file_id"), "meeting_id", F.when(F.col("id") % 2 == 0, F.upper("title")).otherwise(F.concat("title", F.lit("s"))).alias("title"))
    return ops.attachments(files, c.agenda_items)


@query("rem06_participation_chunks", None)
def rem06(c: Civic) -> DataFrame:
    text = F.when(F.col("id") % 5 == 0, F.concat(F.lit("My name is "), "text")).otherwise(F.col("text"))
    return ops.participation_chunks(c.segments.withColumn("text", text), size=120)


@query("stm06_calendar_apply", """
    WITH e AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'cal-' || CAST(o_orderkey AS STRING) ELSE 'new-' || CAST(o_orderkey AS STRING) END AS event_id, o_custkey % 5 AS organization_id, CAST(o_orderdate AS DATE) AS event_date FROM {orders} WHERE o_orderkey % 3 = 0),
    f AS (SELECT organization_id, meeting_date, MIN(id) AS free, COUNT(*) AS n FROM {meetings} WHERE calendar_source_id IS NULL AND id % 13 = 2 GROUP BY 1, 2)
    SELECT e.event_id, COALESCE(b.id, CASE WHEN f.n = 1 THEN f.free END) AS meeting_id, CASE WHEN b.id IS NOT NULL THEN 'updated' WHEN f.n = 1 THEN 'bound' WHEN f.n > 1 THEN 'held' ELSE 'created' END AS action
    FROM e LEFT JOIN {meetings} b ON b.calendar_source_id = e.event_id LEFT JOIN f ON f.organization_id = e.organization_id AND f.meeting_date = e.event_date""")
def stm06(c: Civic) -> DataFrame:
    k = F.col("o_orderkey")
    events = c.orders.where("o_orderkey % 3 = 0").select(F.concat(F.when(k % 11 == 0, "cal-").otherwise("new-"), k.cast("string")).alias("event_id"), (F.col("o_custkey") % 5).alias("organization_id"), F.to_date("o_orderdate").alias("event_date"))
    return ops.calendar_apply(c.meetings.where("calendar_source_id is not null or id % 13 = 2"), events)


@query("hyb10_quick_search", "SELECT id, score, score = 100 AND COUNT(*) FILTER (score = 100) OVER () = 1 AS exact FROM (SELECT id, CASE WHEN lower(name) = 'supplier#000000007' THEN 100 WHEN starts_with(lower(name), 'supplier#000000007') THEN 80 WHEN contains(' ' || lower(name), ' supplier#000000007') THEN 60 WHEN contains(lower(name), 'supplier#000000007') THEN 40 END AS score FROM {people}) WHERE score IS NOT NULL")
def hyb10(c: Civic) -> DataFrame:
    return ops.quick_search(c.people, "Supplier#000000007 ")


@query("rem03_unchanged", "SELECT id FROM {matters} WHERE id % 3 = 0 OR id % 4 = 1")
def rem03(c: Civic) -> DataFrame:
    known = c.matters.select(F.col("id").alias("k"), F.sha2("title", 256).alias("text_hash"), F.when(F.col("id") % 3 == 0, "m").alias("manifest"))
    seen = c.matters.select("id", F.when(F.col("id") % 4 == 1, F.col("title")).otherwise("other").alias("text"), F.lit("m").alias("manifest_now"))
    return seen.join(known, F.col("id") == F.col("k")).where(F.col("manifest").eqNullSafe(F.col("manifest_now")) | (F.sha2("text", 256) == F.col("text_hash"))).select("id")


@query("rem25_meeting_votes", "SELECT m.meeting_id, COUNT(*) FILTER (v.vote IN ('No', 'Opposed')) AS opposed FROM {motions} m JOIN {votes} v ON v.motion_id = m.id GROUP BY 1")
def rem25(c: Civic) -> DataFrame:
    rows = c.motions.select(F.col("id").alias("m"), "meeting_id").join(c.votes, F.col("motion_id") == F.col("m"))
    return rows.groupBy("meeting_id").agg(F.count_if(F.col("vote").isin("No", "Opposed")).alias("opposed"))
