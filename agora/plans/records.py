"""Records work: names, linkage, participants, schedules, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import names as nm
from agora.functions.text import AMOUNT, TURNING
from agora.operators import records as ops
from agora.operators.documents import SMALL_WORDS, motion_sources
from agora.plans.registry import query
from agora.sources.civic import Civic


LISTED = "CASE id % 6 WHEN 0 THEN 'Staff ' || title WHEN 1 THEN 'Stafford ' || title WHEN 2 THEN 'Clerk' WHEN 3 THEN 'The Mayor ' || CAST(id AS STRING) WHEN 4 THEN 'Al' ELSE title END"


@query("flt11_valid_names", f"WITH n AS (SELECT id, {LISTED} AS speaker_name FROM {{agenda_items}}) SELECT id, speaker_name FROM n WHERE length(trim(speaker_name)) >= 3 AND NOT regexp_matches(speaker_name, '\\d') AND NOT list_contains({nm.NOT_NAMES}, lower(trim(speaker_name))) AND len(list_filter({nm.NOT_NAMES}, lambda x: starts_with(lower(trim(speaker_name)), x || ' '))) = 0")
def flt11(c: Civic) -> DataFrame:
    return c.agenda_items.withColumn("speaker_name", F.expr(LISTED)).where(nm.valid_name("speaker_name")).select("id", "speaker_name")


@query("flt12_spoken_only", "SELECT id FROM {segments} WHERE CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'transcript' ELSE 'minutes' END IS NULL OR id % 3 = 1")
def flt12(c: Civic) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 1, "transcript").when(F.col("id") % 3 == 2, "minutes")
    return c.segments.where(kind.isNull() | (kind == "transcript")).select("id")


@query("flt19_ocd_events", "SELECT id, CAST(meeting_date AS STRING) AS meeting_date FROM {meetings} WHERE meeting_date < DATE '1999-01-01' AND meeting_date > DATE '1997-01-01' ORDER BY meeting_date, id LIMIT 25 OFFSET 50")
def flt19(c: Civic) -> DataFrame:
    from agora.operators.filters import offset_page

    rows = c.meetings.where("meeting_date < DATE '1999-01-01' and meeting_date > DATE '1997-01-01'")
    return offset_page(rows, [F.col("meeting_date"), F.col("id")], 3, 25).select("id", F.col("meeting_date").cast("string").alias("meeting_date"))


@query("flt22_eligibility", "SELECT id, CASE WHEN title LIKE 'small%' THEN 'generic' WHEN identifier IS NOT NULL THEN 'identifier' WHEN id % 2 = 0 THEN 'address' WHEN length(title) >= 18 THEN 'substantive title' ELSE 'weak' END AS reason FROM {matters}")
def flt22(c: Civic) -> DataFrame:
    reason = F.when(F.col("title").startswith("small"), "generic").when(F.col("identifier").isNotNull(), "identifier").when(F.col("id") % 2 == 0, "address").when(F.length("title") >= 18, "substantive title").otherwise("weak")
    return c.matters.select("id", reason.alias("reason"))


@query("joi02_left_preaggregated", "SELECT p.id, COALESCE(v.n, 0) AS votes, COALESCE(m.n, 0) AS moved FROM {people} p LEFT JOIN (SELECT person_id, COUNT(*) AS n FROM {votes} GROUP BY 1) v ON v.person_id = p.id LEFT JOIN (SELECT mover_id, COUNT(*) AS n FROM {motions} GROUP BY 1) m ON m.mover_id = p.id")
def joi02(c: Civic) -> DataFrame:
    v = c.votes.groupBy(F.col("person_id").alias("v")).agg(F.count(F.lit(1)).alias("nv"))
    m = c.motions.groupBy(F.col("mover_id").alias("m")).agg(F.count(F.lit(1)).alias("nm"))
    return c.people.join(v, F.col("id") == F.col("v"), "left").join(m, F.col("id") == F.col("m"), "left").select("id", F.coalesce("nv", F.lit(0)).alias("votes"), F.coalesce("nm", F.lit(0)).alias("moved"))


@query("joi03_full_outer", "SELECT COALESCE(a.id, b.id) AS id, a.n AS moved, b.n AS seconded FROM (SELECT mover_id AS id, COUNT(*) AS n FROM {motions} WHERE meeting_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT seconder_id AS id, COUNT(*) AS n FROM {motions} WHERE meeting_id % 2 = 1 GROUP BY 1) b ON a.id = b.id")
def joi03(c: Civic) -> DataFrame:
    a = c.motions.where("meeting_id % 2 = 0").groupBy(F.col("mover_id").alias("a")).agg(F.count(F.lit(1)).alias("moved"))
    b = c.motions.where("meeting_id % 2 = 1").groupBy(F.col("seconder_id").alias("b")).agg(F.count(F.lit(1)).alias("seconded"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("id"), "moved", "seconded")


@query("joi08_serving_votes", "SELECT m.id AS motion_id, m.mover_id FROM {motions} m JOIN {meetings} g ON g.id = m.meeting_id WHERE EXISTS (SELECT 1 FROM {memberships} s WHERE s.person_id = m.mover_id AND (s.start_date IS NULL OR s.start_date <= g.meeting_date) AND (s.end_date IS NULL OR g.meeting_date <= s.end_date))")
def joi08(c: Civic) -> DataFrame:
    from agora.operators.filters import in_service

    rows = c.motions.join(c.meetings.select(F.col("id").alias("g"), "meeting_date"), F.col("meeting_id") == F.col("g")).withColumn("person_id", F.col("mover_id"))
    return in_service(rows, c.memberships, "meeting_date", ["person_id"]).select(F.col("id").alias("motion_id"), "mover_id")


@query("agg14_public_participants", """
    WITH d AS (SELECT s.*, m.meeting_date, i.category, s.end_time - s.start_time AS sec FROM {segments} s JOIN {meetings} m ON m.id = s.meeting_id LEFT JOIN {agenda_items} i ON i.id = s.agenda_item_id
      WHERE s.person_id IS NOT NULL AND s.end_time > s.start_time AND m.meeting_date <= DATE '2001-06-30' AND NOT EXISTS (SELECT 1 FROM {memberships} o WHERE o.person_id = s.person_id AND o.organization_id = 1 AND (o.start_date IS NULL OR o.start_date <= m.meeting_date) AND (o.end_date IS NULL OR m.meeting_date <= o.end_date))),
    t AS (SELECT person_id, CAST(ROUND(SUM(CAST(sec AS DECIMAL(18,3))), 1) AS DOUBLE) AS seconds, COUNT(*) AS segments, COUNT(DISTINCT meeting_id) AS meetings, CAST(MIN(meeting_date) AS STRING) AS first_date, CAST(MAX(meeting_date) AS STRING) AS last_date FROM d GROUP BY 1),
    k AS (SELECT person_id, string_agg(kind, ',' ORDER BY k) AS categories FROM (SELECT person_id, COALESCE(category, 'Public') AS kind, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY COUNT(*) DESC, COALESCE(category, 'Public')) AS k FROM d GROUP BY 1, 2) WHERE k <= 5 GROUP BY 1),
    r AS (SELECT person_id, string_agg(CAST(meeting_id AS STRING), ',' ORDER BY k) AS recent FROM (SELECT person_id, meeting_id, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY meeting_date DESC, meeting_id DESC) AS k FROM d GROUP BY person_id, meeting_id, meeting_date) WHERE k <= 6 GROUP BY 1)
    SELECT t.*, k.categories, r.recent FROM t JOIN k ON k.person_id = t.person_id JOIN r ON r.person_id = t.person_id""")
def agg14(c: Civic) -> DataFrame:
    s = c.segments.join(c.agenda_items.select(F.col("id").alias("i"), "category"), F.col("agenda_item_id") == F.col("i"), "left")
    out = ops.participants(s, c.meetings, c.memberships.where("organization_id = 1"), "2001-06-30")
    return out.withColumns({k: F.col(k).cast("string") for k in ("first_date", "last_date")})


@query("agg17_attendance_groups", """
    WITH r AS (SELECT meeting_id, person_id, lower(trim(speaker_name)) AS name FROM {segments} UNION ALL SELECT motion_id, person_id, NULL FROM {votes})
    SELECT meeting_id, CASE WHEN person_id IN (SELECT person_id FROM {memberships} WHERE organization_id = 1) THEN 'council' WHEN person_id IN (SELECT person_id FROM {memberships} WHERE organization_id = 2) THEN 'staff' ELSE 'other' END AS kind, COUNT(DISTINCT COALESCE('p' || CAST(person_id AS STRING), name)) AS people FROM r GROUP BY 1, 2""")
def agg17(c: Civic) -> DataFrame:
    recorded = c.votes.select(F.col("motion_id").alias("meeting_id"), "person_id")
    return ops.attendance_groups(c.segments, recorded, c.memberships.where("organization_id = 1"), c.memberships.where("organization_id = 2"))


@query("agg28_first_summary", "SELECT host_id, arg_max(summary, (meeting_date, id)) AS summary FROM {meetings} WHERE summary IS NOT NULL GROUP BY host_id")
def agg28(c: Civic) -> DataFrame:
    return c.meetings.where("summary is not null").groupBy("host_id").agg(F.max_by("summary", F.struct("meeting_date", "id")).alias("summary"))


@query("set02_total_level", "SELECT status, COUNT(*) AS n FROM {meetings} GROUP BY status UNION ALL SELECT 'all', COUNT(*) FROM {meetings}")
def set02(c: Civic) -> DataFrame:
    one = c.meetings.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return one.unionAll(c.meetings.agg(F.lit("all").alias("status"), F.count(F.lit(1)).alias("n")))


@query("set03_one_schema", "SELECT 'motion' AS type, id, text AS content, meeting_id, NULL AS year FROM {motions} UNION ALL SELECT 'matter', id, title, NULL, year FROM {matters}")
def set03(c: Civic) -> DataFrame:
    return ops.unioned([c.motions.select(F.lit("motion").alias("type"), "id", F.col("text").alias("content"), "meeting_id"), c.matters.select(F.lit("matter").alias("type"), "id", F.col("title").alias("content"), "year")])


@query("set05_shared_keys", "SELECT a.motion_id FROM (SELECT DISTINCT motion_id FROM {votes} WHERE person_id = 4) a JOIN (SELECT DISTINCT motion_id FROM {votes} WHERE person_id = 8) b ON a.motion_id = b.motion_id")
def set05(c: Civic) -> DataFrame:
    return c.votes.where("person_id = 4").select("motion_id").intersect(c.votes.where("person_id = 8").select("motion_id"))


@query("set06_number_mismatch", "SELECT id, regexp_extract(text, '(\\d+)', 1) <> CAST(id % 30 AS STRING) AS mismatch FROM {motions}")
def set06(c: Civic) -> DataFrame:
    other = F.concat(F.lit("Motion "), (F.col("id") % 30).cast("string"))
    return c.motions.select("id", ops.number_mismatch(F.col("text"), other).alias("mismatch"))


@query("str04_matter_slug", "SELECT id, CASE WHEN id % 4 = 0 THEN 'matter-' || CAST(id AS STRING) WHEN id % 4 = 1 THEN 'matter-' || CAST(id + 100 AS STRING) ELSE regexp_replace(lower(title), ' ', '-', 'g') END AS slug FROM {matters}")
def str04(c: Civic) -> DataFrame:
    title = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, (F.col("id") + 100).cast("string")).otherwise(F.col("title"))
    return c.matters.select("id", nm.matter_slug(F.lit(None).cast("string"), title, "id").alias("slug"))


@query("str18_clean_names", "SELECT id, name AS name FROM {people}")
def str18(c: Civic) -> DataFrame:
    return c.people.select("id", nm.clean_name(F.concat(F.lit("Acting Mayor  "), "name", F.lit(" (by phone)"))).alias("name"))


SPELT = "CASE id % 10 WHEN 0 THEN upper(title) WHEN 1 THEN substring(title, 2) WHEN 2 THEN title || 'x' WHEN 3 THEN substring(title, 1, length(title) - 2) WHEN 4 THEN substring(title, 1, 1) || '.' || substring(title, position(' ' IN title)) WHEN 5 THEN replace(title, 'e', 'é') WHEN 6 THEN title || ' x' WHEN 7 THEN replace(title, 'a', 'o') WHEN 8 THEN substring(title, 1, position(' ' IN title)) ELSE replace(title, 'e', '') END"


@query("str20_name_score", f"""
    WITH n AS (SELECT id, title AS a, {SPELT} AS b FROM {{agenda_items}}),
    w AS (SELECT id, regexp_extract_all(strip_accents(lower(a)), '[a-z]+(?:[''’-][a-z]+)*') AS x, regexp_extract_all(strip_accents(lower(b)), '[a-z]+(?:[''’-][a-z]+)*') AS y FROM n)
    SELECT id, CAST(CASE WHEN len(x) < 2 OR len(x) <> len(y) THEN 0 WHEN x = y THEN 1
      WHEN x[2:] = y[2:] AND x[1][1] = y[1][1] AND LEAST(length(x[1]), length(y[1])) = 1 THEN 0.92
      WHEN x[:len(x) - 1] = y[:len(y) - 1] AND LEAST(length(x[-1]), length(y[-1])) >= 5 AND levenshtein(x[-1], y[-1]) <= 1 THEN 0.96
      WHEN x[2:] = y[2:] AND LEAST(length(x[1]), length(y[1])) >= 4 AND levenshtein(x[1], y[1]) <= 1 THEN 0.94 ELSE 0 END AS DOUBLE) AS score FROM w""")
def str20b(c: Civic) -> DataFrame:
    return c.agenda_items.select("id", nm.name_score("title", F.expr(SPELT)).alias("score"))


@query("str22_glossary", "SELECT id, replace(text, 'click', 'tap') AS text FROM {segments}")
def str22(c: Civic) -> DataFrame:
    return c.segments.select("id", nm.glossary("text", {"click": "press", "press": "tap"}).alias("text"))


#: Speech with numbers: tens and units, runs of digits, decimals, hyphens, number words inside other words. {n}: the words.
SPOKEN = """concat('Item ', array_element, CASE id % 6 WHEN 0 THEN ' point one point ' WHEN 1 THEN '-' WHEN 2 THEN ' . ' WHEN 3 THEN ', or ' WHEN 4 THEN ' someone said ' ELSE '  ' END, second_element, CASE id % 5 WHEN 0 THEN ' zero' WHEN 1 THEN '-way, twofold; bone' WHEN 2 THEN ' point oh point nine, it''s' WHEN 3 THEN ' Five Two!' ELSE ' 3. 4' END, ' ', third_element, ' of ', title)"""
SAID = list(nm.NUMBERS)


def said_sql(k: str, index: str) -> str:
    return "CASE " + k + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(SAID)) + " END"


SPOKEN_SQL = SPOKEN.replace("array_element", said_sql(f"id % {len(SAID)}", "")).replace("second_element", said_sql(f"(id * 7) % {len(SAID)}", "")).replace("third_element", said_sql(f"CAST(FLOOR(id / 25) AS BIGINT) % {len(SAID)}", ""))
VALUE_SQL = "CASE w " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in nm.NUMBERS.items()) + " END"


@query("str23_spoken_numbers", rf"""
    WITH t AS (SELECT id, lower({SPOKEN_SQL}) AS x FROM {{matters}}), p AS (SELECT id, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (SELECT id, regexp_extract_all(x, '{nm.PIECE}') AS ps FROM t)),
    v AS (SELECT id, k, piece, list_transform(string_split_regex(piece, '[\s-]+'), lambda w: {VALUE_SQL}) AS vs, regexp_full_match(piece, '{nm.NUMBER_WORD}(?:[\s-]+{nm.NUMBER_WORD})*') AS run FROM p),
    f AS (SELECT id, k, CASE WHEN NOT run THEN piece WHEN len(vs) > 1 AND len(list_filter(vs, lambda n: n >= 10)) = 0 THEN array_to_string(vs, '')
      ELSE list_reduce(list_transform(vs, lambda n: CAST(n AS VARCHAR)), lambda a, n: CASE WHEN CAST(n AS INT) < 10 AND CAST(regexp_extract(a, '(\d+)$', 1) AS INT) >= 20 AND CAST(regexp_extract(a, '(\d+)$', 1) AS INT) % 10 = 0 THEN regexp_replace(a, '\d+$', CAST(CAST(regexp_extract(a, '(\d+)$', 1) AS INT) + CAST(n AS INT) AS VARCHAR)) ELSE a || ' ' || n END) END AS y FROM v),
    j AS (SELECT id, string_agg(y, '' ORDER BY k) AS x FROM f GROUP BY id),
    d AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(x, '\b(\d+)\s+point\s+(\d+)\b', '\1.\2', 'g'), '\b(\d+)\s+point\s+(\d+)\b', '\1.\2', 'g'), '\b(\d+(?:\.\d+)+)\s+point\s+(\d+)\b', '\1.\2', 'g') AS x FROM j)
    SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(x, '(\d)\s*\.\s+(\d)', '\1.\2', 'g'), '[^a-z0-9.''\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM d""")
def str23(c: Civic) -> DataFrame:
    return c.matters.select("id", nm.spoken_numbers(F.expr(SPOKEN_SQL)).alias("text"))


#: Two texts that share runs of words of a matter and the next one, some in other capitals.
SHARED = """SELECT id, concat(title, ' of ', address, ' and ', COALESCE(following, '')) AS a, CASE id % 5 WHEN 0 THEN concat('about ', title, ' of ', address) WHEN 1 THEN concat(COALESCE(following, ''), ' and ', title) WHEN 2 THEN upper(title) WHEN 3 THEN concat('x ', address, ' and ', COALESCE(following, ''), 's of ', title) ELSE NULL END AS b
  FROM (SELECT id, title, address, lead(title) OVER (PARTITION BY municipality_id ORDER BY id) AS following FROM {matters})"""


@query("str26_common_sequence", f"""
    WITH s AS (SELECT id, string_split(a, ' ') AS ws, ' ' || COALESCE(b, '') || ' ' AS b FROM ({SHARED})), i AS (SELECT id, ws, b, unnest(range(1, len(ws) + 1)) AS i FROM s), j AS (SELECT id, b, ws, i, unnest(range(i + 2, len(ws) + 1)) AS j FROM i)
    SELECT s.id, COALESCE(MAX(length(array_to_string(j.ws[i:j], ' '))) FILTER (contains(j.b, ' ' || array_to_string(j.ws[i:j], ' ') || ' ')), 0)::INT AS chars FROM s LEFT JOIN j ON j.id = s.id GROUP BY s.id""")
def str26(c: Civic) -> DataFrame:
    return c.spark.sql(SHARED, matters=c.matters).select("id", nm.common_sequence("a", "b").alias("chars"))


@query("str27_key_vote_sentence", "SELECT id, name || ' voted No on ' || 'the budget against the majority (5-2)' AS sentence FROM {people}")
def str27(c: Civic) -> DataFrame:
    return c.people.select("id", nm.key_vote_sentence("name", F.lit("No"), F.lit("the budget"), F.lit("5-2"), F.lit("minority,close_vote")).alias("sentence"))


@query("jsn02_attendance_evidence", "SELECT id, CASE WHEN id % 5 = 0 THEN 'present' WHEN id % 5 = 3 AND meeting_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN 'absent' ELSE 'unknown' END AS state, id % 5 = 0 AS verified FROM {meetings}")
def jsn02(c: Civic) -> DataFrame:
    k = F.col("id")
    base = lambda day, sha: F.to_json(F.struct(F.lit("v1").alias("schema"), F.lit("original_roster").alias("method"), F.lit("present").alias("state"), F.lit(1).alias("person_id"), k.alias("meeting_id"), F.lit("https://x.org/a").alias("source_url"), F.lit(sha).alias("source_sha256"), F.lit(1).alias("source_page"), F.lit("q").alias("source_quote"), day.cast("string").alias("local_date")))
    notes = F.when(k % 5 == 0, base(F.col("meeting_date"), "a" * 64)).when(k % 5 == 1, base(F.date_add("meeting_date", 1), "a" * 64)).when(k % 5 == 2, base(F.col("meeting_date"), "short")).when(k % 5 == 3, " ").otherwise("not json")
    found = nm.attendance_evidence(notes, F.lit(1), "id", "meeting_date", "v1", ["original_roster", "original_minutes_attendance"], F.lit("Regrets"), ("1997-01-01", "1999-12-31"))
    return c.meetings.select("id", found.alias("e")).select("id", "e.state", "e.verified")


#: Names of people, some with an initial or twice, and how the minutes spell them.
FIRST_NAMES = ["Amelia", "Bertram", "Cordula", "Dietrich", "Evangeline", "Florian", "Gwendolyn", "Hubert"]
LAST_NAMES = ["Ashdowne", "Brockwell", "Cartmille", "Dunstable", "Eglinton", "Fairhurst", "Grimsditch", "Holloway", "Inskipper", "Jocelynd", "Kirkbride"]
PICK = "element_at(array({0}), CAST({1} % {2} + 1 AS INT))"
PEOPLED = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 6 THEN substring({first}, 1, 1) || '.' WHEN c_custkey % 31 = 30 THEN '' ELSE {first} END || ' ' || {last} || CASE WHEN c_custkey % 17 = 16 THEN 'son' ELSE '' END AS name FROM {customer} WHERE c_custkey % 88 <= 9"""
ROLL = """SELECT c_custkey AS row_id, CASE c_custkey % 8 WHEN 0 THEN 'Mayor ' || {first} WHEN 1 THEN substring({first}, 1, 1) WHEN 2 THEN '' WHEN 3 THEN substring({first}, 1, 1) || '.' WHEN 4 THEN substring({first}, 2) WHEN 5 THEN {first} || 'a' WHEN 6 THEN 'Xerxes' ELSE {first} END || ' ' ||
  CASE c_custkey % 5 WHEN 0 THEN {last} WHEN 1 THEN upper({last}) || ' (chair)' WHEN 2 THEN substring({last}, 1, 4) || 'x' || substring({last}, 6) WHEN 3 THEN {last} || 's' ELSE 'Van' || {last} END AS name FROM {customer}"""


def picked(sql: str, spark: bool) -> str:
    def one(names: list[str], k: str) -> str:
        if spark:
            return PICK.format(", ".join(f"'{n}'" for n in names), k, len(names))
        return f"[{', '.join(repr(n) for n in names)}][CAST({k} % {len(names)} + 1 AS INT)]"

    return sql.replace("{first}", one(FIRST_NAMES, "c_custkey")).replace("{last}", one(LAST_NAMES, "CAST(FLOOR(c_custkey / 8) AS BIGINT)"))


@query("ent08_match_people", rf"""
    WITH p0 AS ({picked(PEOPLED, False)}), n0 AS ({picked(ROLL, False)}), p AS (SELECT id, lower(trim(name)) AS name FROM p0), n AS (SELECT row_id, lower(trim(regexp_replace(regexp_replace(name, '^Mayor ', ''), ' \(chair\)', ''))) AS name FROM n0),
    q AS (SELECT id, name, regexp_extract(name, '([^ ]+)$', 1) AS last, CASE WHEN contains(name, ' ') THEN regexp_extract(name, '^([^ ]+)', 1) ELSE '' END AS first FROM p), m AS (SELECT row_id, name, regexp_extract(name, '([^ ]+)$', 1) AS last, CASE WHEN contains(name, ' ') THEN regexp_extract(name, '^([^ ]+)', 1) ELSE '' END AS first FROM n),
    one AS (SELECT last, MIN(id) AS id FROM q GROUP BY last HAVING COUNT(*) = 1), same AS (SELECT m.row_id, MIN(q.id) AS id FROM m JOIN q ON q.name = m.name GROUP BY m.row_id),
    kinds AS (SELECT DISTINCT last, first, name FROM m), near AS (SELECT k.name, MIN(q.id) AS id FROM kinds k JOIN q ON (levenshtein(k.last, q.last) <= 1 OR contains(k.last, q.last) OR contains(q.last, k.last))
      AND (k.first = '' OR q.first = '' OR k.first = q.first OR CASE WHEN length(replace(k.first, '.', '')) = 1 OR length(replace(q.first, '.', '')) = 1 THEN k.first[1] = q.first[1] ELSE levenshtein(k.first, q.first) <= 1 END) GROUP BY k.name)
    SELECT m.row_id, COALESCE(s.id, o.id, near.id) AS person_id, CASE WHEN s.id IS NOT NULL THEN 'exact' WHEN o.id IS NOT NULL THEN 'surname' ELSE 'alike' END AS how FROM m LEFT JOIN same s ON s.row_id = m.row_id LEFT JOIN one o ON o.last = m.last LEFT JOIN near ON near.name = m.name WHERE COALESCE(s.id, o.id, near.id) IS NOT NULL""")
def ent08(c: Civic) -> DataFrame:
    people, names = (c.spark.sql(picked(x, True), customer=c.customer) for x in (PEOPLED, ROLL))
    return ops.match_people(names, people)


@query("ent12_bylaw_links", """
    WITH b AS (SELECT DISTINCT p_size AS number, 1990 + p_size % 10 AS year FROM {part} WHERE p_size % 3 > 0), m AS (SELECT COALESCE(canonical_id, id) AS matter_id, id % 60 AS number, year FROM {matters}),
    a AS (SELECT number AS by_, number - 1 AS amends FROM b), r AS (SELECT matter_id, m.number, 1 AS rank FROM m JOIN b ON b.number = m.number UNION SELECT matter_id, a.amends, 2 FROM m JOIN a ON a.by_ = m.number JOIN b ON b.number = a.amends AND b.year <= m.year),
    k AS (SELECT * FROM r QUALIFY rank = MIN(rank) OVER (PARTITION BY matter_id))
    SELECT matter_id, MIN(number) AS number, MIN(rank) AS rank FROM k GROUP BY matter_id HAVING COUNT(*) = 1""")
def ent12(c: Civic) -> DataFrame:
    bylaws = c.part.where("p_size % 3 > 0").select(F.col("p_size").cast("long").alias("number"), (1990 + F.col("p_size") % 10).alias("year")).distinct()
    matters = c.matters.select("id", "canonical_id", (F.col("id") % 60).alias("number"), "year")
    return ops.bylaw_links(bylaws, matters, bylaws.select("number", (F.col("number") - 1).alias("amends")))


@query("ent13_margin", "SELECT meeting_id AS k, arg_max(id, (s, -id)) AS candidate, MAX(s) AS score FROM (SELECT meeting_id, id, ROUND(end_time - start_time, 2) / 100 AS s FROM {segments}) GROUP BY meeting_id HAVING COUNT(*) = 1 OR MAX(s) - list_sort(list(s), 'DESC')[2] > 0.06")
def ent13(c: Civic) -> DataFrame:
    rows = c.segments.select(F.col("meeting_id").alias("k"), F.col("id").alias("candidate"), (F.round(F.col("end_time") - F.col("start_time"), 2) / 100).alias("score"))
    return ops.resolved(rows, "k", "score")


@query("ent14_streets", "SELECT id AS row_id, 'oak street' AS street, CASE id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' ELSE 'one_edit' END AS how FROM {people}")
def ent14(c: Civic) -> DataFrame:
    street = F.element_at(F.array(F.lit("Oak Street"), F.lit("the oak"), F.lit("Oax Street")), (F.col("id") % 3).cast("int") + 1)
    known = c.spark.createDataFrame([("Oak Street",), ("Elm Street",), ("Oak Road",)], "street string")
    return ops.streets(c.people.select(F.col("id").alias("row_id"), street.alias("street")), known, {"the oak": "oak street"})


@query("ent15_probable_links", "SELECT id, kind FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'suggested' WHEN 1 THEN 'automatic' WHEN 2 THEN 'relinked' ELSE 'other' END AS kind, CASE WHEN id % 9 = 0 THEN NULL ELSE (end_time - start_time) / 40 END AS p FROM {segments}) WHERE (kind = 'suggested' AND p >= 0.7) OR (kind = 'automatic' AND p >= 0.85) OR (kind = 'relinked' AND p >= 0.75)")
def ent15(c: Civic) -> DataFrame:
    k = F.col("id")
    kind = F.when(k % 4 == 0, "suggested").when(k % 4 == 1, "automatic").when(k % 4 == 2, "relinked").otherwise("other")
    rows = c.segments.select("id", kind.alias("kind"), F.when(k % 9 != 0, (F.col("end_time") - F.col("start_time")) / 40).alias("probability"))
    return ops.kept_links(rows, {"suggested": 0.7, "automatic": 0.85, "relinked": 0.75}).select("id", "kind")


@query("aln08_supported", "SELECT id, (id % 20) / 20.0 >= 0.9 AND (id % 7) / 20.0 <= 0.1 AS supported FROM {segments}")
def aln08(c: Civic) -> DataFrame:
    rows = c.segments.select("id", ((F.col("id") % 20) / 20.0).alias("coverage"), ((F.col("id") % 7) / 20.0).alias("competing"))
    return ops.supported(rows).select("id", "supported")


@query("prf03_topic_evidence", """
    WITH s AS (SELECT person_id, category AS topic, s.id, m.meeting_date AS d FROM {segments} s JOIN {agenda_items} i ON i.id = s.agenda_item_id JOIN {meetings} m ON m.id = s.meeting_id WHERE person_id IS NOT NULL AND category IS NOT NULL),
    v AS (SELECT person_id, CAST(motion_id % 8 AS STRING) AS topic, id, DATE '2000-01-01' AS d FROM {votes})
    SELECT person_id, topic, 'statement' AS kind, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id, topic ORDER BY d DESC, id DESC) AS k FROM s) WHERE k <= 15
    UNION ALL SELECT person_id, topic, 'vote', id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id, topic ORDER BY d DESC, id DESC) AS k FROM v) WHERE k <= 10""")
def prf03(c: Civic) -> DataFrame:
    s = c.segments.where("person_id is not null").join(c.agenda_items.where("category is not null").select(F.col("id").alias("i"), F.col("category").alias("topic")), F.col("agenda_item_id") == F.col("i")).join(c.meetings.select(F.col("id").alias("m"), F.col("meeting_date").alias("day")), F.col("meeting_id") == F.col("m"))
    v = c.votes.select("person_id", (F.col("motion_id") % 8).cast("string").alias("topic"), "id", F.lit("2000-01-01").cast("date").alias("day"))
    return ops.evidence_for_topics(s, v)


@query("prf04_quote_meetings", "SELECT s.id AS quote_id, COALESCE(t.m, o.m) AS meeting_id FROM {segments} s JOIN {meetings} g ON g.id = s.meeting_id LEFT JOIN (SELECT g.meeting_date AS d, lower(trim(text)) AS t, MIN(s.meeting_id) AS m FROM {segments} s JOIN {meetings} g ON g.id = s.meeting_id GROUP BY 1, 2) t ON t.d = g.meeting_date AND t.t = CASE WHEN s.id % 2 = 0 THEN lower(trim(s.text)) ELSE 'changed' END LEFT JOIN (SELECT g.meeting_date AS d, MIN(s.meeting_id) AS m FROM {segments} s JOIN {meetings} g ON g.id = s.meeting_id GROUP BY 1 HAVING COUNT(DISTINCT s.meeting_id) = 1) o ON o.d = g.meeting_date")
def prf04(c: Civic) -> DataFrame:
    s = c.segments.join(c.meetings.select(F.col("id").alias("g"), F.col("meeting_date").alias("day")), F.col("meeting_id") == F.col("g"))
    quotes = s.select(F.col("id").alias("quote_id"), "day", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("changed").alias("text"))
    return ops.quote_meetings(quotes, s.select("meeting_id", "day", "text"))


@query("rem01_bulk_selection", """
    WITH d AS (SELECT 'directory' AS source, p_partkey AS id, p_size AS number, CASE WHEN ROW_NUMBER() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1 THEN 'selected' ELSE 'same number' END AS reason FROM {part} WHERE p_size < 10),
    m0 AS (SELECT p_partkey AS id, p_size AS number, p_name AS text_hash, p_partkey % 5 > 0 AS is_bylaw, p_retailprice AS uploaded, p_size >= 10 AND p_partkey % 5 > 0 AS usable FROM {part} WHERE p_partkey % 2 = 0),
    m1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY text_hash, usable ORDER BY id) AS h FROM m0), m2 AS (SELECT *, usable AND h = 1 AS fit FROM m1), m3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY number, fit ORDER BY uploaded DESC, id) AS k FROM m2)
    SELECT * FROM d UNION ALL SELECT 'media', id, number, CASE WHEN number < 10 THEN 'in directory' WHEN NOT is_bylaw THEN 'not a bylaw' WHEN h > 1 THEN 'same text' WHEN k > 1 THEN 'older version' ELSE 'selected' END FROM m3""")
def rem01(c: Civic) -> DataFrame:
    d = c.part.where("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("number"))
    m = c.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("number"), F.col("p_name").alias("text_hash"), (F.col("p_partkey") % 5 > 0).alias("is_bylaw"), F.lit(True).alias("adopted"), F.lit(True).alias("consolidated"), F.col("p_retailprice").alias("uploaded"))
    return ops.bulk_selection(d, m)


@query("rem08_title_status", "SELECT id, CASE WHEN contains(lower(title), 'urgent') THEN 'cancelled' WHEN contains(lower(title), 'high') THEN 'postponed' ELSE 'scheduled' END AS status FROM {meetings}")
def rem08(c: Civic) -> DataFrame:
    title = F.concat("title", F.when(F.lower("title").contains("urgent"), " CANCELLED").when(F.lower("title").contains("high"), " Postponed").otherwise(""))
    return c.meetings.select("id", ops.title_status(title).alias("status"))


@query("rem09_synthetic_id", "SELECT COALESCE(calendar_source_id, CAST(meeting_date AS STRING) || ':' || title) AS source_id, id FROM {meetings}")
def rem09(c: Civic) -> DataFrame:
    return c.meetings.select(F.coalesce("calendar_source_id", F.concat_ws(":", F.col("meeting_date").cast("string"), "title")).alias("source_id"), "id")


@query("rem26_calendar_events", """
    SELECT source_id, CAST((e).d AS STRING) AS event_date, CASE lower((e).kind) WHEN '1-urgent' THEN 'special' WHEN '5-low' THEN 'committee' ELSE 'other' END AS type, 'scheduled' AS status
    FROM (SELECT o_custkey AS source_id, arg_max({{'d': CAST(o_orderdate AS DATE), 'kind': o_orderpriority}}, o_orderkey) AS e FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY 1)""")
def rem26(c: Civic) -> DataFrame:
    events = c.orders.select(F.col("o_custkey").alias("source_id"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("kind"), F.lit("Regular").alias("title"), F.col("o_orderkey").alias("seen"))
    return ops.calendar_events(events, {"1-urgent": "special", "5-low": "committee"}, "1998-01-01", 180).withColumn("event_date", F.col("event_date").cast("string"))


@query("rem28_incoming_term", "SELECT person_id AS id, CAST(start_date AS STRING) AS start_date FROM {memberships} WHERE start_date > DATE '2000-02-01' ORDER BY start_date, person_id LIMIT 1")
def rem28(c: Civic) -> DataFrame:
    return ops.incoming_term(c.memberships.select(F.col("person_id").alias("id"), "start_date"), "2000-02-01").select("id", F.col("start_date").cast("string").alias("start_date"))


@query("rem30_nested_elections", "SELECT n_nationkey AS election, COUNT(DISTINCT s_suppkey % 4) AS offices, COUNT(*) AS candidates FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY 1")
def rem30(c: Civic) -> DataFrame:
    offices = c.supplier.groupBy("s_nationkey", (F.col("s_suppkey") % 4).alias("office")).agg(F.collect_list(F.struct("s_suppkey", "s_name")).alias("candidates"))
    nested = offices.groupBy("s_nationkey").agg(F.collect_list(F.struct("office", "candidates")).alias("offices"))
    size = F.aggregate(F.transform("offices", lambda o: F.size(o["candidates"])), F.lit(0), lambda s, x: s + x)
    return c.nation.join(nested, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_nationkey").alias("election"), F.size("offices").cast("long").alias("offices"), size.cast("long").alias("candidates"))


@query("rem31_bylaws_with_matters", "SELECT identifier, COUNT(*) AS matters, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM {matters} WHERE identifier IS NOT NULL GROUP BY identifier")
def rem31(c: Civic) -> DataFrame:
    return c.matters.where("identifier is not null").groupBy("identifier").agg(F.count(F.lit(1)).alias("matters"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("rem34_missing_slugs", "SELECT a.id, COALESCE(a.slug, 'm-' || CAST(a.id AS STRING)) AS slug FROM (SELECT id, CASE WHEN id % 3 > 0 THEN 's' || CAST(id AS STRING) END AS slug FROM {meetings}) a")
def rem34(c: Civic) -> DataFrame:
    return c.meetings.select("id", F.coalesce(F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id").cast("string"))), F.concat(F.lit("m-"), F.col("id").cast("string"))).alias("slug"))


@query("rem38_history_coverage", "SELECT g.id, CASE WHEN NOT (COALESCE(has_agenda, FALSE) OR COALESCE(has_minutes, FALSE) OR COALESCE(has_transcript, FALSE)) THEN 'source unavailable' WHEN status = 'Cancelled' THEN 'held' WHEN m.n IS NULL THEN 'missing decisions' WHEN m.o > 0 THEN 'review required' ELSE 'complete' END AS status FROM {meetings} g LEFT JOIN (SELECT meeting_id, COUNT(*) AS n, COUNT(*) FILTER (result IS NULL) AS o FROM {motions} GROUP BY 1) m ON m.meeting_id = g.id")
def rem38(c: Civic) -> DataFrame:
    return ops.coverage_status(c.meetings, c.motions)


@query("rem40_relinked", "SELECT event_id AS doc_id, event_id % 200 + 200 * (event_id % 7) AS item_id FROM {events} WHERE event_id % 4 = 0 AND (event_id % 100) / 100.0 >= 0.75 AND event_id % 200 + 200 * (event_id % 7) IN (SELECT id FROM {agenda_items})")
def rem40(c: Civic) -> DataFrame:
    e = F.col("event_id")
    docs = c.events.where("event_id % 4 = 0").select(e.alias("doc_id"), (e % 200).alias("meeting_id"), F.lit(None).cast("long").alias("item_id"))
    choices = c.events.select(e.alias("doc_id"), (e % 200 + 200 * (e % 7)).alias("item_id"), ((e % 100) / 100.0).alias("probability"))
    return ops.relinked(docs, c.agenda_items, choices)


@query("rem41_matter_context", "SELECT COALESCE(m.canonical_id, m.id) AS matter_id, COUNT(*) AS items, string_agg(CAST(i.id AS STRING), ',' ORDER BY i.id) AS ids FROM {agenda_items} i JOIN {matters} m ON m.id = i.matter_id GROUP BY 1")
def rem41(c: Civic) -> DataFrame:
    owner = c.matters.select(F.col("id").alias("m"), F.coalesce("canonical_id", "id").alias("owner"))
    return c.agenda_items.join(owner, F.col("matter_id") == F.col("m")).groupBy(F.col("owner").alias("matter_id")).agg(F.count(F.lit(1)).alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


@query("stm13_participation_cas", "SELECT meeting_id, COUNT(*) AS rows, sha256('[' || string_agg('{{\"id\":' || CAST(id AS STRING) || ',\"text\":\"' || text || '\"}}', ',' ORDER BY id) || ']') AS digest FROM {segments} GROUP BY meeting_id")
def stm13(c: Civic) -> DataFrame:
    return ops.fingerprint(c.segments, "meeting_id", ["id", "text"])


ASKED = "CASE id % 8 WHEN 0 THEN 'June ' || CAST(1 + id % 40 AS STRING) WHEN 1 THEN 'on the 3rd sept 2024' WHEN 2 THEN '2026-06-' || CAST(1 + id % 30 AS STRING) WHEN 3 THEN 'parks 12' WHEN 4 THEN 'May. 2nd, 2021 agenda' WHEN 5 THEN 'trees' WHEN 6 THEN '31 october' ELSE title END"
MONTH_LIST = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"


@query("dat04_date_asked", f"""
    WITH q AS (SELECT id, lower({ASKED}) AS t FROM {{matters}}),
    e AS (SELECT id, t, regexp_extract(t, '\\b(20\\d{{{{2}}}})-(\\d{{{{1,2}}}})-(\\d{{{{1,2}}}})\\b', ['y', 'm', 'd']) AS i, regexp_extract(t, '\\b([a-z]{{{{3,9}}}})\\.?\\s+(\\d{{{{1,2}}}})(?:st|nd|rd|th)?(?:,?\\s+(20\\d{{{{2}}}}))?\\b', ['m', 'd', 'y']) AS a, regexp_extract(t, '\\b(\\d{{{{1,2}}}})(?:st|nd|rd|th)?\\s+([a-z]{{{{3,9}}}})(?:,?\\s+(20\\d{{{{2}}}}))?\\b', ['d', 'm', 'y']) AS b FROM q),
    p AS (SELECT id, CASE WHEN i.y <> '' THEN TRY_CAST(i.m AS INT) WHEN a.m <> '' THEN list_position({MONTH_LIST}, left(a.m, 3)) WHEN b.m <> '' THEN list_position({MONTH_LIST}, left(b.m, 3)) END AS month, CASE WHEN i.y <> '' THEN TRY_CAST(i.d AS INT) WHEN a.m <> '' THEN TRY_CAST(a.d AS INT) ELSE TRY_CAST(b.d AS INT) END AS day, CASE WHEN i.y <> '' THEN TRY_CAST(i.y AS INT) WHEN a.m <> '' THEN TRY_CAST(a.y AS INT) ELSE TRY_CAST(b.y AS INT) END AS year, i.y <> '' AS iso FROM e),
    g AS (SELECT *, iso OR (COALESCE(month, 0) > 0 AND day BETWEEN 1 AND 31) AS fit FROM p)
    SELECT id, CASE WHEN fit THEN month END AS month, CASE WHEN fit THEN day END AS day, CASE WHEN fit THEN year END AS year FROM g""")
def dat04(c: Civic) -> DataFrame:
    from agora.functions.dates import date_asked

    return c.matters.select("id", date_asked(F.expr(ASKED)).alias("d")).select("id", "d.month", "d.day", "d.year")


@query("rem02_arbitrated_number", """
    WITH b AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 300 AS STRING) END AS own, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(id % 300 AS STRING) ELSE CAST(id % 200 AS STRING) END AS listed, id % 3 = 0 AS loose, CASE WHEN id % 2 = 0 THEN 'directory' ELSE 'search' END AS source, id % 7 < 4 AS amends FROM {matters})
    SELECT id, CASE WHEN listed = '' THEN own WHEN loose THEN own WHEN own IS NOT NULL AND own <> listed THEN CASE WHEN source = 'directory' AND amends THEN listed ELSE own END ELSE listed END AS number,
      CASE WHEN listed = '' THEN CASE WHEN own IS NULL THEN '' ELSE 'number from the PDF' END WHEN loose THEN CASE WHEN own IS NULL OR own = listed THEN '' ELSE 'title read ' || listed || ', PDF is Bylaw ' || own END
        WHEN own IS NOT NULL AND own <> listed THEN CASE WHEN source = 'directory' AND amends THEN 'PDF is amending Bylaw ' || own || '; listed as ' || listed ELSE 'listed as ' || listed || ', PDF is Bylaw ' || own END ELSE '' END AS note FROM b""")
def rem02(c: Civic) -> DataFrame:
    k = F.col("id")
    own, listed = F.when(k % 5 != 0, (k % 300).cast("string")), F.when(k % 4 == 0, "").when(k % 4 == 1, (k % 300).cast("string")).otherwise((k % 200).cast("string"))
    text = F.when(k % 7 < 4, F.concat(F.lit("A bylaw to\namend the Sign Bylaw No. 0"), listed, F.lit(", 2019"))).otherwise("To amend it. See Bylaw No. 1 and others")
    found = c.matters.select("id", ops.arbitrated_number(own, listed, k % 3 == 0, F.when(k % 2 == 0, "directory").otherwise("search"), text).alias("f"))
    return found.select("id", "f.number", "f.note")


@query("rem33_meeting_period", """
    WITH q AS (SELECT id, CASE id % 4 WHEN 0 THEN CAST(1990 + id % 40 AS STRING) WHEN 1 THEN '0999' WHEN 2 THEN NULL ELSE '2026' END AS y, CASE id % 5 WHEN 0 THEN CAST(id % 14 AS STRING) WHEN 1 THEN '012' ELSE NULL END AS m, CASE WHEN id % 2 = 0 THEN 'calendar' END AS v FROM {matters}),
    r AS (SELECT id, m, v, CASE WHEN regexp_full_match(y, '[1-9]\\d{{3}}') THEN CAST(y AS INT) ELSE 2026 END AS year FROM q)
    SELECT id, year, CASE WHEN regexp_full_match(m, '[1-9]|1[0-2]') THEN CAST(m AS INT) WHEN year = 2026 THEN 11 ELSE 12 END AS month, COALESCE(v = 'calendar', FALSE) AS monthly FROM r""")
def rem33(c: Civic) -> DataFrame:
    from agora.functions.dates import meeting_period

    k = F.col("id")
    year = F.when(k % 4 == 0, (1990 + k % 40).cast("string")).when(k % 4 == 1, "0999").when(k % 4 == 3, "2026")
    month = F.when(k % 5 == 0, (k % 14).cast("string")).when(k % 5 == 1, "012")
    return c.matters.select("id", meeting_period(year, month, F.when(k % 2 == 0, "calendar"), "2026-11-28").alias("p")).select("id", "p.*")


@query("src10_seeded_memberships", """
    WITH r AS (SELECT s_name AS name, 'Body ' || CAST(s_suppkey % 6 AS STRING) AS organization, CASE WHEN s_suppkey % 9 = 0 THEN 'Mayor' ELSE 'Councillor' END AS role, DATE '2022-11-07' AS s FROM {supplier} UNION ALL SELECT 'Nobody', 'Body 1', 'Mayor', DATE '2022-11-07')
    SELECT p.id AS person_id, o.id AS organization_id, r.role, CAST(r.s AS STRING) AS start_date FROM r JOIN {people} p ON p.name = r.name JOIN (SELECT DISTINCT organization_id AS id, 'Body ' || CAST(organization_id AS STRING) AS name FROM {memberships}) o ON o.name = r.organization
    WHERE NOT EXISTS (SELECT 1 FROM {memberships} m WHERE m.person_id = p.id AND m.organization_id = o.id AND r.role = 'Councillor' AND m.end_date IS NULL)""")
def src10(c: Civic) -> DataFrame:
    k = F.col("s_suppkey")
    start = F.lit("2022-11-07").cast("date")
    roster = c.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("Body "), (k % 6).cast("string")).alias("organization"), F.when(k % 9 == 0, "Mayor").otherwise("Councillor").alias("role"), start.alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    roster = roster.unionByName(c.spark.range(1).select(F.lit("Nobody").alias("name"), F.lit("Body 1").alias("organization"), F.lit("Mayor").alias("role"), start.alias("start_date"), F.lit(None).cast("date").alias("end_date")))
    bodies = c.memberships.select(F.col("organization_id").alias("id"), F.concat(F.lit("Body "), F.col("organization_id").cast("string")).alias("name")).distinct()
    held = c.memberships.where("end_date is null").select("person_id", "organization_id", F.lit("Councillor").alias("role"))
    return ops.seeded_memberships(roster, c.people, bodies, held).select("person_id", "organization_id", "role", F.col("start_date").cast("string").alias("start_date"))


#: A motion's wording, long enough that two differ by far, and what becomes of it in the minutes and in its quote.
WORDING = "text || ' ' || md5(CAST(id AS STRING)) || ' ' || md5(CAST(id + 7 AS STRING)) || ' ' || md5(CAST(id * 3 AS STRING))"
#: As it is; beside one that differs by a word; twice; not at all but in the quote; in a quote that turns it, or lacks a word.
BLOCKS = f"""SELECT id, meeting_id, upper(x) AS t, CASE id % 8 WHEN 3 THEN 'To ' || x || ' as is.' WHEN 4 THEN 'Not ' || x WHEN 5 THEN x || '; 2 trees' END AS quote, 0 AS copy FROM (SELECT id, meeting_id, {WORDING} AS x FROM {{motions}})"""
PLACED = """SELECT meeting_id AS doc, id * 10 AS place, COALESCE(quote, t) AS t FROM w WHERE id % 8 <> 6 UNION ALL SELECT meeting_id, id * 10 + 1, t || ' NOW' FROM w WHERE id % 8 = 1 UNION ALL SELECT meeting_id, id * 10 + 2, t FROM w WHERE id % 8 = 2
  UNION ALL SELECT meeting_id, id * 10 + 3, quote || ' so' FROM w WHERE id % 16 = 3"""


@query("doc09_motion_sources", rf"""
    WITH w AS ({BLOCKS}), b0 AS ({PLACED}), b AS (SELECT doc, place, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS words FROM b0),
    m AS (SELECT meeting_id AS doc, id, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS own, quote, t, trim(regexp_replace(lower(quote), '[^a-z0-9]+', ' ', 'g')) AS quoted FROM w),
    wanted AS (SELECT doc, id, own AS target, 1 AS arm FROM m UNION ALL SELECT doc, id, quoted, 2 FROM m WHERE quote IS NOT NULL
      AND regexp_extract_all(lower(quote), '{AMOUNT.replace("{", "{{").replace("}", "}}")}') = regexp_extract_all(lower(t), '{AMOUNT.replace("{", "{{").replace("}", "}}")}')
      AND list_sort(list_filter(string_split(quoted, ' '), lambda y: list_contains({TURNING}, y))) = list_sort(list_filter(string_split(own, ' '), lambda y: list_contains({TURNING}, y)))
      AND list_has_all(string_split(quoted, ' '), list_filter(string_split(own, ' '), lambda y: NOT list_contains({SMALL_WORDS}, y)))),
    one AS (SELECT w.doc, w.id, w.arm, w.target, MIN(b.place) AS place FROM wanted w JOIN b ON b.doc = w.doc AND b.words = w.target GROUP BY w.doc, w.id, w.arm, w.target HAVING COUNT(*) = 1),
    sure AS (SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = one.doc AND b.words <> one.target AND levenshtein(b.words, one.target) <= 6))
    SELECT doc, id, place, CASE arm WHEN 1 THEN 'exact_motion_text' ELSE 'verbatim_quote_exact_identity' END AS how FROM sure WHERE arm = 1 OR NOT EXISTS (SELECT 1 FROM sure s WHERE s.doc = sure.doc AND s.id = sure.id AND s.arm = 1)""")
def doc09(c: Civic) -> DataFrame:
    w = c.spark.sql(BLOCKS, motions=c.motions)
    blocks = c.spark.sql(f"WITH w AS (SELECT * FROM {{w}}) {PLACED}", w=w).select("doc", F.col("place").cast("long").alias("place"), F.col("t").alias("text"))
    return motion_sources(w.select(F.col("meeting_id").alias("doc"), "id", F.col("t").alias("text"), "quote"), blocks)
