"""Scalar functions over text, dates, numbers, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import dates as d
from agora.functions import text as t
from agora.plans.aggregates import topic_sql
from agora.plans.registry import query
from agora.sources.civic import Civic

SLUG = "left(regexp_replace(lower(regexp_replace(trim({c}), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), {n})"


def quoted(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("str01_topic", f"SELECT id, {topic_sql('category')} AS topic FROM {{agenda_items}}")
def str01(c: Civic) -> DataFrame:
    return c.agenda_items.select("id", t.topic("category").alias("topic"))


@query("str02_slug", "SELECT id, " + SLUG.replace("{c}", "title").replace("{n}", "40") + " AS slug FROM {matters}")
def str02(c: Civic) -> DataFrame:
    return c.matters.select("id", t.slug("title", 40).alias("slug"))


@query("str03_slug_capped", "WITH s AS (SELECT doc_id, " + SLUG.replace("{c}", "text").replace("{n}", "1000") + " AS w FROM {documents} UNION ALL SELECT -p_partkey, " + SLUG.replace("{c}", "(p_name || ' and the ' || p_type)").replace("{n}", "1000") + " FROM {part}), h AS (SELECT doc_id, w, CASE WHEN substr(w, 61, 1) <> '-' AND contains(left(w, 60), '-') THEN regexp_replace(left(w, 60), '-[^-]*$', '') ELSE left(w, 60) END AS c FROM s) SELECT doc_id, CASE WHEN length(w) <= 60 THEN w ELSE trim(regexp_replace(c, '(-(" + "|".join(t.DANGLING) + "))+$', ''), '-') END AS slug FROM h")
def str03(c: Civic) -> DataFrame:
    titles = c.part.select((-F.col("p_partkey")).alias("doc_id"), F.concat_ws(" and the ", "p_name", "p_type").alias("text"))
    return c.documents.select("doc_id", "text").unionByName(titles).select("doc_id", t.slug_capped("text").alias("slug"))


@query("str06_motion_result", "SELECT id, CASE " + " ".join(f"WHEN upper(trim(result)) = '{k}' THEN '{v}'" for k, v in t.RESULTS.items()) + " END AS outcome FROM {motions}")
def str06(c: Civic) -> DataFrame:
    return c.motions.select("id", t.motion_result("result").alias("outcome"))


@query("str07_outcome_family", "SELECT id, CASE WHEN regexp_matches(lower(trim(result)), '^(carried|passed|carrried)') THEN 'carried' WHEN regexp_matches(lower(trim(result)), '^(defeated|failed|not carried)') THEN 'defeated' ELSE lower(trim(result)) END AS family FROM {motions}")
def str07(c: Civic) -> DataFrame:
    return c.motions.select("id", t.outcome_family("result").alias("family"))


@query("str08_question_key", "SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(lower(text), '[''\"’‘“”]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS key FROM {conversations}")
def str08(c: Civic) -> DataFrame:
    return c.conversations.select("conv_id", "turn", F.md5(t.question_key("text")).alias("key"))


@query("str09_intent", """
    WITH t AS (SELECT conv_id, turn, text FROM {conversations} UNION ALL SELECT -p_partkey, 0, CASE p_size % 6 WHEN 0 THEN 'Explain ' || p_type WHEN 1 THEN 'tell me ' || p_brand WHEN 2 THEN p_name WHEN 3 THEN p_brand || '?' WHEN 4 THEN p_name || ' ' || p_type ELSE 'telling me' END FROM {part})
    SELECT conv_id, turn, CASE WHEN suffix(s, '?') OR list_contains(""" + str([x for x in t.ASKING if " " not in x]) + """, string_split_regex(s, '\\s+')[1]) OR s = 'tell me' OR starts_with(s, 'tell me ') OR len(string_split_regex(s, '\\s+')) > 3 THEN 'question' ELSE 'keyword' END AS intent FROM (SELECT conv_id, turn, lower(trim(text)) AS s FROM t)""")
def str09(c: Civic) -> DataFrame:
    kind = F.col("p_size") % 6
    asked = F.when(kind == 0, F.concat(F.lit("Explain "), "p_type")).when(kind == 1, F.concat(F.lit("tell me "), "p_brand")).when(kind == 2, F.col("p_name")).when(kind == 3, F.concat("p_brand", F.lit("?"))).when(kind == 4, F.concat_ws(" ", "p_name", "p_type")).otherwise("telling me")
    rows = c.conversations.select("conv_id", "turn", "text").union(c.part.select(-F.col("p_partkey"), F.lit(0), asked))
    return rows.select("conv_id", "turn", t.intent("text").alias("intent"))


STAGED = "CASE id % 7 WHEN 0 THEN title || ' - Third Reading' WHEN 1 THEN title || ' (First Reading), Second Reading' WHEN 2 THEN title || ' (SECOND AND THIRD READINGS)' WHEN 3 THEN 'Zoning - adoption' WHEN 4 THEN title || ' for adoption (background report attached)' WHEN 5 THEN title || ' – rescinding readings – all readings - Final Adoption' ELSE title END"


def without_stage(text: str) -> str:
    less = f"trim(regexp_replace({text}, '{t.STAGE}', ''), '{t.STAGE_ENDS}')"
    return f"CASE WHEN length({less}) < 6 THEN {text} ELSE {less} END"


@query("str14_strip_stage", f"WITH a AS (SELECT id, {STAGED} AS t FROM {{matters}}), b AS (SELECT id, {without_stage('t')} AS t FROM a), c AS (SELECT id, {without_stage('t')} AS t FROM b) SELECT id, {without_stage('t')} AS title FROM c")
def str14(c: Civic) -> DataFrame:
    return c.matters.withColumn("title", F.expr(STAGED)).select("id", t.strip_stage("title").alias("title"))


@query("str20_one_edit", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) <= 1 AS near FROM {nation} a, {nation} b WHERE a.n_nationkey < b.n_nationkey")
def str20(c: Civic) -> DataFrame:
    a, b = c.nation.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), c.nation.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    return a.join(b, F.col("ka") < F.col("kb")).select("a", "b", t.one_edit("a", "b").alias("near"))


CONTACT = "c_name || CASE c_custkey % 5 WHEN 0 THEN ', write to ' || replace(lower(c_name), '#', '.') || '@example.org.' WHEN 1 THEN ' called 250-555-0' || right(CAST(100 + c_custkey % 900 AS STRING), 3) WHEN 2 THEN ' of ' || CAST(c_custkey AS STRING) || ' ' || 'Oak Street' WHEN 3 THEN ' (250) 555-0101 at ' || CAST(c_custkey AS STRING) || ' Low Road' ELSE ' spoke for 15 minutes' END"


@query("str21_scrub", f"SELECT c_custkey AS id, regexp_replace(regexp_replace(regexp_replace({CONTACT}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{{{2,}}}}', '[contact omitted]', 'g'), '(\\+?1[ .-]?)?\\(?\\d{{{{3}}}}\\)?[ .-]\\d{{{{3}}}}[ .-]\\d{{{{4}}}}', '[contact omitted]', 'g'), '\\b\\d{{{{1,5}}}}\\s+([A-Z][a-z]+ (Street|Avenue|Road|Drive|Lane|Place|Way)\\b)', '\\1', 'g') AS text FROM {{customer}}")
def str21(c: Civic) -> DataFrame:
    return c.customer.select(F.col("c_custkey").alias("id"), t.scrub(F.expr(CONTACT)).alias("text"))


@query("str25_related_addresses", "SELECT id, address AS first_address, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS n FROM {matters}")
def str25(c: Civic) -> DataFrame:
    raw = F.when(F.col("id") % 3 == 0, F.to_json(F.array("address", "title"))).otherwise(F.col("address"))
    found = t.related_addresses(raw)
    return c.matters.select("id", found[0].alias("first_address"), F.size(found).alias("n"))


WORDED = "CASE id % 4 WHEN 0 THEN 'THATCouncil not approve $1,000.50 and 5% of ' || text WHEN 1 THEN text || ' be deferred; table, refer (amend) no. 12' WHEN 2 THEN 'Rescind and defeat ' || text ELSE text END"


@query("str28_polarity", f"WITH w AS (SELECT id, {WORDED} AS x FROM {{motions}}) SELECT id, concat_ws(' ', array_to_string(regexp_extract_all(x, '{t.AMOUNT}'), ' '), '|', array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(replace(x, 'THATCouncil', 'THAT Council')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda y: list_contains({t.TURNING}, y))), ' ')) AS marks FROM w")
def str28(c: Civic) -> DataFrame:
    return c.motions.withColumn("text", F.expr(WORDED)).select("id", t.polarity("text").alias("marks"))


@query("str30_uuid5", None)
def str30(c: Civic) -> DataFrame:
    return c.people.select("id", t.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("person/"), F.col("id").cast("string"))).alias("uuid"))


@query("str31_clock", "SELECT id, CAST(CAST(FLOOR(start_time / 3600) AS BIGINT) AS STRING) || ':' || lpad(CAST(CAST(FLOOR(start_time / 60) AS BIGINT) % 60 AS STRING), 2, '0') || ':' || lpad(CAST(CAST(FLOOR(start_time) AS BIGINT) % 60 AS STRING), 2, '0') AS clock FROM {segments}")
def str31(c: Civic) -> DataFrame:
    return c.segments.select("id", t.clock("start_time").alias("clock"))


@query("srt06_natural_order", "SELECT s_suppkey AS id, 'item ' || lpad(CAST(length(n) AS STRING), 6, '0') || n AS key FROM (SELECT s_suppkey, CAST(s_suppkey AS STRING) || repeat('7', s_suppkey % 30) AS n FROM {supplier})")
def srt06(c: Civic) -> DataFrame:
    number = F.concat(F.col("s_suppkey").cast("string"), F.expr("repeat('7', cast(s_suppkey % 30 as int))"))
    return c.supplier.select(F.col("s_suppkey").alias("id"), t.natural_key(F.concat(F.lit("Item 00"), number)).alias("key"))


@query("dat01_civic_today", "SELECT id, CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS STRING) AS day FROM {usage}")
def dat01(c: Civic) -> DataFrame:
    return c.usage.select("id", d.civic_day("ts").cast("string").alias("day"))


@query("dat02_term_status", "SELECT person_id, CAST(start_date AS STRING) AS start_date, CASE WHEN start_date > DATE '2000-06-30' THEN 'upcoming' WHEN end_date < DATE '2000-06-30' THEN 'past' ELSE 'current' END AS status FROM {memberships}")
def dat02(c: Civic) -> DataFrame:
    return c.memberships.select("person_id", F.col("start_date").cast("string").alias("start_date"), d.term_status("start_date", "end_date", "2000-06-30").alias("status"))


@query("dat03_date_in_text", "SELECT id, CAST(meeting_date AS STRING) AS day FROM {meetings}")
def dat03(c: Civic) -> DataFrame:
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Minutes of "), F.date_format("meeting_date", "MMMM d, yyyy"), F.lit(" final"))).otherwise(F.concat(F.lit("agenda_"), F.date_format("meeting_date", "yyyy-MM-dd"), F.lit(".pdf")))
    return c.meetings.select("id", d.date_in_text(text).cast("string").alias("day"))


@query("dat05_months_apart", "SELECT person_id, ROUND((DATE '2001-12-31' - start_date) / 30.4, 4) AS months, ROUND((DATE '2001-12-31' - start_date) / 365.25, 4) AS years FROM {memberships}")
def dat05(c: Civic) -> DataFrame:
    days = F.datediff(F.lit("2001-12-31").cast("date"), "start_date")
    return c.memberships.select("person_id", F.round(days / 30.4, 4).alias("months"), F.round(days / 365.25, 4).alias("years"))


@query("dat06_meeting_type", "SELECT id, CASE WHEN contains(lower(title), 'high') THEN 'special' WHEN contains(lower(title), 'low') THEN 'committee' ELSE 'regular' END AS kind FROM {meetings}")
def dat06(c: Civic) -> DataFrame:
    return c.meetings.select("id", d.kind_of("title", {"special": ["high"], "committee": ["low"]}, "regular").alias("kind"))


@query("dat07_stale_version", "SELECT id, kind < 2 OR (kind = 2 AND attempts < 3) AS stale FROM {jobs}")
def dat07(c: Civic) -> DataFrame:
    version = F.concat_ws(".", F.col("kind").cast("string"), F.col("attempts").cast("string"))
    return c.jobs.select("id", d.older_version(version, "2.3").alias("stale"))


@query("mth02_relative_position", "SELECT id, ROUND(GREATEST(0.0, LEAST(1.0, start_time / 600.0)), 6) AS place FROM {segments}")
def mth02(c: Civic) -> DataFrame:
    return c.segments.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("start_time") / 600.0)), 6).alias("place"))


@query("mth04_token_estimate", "SELECT doc_id, CAST(FLOOR(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 1.3) AS BIGINT) AS tokens FROM {documents}")
def mth04(c: Civic) -> DataFrame:
    return c.documents.select("doc_id", t.token_estimate("text").alias("tokens"))


@query("arr01_any_of_array", "SELECT id FROM {motions} WHERE list_contains(['CARRIED', 'PASSED'], result)")
def arr01(c: Civic) -> DataFrame:
    return c.motions.where(F.array_contains(F.array(F.lit("CARRIED"), F.lit("PASSED")), F.col("result"))).select("id")


@query("arr02_distinct_array", "SELECT meeting_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM {agenda_items} WHERE category IS NOT NULL GROUP BY meeting_id")
def arr02(c: Civic) -> DataFrame:
    return c.agenda_items.where("category is not null").groupBy("meeting_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("jsn01_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') IS NULL AS missing FROM {events}")
def jsn01(c: Civic) -> DataFrame:
    return c.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").isNull().alias("missing"))


@query("jsn03_canonical_hash", "SELECT p_partkey AS id, sha256('{{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || CAST(p_size AS STRING) || '}}') AS digest FROM {part}")
def jsn03(c: Civic) -> DataFrame:
    return c.part.select(F.col("p_partkey").alias("id"), d.canonical_hash({"name": F.col("p_name"), "size": F.col("p_size"), "brand": F.col("p_brand")}).alias("digest"))
