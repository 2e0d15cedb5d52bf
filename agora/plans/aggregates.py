"""Aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import TOPICS, topic
from agora.operators import aggregates as ops
from agora.plans.registry import query
from agora.sources.civic import Civic


def topic_sql(c: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({c}), '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in TOPICS.items())
    return f"CASE WHEN {c} IS NULL THEN 'General' {arms} ELSE 'General' END"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("agg01_meeting_stats", f"""
    SELECT m.id, COALESCE(c.carried, 0) AS carried, COALESCE(c.defeated, 0) AS defeated, COALESCE(c.other, 0) AS other, COALESCE(t.topics, '') AS topics
    FROM {{meetings}} m
    LEFT JOIN (SELECT meeting_id, COUNT(*) FILTER (upper(result) IN {listed(ops.CARRIED)}) AS carried, COUNT(*) FILTER (upper(result) IN {listed(ops.DEFEATED)}) AS defeated,
        COUNT(*) FILTER (result IS NULL OR upper(result) NOT IN {listed(ops.CARRIED + ops.DEFEATED)}) AS other FROM {{motions}} GROUP BY meeting_id) c ON c.meeting_id = m.id
    LEFT JOIN (SELECT meeting_id, string_agg(topic, ',' ORDER BY topic) AS topics FROM (SELECT DISTINCT meeting_id, {topic_sql('category')} AS topic FROM {{agenda_items}}) WHERE topic <> 'General' GROUP BY meeting_id) t ON t.meeting_id = m.id
    WHERE m.municipality_id = 1""")
def agg01(c: Civic) -> DataFrame:
    return ops.meeting_stats(c.meetings.where("municipality_id = 1").select("id"), c.motions, c.agenda_items).withColumn("topics", F.array_join("topics", ","))


@query("agg02_speaking_time", """
    SELECT s.person_id, p.name, CAST(ROUND(SUM(CAST(s.end_time - s.start_time AS DECIMAL(18,3))), 1) AS DOUBLE) AS seconds, COUNT(DISTINCT s.meeting_id) AS meetings, COUNT(*) AS segments
    FROM {segments} s JOIN {people} p ON p.id = s.person_id JOIN {meetings} m ON m.id = s.meeting_id
    WHERE m.meeting_date >= DATE '1996-01-01' AND m.meeting_date <= DATE '2001-12-31' GROUP BY s.person_id, p.name""")
def agg02(c: Civic) -> DataFrame:
    dated = c.meetings.where("meeting_date between DATE '1996-01-01' and DATE '2001-12-31'").select(F.col("id").alias("m"))
    s = c.segments.select("person_id", "meeting_id", "start_time", "end_time").join(dated, F.col("meeting_id") == F.col("m"), "left_semi")
    s = s.join(c.people.select(F.col("id").alias("p"), "name"), F.col("person_id") == F.col("p"))
    return ops.speaking_time(s, ["person_id", "name"]).orderBy(F.col("raw_seconds").desc(), "person_id").drop("raw_seconds")


@query("agg03_speaking_by_meeting", """
    SELECT s.meeting_id, CAST(m.meeting_date AS STRING) AS meeting_date, CAST(ROUND(SUM(CAST(s.end_time - s.start_time AS DECIMAL(18,3))), 1) AS DOUBLE) AS seconds, COUNT(*) AS segments
    FROM {segments} s JOIN {meetings} m ON m.id = s.meeting_id WHERE s.person_id = 12 GROUP BY s.meeting_id, m.meeting_date""")
def agg03(c: Civic) -> DataFrame:
    s = c.segments.where("person_id = 12").join(c.meetings.select(F.col("id").alias("m"), F.col("meeting_date").cast("string").alias("meeting_date")), F.col("meeting_id") == F.col("m"))
    return ops.speaking_time(s, ["meeting_id", "meeting_date"]).orderBy("meeting_date", "meeting_id").drop("raw_seconds", "meetings")


@query("agg06_usage_summary", """
    SELECT u.stage, COUNT(*) AS calls, COUNT(*) FILTER (NOT ok) AS failed, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in, CAST(SUM(tokens_out) AS BIGINT) AS tokens_out,
      ROUND(quantile_cont(latency, 0.5), 4) AS p50, ROUND(quantile_cont(latency, 0.95), 4) AS p95, ANY_VALUE(m.by_model) AS by_model
    FROM {usage} u JOIN (SELECT stage, '[' || string_agg('{{"model":"' || model || '","calls":' || CAST(n AS STRING) || '}}', ',' ORDER BY model) || ']' AS by_model FROM (SELECT stage, model, COUNT(*) AS n FROM {usage} GROUP BY stage, model) GROUP BY stage) m ON m.stage = u.stage
    GROUP BY u.stage""")
def agg06(c: Civic) -> DataFrame:
    return ops.usage_summary(c.usage).withColumns({"p50": F.round("p50", 4), "p95": F.round("p95", 4)})


@query("agg07_usage_cost", """
    SELECT u.stage, ROUND(SUM((tokens_in * p.price_in + tokens_out * p.price_out) / 1000000), 6) AS cost, BOOL_OR(p.model IS NULL) AS partial
    FROM {usage} u LEFT JOIN (VALUES ('model-0', 0.25, 1.0), ('model-1', 3.0, 15.0), ('model-2', 0.5, 2.0)) p(model, price_in, price_out) ON p.model = u.model GROUP BY u.stage""")
def agg07(c: Civic) -> DataFrame:
    prices = c.spark.createDataFrame([("model-0", 0.25, 1.0), ("model-1", 3.0, 15.0), ("model-2", 0.5, 2.0)], "model string, price_in double, price_out double")
    return ops.priced(c.usage, prices)


@query("agg08_tallies", "SELECT motion_id, COUNT(*) FILTER (vote IN ('Yes', 'In Favour')) AS yes, COUNT(*) FILTER (vote IN ('No', 'Opposed')) AS no, COUNT(*) FILTER (vote NOT IN ('Yes', 'In Favour', 'No', 'Opposed')) AS other FROM {votes} GROUP BY motion_id")
def agg08(c: Civic) -> DataFrame:
    return ops.tallies(c.votes)


@query("agg09_complete_counts", """
    SELECT m.id, CASE WHEN m.coverage = 'reconstructed_complete' AND v.fit AND v.c = v.d THEN v.y END AS yes, CASE WHEN m.coverage = 'reconstructed_complete' AND v.fit AND v.c = v.d THEN v.n END AS no
    FROM {motions} m LEFT JOIN (SELECT motion_id, COUNT(*) FILTER (vote = 'Yes') AS y, COUNT(*) FILTER (vote = 'No') AS n, COUNT(*) AS c, COUNT(DISTINCT person_id) AS d, BOOL_AND(vote IN ('Yes', 'No')) AS fit FROM {votes} GROUP BY motion_id) v ON v.motion_id = m.id""")
def agg09(c: Civic) -> DataFrame:
    return ops.complete_counts(c.votes, c.motions)


@query("agg15_coverage", "SELECT COUNT(*) AS total, COUNT(person_id) AS linked FROM {segments}")
def agg15(c: Civic) -> DataFrame:
    return c.segments.agg(F.count(F.lit(1)).alias("total"), F.count("person_id").alias("linked"))


@query("agg16_speaker_stats", "SELECT s.meeting_id, COALESCE(p.name, s.speaker_name) AS speaker, ROUND(SUM(s.end_time - s.start_time), 2) AS seconds FROM {segments} s LEFT JOIN {people} p ON p.id = s.person_id GROUP BY 1, 2")
def agg16(c: Civic) -> DataFrame:
    s = c.segments.join(c.people.select(F.col("id").alias("p"), "name"), F.col("person_id") == F.col("p"), "left")
    return s.groupBy("meeting_id", F.coalesce("name", "speaker_name").alias("speaker")).agg(F.round(F.sum(F.col("end_time") - F.col("start_time")), 2).alias("seconds"))


@query("agg19_person_votes", "SELECT person_id, COUNT(*) AS total, COUNT(*) FILTER (vote IN ('Yes', 'In Favour')) AS yes, COUNT(*) FILTER (vote IN ('No', 'Opposed')) AS no, COUNT(*) FILTER (vote IN ('Abstain', 'Abstained', 'Recused')) AS abstain FROM {votes} GROUP BY person_id")
def agg19(c: Civic) -> DataFrame:
    v = F.col("vote")
    return c.votes.groupBy("person_id").agg(F.count(F.lit(1)).alias("total"), ops.n(v.isin(ops.YES)).alias("yes"), ops.n(v.isin(ops.NO)).alias("no"), ops.n(v.isin("Abstain", "Abstained", "Recused")).alias("abstain"))


@query("agg20_divided_decisions", "SELECT v.motion_id, COALESCE(string_agg(p.name, ',' ORDER BY p.name) FILTER (v.vote IN ('Yes', 'In Favour')), '') AS yes_names, string_agg(p.name, ',' ORDER BY p.name) FILTER (v.vote IN ('No', 'Opposed')) AS no_names FROM {votes} v JOIN {people} p ON p.id = v.person_id GROUP BY v.motion_id HAVING COUNT(*) FILTER (v.vote IN ('No', 'Opposed')) > 0")
def agg20(c: Civic) -> DataFrame:
    return ops.divided(c.votes, c.people).select("motion_id", F.array_join("yes_names", ",").alias("yes_names"), F.array_join("no_names", ",").alias("no_names"))


@query("agg21_matter_rollup", "SELECT COALESCE(canonical_id, id) AS matter_id, COUNT(*) AS members, COUNT(DISTINCT address) AS addresses, MIN(title) AS first_title FROM {matters} GROUP BY 1")
def agg21(c: Civic) -> DataFrame:
    return c.matters.groupBy(F.coalesce("canonical_id", "id").alias("matter_id")).agg(F.count(F.lit(1)).alias("members"), F.countDistinct("address").alias("addresses"), F.min("title").alias("first_title"))


@query("agg22_by_address", "SELECT COALESCE(word, 'none') AS word, COUNT(*) AS n FROM (SELECT id, UNNEST(string_split(address, ' ')) AS word FROM {matters}) GROUP BY 1")
def agg22(c: Civic) -> DataFrame:
    return c.matters.select("id", F.explode_outer(F.split("address", " ")).alias("word")).groupBy(F.coalesce("word", F.lit("none")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("agg23_overlinked", "SELECT id, matter_id FROM (SELECT id, matter_id, COUNT(*) OVER (PARTITION BY matter_id) AS n, ROW_NUMBER() OVER (PARTITION BY matter_id ORDER BY id) AS k FROM {agenda_items}) WHERE n <= 10 OR k <= 3")
def agg23(c: Civic) -> DataFrame:
    w = Window.partitionBy("matter_id")
    return c.agenda_items.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("id"))).where("n <= 10 or k <= 3").select("id", "matter_id")


@query("agg24_repeated_headings", "SELECT title, COUNT(*) AS n, MIN(id) AS first_id, MAX(place) AS last_place FROM {agenda_items} GROUP BY title HAVING COUNT(*) >= 5")
def agg24(c: Civic) -> DataFrame:
    return c.agenda_items.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("place").alias("last_place")).where("n >= 5")


@query("agg25_mode_by_characters", "SELECT meeting_id, arg_max(category, (chars, category)) AS category FROM (SELECT meeting_id, category, SUM(LENGTH(title)) AS chars FROM {agenda_items} WHERE category IS NOT NULL GROUP BY 1, 2) GROUP BY meeting_id")
def agg25(c: Civic) -> DataFrame:
    chars = c.agenda_items.where("category is not null").groupBy("meeting_id", "category").agg(F.sum(F.length("title")).alias("chars"))
    return chars.groupBy("meeting_id").agg(F.max_by("category", F.struct("chars", "category")).alias("category"))


@query("agg26_classify_new", f"SELECT i.id, {topic_sql('i.category')} AS topic FROM {{agenda_items}} i WHERE i.category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{motions}} m WHERE m.agenda_item_id = i.id)")
def agg26(c: Civic) -> DataFrame:
    known = c.motions.select(F.col("agenda_item_id").alias("known"))
    return c.agenda_items.where("category is not null").join(known, F.col("id") == F.col("known"), "left_anti").select("id", topic("category").alias("topic"))


@query("agg27_latest_motion", "SELECT matter_id, id, result FROM (SELECT i.matter_id, m.id, m.result, ROW_NUMBER() OVER (PARTITION BY i.matter_id ORDER BY g.meeting_date DESC, m.id DESC) AS k FROM {motions} m JOIN {agenda_items} i ON i.id = m.agenda_item_id JOIN {meetings} g ON g.id = m.meeting_id WHERE m.result IS NOT NULL) WHERE k = 1")
def agg27(c: Civic) -> DataFrame:
    rows = c.motions.where("result is not null").join(c.agenda_items.select(F.col("id").alias("i"), "matter_id"), F.col("agenda_item_id") == F.col("i")).join(c.meetings.select(F.col("id").alias("g"), "meeting_date"), F.col("meeting_id") == F.col("g"))
    return rows.groupBy("matter_id").agg(F.max_by(F.struct("id", "result"), F.struct("meeting_date", "id")).alias("last")).select("matter_id", "last.id", "last.result")


@query("agg29_agreement_levels", """
    SELECT COALESCE(a.topic, b.topic) AS topic, CASE WHEN a.score IS NULL OR b.score IS NULL THEN 'no-data' WHEN ABS(a.score - b.score) <= 0.5 THEN 'agree' WHEN ABS(a.score - b.score) > 1.0 THEN 'disagree' ELSE 'partial' END AS level
    FROM (SELECT motion_id % 40 AS topic, COUNT(*) / 10.0 AS score FROM {votes} WHERE person_id = 3 GROUP BY 1) a FULL JOIN (SELECT motion_id % 50 AS topic, COUNT(*) / 10.0 AS score FROM {votes} WHERE person_id = 5 GROUP BY 1) b ON a.topic = b.topic""")
def agg29(c: Civic) -> DataFrame:
    side = lambda person, k, name: c.votes.where(F.col("person_id") == person).groupBy((F.col("motion_id") % k).alias(f"t{name}")).agg((F.count(F.lit(1)) / 10.0).alias(name))
    both = side(3, 40, "a").join(side(5, 50, "b"), F.col("ta") == F.col("tb"), "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    return both.select(F.coalesce("ta", "tb").alias("topic"), F.when(gap.isNull(), "no-data").when(gap <= 0.5, "agree").when(gap > 1.0, "disagree").otherwise("partial").alias("level"))


@query("agg30_service_periods", """
    SELECT person_id, organization_id, CAST(start_date AS STRING) AS start_date, CAST(CASE WHEN e < DATE '9999-12-31' THEN e END AS STRING) AS end_date, CASE WHEN start_date > DATE '2000-01-01' THEN 'upcoming' WHEN e < DATE '2000-01-01' THEN 'past' ELSE 'current' END AS status
    FROM (SELECT person_id, organization_id, period, MIN(start_date) AS start_date, MAX(e) AS e FROM (
      SELECT *, SUM(fresh) OVER (PARTITION BY person_id, organization_id ORDER BY start_date, e) AS period FROM (
        SELECT *, CASE WHEN start_date <= MAX(e) OVER (PARTITION BY person_id, organization_id ORDER BY start_date, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 0 ELSE 1 END AS fresh
        FROM (SELECT *, COALESCE(end_date, DATE '9999-12-31') AS e FROM {memberships}))) GROUP BY person_id, organization_id, period)""")
def agg30(c: Civic) -> DataFrame:
    return ops.service_periods(c.memberships, "2000-01-01", gap_days=10).withColumns({k: F.col(k).cast("string") for k in ("start_date", "end_date")})


@query("agg31_covered_seconds", "SELECT meeting_id, speaker_id, ROUND(SUM(GREATEST(0, end_time - GREATEST(start_time, COALESCE(reach, start_time)))), 3) AS covered FROM (SELECT *, MAX(end_time) OVER (PARTITION BY meeting_id, speaker_id ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {segments}) GROUP BY meeting_id, speaker_id")
def agg31(c: Civic) -> DataFrame:
    return ops.covered_seconds(c.segments, ["meeting_id", "speaker_id"]).withColumn("covered", F.round("covered", 3))


@query("agg32_confidence", "SELECT person_id, meeting_id, CASE WHEN COUNT(*) >= 8 THEN 'high' WHEN COUNT(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM {segments} GROUP BY person_id, meeting_id")
def agg32(c: Civic) -> DataFrame:
    k = F.count(F.lit(1))
    return c.segments.groupBy("person_id", "meeting_id").agg(F.when(k >= 8, "high").when(k >= 3, "medium").otherwise("low").alias("confidence"))


ATTENDANCE_SQL = """
    WITH terms AS (SELECT * FROM (VALUES (1, DATE '1995-01-01', DATE '1998-06-30'), (2, DATE '1998-07-01', CAST(NULL AS DATE))) t(id, s, e)),
    records AS (SELECT motion_id AS meeting_id, person_id, CASE vote WHEN 'Yes' THEN 'present' WHEN 'No' THEN 'absent' ELSE 'unknown' END AS state, person_id % 2 = 0 AS verified FROM {votes}),
    expected AS (SELECT DISTINCT m.id, m.meeting_date, s.person_id FROM {meetings} m JOIN {memberships} s ON s.organization_id = m.organization_id AND (s.start_date IS NULL OR s.start_date <= m.meeting_date) AND (s.end_date IS NULL OR m.meeting_date <= s.end_date)
      WHERE m.meeting_date <= DATE '2001-01-01' AND lower(m.status) NOT IN ('cancelled', 'canceled') AND (m.has_agenda IS TRUE OR m.has_minutes IS TRUE OR m.has_transcript IS TRUE OR m.summary IS NOT NULL)),
    per AS (SELECT e.*, COALESCE(r.state, 'unknown') AS state, COALESCE(r.verified, FALSE) AS verified FROM expected e LEFT JOIN (SELECT meeting_id, person_id, CASE WHEN MIN(state) = MAX(state) THEN MIN(state) ELSE 'unknown' END AS state, BOOL_OR(verified) AS verified FROM records GROUP BY 1, 2) r ON r.meeting_id = e.id AND r.person_id = e.person_id),
    dated AS (SELECT p.person_id, CAST(t.id AS STRING) AS term, state, verified FROM per p JOIN terms t ON p.meeting_date BETWEEN t.s AND COALESCE(t.e, DATE '2001-01-01') UNION ALL SELECT person_id, 'all', state, verified FROM per),
    counts AS (SELECT person_id, term, COUNT(*) AS total, COUNT(*) FILTER (state = 'present') AS attended, COUNT(*) FILTER (state = 'absent') AS absent, COUNT(*) FILTER (state IN ('present', 'absent') AND verified) AS verified FROM dated GROUP BY 1, 2),
    matrix AS (SELECT p.id AS person_id, t.term FROM {people} p CROSS JOIN (SELECT CAST(id AS STRING) AS term FROM terms UNION ALL SELECT 'all') t),
    full_ AS (SELECT m.person_id, m.term, COALESCE(total, 0) AS total, COALESCE(attended, 0) AS attended, COALESCE(absent, 0) AS absent, COALESCE(verified, 0) AS verified FROM matrix m LEFT JOIN counts c ON c.person_id = m.person_id AND c.term = m.term)
    SELECT person_id, term, total, attended, absent, total - attended - absent AS unknown, verified, attended + absent AS recorded,
      CASE WHEN total > 0 AND (total = attended + absent OR attended + absent > verified) THEN CAST(ROUND(100 * attended / total) AS BIGINT) END AS rate FROM full_"""


@query("agg05_council_attendance", ATTENDANCE_SQL)
def agg05(c: Civic) -> DataFrame:
    terms = c.spark.createDataFrame([(1, "1995-01-01", "1998-06-30"), (2, "1998-07-01", None)], "id int, s string, e string").select("id", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"))
    state = F.when(F.col("vote") == "Yes", "present").when(F.col("vote") == "No", "absent").otherwise("unknown")
    records = c.votes.select(F.col("motion_id").alias("meeting_id"), "person_id", state.alias("state"), (F.col("person_id") % 2 == 0).alias("verified"))
    return ops.attendance(c.people, terms, c.meetings, c.memberships, records, "2001-01-01")


@query("agg33_attendance_consistent", ATTENDANCE_SQL.replace("SELECT person_id, term, total, attended, absent, total - attended - absent AS unknown, verified, attended + absent AS recorded,", "SELECT COUNT(*) AS cells, COUNT(*) FILTER (total <> attended + absent + (total - attended - absent)) AS wrong, COUNT(DISTINCT person_id) * COUNT(DISTINCT term) - COUNT(*) AS missing FROM full_ -- ").split("\n      CASE WHEN total > 0 AND")[0])
def agg33(c: Civic) -> DataFrame:
    a = agg05(c)
    return a.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("total") != F.col("attended") + F.col("absent") + F.col("unknown")).alias("wrong"), (F.countDistinct("person_id") * F.countDistinct("term") - F.count(F.lit(1))).alias("missing"))


@query("set01_subscribers", """
    SELECT DISTINCT user_id, id AS subscription_id, type, email FROM (
      SELECT user_id, id, 'digest' AS type, email FROM {subscriptions} WHERE is_active AND kind = 'BUILDING'
      UNION SELECT user_id, id, 'matter', email FROM {subscriptions} WHERE is_active AND kind = 'MACHINERY' AND matter_id IN (SELECT matter_id FROM {agenda_items} WHERE meeting_id = 17)
      UNION SELECT s.user_id, s.id, 'person', s.email FROM {subscriptions} s WHERE is_active AND kind = 'HOUSEHOLD' AND person_id IN (SELECT mover_id FROM {motions} WHERE meeting_id = 17 UNION SELECT seconder_id FROM {motions} WHERE meeting_id = 17))""")
def set01(c: Civic) -> DataFrame:
    s = c.subscriptions.where("is_active")
    out = lambda df, kind: df.select("user_id", F.col("id").alias("subscription_id"), F.lit(kind).alias("type"), "email")
    items = c.agenda_items.where("meeting_id = 17").select(F.col("matter_id").alias("k"))
    movers = c.motions.where("meeting_id = 17").select(F.explode(F.array("mover_id", "seconder_id")).alias("k"))
    parts = [out(s.where("kind = 'BUILDING'"), "digest"), out(s.where("kind = 'MACHINERY'").join(items, F.col("matter_id") == F.col("k"), "left_semi"), "matter"), out(s.where("kind = 'HOUSEHOLD'").join(movers, F.col("person_id") == F.col("k"), "left_semi"), "person")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("set04_keyword_wins_vector", "SELECT id, source, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY rank) AS k FROM (SELECT vec_id AS id, 'vector' AS source, label / 10.0 AS score, 1 AS rank FROM {embeddings} WHERE vec_id % 3 = 0 UNION ALL SELECT doc_id, 'keyword', NULL, 2 FROM {documents} WHERE doc_id % 2 = 0)) WHERE k = 1")
def set04(c: Civic) -> DataFrame:
    vector = c.embeddings.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), F.lit("vector").alias("source"), (F.col("label") / 10.0).alias("score"), F.lit(1).alias("rank"))
    words = c.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("keyword").alias("source"), F.lit(None).cast("double").alias("score"), F.lit(2).alias("rank"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return vector.union(words).withColumn("k", k).where("k = 1").select("id", "source", "score")


@query("set07_unsent_emails", "SELECT DISTINCT email FROM {subscriptions} s WHERE is_active AND email IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {subscriptions} t WHERE t.email = s.email AND t.topic = 3)")
def set07(c: Civic) -> DataFrame:
    sent = c.subscriptions.where("topic = 3").select(F.col("email").alias("sent"))
    return c.subscriptions.where("is_active and email is not null").join(sent, F.col("email") == F.col("sent"), "left_anti").select("email").distinct()
