"""People in minutes and transcripts; images on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import research as ops
from agora.plans.registry import query
from agora.sources.civic import Civic

#: Documents as minutes: names at the head of lines, twice, inside other words, in their short form. {k}: a person, {x}: the line.
NAMED = "concat('Supplier#', lpad(CAST({k} AS STRING), 9, '0'))"
LINE = "CASE ({i} + doc_id) % 7 WHEN 0 THEN concat({n}, ' of 1200 Low Oak Road - ', {x}) WHEN 1 THEN concat('x', {n}, ' ', {x}) WHEN 2 THEN concat(upper({n}), 's ', {x}) WHEN 3 THEN concat({x}, ' (no.    ', CAST({k} AS STRING), ') then B. Lind spoke') WHEN 4 THEN concat({n}, ', ', lower({n}), ': ', {x}) ELSE {x} END"
K = "((doc_id * 7 + {i}) % 120)"
SPOKEN = "SELECT meeting_id, CASE WHEN id % 5 = 0 THEN speaker_name || ' (public)' ELSE speaker_name END AS speaker_name, start_time, CASE WHEN id % 50 = 7 THEN start_time - 1 ELSE end_time END AS end_time FROM {segments}"


def line(i: str) -> str:
    k = K.format(i=i)
    return LINE.format(i=i, x="x", k=k, n=NAMED.format(k=k))


PEOPLE = "SELECT id AS person, name, 'no. ' || CAST(id AS STRING) AS short, 'Person ' || CAST(id AS STRING) AS label FROM {people}"
NUMBERED = r"(?i)(?:^|[^\w])(supplier#\d{{9}}|no\. \d+)(?:[^\w]|$)"


@query("rem22_person_research", rf"""
    WITH who AS ({PEOPLE}), m AS (SELECT doc_id AS doc, doc_id % 300 AS meeting_id, trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {line('(i - 1)')}), chr(10)), '\s+', ' ', 'g')) AS t FROM {{documents}} WHERE text IS NOT NULL),
    hit AS (SELECT doc, meeting_id, lower(unnest(regexp_extract_all(t, '{NUMBERED}', 1))) AS y FROM m), n AS (SELECT h.doc, h.meeting_id, w.person, COUNT(*) AS n FROM hit h JOIN who w ON h.y = lower(w.name) OR h.y = w.short GROUP BY ALL),
    best AS (SELECT person, meeting_id, arg_max(doc, n * 1000000 - doc) AS doc, MAX(n) AS n FROM n GROUP BY person, meeting_id),
    s AS ({SPOKEN}), sp AS (SELECT w.person, s.meeting_id, COUNT(*) AS turns, ROUND(SUM(GREATEST(0, s.end_time - s.start_time)), 2) AS secs FROM s JOIN who w ON s.speaker_name = w.label OR s.speaker_name = w.label || ' (public)' GROUP BY ALL)
    SELECT COALESCE(b.person, sp.person) AS person, COALESCE(b.meeting_id, sp.meeting_id) AS meeting_id, b.doc, COALESCE(b.n, 0) AS name_mentions, COALESCE(sp.turns, 0) AS turns, COALESCE(sp.secs, 0) AS timed_seconds FROM best b FULL JOIN sp ON sp.person = b.person AND sp.meeting_id = b.meeting_id""")
def rem22(c: Civic) -> DataFrame:
    lines = F.expr(f"array_join(transform(split(text, '\\n'), (x, i) -> {line('i')}), '\\n')")
    minutes = c.documents.where("text is not null").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 300).alias("meeting_id"), lines.alias("text"))
    people = c.spark.sql(PEOPLE, people=c.people).select("person", "name", F.array("short", "label").alias("also"))
    return ops.person_research(people, minutes, c.spark.sql(SPOKEN, segments=c.segments)).drop("excerpts")


IMAGES = "SELECT CAST(FLOOR(event_id / 20) AS BIGINT) AS page, event_id AS id, CAST(event_id * 37 % 600 AS DOUBLE) AS x0, CAST(event_id * 91 % 700 AS DOUBLE) AS y0, CAST(event_id * 37 % 600 + 20 + user_id % 80 AS DOUBLE) AS x1, CASE WHEN event_id % 61 = 3 THEN NULL ELSE CAST(event_id * 91 % 700 + 10 + user_id % 60 AS DOUBLE) END AS y1 FROM {events}"


@query("doc13_collages", f"""
    WITH RECURSIVE i AS ({IMAGES}), e AS (SELECT a.page, a.id AS a, b.id AS b FROM i a JOIN i b ON a.page = b.page AND a.id <> b.id AND a.y1 IS NOT NULL AND b.y1 IS NOT NULL AND GREATEST(0, a.x0 - b.x1, b.x0 - a.x1) <= 30 AND GREATEST(0, a.y0 - b.y1, b.y0 - a.y1) <= 30),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT i.page, i.id, LEAST(i.id, COALESCE(MIN(r.b), i.id)) AS collage FROM i LEFT JOIN r ON r.a = i.id GROUP BY i.page, i.id""")
def doc13(c: Civic) -> DataFrame:
    return ops.collages(c.spark.sql(IMAGES, events=c.events))


TAGS = "SELECT page, concat('x [Image: plan of ', CAST(page AS STRING), '] y [image 2: no tag] [Image 2:  the Logo] z', CASE WHEN page % 3 = 0 THEN '[Image 7: chart, logos]' ELSE '' END, ' [Image: ]') AS text FROM i WHERE id % 20 = 0 AND page % 5 <> 4"


@query("doc13_described_images", f"""
    WITH i AS ({IMAGES}), t AS ({TAGS}), d AS (SELECT page, unnest(regexp_extract_all(text, '\\[Image(?:\\s+\\d+)?:\\s*([^\\]]+)\\]', 1)) AS description, unnest(range(len(regexp_extract_all(text, '\\[Image(?:\\s+\\d+)?:\\s*([^\\]]+)\\]', 1)))) AS k FROM t),
    o AS (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY y0, id) - 1 AS k FROM i)
    SELECT o.page, o.id, d.description FROM o LEFT JOIN d ON d.page = o.page AND d.k = o.k WHERE d.description IS NULL OR NOT regexp_matches(d.description, '{ops.junk_pattern()}')""")
def doc13_described(c: Civic) -> DataFrame:
    i = c.spark.sql(IMAGES, events=c.events)
    return ops.described(i.select("page", F.col("y0").alias("place"), "id"), c.spark.sql(TAGS.replace("FROM i", "FROM {i}"), i=i))


@query("doc13_margin_decorations", "SELECT id, COALESCE(w > 0 AND h > 0 AND w <= 520 AND h <= 180 AND (w >= 2 * h OR h >= 2 * w) AND (y0 < 95 OR y1 > 700 - 95), FALSE) AS decoration FROM (SELECT *, x1 - x0 AS w, (y1 - y0) / 4 AS h FROM (" + IMAGES + "))")
def doc13_margins(c: Civic) -> DataFrame:
    i = c.spark.sql(IMAGES, events=c.events)
    return i.select("id", ops.margin_decoration(F.col("x1") - F.col("x0"), (F.col("y1") - F.col("y0")) / 4, F.col("y0"), F.col("y1"), F.lit(700)).alias("decoration"))
