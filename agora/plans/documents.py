"""Documents, entities, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import documents as docs
from agora.operators import entities as ent
from agora.plans.registry import query
from agora.sources.civic import Civic


@query("doc01_chunks", """
    WITH RECURSIVE t AS (SELECT doc_id, text AS x, length(text) AS n FROM {documents} WHERE text <> ''),
    c AS (SELECT doc_id, 0 AS start, 0 AS stop FROM t UNION ALL
      SELECT doc_id, CASE WHEN stop = 0 THEN start ELSE stop - 200 END, CASE WHEN start + 1000 < n AND brk > 700 THEN start + brk + 1 ELSE start + 1000 END
      FROM (SELECT doc_id, start, 0 AS stop, n, CASE WHEN contains(chunk, chr(10)) THEN length(regexp_extract(chunk, '(?s)^(.*)\\n', 1)) WHEN contains(chunk, '. ') THEN length(regexp_extract(chunk, '(?s)^(.*)\\. ', 1)) ELSE -1 END AS brk
        FROM (SELECT c.doc_id, GREATEST(c.stop - 200, 0) AS start, t.n, substr(t.x, GREATEST(c.stop - 200, 0) + 1, 1000) AS chunk FROM c JOIN t ON t.doc_id = c.doc_id WHERE GREATEST(c.stop - 200, 0) < t.n AND (c.stop = 0 OR c.stop - 200 < t.n)))),
    p AS (SELECT c.doc_id, c.start, regexp_replace(substr(t.x, c.start + 1, c.stop - c.start), '^\\s+|\\s+$', '', 'g') AS chunk FROM c JOIN t ON t.doc_id = c.doc_id WHERE c.stop > 0)
    SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS place, chunk FROM p WHERE length(chunk) > 20""")
def doc01(c: Civic) -> DataFrame:
    return docs.exploded(c.documents, "doc_id", "text", docs.chunk_text)


@query("doc02_packed_paragraphs", """
    WITH RECURSIVE parts AS (SELECT doc_id, CASE WHEN len(string_split_regex(text, '\\n\\s*\\n')) > 1 THEN string_split_regex(text, '\\n\\s*\\n') ELSE string_split(text, chr(10)) END AS ps FROM {documents} WHERE text <> ''),
    p AS (SELECT doc_id, list_filter(list_transform(ps, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM parts),
    f AS (SELECT doc_id, 0 AS k, 0 AS pack, 8000 AS room FROM p UNION ALL
      SELECT f.doc_id, k + 1, CASE WHEN k > 0 AND length(ps[k + 1]) + 1 > room THEN pack + 1 ELSE pack END, CASE WHEN k > 0 AND length(ps[k + 1]) + 1 > room THEN 8000 - length(ps[k + 1]) ELSE room - length(ps[k + 1]) - 1 END
      FROM f JOIN p ON p.doc_id = f.doc_id WHERE k < len(ps)),
    s AS (SELECT f.doc_id, pack, string_agg(ps[k], chr(10) || chr(10) ORDER BY k) AS chunk FROM f JOIN p ON p.doc_id = f.doc_id WHERE k > 0 GROUP BY 1, 2)
    SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY pack) - 1 AS place, chunk FROM s WHERE length(chunk) >= 150""")
def doc02(c: Civic) -> DataFrame:
    return docs.exploded(c.documents, "doc_id", "text", docs.packed_paragraphs)


@query("doc05_markdown_sections", "SELECT id, place, title, body FROM (SELECT p_partkey AS id, 0 AS place, 'Introduction' AS title, 'Preamble of ' || p_name AS body FROM {part} UNION ALL SELECT p_partkey, 1, 'First ' || p_brand, 'body one' FROM {part} UNION ALL SELECT p_partkey, 2, 'Second', 'body two ' || p_type FROM {part})")
def doc05(c: Civic) -> DataFrame:
    markdown = F.concat(F.lit("Preamble of "), F.col("p_name"), F.lit("\n## First "), F.col("p_brand"), F.lit("\nbody one\n## Second\nbody two "), F.col("p_type"))
    return c.part.select(F.col("p_partkey").alias("id"), F.posexplode(docs.markdown_sections(markdown)).alias("place", "s")).select("id", "place", "s.title", "s.body")


@query("doc06_innermost_ranges", """
    WITH r AS (SELECT l_orderkey AS doc, l_partkey AS id, MIN(l_linenumber) AS first, MIN(l_linenumber) + MAX(l_suppkey) % 4 AS last FROM {lineitem} GROUP BY 1, 2)
    SELECT doc, id FROM r WHERE NOT EXISTS (SELECT 1 FROM r i WHERE i.doc = r.doc AND i.id <> r.id AND r.first <= i.first AND i.last <= r.last AND (r.first < i.first OR i.last < r.last))""")
def doc06(c: Civic) -> DataFrame:
    first = F.min("l_linenumber")
    ranges = c.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("id")).agg(first.alias("first"), (first + F.max("l_suppkey") % 4).alias("last"))
    return docs.outermost_dropped(ranges).select("doc", "id")


@query("doc03_merged_headings", """
    WITH s AS (SELECT id % 7 AS doc, title, id AS place, title || ' ' || CAST(id AS STRING) AS text, place AS last_page FROM {agenda_items}),
    n AS (SELECT *, COUNT(*) OVER (PARTITION BY doc, title) AS n, MIN(place) OVER (PARTITION BY doc, title) AS lead FROM s)
    SELECT doc, title, CASE WHEN n >= 5 THEN lead ELSE place END AS place, md5(string_agg(text, chr(10) || chr(10) ORDER BY n.place)) AS text, MAX(last_page) AS last_page, COUNT(*) AS parts FROM n GROUP BY doc, title, CASE WHEN n >= 5 THEN lead ELSE place END""")
def doc03(c: Civic) -> DataFrame:
    s = c.agenda_items.select((F.col("id") % 7).alias("doc"), "title", F.col("id").alias("place"), F.concat_ws(" ", "title", F.col("id").cast("string")).alias("text"), F.col("place").alias("last_page"))
    return docs.merged_headings(s).withColumn("text", F.md5("text"))


#: Items of meetings with numbers and longer titles; sections that have a number, hold a title or lie in one, or share words with one.
NUMBERED_ITEMS = "SELECT id, meeting_id, CAST(place + 1 AS STRING) || '.' || CAST(id % 3 AS STRING) || CASE WHEN id % 4 = 0 THEN '. ' ELSE '' END AS number, CASE WHEN id % 13 = 5 THEN 'Item' ELSE title || ', Phase ' || CAST(id % 10 AS STRING) END AS title FROM {agenda_items}"
SECTIONS = """SELECT meeting_id, meeting_id AS doc, id AS place, CASE id % 7 WHEN 0 THEN CAST(place + 1 AS STRING) || '.' || CAST(id % 3 AS STRING) || ' Report' WHEN 1 THEN 'On the ' || upper(title) || ', phase ' || CAST(id % 10 AS STRING) || ' again' WHEN 2 THEN ' ' || substring(title, 3) WHEN 3 THEN 'Report: ' || title || ' - phase ' || CAST(id % 10 AS STRING) || '!'
  WHEN 4 THEN '99.9 ' || title WHEN 5 THEN 'It' ELSE 'of ' || regexp_replace(title, ' ', ' and the ') END AS title FROM {agenda_items} UNION ALL SELECT meeting_id, meeting_id, id + 1000000 + k, title || ', Phase ' || CAST(id % 10 AS STRING) FROM (SELECT *, unnest_k AS k FROM {agenda_items} {twelve}) WHERE id % 50 = 1"""


def sections_of(twelve: str, column: str) -> str:
    return SECTIONS.replace("{twelve}", twelve).replace("unnest_k", column)


PLAIN_SQL = "trim(regexp_replace(regexp_replace(trim(lower({0})), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("doc04_linked_items", rf"""
    WITH i AS ({NUMBERED_ITEMS}), s AS ({sections_of(', range(12) r(k)', 'r.k')}), p AS (SELECT s.doc, s.place, s.title, i.id, i.number, i.title AS item, {PLAIN_SQL.format('s.title')} AS a, {PLAIN_SQL.format('i.title')} AS b FROM s JOIN i ON i.meeting_id = s.meeting_id WHERE s.title <> ''),
    w AS (SELECT doc, place, id, b, string_split(a, ' ') AS ws FROM p WHERE length(title) > 10 AND length(b) >= 10), r1 AS (SELECT *, unnest(range(1, len(ws) + 1)) AS x FROM w), r2 AS (SELECT *, unnest(range(x + 2, len(ws) + 1)) AS y FROM r1),
    run AS (SELECT doc, place, id, MAX(length(array_to_string(ws[x:y], ' '))) AS n FROM r2 WHERE contains(' ' || b || ' ', ' ' || array_to_string(ws[x:y], ' ') || ' ') GROUP BY ALL),
    c AS (SELECT doc, place, 1 AS how, -MAX(id) AS k, 0 AS n FROM p WHERE regexp_extract(trim(title), '^(\d+(?:\.\d+)*)', 1) = rtrim(trim(number), '.') GROUP BY doc, place
      UNION ALL SELECT doc, place, 2, MIN(id), 0 FROM p WHERE length(title) > 10 AND length(trim(item)) > 10 AND (contains(lower(trim(item)), lower(trim(title))) OR contains(lower(trim(title)), lower(trim(item)))) GROUP BY doc, place
      UNION ALL SELECT doc, place, 3, id, -n FROM run WHERE n >= 15),
    best AS (SELECT doc, place, arg_min({{{{'h': how, 'k': k}}}}, (how, n, k)) AS b FROM c GROUP BY doc, place), l AS (SELECT doc, place, ABS(b.k) AS item_id, b.h AS h, row_number() OVER (PARTITION BY ABS(b.k) ORDER BY doc, place) AS t, COUNT(*) OVER (PARTITION BY ABS(b.k)) AS m FROM best)
    SELECT doc, place, item_id, CASE h WHEN 1 THEN 'number' WHEN 2 THEN 'title' ELSE 'words' END AS how FROM l WHERE m <= 10 OR t <= 3""")
def doc04(c: Civic) -> DataFrame:
    sections = c.spark.sql(sections_of("LATERAL VIEW explode(sequence(0, 11)) AS k12", "k12"), agenda_items=c.agenda_items)
    return docs.linked_items(sections, c.spark.sql(NUMBERED_ITEMS, agenda_items=c.agenda_items))


@query("doc12_sentence_times", "SELECT id, place, sentence, ROUND(t, 6) AS t FROM (SELECT id, 0 AS place, text || '.' AS sentence, start_time AS t FROM {segments} UNION ALL SELECT id, 1, 'It ended!', start_time + (end_time - start_time) * (length(text) + 2) / (length(text) + 2 + 10) FROM {segments})")
def doc12(c: Civic) -> DataFrame:
    rows = c.segments.withColumn("text", F.concat("text", F.lit(". It ended!")))
    return docs.sentences(rows).select("id", "place", "sentence", F.round("at", 6).alias("t"))


@query("vec15_discussion_text", "SELECT i.id AS item_id, md5(i.title || chr(10) || '---' || chr(10) || string_agg(s.speaker_name || ': ' || s.text, chr(10) ORDER BY s.start_time, s.id)) AS digest FROM {segments} s JOIN {agenda_items} i ON i.meeting_id = s.meeting_id AND s.start_time BETWEEN i.start_time AND i.end_time GROUP BY i.id, i.title")
def vec15(c: Civic) -> DataFrame:
    return docs.discussion_text(c.agenda_items, c.segments).select("item_id", F.md5("text").alias("digest"))


@query("vec14_embedding_text", "SELECT id, left(title || chr(10) || COALESCE(category, '') || chr(10) || CAST(place AS STRING), 8000) AS text FROM {agenda_items} WHERE len(string_split(title, ' ')) >= 2")
def vec14(c: Civic) -> DataFrame:
    text = F.substring(F.concat_ws("\n", "title", F.coalesce("category", F.lit("")), F.col("place").cast("string")), 1, 8000)
    return c.agenda_items.where(F.size(F.split("title", " ")) >= 2).select("id", text.alias("text"))


@query("doc08_motion_blocks", "SELECT id AS doc, 14 AS start, 'Moved by ' || text || '. CARRIED' AS block, 'carried' AS outcome FROM {motions}")
def doc08(c: Civic) -> DataFrame:
    minutes = c.motions.select(F.col("id").alias("doc"), F.concat(F.lit("Introduction. Moved by "), "text", F.lit(". CARRIED\nThen Moved by "), "text", F.lit(". carried\nend")).alias("text"))
    return docs.motion_blocks(minutes).withColumn("start", F.col("start") - 1)


@query("snk05_minutes_markdown", "SELECT m.id AS meeting_id, md5('# ' || m.title || chr(10) || chr(10) || b.body) AS digest FROM {meetings} m JOIN (SELECT i.meeting_id, string_agg('## ' || i.title || COALESCE(chr(10) || l.lines, ''), chr(10) || chr(10) ORDER BY i.place, i.id) AS body FROM {agenda_items} i LEFT JOIN (SELECT agenda_item_id, string_agg('- ' || text || ': **' || COALESCE(result, 'no result') || '**', chr(10) ORDER BY id) AS lines FROM {motions} GROUP BY agenda_item_id) l ON l.agenda_item_id = i.id GROUP BY i.meeting_id) b ON b.meeting_id = m.id")
def snk05(c: Civic) -> DataFrame:
    return docs.minutes_markdown(c.meetings, c.agenda_items, c.motions).select("meeting_id", F.md5("markdown").alias("digest"))


@query("src11_page_links", "SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"')) AS n FROM {pages}")
def src11(c: Civic) -> DataFrame:
    return c.pages.select("page_id", F.size(docs.links(F.col("html"))).cast("long").alias("n"))


@query("src12_page_text", "SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) AS digest FROM {pages}")
def src12(c: Civic) -> DataFrame:
    return c.pages.select("page_id", F.md5(docs.page_text(F.col("html"))).alias("digest"))


@query("ent07_complete_link", None)
def ent07(c: Civic) -> DataFrame:
    pairs = c.lineitem.select(F.floor(F.col("l_orderkey") / 8).alias("component"), (F.col("l_partkey") % 12).alias("x"), (F.col("l_suppkey") % 12).alias("y"), F.round(F.col("l_discount") * 5 + 0.5, 2).alias("confidence"), "l_returnflag").where("x <> y")
    pair = lambda df: df.groupBy("component", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("confidence").alias("confidence"))
    return ent.complete_link(pair(pairs.where("l_returnflag <> 'A'")), pair(pairs.where("l_returnflag = 'A'")), "component", 0.85)


#: Titles that come once, twice or not at all on a side.
LEFT = "SELECT id, title || ' ' || CAST(id % 1900 AS STRING) AS title FROM {agenda_items}"
RIGHT = "SELECT p_partkey AS id, p_name || ' ' || CAST(CASE WHEN p_partkey % 7 = 3 THEN p_partkey % 900 ELSE p_partkey % 1900 END AS STRING) AS title FROM {part} WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey + 1000000, p_name || ' ' || CAST(p_partkey % 1900 AS STRING) FROM {part} WHERE p_partkey % 5 = 2"


@query("ent09_unique_matches", f"SELECT l.left_id, r.right_id FROM (SELECT title, MIN(id) AS left_id FROM ({LEFT}) GROUP BY title HAVING COUNT(*) = 1) l JOIN (SELECT title, MIN(id) AS right_id FROM ({RIGHT}) GROUP BY title HAVING COUNT(*) = 1) r ON r.title = l.title")
def ent09(c: Civic) -> DataFrame:
    return ent.unique_matches(c.spark.sql(LEFT, agenda_items=c.agenda_items), c.spark.sql(RIGHT, part=c.part), ["title"])


@query("rem20_merged_matters", "SELECT canonical_root AS cluster, arg_min(id, (year, id)) AS canonical, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS merged, MIN(year) AS first_year, MAX(year) AS last_year FROM (SELECT *, id % 60 AS canonical_root FROM {matters}) GROUP BY 1")
def rem20(c: Civic) -> DataFrame:
    pairs = c.matters.select((F.col("id") % 60).alias("cluster"), F.col("id").alias("member"))
    return ent.merged_matters(pairs, c.matters).withColumn("merged", F.array_join(F.transform("merged", lambda x: x.cast("string")), ","))


@query("aln05_monotonic_chain", None)
def aln05(c: Civic) -> DataFrame:
    options = c.segments.select("meeting_id", (F.col("id") % 11).alias("item"), F.col("start_time").alias("time"), F.round((F.col("end_time") - F.col("start_time")) / 20, 3).alias("score"))
    return ent.monotonic_chain(options)


@query("aln07_best_speaker", """
    WITH o AS (SELECT s.id, t.name AS speaker, s.end_time - s.start_time AS len, GREATEST(s.start_time, t.s) AS lo, LEAST(s.end_time, t.e) AS hi FROM {segments} s JOIN (SELECT meeting_id, 'turn ' || CAST(id % 5 AS STRING) AS name, start_time AS s, end_time AS e FROM {segments}) t ON t.meeting_id = s.meeting_id AND s.start_time < t.e AND s.end_time > t.s),
    r AS (SELECT *, MAX(hi) OVER (PARTITION BY id, speaker ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
    p AS (SELECT id, speaker, ROUND(SUM(GREATEST(0, hi - GREATEST(lo, COALESCE(reach, lo)))) / MAX(len), 9) AS share FROM r GROUP BY id, speaker),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY share DESC, speaker) AS k FROM p)
    SELECT id, MAX(speaker) FILTER (k = 1) AS speaker, ROUND(MAX(share), 6) AS coverage, ROUND(COALESCE(MAX(share) FILTER (k > 1), 0), 6) AS competing FROM k GROUP BY id""")
def aln07(c: Civic) -> DataFrame:
    turns = c.segments.select("meeting_id", F.concat(F.lit("turn "), (F.col("id") % 5).cast("string")).alias("speaker"), "start_time", "end_time")
    return ent.best_speaker(c.segments, turns).withColumns({"coverage": F.round("coverage", 6), "competing": F.round("competing", 6)})
