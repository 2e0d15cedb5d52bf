"""Sources and sinks over what the tables hold."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.plans.registry import query
from agora.sources import connectors as con
from agora.sources import sinks
from agora.sources.civic import Civic


@query("src01_nested_scan", "SELECT n_nationkey AS id, n_name AS name, r_name AS region FROM {nation} JOIN {region} ON r_regionkey = n_regionkey")
def src01(c: Civic) -> DataFrame:
    r = c.region.select(F.col("r_regionkey").alias("k"), F.struct("r_name").alias("region"))
    return c.nation.join(r, F.col("n_regionkey") == F.col("k")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("region.r_name").alias("region"))


#: Responses of sources, one a nation's customers: meetings with and without a date or an id.
MEETING_ROWS = "SELECT c_nationkey AS k, c_custkey, CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE CAST(c_custkey AS STRING) END AS ident, c_name AS title, CASE WHEN c_custkey % 7 = 2 THEN NULL WHEN c_custkey % 2 = 0 THEN '2024/01/' || CAST(10 + c_custkey % 15 AS STRING) ELSE '2024-02-' || CAST(10 + c_custkey % 15 AS STRING) || 'T09:00:00' END AS day, CASE WHEN c_custkey % 3 = 0 THEN 'https://example.org/' || c_name END AS url FROM {customer}"


@query("src03_meeting_connector", f"SELECT CASE k % 3 WHEN 0 THEN 'legistar' WHEN 1 THEN 'escribe' ELSE 'civicweb' END AS kind, ident AS source_id, title, replace(substring(day, 1, 10), '/', '-') AS date, url FROM ({MEETING_ROWS}) WHERE ident IS NOT NULL AND day IS NOT NULL")
def src03(c: Civic) -> DataFrame:
    rows = c.spark.sql(MEETING_ROWS, customer=c.customer)
    found = None
    for n, (kind, names) in enumerate(con.FIELDS.items()):
        entry = F.struct(*[F.col(a).alias(b) for a, b in zip(("ident", "title", "day", "url"), names, strict=True)])
        dumps = rows.where(F.col("k") % 3 == n).groupBy("k").agg(F.to_json(F.collect_list(entry)).alias("raw"))
        one = dumps.select(F.lit(kind).alias("kind"), F.inline(con.meetings_in(F.col("raw"), kind)))
        found = one if found is None else found.unionByName(one)
    return found


@query("src03_meeting_pages", f"SELECT k AS page, title, strftime(CAST(replace(substring(day, 1, 10), '/', '-') AS DATE), '%Y-%m-%d') AS date, CASE WHEN url IS NOT NULL THEN url || '.pdf' END AS url FROM ({MEETING_ROWS}) WHERE day IS NOT NULL")
def src03_pages(c: Civic) -> DataFrame:
    rows = c.spark.sql(MEETING_ROWS, customer=c.customer)
    day = F.date_format(F.to_date(F.replace(F.substring("day", 1, 10), F.lit("/"), F.lit("-"))), "MMMM d, yyyy")
    link = F.when(F.col("url").isNotNull(), F.concat(F.lit('<a href="x.doc">a</a><a class="f" href="'), "url", F.lit('.pdf">b</a>'))).otherwise(F.lit(""))
    entry = F.concat(F.lit('<li class="row meeting-item">\n<b class="meeting-date"> '), F.coalesce(day, F.lit("soon")), F.lit('</b><span class="meeting-title x"><i>'), "title", F.lit("</i> </span>"), link, F.lit("</li>"))
    pages = rows.groupBy("k").agg(F.concat(F.lit("<html><ul>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</ul></html>")).alias("html"))
    return pages.select(F.col("k").alias("page"), F.inline(con.meetings_on_page(F.col("html"), "meeting-item", "meeting-date", "meeting-title"))).drop("source_id")


@query("src04_preferred_rows", "SELECT COALESCE(d.id, m.id) AS id, COALESCE(d.number, m.number) AS number FROM (SELECT MIN(p_partkey) AS id, p_partkey % 90 AS number FROM {part} WHERE p_size < 5 GROUP BY 2) d FULL JOIN (SELECT arg_max(p_partkey, (p_retailprice, -p_partkey)) AS id, p_partkey % 90 AS number FROM {part} WHERE p_size >= 5 GROUP BY 2) m ON m.number = d.number")
def src04(c: Civic) -> DataFrame:
    rows = c.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 90).alias("number"), "p_size", "p_retailprice")
    return con.preferred(rows.where("p_size < 5"), rows.where("p_size >= 5"), "number", [F.col("p_retailprice").desc(), F.col("id")]).select("id", "number")


@query("src05_decoded_text", "SELECT page_id, md5(html) AS digest FROM {pages}")
def src05(c: Civic) -> DataFrame:
    return c.pages.select("page_id", F.md5(con.decoded(F.encode("html", "UTF-8"))).alias("digest"))


@query("src07_feed_items", "SELECT r_regionkey AS id, k AS place, 'T' || CAST(k AS STRING) || ' ' || r_name AS title, '/l' || CAST(k AS STRING) AS link FROM {region}, (SELECT unnest(range(0, 5)) AS k)")
def src07(c: Civic) -> DataFrame:
    item = lambda k: F.concat(F.lit(f"<item><title><![CDATA[T{k} "), F.col("r_name"), F.lit(f"]]></title><link>/l{k}</link><pubDate>d</pubDate></item>"))
    feed = F.concat(F.lit("<rss>"), *[item(k) for k in range(7)], F.lit("</rss>"))
    return c.region.select(F.col("r_regionkey").alias("id"), F.posexplode(con.feed_items(feed)).alias("k", "i")).select("id", F.col("k").cast("long").alias("place"), "i.title", "i.link")


@query("src08_folder_documents", "SELECT 'm/' || CAST(o_custkey AS STRING) AS folder, BOOL_OR(o_orderkey % 3 = 0) AS has_agenda, BOOL_OR(o_orderkey % 3 = 1) AS has_minutes, BOOL_OR(o_orderkey % 3 = 2) AS has_transcript, COUNT(*) AS files FROM {orders} GROUP BY o_custkey")
def src08(c: Civic) -> DataFrame:
    kind = F.element_at(F.array(F.lit("Agenda"), F.lit("Minutes"), F.lit("Transcript")), (F.col("o_orderkey") % 3).cast("int") + 1)
    return con.folder_documents(c.orders.select(F.concat(F.lit("m/"), F.col("o_custkey").cast("string"), F.lit("/"), kind, F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path")))


@query("src09_transcript_json", "SELECT event_id AS id, CAST(65 AS DOUBLE) AS start, CAST(70 AS DOUBLE) AS end_, event_type AS text FROM {events} UNION ALL SELECT event_id, value, value + 5, 'second' FROM {events}")
def src09(c: Civic) -> DataFrame:
    raw = F.concat(F.lit('{"segments": [{"timestamp": "1:05", "text": "'), F.col("event_type"), F.lit('"}, {"start": '), F.col("value").cast("string"), F.lit(', "text": "second"}]}'))
    rows = c.events.select(F.col("event_id").alias("id"), F.explode(con.transcript_segments(raw)).alias("s"))
    return rows.select("id", "s.start", F.col("s.end").alias("end_"), "s.text")


@query("snk06_sitemap", "SELECT id, '<url><loc>https://example.org/m-' || CAST(id AS STRING) || '</loc><lastmod>' || CAST(meeting_date AS STRING) || '</lastmod></url>' AS entry FROM {meetings}")
def snk06(c: Civic) -> DataFrame:
    return sinks.sitemap(c.meetings.select("id", F.col("meeting_date").alias("day")), "https://example.org", "m")


@query("snk06_api_json", "SELECT id, '{{\"id\":' || CAST(id AS STRING) || ',\"name\":\"' || name || '\"}}' AS body FROM {people}")
def snk06b(c: Civic) -> DataFrame:
    return sinks.api_json(c.people.select("id", "name"), "id")
