"""Readers of files as they come: text of unknown encoding, feeds, transcripts, folder archives, meeting dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Windows-1252 leaves undefined; where it differs from Latin-1, character by character.
UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
DIFFERENT = [b for b in range(0x80, 0xA0) if b not in UNDEFINED]


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if valid, else Windows-1252 where all its bytes are defined, else Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    undefined = latin.rlike("[" + "".join(map(chr, UNDEFINED)) + "]")
    windows = F.translate(latin, "".join(map(chr, DIFFERENT)), bytes(DIFFERENT).decode("windows-1252"))
    return F.when(F.is_valid_utf8(content), content.cast("string")).when(undefined, latin).otherwise(windows)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every file under a folder, which any of Spark's file systems may hold."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", decoded(F.col("content")).alias("text"))


def feed_items(xml: Column, most: int = 5) -> Column:
    """The first items of an RSS feed as structs of title, link and date, character data unwrapped."""
    items = F.slice(F.regexp_extract_all(xml, F.lit("(?s)<item\\b[^>]*>(.*?)</item>"), 1), 1, most)

    def part(item: Column, tag: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_extract(item, f"(?s)<{tag}\\b[^>]*>(.*?)</{tag}>", 1), "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", "$1"))

    return F.transform(items, lambda i: F.struct(part(i, "title").alias("title"), part(i, "link").alias("link"), part(i, "pubDate").alias("date")))


SEGMENT = "struct<start: double, start_time: double, timestamp: string, end: double, end_time: double, speaker: string, text: string>"


def transcript_segments(raw: Column) -> Column:
    """Segments of a transcript in JSON: a list, or under segments or chunks.

    A start is a number or MM:SS or H:MM:SS; a missing end is five seconds later. Null for other text.
    """
    listed = F.from_json(raw, f"array<{SEGMENT}>")
    held = F.from_json(raw, f"struct<segments: array<{SEGMENT}>, chunks: array<{SEGMENT}>>")
    found = F.when(F.trim(raw).startswith("["), listed).otherwise(F.coalesce(held["segments"], held["chunks"]))

    def clean(s: Column) -> Column:
        clock = F.aggregate(F.split(s["timestamp"], ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
        start = F.coalesce(s["start"], s["start_time"], clock)
        return F.struct(start.alias("start"), F.coalesce(s["end"], s["end_time"], start + 5).alias("end"), s["speaker"].alias("speaker"), s["text"].alias("text"))

    return F.transform(found, clean)


def folder_documents(files: DataFrame) -> DataFrame:
    """folder and which documents it has, from the paths of an archive's files (path)."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    has = lambda word: F.bool_or(name.contains(word)).alias(f"has_{word}")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(has("agenda"), has("minutes"), has("transcript"), F.count(F.lit(1)).alias("files"))


def preferred(directory: DataFrame, media: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the directory's if it has one, else the best of the media by order; directory rows without key stay."""
    from agora.operators.windows import first_of

    best = first_of(media.where(F.col(key).isNotNull()), [key], order).drop("place")
    known = directory.where(F.col(key).isNotNull())
    first = first_of(known, [key], [F.col("id")]).drop("place")
    rest = best.join(known.select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")
    return first.unionByName(rest, allowMissingColumns=True).unionByName(directory.where(F.col(key).isNull()), allowMissingColumns=True)


#: A source's names for a meeting's id, title, date and address, in its responses.
FIELDS = {
    "legistar": ("EventId", "EventBodyName", "EventDate", "EventInSiteURL"),
    "escribe": ("ID", "MeetingName", "StartDate", "Url"),
    "civicweb": ("Id", "Name", "MeetingDateTime", "Link"),
}


def meetings_in(raw: Column, kind: str) -> Column:
    """The meetings of a source's response in JSON, as structs of source_id, title, date and url; null for other text.

    A meeting without an id or a date is none.
    """
    ident, title, date, url = FIELDS[kind]
    rows = F.from_json(raw, f"array<struct<`{ident}`: string, `{title}`: string, `{date}`: string, `{url}`: string>>")
    made = F.transform(rows, lambda m: F.struct(m[ident].alias("source_id"), m[title].alias("title"), F.replace(F.substring(m[date], 1, 10), F.lit("/"), F.lit("-")).alias("date"), m[url].alias("url")))
    return F.filter(made, lambda m: m["source_id"].isNotNull() & (F.coalesce(m["date"], F.lit("")) != ""))


#: Characters that pages spell out; the ampersand last, since it begins the others.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def meetings_on_page(html: Column, entry: str, date: str, title: str, date_format: str = "MMMM d, yyyy") -> Column:
    """The meetings of a page that lists them, as structs of source_id (null), title, date and url (of the first PDF).

    entry, date and title: classes of the elements that hold a meeting, its date and its title; an entry ends where the next
    begins. One without a date in the format is none.
    """

    def inner(part: Column, name: str) -> Column:
        out = F.regexp_replace(F.regexp_extract(part, rf'(?s)<\w+[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</', 1), "<[^>]*>", " ")
        for entity, letter in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(letter))
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    parts = F.slice(F.split(html, rf'(?=<\w+[^>]*class="[^"]*\b{entry}\b)'), 2, 1_000_000_000)
    made = F.transform(parts, lambda p: F.struct(F.lit(None).cast("string").alias("source_id"), inner(p, title).alias("title"), F.try_to_date(inner(p, date), date_format).cast("string").alias("date"), F.regexp_extract(p, r'href="([^"]+\.pdf)"', 1).alias("url")))
    return F.transform(F.filter(made, lambda m: m["date"].isNotNull()), lambda m: F.struct(m["source_id"].alias("source_id"), m["title"].alias("title"), m["date"].alias("date"), F.when(m["url"] != "", m["url"]).alias("url")))


def meeting_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, source_id, title, date, url of the meetings in a folder's files, each a response of a source; files are shared out."""
    return text_files(spark, path).select("path", F.inline(meetings_in(F.col("text"), kind)))
