"""Documents: chunks, sections, links to agenda items, minutes, sentences with times."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.functions.names import common_sequence
from agora.functions.text import motion_words, polarity, question_key
from agora.operators.joins import point_in_window

#: Sizes of overlapping chunks, of packed sections, and below which either is dropped.
CHUNK, OVERLAP, LEAST_CHUNK = 1000, 200, 20
SECTION, LEAST_SECTION = 8000, 150


def chunk_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST_CHUNK) -> list[str]:
    """Stretches of ``size`` characters, each beginning ``overlap`` before where the last one ended.

    A stretch that isn't the text's last ends at its last line break, or, without any, at its last sentence end, if that is
    past seven tenths. The last one's end counts as if the text went on. Stretches of up to ``least`` characters go.
    """
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            mark = "\n" if text.find("\n", start, end) >= 0 else ". "
            if text.rfind(mark, start, end) - start > size * 0.7:
                end = text.rfind(mark, start, end) + 1
        out.append(text[start:end].strip())
        start = end - overlap
    return [x for x in out if len(x) > least]


def packed_paragraphs(text: str, size: int = SECTION, least: int = LEAST_SECTION) -> list[str]:
    """Paragraphs, or the lines of a text without a blank line, side by side up to a size; longer ones stay whole.

    Each counts one character more than it has, but for the first of all but the first section. Short sections go.
    """
    parts = [p.strip() for p in re.split(r"\n\s*\n", text)]
    if len(parts) == 1:
        parts = [p.strip() for p in text.split("\n")]
    packs: list[list[str]] = [[]]
    room = size
    for part in filter(None, parts):
        if packs[-1] and len(part) + 1 > room:
            packs.append([part])
            room = size - len(part)
        else:
            packs[-1].append(part)
            room -= len(part) + 1
    return [x for x in map("\n\n".join, packs) if len(x) >= least]


#: Bytes of text that a task splits at once (a longer single text is split alone).
SPLIT_BYTES = 1_000_000


def exploded(docs: DataFrame, key: str, column: str, split) -> DataFrame:
    """key, place, chunk for the list of strings that ``split`` makes of each text.

    A task holds the pieces of a bounded stretch of a batch, whatever the texts' lengths.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                done = ends[at] - sizes[at]
                stop = max(int(np.searchsorted(ends, done + SPLIT_BYTES, side="right")), at + 1)
                part = batch.slice(at, stop - at)
                pieces = [split(t or "") for t in part.column(1).to_pylist()]
                counts = [len(x) for x in pieces]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(pieces)), counts), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([k for n in counts for k in range(n)], pa.int32()), pa.array([x for p in pieces for x in p], pa.string())], names=[key, "place", "chunk"])
                at = stop

    rows = docs.select(F.col(key), F.col(column))
    return rows.mapInArrow(cut, T.StructType([rows.schema[key], T.StructField("place", T.IntegerType(), False), T.StructField("chunk", T.StringType())]))


def markdown_sections(text: Column) -> Column:
    """Structs of title and body, split at second-level headings; what precedes them is the introduction."""
    has = text.rlike("(?m)^## ")
    parts = F.split(F.concat(F.lit("\n"), text), "\n## ")
    first = F.struct(F.when(has, "Introduction").otherwise("Document Content").alias("title"), F.regexp_replace(parts[0], "^\\s+|\\s+$", "").alias("body"))
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("title"), F.regexp_replace(F.regexp_replace(p, "^[^\n]*\n?", ""), "^\\s+|\\s+$", "").alias("body")))
    return F.filter(F.concat(F.array(first), rest), lambda s: s["body"] != "")


def outermost_dropped(ranges: DataFrame) -> DataFrame:
    """Ranges (doc, id, first, last) that strictly contain no other of their document."""
    inner = ranges.select(F.col("doc").alias("_d"), F.col("id").alias("_i"), F.col("first").alias("_f"), F.col("last").alias("_l"))
    holds = (F.col("doc") == F.col("_d")) & (F.col("id") != F.col("_i")) & (F.col("first") <= F.col("_f")) & (F.col("_l") <= F.col("last")) & ((F.col("first") < F.col("_f")) | (F.col("_l") < F.col("last")))
    return ranges.join(inner, holds, "left_anti")


def merged_headings(sections: DataFrame, often: int = 5) -> DataFrame:
    """Sections whose title comes at least ``often`` times in a document as one, at the first one's place."""
    of = Window.partitionBy("doc", "title")
    counted = sections.withColumn("_n", F.count(F.lit(1)).over(of)).withColumn("_group", F.when(F.col("_n") >= often, F.min("place").over(of)).otherwise(F.col("place")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n")
    return counted.groupBy("doc", "title", F.col("_group").alias("place")).agg(texts.alias("text"), F.max("last_page").alias("last_page"), F.count(F.lit(1)).alias("parts"))


#: A title is long enough to compare beyond this, an item's plain title from this; characters of words in common
#: that link; an item with more sections than this keeps its first ones.
LONG_TITLE, LONG_ITEM, COMMON, OVERLINKED, KEPT = 10, 10, 15, 10, 3
#: Characters by which titles that lie in each other are found.
GRAM = 8


def linked_items(sections: DataFrame, items: DataFrame) -> DataFrame:
    """doc, place, item_id, how: each section's agenda item (id, meeting_id, number, title) of the same meeting.

    By the number that its title (meeting_id, doc, place, title) begins with; else by a title that lies in the other, whatever
    the case, if both are long enough, the first item; else by the longest sequence of three words or more in common, of 15
    characters or more. An item with more than ten sections keeps its first three. Titles that can't be linked don't meet:
    those in each other share the shorter one's first characters, those with words in common three words in a row. Equal
    titles of a meeting meet once, on either side.
    """
    i = items.select(F.col("meeting_id").alias("_m"), F.col("id").alias("item_id"), F.rtrim(F.trim("number"), F.lit(".")).alias("_n"), F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("_t"))
    s = sections.where(F.coalesce("title", F.lit("")) != "").select("meeting_id", "doc", "place", F.regexp_extract(F.trim("title"), r"^(\d+(?:\.\d+)*)", 1).alias("_number"), F.lower(F.trim("title")).alias("_title"), (F.length("title") > LONG_TITLE).alias("_long"))
    at = ["doc", "place"]
    numbers = i.groupBy("_m", "_n").agg(F.max("item_id").alias("item_id"))
    by_number = s.where("_number <> ''").join(numbers, (F.col("meeting_id") == F.col("_m")) & (F.col("_number") == F.col("_n"))).select(*at, F.struct(F.lit(1).alias("_how"), F.lit(0).alias("z"), "item_id").alias("b"))

    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - GRAM + 1, F.lit(1))), lambda k: F.substr(x, k, F.lit(GRAM))))
    head = lambda x: F.array(F.substr(x, F.lit(1), F.lit(GRAM)))
    of = ["meeting_id", "_title"]
    long_s = s.where(F.col("_long"))
    titles, names = long_s.select(*of).distinct(), i.groupBy("_m", "_t").agg(F.min("item_id").alias("item_id"))

    def held(of_s, of_i, inside: Column) -> DataFrame:
        a = titles.select(*of, F.explode(of_s(F.col("_title"))).alias("_g"))
        b = names.where(F.length("_t") > LONG_TITLE).select("_m", "item_id", "_t", F.explode(of_i(F.col("_t"))).alias("_h"))
        return a.join(b.hint("merge"), (F.col("meeting_id") == F.col("_m")) & (F.col("_g") == F.col("_h"))).where(inside).select(*of, "item_id")

    within = held(head, grams, F.contains("_t", F.col("_title"))).unionByName(held(grams, head, F.contains("_title", F.col("_t"))))
    by_title = within.groupBy(*of).agg(F.min("item_id").alias("item_id")).select(*of, "item_id", F.lit(2).alias("_how"), F.lit(0).alias("_size"))

    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", " "), r"\s+", " "))
    threes = lambda x: word_triples(F.split(x, " "))
    a = titles.select(*of, plain(F.col("_title")).alias("_a"))
    b = names.select("_m", "item_id", plain(F.col("_t")).alias("_b")).where(F.length("_b") >= LONG_ITEM).groupBy("_m", "_b").agg(F.min("item_id").alias("item_id"))
    met = a.withColumn("_g", F.explode(threes(F.col("_a")))).join(b.withColumn("_h", F.explode(threes(F.col("_b")))).hint("merge"), (F.col("meeting_id") == F.col("_m")) & (F.col("_g") == F.col("_h"))).select(*of, "item_id", "_a", "_b").distinct()
    by_words = met.withColumn("_size", common_sequence("_a", "_b")).where(F.col("_size") >= COMMON).select(*of, "item_id", F.lit(3).alias("_how"), "_size")

    told = by_title.unionByName(by_words).groupBy(*of).agg(F.min(F.struct("_how", (-F.col("_size")).alias("z"), "item_id")).alias("b"))
    told = told.select(F.col("meeting_id").alias("_of"), F.col("_title").alias("_as"), "b")
    by_text = long_s.join(told, (F.col("meeting_id") == F.col("_of")) & (F.col("_title") == F.col("_as"))).select(*at, "b")
    best = by_number.unionByName(by_text).groupBy(*at).agg(F.min("b").alias("b"))
    linked = best.select(*at, "b.item_id", F.element_at(F.array(*map(F.lit, ("number", "title", "words"))), F.col("b._how")).alias("how"))
    of_item = Window.partitionBy("item_id")
    ranked = linked.withColumn("_turn", F.row_number().over(of_item.orderBy(*at))).withColumn("_n", F.count("*").over(of_item))
    return ranked.where((F.col("_n") <= OVERLINKED) | (F.col("_turn") <= KEPT)).select(*at, "item_id", "how")


def word_triples(words: Column) -> Column:
    """Three words in a row, as they are, each once."""
    starts = F.sequence(F.lit(1), F.size(words) - 2)
    return F.when(F.size(words) >= 3, F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice(words, k, 3), " ")))).otherwise(F.array().cast("array<string>"))


def sentences(segments: DataFrame) -> DataFrame:
    """id, place, sentence, at: each segment's sentences with a time in proportion to the characters before them."""
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    rows = segments.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("place", "sentence"))
    length = lambda a: F.aggregate(F.transform(a, lambda s: F.length(s) + 1), F.lit(0), lambda s, x: s + x)
    before = length(F.slice("_parts", F.lit(1), F.col("place")))
    return rows.select("id", "place", "sentence", (F.col("start_time") + (F.col("end_time") - F.col("start_time")) * before / length(F.col("_parts"))).alias("at"))


def discussion_text(items: DataFrame, segments: DataFrame) -> DataFrame:
    """item_id, text: title, a rule, and "speaker: words" of all segments in the item's window (both ends), by start."""
    w = items.where("start_time is not null").select("meeting_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.col("id").alias("item_id"), "title")
    rows = point_in_window(segments.select("meeting_id", "id", "start_time", "speaker_name", "text"), w, ["meeting_id"], closed="both").withColumnsRenamed({"w_item_id": "item_id", "w_title": "title"})
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "id", F.concat_ws(": ", "speaker_name", "text").alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("item_id", "title").agg(lines.alias("_lines")).select("item_id", F.concat_ws("\n---\n", "title", "_lines").alias("text"))


def motion_blocks(minutes: DataFrame) -> DataFrame:
    """doc, start, block, outcome: stretches of minutes from "Moved by" to a result line, equal ones once."""
    found = F.regexp_extract_all("text", F.lit(r"(?si)(moved by.*?\b(?:carried|defeated|withdrawn|tabled)\b)"), 1)
    rows = minutes.select("doc", "text", F.posexplode(found).alias("place", "block"))
    rows = rows.withColumn("outcome", F.lower(F.regexp_extract("block", r"(?si)(carried|defeated|withdrawn|tabled)\s*$", 1))).withColumn("start", F.expr("locate(block, text)"))
    return rows.withColumn("_same", question_key("block")).groupBy("doc", "_same").agg(F.min(F.struct("start", "block", "outcome")).alias("b")).select("doc", "b.start", "b.block", "b.outcome")


def minutes_markdown(meetings: DataFrame, items: DataFrame, motions: DataFrame) -> DataFrame:
    """meeting_id, markdown: title, items in order, each with its motions and their results."""
    lines = motions.groupBy(F.col("agenda_item_id").alias("_i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text", "result"))), lambda m: F.concat(F.lit("- "), m["text"], F.lit(": **"), F.coalesce(m["result"], F.lit("no result")), F.lit("**"))), "\n").alias("_motions"))
    part = F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), "_motions")
    body = items.join(lines, F.col("id") == F.col("_i"), "left").groupBy(F.col("meeting_id").alias("_m")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("_body"))
    return meetings.join(body, F.col("id") == F.col("_m")).select(F.col("id").alias("meeting_id"), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("_body")).alias("markdown"))


def page_text(html: Column) -> Column:
    """Visible text of simple markup: scripts, styles, comments and tags out, the common entities decoded."""
    out = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, "(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), 1)


def ratio(a: Column, b: Column, junk: bool = True) -> Column:
    """Ratcliff-Obershelp similarity; null for a null side. ``junk``: letters that are common in a long text don't count.

    Equal pairs of texts of a batch are compared once.
    """

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        made: dict[tuple[str, str], float] = {}
        for pair in zip(x, y, strict=True):
            if None not in pair and pair not in made:
                made[pair] = SequenceMatcher(None, *pair, junk).ratio()
        return pd.Series([made.get(pair) for pair in zip(x, y, strict=True)], dtype="float64")

    return alike(a, b)


#: Words of a motion that its source may lack.
SMALL_WORDS = ["the", "a", "an", "that", "to", "of", "for", "and", "be", "is", "as", "by", "with", "it", "its", "on", "in", "at", "from", "this", "these", "those"]


def motion_sources(motions: DataFrame, blocks: DataFrame, margin: float = 0.06) -> DataFrame:
    """doc, id, place, how: the block of the minutes (doc, place, text) that has a motion (doc, id, text, quote) word for word.

    It must be the only one, and no other block of the minutes may be within the margin of it. Where the motion's own text
    has none, its quote is tried, if both have the same amounts and turning words and the quote has all other words of it.
    """
    b = blocks.select(F.col("doc").alias("_d"), "place", motion_words("text").alias("_words")).where("_words <> ''")
    told = F.array_except(F.split(motion_words("text"), " "), F.array(*[F.lit(w) for w in SMALL_WORDS], F.lit("")))
    backed = (polarity("text") == polarity("quote")) & (F.size(told) > 0) & (F.size(F.array_except(told, F.split(motion_words("quote"), " "))) == 0)
    own = motions.select("doc", "id", motion_words("text").alias("target"), F.lit(1).alias("arm"))
    quoted = motions.where(F.col("quote").isNotNull() & backed).select("doc", "id", motion_words("quote").alias("target"), F.lit(2).alias("arm"))
    wanted = own.unionByName(quoted).where("target <> ''")
    same = wanted.join(b.hint("merge"), (F.col("doc") == F.col("_d")) & (F.col("target") == F.col("_words"))).groupBy("doc", "id", "arm", "target").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n")).where("n = 1")
    near = rivals(same.select("doc", "target").distinct(), b.select("_d", "_words").distinct(), margin)
    alone = same.join(near.hint("merge"), ["doc", "target"], "left_anti").withColumn("first", F.min("arm").over(Window.partitionBy("doc", "id"))).where("arm = first")
    return alone.select("doc", "id", "place", F.when(F.col("arm") == 1, "exact_motion_text").otherwise("verbatim_quote_exact_identity").alias("how"))


def rivals(targets: DataFrame, blocks: DataFrame, margin: float) -> DataFrame:
    """The (doc, target) that another text of their document (_d, _words) is like, with a ``ratio`` of more than 1 - margin.

    The blocks of a ratio are a common subsequence, so that no more edits than what it lacks of 1, times both lengths, lie between
    the texts: most pairs have more, which costs far less to find than the ratio. One text within the other is one block.
    """
    total = F.length("target") + F.length("_words")
    met = targets.join(blocks.hint("merge"), (F.col("doc") == F.col("_d")) & (F.col("target") != F.col("_words")) & (2 * F.least(F.length("target"), F.length("_words")) > (1 - margin) * total))
    most = F.floor(margin * total).cast("int") + 1
    edits = F.when(F.contains("target", F.col("_words")) | F.contains("_words", F.col("target")), -2).otherwise(F.expr("levenshtein(target, _words, most)"))
    close = met.withColumn("most", most).select("doc", "target", "_words", edits.alias("edits"))
    sure = close.where("edits = -2").select("doc", "target")
    like = close.where("edits >= 0").where(ratio(F.col("target"), F.col("_words"), junk=False) > 1 - margin).select("doc", "target")
    return sure.unionByName(like)
