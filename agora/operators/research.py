"""A person's trace in minutes and transcripts, and collages of images on a page."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names that one automaton holds; more are dealt to several, which each read the texts.
NAMES = 100_000


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def aliases(people: DataFrame) -> DataFrame:
    """person, alias, rank of people (person, name, also: other names): the name, the others, and of two words "A. Word"."""
    words = F.split(one_space(F.col("name")), " ")
    short = F.when((F.size(words) == 2) & (F.length(words[0]) > 1), F.concat(F.substring(words[0], 1, 1), F.lit(". "), words[1]))
    listed = F.filter(F.concat(F.array(one_space(F.col("name"))), F.transform(F.coalesce("also", F.array().cast("array<string>")), one_space), F.array(short)), lambda x: x.isNotNull() & (x != ""))
    return people.select("person", F.posexplode(F.array_distinct(listed)).alias("rank", "alias"))


def mentions(texts: DataFrame, names: DataFrame, most: int = NAMES) -> DataFrame:
    """doc, person, n, ends: how often a text (doc, text) has one of a person's names (person, alias, rank) as whole words,
    whatever the case and the white space, and where each mention ends in the text with single spaces.

    All names are sought in one pass over a text by an automaton; mentions of one person don't overlap, the leftmost
    counts, of several that begin there the alias with the least rank. The names are collected in parts of ``most`` on average.
    """
    import ahocorasick

    plain = texts.select("doc", one_space(F.col("text")).alias("text"))
    keyed = names.select("person", F.lower(one_space(F.col("alias"))).alias("alias"), "rank").where("alias <> ''")
    parts = max(1, -(-keyed.count() // most))
    out = None
    for part in range(parts):
        known = defaultdict(list)
        for row in keyed.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == part).collect():
            known[row["alias"]].append((row["person"], row["rank"]))

        def find(frames: Iterator[pd.DataFrame], known=dict(known)) -> Iterator[pd.DataFrame]:
            automaton = ahocorasick.Automaton()
            for alias, of in known.items():
                automaton.add_word(alias, (len(alias), of))
            if known:
                automaton.make_automaton()
            edge = lambda text, k: not (0 <= k < len(text)) or not (text[k].isalnum() or text[k] == "_")
            for frame in frames:
                rows = []
                for doc, text in zip(frame["doc"], frame["text"], strict=True):
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                    hits = defaultdict(list)
                    for last, (size, of) in automaton.iter(low) if known else ():
                        if edge(low, last - size) and edge(low, last + 1):
                            for person, rank in of:
                                hits[person].append((last + 1 - size, rank, last + 1))
                    rows += [(doc, person, begin, rank, end) for person, found in hits.items() for begin, rank, end in found]
                yield pd.DataFrame(rows, columns=["doc", "person", "begin", "rank", "end"])

        kind = {f.name: f.dataType.simpleString() for f in (*plain.schema, *keyed.schema)}
        found = plain.mapInPandas(find, f"doc {kind['doc']}, person {kind['person']}, begin int, rank int, end int")
        out = found if out is None else out.unionByName(found)
    spans = F.sort_array(F.collect_list(F.struct("begin", "rank", "end")))
    apart = F.aggregate(spans, F.array().cast("array<int>"), lambda ends, x: F.when((F.size(ends) > 0) & (x["begin"] < F.element_at(ends, -1)), ends).otherwise(F.concat(ends, F.array(x["end"]))))
    return out.groupBy("doc", "person").agg(apart.alias("ends")).select("doc", "person", F.size("ends").alias("n"), "ends")


#: What parts a name from a speech, how the next speaker looks, an address in a speech; lengths of an excerpt.
SEPARATOR, NEXT_SPEAKER = r"\s[-–—]\s", r"\s[A-Z]\.\s*[A-Z][a-z]+(?:[,\.]|\s+[A-Z][a-z]+)"
PLACE = r"\b\d{3,5}\s+.{0,35}?(?:Rd|Road|Dr|Drive|St|Street|Ave|Avenue|Pkwy|Lane|Terr|Pl|Place)\b"
SEEN, PARTED_WITHIN, EXCERPT = 500, 100, 260


def excerpt(text: Column, end: Column) -> Column:
    """What a text with single spaces says after a mention: from after a dash nearby, up to the next speaker, without addresses."""
    tail = F.substr(text, end + 1, F.lit(SEEN))
    dash = F.regexp_instr(F.substr(tail, F.lit(1), F.lit(PARTED_WITHIN)), F.lit(SEPARATOR))
    said = F.trim(F.when(dash > 0, F.substr(tail, dash + 3)).otherwise(tail))
    until = F.regexp_instr(said, F.lit(NEXT_SPEAKER))
    said = F.when(until > 0, F.substr(said, F.lit(1), until - 1)).otherwise(said)
    return F.rtrim(F.substr(F.regexp_replace(said, PLACE, "[address omitted]"), F.lit(1), F.lit(EXCERPT)))


def person_research(people: DataFrame, minutes: DataFrame, segments: DataFrame) -> DataFrame:
    """person, meeting_id, doc, name_mentions, excerpts, turns, timed_seconds of each person and meeting that has a trace of them.

    minutes: doc, meeting_id, text; of a meeting's documents the one with the most mentions, of equals the least doc. segments:
    meeting_id, speaker_name, start_time, end_time; those under one of the names, or one with "(public)" behind it, count.
    """
    names = aliases(people)
    found = mentions(minutes.select("doc", "text"), names).join(minutes.select("doc", "meeting_id"), "doc")
    best = found.groupBy("person", "meeting_id").agg(F.max_by(F.struct("doc", "n", "ends"), F.struct("n", -F.col("doc"))).alias("b"))
    text = minutes.select("doc", one_space(F.col("text")).alias("text"))
    told = best.select("person", "meeting_id", "b.doc", "b.n", "b.ends").join(text, "doc")
    excerpts = F.filter(F.transform("ends", lambda e: excerpt(F.col("text"), e)), lambda x: x != "")
    told = told.select("person", "meeting_id", "doc", F.col("n").alias("name_mentions"), excerpts.alias("excerpts"))
    labels = names.select("person", F.explode(F.array("alias", F.concat("alias", F.lit(" (public)")))).alias("speaker_name")).distinct()
    spoken = segments.join(labels, "speaker_name").groupBy("person", "meeting_id").agg(F.count("*").alias("turns"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))), 2).alias("timed_seconds"))
    zero = told.join(spoken, ["person", "meeting_id"], "full_outer")
    return zero.select("person", "meeting_id", "doc", F.coalesce("name_mentions", F.lit(0)).alias("name_mentions"), F.coalesce("excerpts", F.array().cast("array<string>")).alias("excerpts"), F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("timed_seconds", F.lit(0.0)).alias("timed_seconds"))


# --- images ---------------------------------------------------------------------------------------------------------


def collages(images: DataFrame, reach: float = 30.0) -> DataFrame:
    """page, id, collage: images (page, id, x0, y0, x1, y1) whose boxes are within ``reach`` of each other in both directions, and
    what is so joined to them, have the least id among them as their collage. An image without a box is alone.

    A page's boxes meet in the cells of a grid as wide as the reach: each is entered in the cells that it covers with half
    the reach around it, where any box within reach is entered, too. In a cell a box is compared with the groups that are
    there, and with a group's boxes only until one is near.
    """
    kind = {f.name: f.dataType.simpleString() for f in images.schema}

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        boxes = frame[["x0", "y0", "x1", "y1"]].to_numpy(float)
        lead = list(range(len(frame)))

        def root(k: int) -> int:
            while lead[k] != k:
                lead[k] = lead[lead[k]]
                k = lead[k]
            return k

        cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, (x0, y0, x1, y1) in enumerate(boxes):
            if not (x0 <= x1 and y0 <= y1):  # no box, or one that isn't known
                continue
            half = reach / 2
            for x in range(int((x0 - half) // reach), int((x1 + half) // reach) + 1):
                for y in range(int((y0 - half) // reach), int((y1 + half) // reach) + 1):
                    for j in cells[x, y]:
                        if root(j) != root(k) and max(x0 - boxes[j][2], boxes[j][0] - x1) <= reach and max(y0 - boxes[j][3], boxes[j][1] - y1) <= reach:
                            a, b = sorted((root(j), root(k)))
                            lead[b] = a
                    cells[x, y].append(k)
        return pd.DataFrame({"page": frame["page"], "id": frame["id"], "collage": frame["id"].to_numpy()[[root(k) for k in range(len(frame))]]})

    return images.groupBy("page").applyInPandas(unite, f"page {kind['page']}, id {kind['id']}, collage {kind['id']}")


#: Words of descriptions of images that show nothing; sizes in points of small graphics in a page's margins.
JUNK = [
    "logo", "signature", "letterhead", "header", "footer", "crest", "coat of arms", "watermark", "handwritten", "stamp", "seal", "branding", "meeting available", "teleconference",
    "electronic meeting", "council chambers", "zoom", "meeting id", "dial in", "raise your hand",
]
SMALL_WIDTH, SMALL_HEIGHT, LONG_SIDE, MARGIN = 520, 180, 2.0, 95


def margin_decoration(width: Column, height: Column, y0: Column, y1: Column, page_height: Column) -> Column:
    """Whether an image is a long, small graphic at the head or foot of its page; one without a box isn't."""
    small = (width > 0) & (height > 0) & (width <= SMALL_WIDTH) & (height <= SMALL_HEIGHT)
    long_ = F.greatest(width / F.nullif(height, F.lit(0)), height / F.nullif(width, F.lit(0))) >= LONG_SIDE
    return F.coalesce(small & long_ & ((y0 < MARGIN) | ((page_height > 0) & (y1 > page_height - MARGIN))), F.lit(False))


def junk_pattern() -> str:
    return rf"(?i)\b({'|'.join(JUNK)})\b"


def described(images: DataFrame, descriptions: DataFrame) -> DataFrame:
    """page, id, description of images (page, place, id): a page's images and descriptions (page, text: with [Image: ...] tags) in order.

    An image whose description has one of the words of ``JUNK`` goes; one beyond the descriptions stays without one.
    """
    tags = descriptions.select("page", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[Image(?:\s+\d+)?:\s*([^\]]+)\]"), 1)).alias("_k", "description"))
    order = F.row_number().over(Window.partitionBy("page").orderBy("place", "id")) - 1
    rows = images.withColumn("_k", order).join(tags, ["page", "_k"], "left")
    return rows.where(F.col("description").isNull() | ~F.col("description").rlike(junk_pattern())).select("page", "id", "description")
