"""Agenda items, motions and words placed in a meeting's transcript."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import natural_key
from agora.operators.joins import overlapping, point_in_window

#: Words of titles and motions that say nothing about them; what recognisers hear instead of motions' words.
TITLE_JUNK = ["report", "dated", "council", "meeting", "recommendation", "attachment"]
MOTION_JUNK = ["publi", "heari", "meeti", "counc"]
HEARD = [("move your seat", "move receipt"), ("move to seat", "move receipt"), ("move receipt", "move receive")]
GENERIC_MOTION = ["move", "moved", "second", "carried", "opposed", "receipt", "receive", "recommend", "unanimous"]
#: Scores of a number said with a word before it, alone, of title words, of the first and last items; seconds
#: around an item's window, in which a match is early, and of an end without a mark.
NAMED, BARE, WORDS, SURE = 1.2, 1.0, 0.8, 2.0
AROUND, EARLY, TAIL = 30.0, 300.0, 10.0


def plain_words(text: Column) -> Column:
    """Lower case without anything but letters a-z, digits and white space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def numbered(segments: DataFrame) -> DataFrame:
    """Adds the place of each segment in its meeting from either end."""
    order = Window.partitionBy("meeting_id").orderBy("start_time", "id")
    return segments.withColumn("_at", F.row_number().over(order)).withColumn("_left", F.count(F.lit(1)).over(Window.partitionBy("meeting_id")) - F.col("_at"))


#: How many numbers in a row, and how many first characters of a word, a text and an item must share to be compared.
RUNS, GRAMS = 4, (4, 6, 8, 12, 16, 24)


def holding(texts: DataFrame, words: DataFrame) -> DataFrame:
    """text, word for every word (of four letters and digits or more) that lies in a text; each of both comes once.

    A word lies within one run of letters and digits. Runs and words that share the word's first characters meet once.
    """
    runs = texts.select("text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z0-9]{4,})"), 1))).alias("run"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda k: F.substr("run", k, F.lit(n)))
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*[F.when(F.length("run") >= n, grams(n)).otherwise(none) for n in GRAMS]))
    size = F.length("word")
    head = F.coalesce(*[F.when(size >= n, F.substring("word", 1, n)) for n in reversed(GRAMS)])
    a = runs.select("run").distinct().select("run", F.explode(F.array_distinct(every)).alias("_g"))
    known = a.join(words.select("word", head.alias("_h")), F.col("_g") == F.col("_h")).where(F.contains("run", F.col("word"))).select(F.col("run").alias("_run"), "word")
    return runs.join(known, F.col("run") == F.col("_run")).select("text", "word").distinct()


def nearest_said(asked: DataFrame, segments: DataFrame) -> DataFrame:
    """item_id, score, at, d for asked texts (meeting_id, text, item_id, score, expected): when a text was said last before the
    expected time and first after it (its first time without one), and how far from it; the times of a text are one sweep.
    """
    first = F.lit(float("-inf"))
    times = segments.select("meeting_id", "text", F.col("start_time").alias("at"), F.col("start_time").cast("double").alias("_when"), F.lit(0).alias("_turn"))
    both = times.unionByName(asked.withColumns({"_when": F.coalesce(F.col("expected").cast("double"), first), "_turn": F.lit(1)}), allowMissingColumns=True)
    of = Window.partitionBy("meeting_id", "text")
    up, down = of.orderBy("_when", "_turn"), of.orderBy(F.desc("_when"), F.desc("_turn"))
    near = lambda order: F.last("at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"_before": near(up), "_after": near(down), "_untimed": F.max((F.col("_turn") == 0) & F.col("at").isNull()).over(of)}).where("_turn = 1")
    places = F.when(F.col("_untimed"), F.array(F.lit(None).cast(times.schema["at"].dataType))).otherwise(F.array_compact(F.array("_before", "_after")))
    said = met.select("item_id", "score", "expected", F.explode(places).alias("at"))
    return said.select("item_id", "score", "at", F.when(F.col("expected").isNull(), F.col("at")).otherwise(F.abs(F.col("at") - F.col("expected"))).alias("d"))


def item_markers(items: DataFrame, segments: DataFrame) -> DataFrame:
    """item_id, at, score: where a transcript (meeting_id, id, start_time, text) most surely names an item.

    items: meeting_id, id, number, title, start_time (where it was expected, or null). A segment that says the item's number
    counts most, more with a word like item before it; a number of one part under 100 counts only so. Else two of the
    title's words, or its only one. Ties go to the nearest to the expected start, else to the earliest. A call to order is
    at the meeting's start; an adjournment at the earliest of the last 30 segments that mentions one.

    Equal texts of a meeting, equal numbers and equal titles are compared once, and only if they share numbers in a row or a
    word; of an item's best texts the nearest times are looked up, so that no segments are tried one by one.
    """
    digits = F.regexp_extract_all(F.coalesce("number", F.lit("")), F.lit(r"(\d+)"), 1)
    parts = F.array_join(digits, r"[\s.\-]+")
    small = (F.size(digits) == 1) & (F.length(digits[0]) < 3)
    kinds = r"(?:item|section|point|paragraph)"
    named = F.concat(F.lit(kinds + r"\s+"), parts)
    said = F.when(F.size(digits) == 0, None).when(small, F.concat(named, F.lit(r"(?!\.\d)\b"))).otherwise(F.concat(F.lit(kinds + r"?\s*(?<!\.)\b"), parts, F.lit(r"(?!\.\d)\b")))
    title = F.lower(F.coalesce("title", F.lit("")))
    wanted = F.filter(words_of(plain_words(F.col("title"))), lambda w: (F.length(w) > 3) & ~w.isin(TITLE_JUNK))
    i = items.select(
        F.col("meeting_id").alias("_m"), F.col("id").alias("item_id"), F.col("start_time").alias("expected"), said.alias("_said"), named.alias("_named"), F.array_join(F.slice(digits, 1, RUNS), " ").alias("_runs"),
        F.array_sort(wanted).alias("_words"), title.contains("call to order").alias("_opens"), (title.contains("termination") | title.contains("adjournment")).alias("_closes"),
    )
    s = numbered(segments.withColumn("text", F.lower("text")))
    same = F.col("meeting_id") == F.col("_m")
    # An adjournment's own mention comes before all else, and its earliest one; so it goes by time, not by the expected start.
    ends = s.where((F.col("_left") < 30) & F.col("text").rlike("terminate|adjourn")).groupBy("meeting_id").agg(F.min(F.struct("start_time")).alias("_end"))
    sure = lambda at: [F.col("item_id"), F.lit(False).alias("o"), F.lit(SURE).alias("score"), F.col(at).alias("at"), F.col(at).alias("d")]
    opened = i.where("_opens").join(s.where("_at = 1"), same).select(*sure("start_time"))
    closed = i.where("_closes and not _opens").join(ends, same).select(*sure("_end.start_time"))

    i = i.where("not _opens")
    texts = s.where("text is not null").select("meeting_id", "text").distinct()
    runs = F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)
    in_row = lambda n: F.transform(F.sequence(F.lit(1), F.size("_all") - n + 1), lambda k: F.array_join(F.slice("_all", k, n), " "))
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*[F.when(F.size("_all") >= n, in_row(n)).otherwise(none) for n in range(1, RUNS + 1)]))
    numbers = i.where("_said is not null").select("_m", "_said", "_named", "_runs").distinct()
    numbered_texts = texts.withColumn("_all", runs).select("meeting_id", "text", F.explode(F.array_distinct(every)).alias("_g"))
    spoken = numbered_texts.join(numbers, same & (F.col("_g") == F.col("_runs"))).where("regexp_like(text, _said)").select("meeting_id", "text", "_said", F.when(F.expr("regexp_like(text, _named)"), NAMED).otherwise(BARE).alias("score"))

    titles = i.where(F.size("_words") > 0).select("_m", "_words").distinct()
    each = titles.select("_m", "_words", F.explode("_words").alias("_word")).groupBy("_m", "_words", "_word").agg(F.count(F.lit(1)).alias("_copies"))
    held = holding(texts.select("text").distinct(), each.select(F.col("_word").alias("word")).distinct()).withColumnRenamed("text", "_text")
    hits = texts.join(held, F.col("text") == F.col("_text")).join(each, same & (F.col("word") == F.col("_word"))).groupBy("meeting_id", "text", "_words").agg(F.sum("_copies").alias("_hits"))
    worded = hits.where((F.col("_hits") >= 2) | (F.size("_words") == 1)).select("meeting_id", "text", "_words", (F.col("_hits") / F.size("_words") * WORDS).alias("score"))

    def asked(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
        top = found.withColumn("_top", F.max("score").over(Window.partitionBy("meeting_id", key))).where("score = _top").withColumnRenamed(key, "_key")
        return rows.join(top, same & (F.col(key) == F.col("_key"))).select("meeting_id", "text", "item_id", "score", "expected")

    numbers_heard = spoken.select(F.col("meeting_id").alias("_of"), F.col("_said").alias("_heard")).distinct()
    rest = i.join(numbers_heard, (F.col("_m") == F.col("_of")) & (F.col("_said") == F.col("_heard")), "left_anti")
    others = nearest_said(asked(i, spoken, "_said").unionByName(asked(rest, worded, "_words")), s).withColumn("o", F.lit(True))
    found = opened.unionByName(closed).unionByName(others)
    best = found.groupBy("item_id").agg(F.min(F.struct("o", (-F.col("score")).alias("s"), "d", "at", "score")).alias("b"))
    return best.select("item_id", "b.at", "b.score")


def placed_items(items: DataFrame, markers: DataFrame, bounds: DataFrame) -> DataFrame:
    """meeting_id, id, start_at, end_at of every item, in the order of its number: anchored by markers, else between anchors.

    Markers (item_id, at, score) must not go back in time; one that does replaces the anchor before it if it has the higher
    score and still lies after the anchor before that. The first and last item stand at the meeting's (bounds: meeting_id,
    opens, closes) start and shortly before its end unless anchored. The anchors depend on each other in order, so that a
    meeting's items are one ordered pass.
    """
    m = markers.select(F.col("item_id").alias("_i"), "at", "score")
    rows = items.join(m, F.col("id") == F.col("_i"), "left").join(bounds.withColumnRenamed("meeting_id", "_m"), F.col("meeting_id") == F.col("_m"))
    rows = rows.select("meeting_id", "id", natural_key(F.coalesce("number", F.lit(""))).alias("order"), F.col("at").cast("double").alias("at"), F.col("score").cast("double").alias("score"), F.col("opens").cast("double").alias("opens"), F.col("closes").cast("double").alias("closes"))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "id"], kind="stable").reset_index(drop=True)
        opens, closes, last = float(group["opens"].iloc[0]), float(group["closes"].iloc[0]), len(group) - 1
        anchors: list[tuple[int, float, float]] = []
        for k, at, score in zip(group.index, group["at"], group["score"], strict=True):
            if pd.isna(at):
                continue
            if not anchors or at >= anchors[-1][1]:
                anchors.append((k, at, score))
            elif score > anchors[-1][2] and at > (anchors[-2][1] if len(anchors) > 1 else opens - 1):
                anchors[-1] = (k, at, score)
        known = {k: at for k, at, _ in anchors}
        known.setdefault(last, closes - TAIL)
        if 0 not in known:
            known[0] = opens
        if not anchors:
            known[0] = opens if last else closes - TAIL
        starts = pd.Series(known).sort_index().reindex(range(last + 1)).interpolate(method="index")
        ends = starts.shift(-1).fillna(closes)
        return pd.DataFrame({"meeting_id": group["meeting_id"], "id": group["id"], "start_at": starts, "end_at": ends.where(ends > starts, starts + 2)})

    return rows.groupBy("meeting_id").applyInPandas(place, "meeting_id long, id long, start_at double, end_at double")


def motion_markers(motions: DataFrame, segments: DataFrame) -> DataFrame:
    """motion_id, at: where a transcript has a motion (meeting_id, id, text, start_at, end_at, closes: of its item).

    The most of the motion's longer words, by their first five letters, in a segment around the item's window; else the
    window's last segment that speaks of a motion at all; else the best segment anywhere, half as good if it is early and
    the item isn't. Motions to adjourn, or of an item that closes the meeting, take the latest of equals. Segments around a
    window are found by time, others by text.
    """
    long_words = F.transform(F.filter(words_of(plain_words(F.col("text"))), lambda w: F.length(w) > 4), lambda w: F.substring(w, 1, 5))
    telling = F.filter(long_words, lambda w: ~w.isin(MOTION_JUNK))
    low = F.lower(F.coalesce("text", F.lit("")))
    late = F.col("closes") | low.contains("terminate") | low.contains("adjourn")
    m = motions.select(F.col("meeting_id").alias("_m"), F.col("id").alias("motion_id"), F.when(F.size(telling) > 0, telling).otherwise(long_words).alias("_keys"), late.alias("_late"), "start_at", "end_at").where(F.size("_keys") > 0)
    heard = plain_words(F.col("text"))
    for wrong, right in HEARD:
        heard = F.replace(heard, F.lit(wrong), F.lit(right))
    s = segments.select("meeting_id", F.col("start_time").alias("at"), "id", heard.alias("_text")).withColumn("_starts", F.transform(F.filter(words_of(F.col("_text")), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5)))
    ends = F.col("_text").contains("termi") | F.col("_text").contains("adjou")
    hits = F.size(F.filter("_keys", lambda k: F.array_contains("_starts", k))) + F.when(F.col("_late") & ends, 2).otherwise(0)
    score = hits / F.size("_keys")
    generic = F.lit(False)
    for word in GENERIC_MOTION:
        generic |= F.col("_text").contains(word)
    fits = (score > 0.4) | (F.col("_late") & (score > 0.2))
    order = lambda rank, weight, turn: F.struct(rank.alias("rank"), (-weight).alias("w"), turn.alias("turn"), "at").alias("b")

    windows = m.select(F.col("_m").alias("meeting_id"), F.greatest(F.lit(0.0), F.col("start_at") - AROUND).alias("start"), (F.col("end_at") + AROUND).alias("end"), "motion_id", "_keys", "_late")
    local = point_in_window(s, windows, ["meeting_id"], at="at", closed="both").withColumnsRenamed({"w_motion_id": "motion_id", "w__keys": "_keys", "w__late": "_late"})
    rank = F.when(fits, 1).when(generic, 2)
    near = local.where(fits | generic).select("motion_id", order(rank, F.when(rank == 1, score).otherwise(0.0), F.when((rank == 2) | F.col("_late"), -F.col("at")).otherwise(F.col("at"))))

    # Anywhere: equal texts of a meeting and motions with equal words meet once, and only if they share a word or an end.
    texts = s.groupBy("meeting_id", "_text", (F.col("at") < EARLY).alias("_early")).agg(F.first("_starts").alias("_starts"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    m = m.withColumn("_key", F.array_join("_keys", " "))
    kinds = m.groupBy("_m", "_key", "_late").agg(F.first("_keys").alias("_keys"))
    same = F.col("meeting_id") == F.col("_m")
    pair = ["meeting_id", "_text", "_early", "_key", "_late"]
    shared = texts.select("meeting_id", "_text", "_early", F.explode(F.array_distinct("_starts")).alias("_x")).join(kinds.select("_m", "_key", "_late", F.explode(F.array_distinct("_keys")).alias("_y")), same & (F.col("_x") == F.col("_y"))).select(*pair)
    ended = texts.where(ends).join(kinds.where("_late"), same).select(*pair)
    met = shared.unionByName(ended).distinct().withColumnRenamed("meeting_id", "_of").withColumnsRenamed({"_text": "_said", "_early": "_soon", "_key": "_words", "_late": "_closing"})
    found = met.join(texts, (F.col("_of") == F.col("meeting_id")) & (F.col("_said") == F.col("_text")) & (F.col("_soon") == F.col("_early"))).withColumn("_keys", F.split("_words", " ")).withColumn("_late", F.col("_closing")).where(fits)
    found = found.withColumn("at", F.when(F.col("_late"), F.col("_last")).otherwise(F.col("_first")))
    turn = F.when(F.col("_late"), -F.col("at")).otherwise(F.col("at"))
    best = found.groupBy("_of", "_words", "_closing").agg(F.min(order(F.lit(3), score * F.lit(1.0), turn)).alias("whole"), F.min(order(F.lit(3), score * F.when(F.col("_early"), 0.5).otherwise(1.0), turn)).alias("halved"))
    far = m.join(best, (F.col("_m") == F.col("_of")) & (F.col("_key") == F.col("_words")) & (F.col("_late") == F.col("_closing"))).select("motion_id", F.when(F.col("start_at") >= EARLY, F.col("halved")).otherwise(F.col("whole")).alias("b"))
    return near.unionByName(far).groupBy("motion_id").agg(F.min("b").alias("b")).select("motion_id", "b.at")


def confident_windows(chosen: DataFrame) -> DataFrame:
    """id, end_at, confidence of items (meeting_id, id, place, start_at, score, method, closes) with a start.

    An item ends where the next one by place starts that doesn't start before it, else with the meeting. Starts that were
    there before are sure; of others, scores of 3.5 and more are high, of 2.5 medium. A meeting's items are few.
    """
    after = Window.partitionBy("meeting_id").orderBy("place", "id").rowsBetween(1, Window.unboundedFollowing)
    later = F.filter(F.collect_list("start_at").over(after), lambda t: t >= F.col("start_at"))
    closes = F.when(F.col("closes") > F.col("start_at"), F.col("closes"))
    level = F.when(F.col("method").isin("segment_link", "existing") | (F.col("score") >= 3.5), "high").when(F.col("score") >= 2.5, "medium").otherwise("low")
    return chosen.where("start_at is not null").select("id", F.coalesce(F.get(later, F.lit(0)), closes).alias("end_at"), level.alias("confidence"))


#: How far a speaker's turns must cover a word, and others may.
COVERED, COMPETING = 0.90, 0.10


def union_seconds(spans: list[tuple[float, float]], start: float, end: float) -> float:
    total, reach = 0.0, start
    for a, b in sorted(spans):
        a, b = max(a, reach), min(b, end)
        if b > a:
            total, reach = total + b - a, b
    return total


def supported(turns: list[tuple[float, float, str]], speaker: str, start: float, end: float) -> bool:
    """Whether a speaker's turns cover a stretch, and all others' together hardly do."""
    own = union_seconds([(a, b) for a, b, who in turns if who == speaker], start, end) / (end - start)
    other = union_seconds([(a, b) for a, b, who in turns if who != speaker], start, end) / (end - start)
    return own >= COVERED and other <= COMPETING


def units(tokens: list[dict]) -> list[dict]:
    """Words of tokens: a token that doesn't begin with a space goes on with the word before it."""
    out: list[dict] = []
    for t in tokens:
        if not out or t["text"][:1].isspace():
            out.append({"text": "", "start": t["start"], "end": t["end"], "first": t["k"], "last": t["k"], "reason": None})
        w = out[-1]
        w.update(text=w["text"] + t["text"], start=min(w["start"], t["start"]), end=max(w["end"], t["end"]), last=t["k"])
        if t["start"] == t["end"] and any(c.isalnum() for c in t["text"]):
            w["reason"] = "unmeasured_lexical_token"
    for w in out:
        if w["reason"] is None and w["end"] <= w["start"]:
            w["reason"] = "missing_measured_word_duration"
    return out


def utterances(tokens: list[dict], voices: list[tuple[float, float, str]]) -> list[dict]:
    """first, last, speaker, text, reason of a paragraph's tokens in order: words of one voice joined, others held alone."""
    out: list[dict] = []
    speaking = None
    for w in units(tokens):
        near = [v for v in voices if v[0] < w["end"] and v[1] > w["start"]]
        reason, who = w["reason"], None
        if reason is None:
            able = [s for s in sorted({v[2] for v in near}) if supported(near, s, w["start"], w["end"])]
            if len(able) != 1:
                reason = "mixed_or_insufficient_temporal_support"
            elif any(v[2] != able[0] for v in near):
                reason = "word_crosses_measured_voice_boundary"
            else:
                who = able[0]
        if who is not None and speaking is not None and out[-1]["speaker"] == who and supported(voices, who, speaking, w["end"]):
            out[-1].update(last=w["last"], text=out[-1]["text"] + w["text"])
            continue
        out.append({"first": w["first"], "last": w["last"], "speaker": who, "text": w["text"], "reason": reason})
        speaking = w["start"] if who is not None else None
    return [x | {"text": x["text"].strip()} for x in out]


def word_turns(parents: DataFrame, tokens: DataFrame, turns: DataFrame) -> DataFrame:
    """parent_id, first, last, speaker, text, reason, status: a paragraph's tokens as utterances of one voice, or held.

    parents: parent_id, text, start, end; tokens: parent_id, k, text, start, end; turns: parent_id, speaker, start, end.
    A word belongs to the only voice whose turns cover nine tenths of it while all others cover a tenth at most, unless
    another voice touches it; words without duration are held. Neighbouring words of a voice are joined while the
    whole is covered so, too. Every token is in exactly one row. status says whether the tokens make up the paragraph's
    text; a paragraph with tokens outside it or out of order is held as a whole. A paragraph is one ordered pass.
    """
    t = tokens.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("k", "text", "start", "end"))).alias("tokens"))
    v = turns.where("0 <= start and start < end").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker"))).alias("voices"))
    rows = parents.join(t, "parent_id").join(v, "parent_id", "left")

    @F.pandas_udf("array<struct<first: long, last: long, speaker: string, text: string, reason: string>>")
    def align(tokens: pd.Series, voices: pd.Series) -> pd.Series:
        return pd.Series([utterances(list(x), [] if y is None else [(z["start"], z["end"], z["speaker"]) for z in y]) for x, y in zip(tokens, voices, strict=True)])

    start, end = F.col("start"), F.col("end")
    inside = F.forall("tokens", lambda x: (start <= x["start"]) & (x["start"] <= x["end"]) & (x["end"] <= end))
    starts = F.transform("tokens", lambda x: x["start"])
    valid = (start >= 0) & (start < end) & inside & (starts == F.array_sort(starts))
    joined = F.array_join(F.transform("tokens", lambda x: x["text"]), "")
    held = rows.where(~valid).select("parent_id", F.col("tokens")[0]["k"].alias("first"), F.element_at("tokens", -1)["k"].alias("last"), F.lit(None).cast("string").alias("speaker"), joined.alias("text"), F.lit("invalid_input").alias("reason"), F.lit("held_invalid_input").alias("status"))
    status = F.when(F.trim(joined) == F.trim("text"), "alignment_candidate").otherwise("held_original_text_mismatch")
    aligned = rows.where(valid).select("parent_id", status.alias("status"), F.explode(align("tokens", "voices")).alias("u")).select("parent_id", "u.*", "status")
    return aligned.unionByName(held)


#: Announcements at a window's edge, and what makes them more than that.
CUE = r"(?i)\b(public (?:hearing|participation|input)|anybody wishing|anyone wishing|call for (?:a |the )?(?:first|second|third)|next (?:item|on)|moving on|close (?:the |this )?public|open (?:the |this )?public)"
CONTENT = r"(?i)\b(my name|i (?:am|live|reside|represent|support|oppose|would|want|ask|think|believe)|concern|because|however|our)\b"


def source_windows(items: DataFrame, segments: DataFrame, most_chars: int = 60_000, most_rows: int = 2000) -> DataFrame:
    """item_id, status, reason, segments (ids in order), excluded: what of a transcript an item's window (both ends) holds.

    A segment that the window cuts is left out if it is a short announcement, else the item is held; so is one without a
    window, without segments, or with too much for one review.
    """
    timed = items.withColumn("_fit", F.coalesce((F.col("start_time") >= 0) & (F.col("start_time") < F.col("end_time")), F.lit(False)))
    i = timed.where("_fit").select("meeting_id", F.col("id").alias("item_id"), "start_time", "end_time")
    met = overlapping(segments.select("meeting_id", "id", "start_time", "end_time", "text"), i, ["meeting_id"]).withColumnsRenamed({"b_item_id": "item_id", "b_start_time": "_s", "b_end_time": "_e"})
    text = F.coalesce("text", F.lit(""))
    cut = (F.col("start_time") < F.col("_s") - 0.01) | (F.col("end_time") > F.col("_e") + 0.01)
    aside = cut & (F.length(text) <= 350) & text.rlike(CUE) & ~text.rlike(CONTENT)
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("start_time", "id")))), lambda x: x["id"])
    g = met.groupBy("item_id").agg(F.max((cut & ~aside).cast("int")).alias("_cut"), ids(~cut).alias("segments"), ids(aside).alias("excluded"), F.sum(F.when(~cut, F.length(text))).alias("_chars"))
    reason = F.when(F.col("_cut") == 1, "window_cuts_unmeasured_source_segment").when(F.size("segments") == 0, "no_fully_bound_source_after_procedural_edges").when((F.size("segments") > most_rows) | (F.col("_chars") > most_chars), "source_window_requires_reviewed_chunking")
    found = timed.join(g, F.col("id") == F.col("item_id"), "left")
    why = F.when(~F.col("_fit"), "missing_aligned_window").when(F.col("item_id").isNull(), "no_source_transcript_in_window").otherwise(reason)
    none = F.array().cast("array<long>")
    return found.select(F.col("id").alias("item_id"), why.alias("reason"), "segments", "excluded").select("item_id", F.when(F.col("reason").isNull(), "ready").otherwise("held").alias("status"), "reason", F.when(F.col("reason").isNull(), F.col("segments")).otherwise(none).alias("segments"), F.when(F.col("reason").isNull(), F.col("excluded")).otherwise(none).alias("excluded"))


def merged_reviews(chunks: DataFrame, reviews: DataFrame, citations: DataFrame) -> DataFrame:
    """item_id, status: merged only if every chunk (item_id, chunk, segment_id) of an item has passed its review (item_id,
    chunk, passed), and no segment is cited twice or from another chunk (citations: item_id, chunk, segment_id)."""
    whole = chunks.select("item_id", "chunk").distinct().join(reviews.groupBy("item_id", "chunk").agg(F.bool_and("passed").alias("passed")), ["item_id", "chunk"], "left")
    reviewed = whole.groupBy("item_id").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("reviewed"))
    cited = citations.groupBy("item_id", "chunk", "segment_id").agg(F.count(F.lit(1)).alias("_n"))
    known = chunks.select("item_id", "chunk", "segment_id", F.lit(True).alias("_known")).distinct()
    bad = cited.join(known, ["item_id", "chunk", "segment_id"], "left").groupBy("item_id").agg(F.bool_or((F.col("_n") > 1) | F.col("_known").isNull()).alias("bad"))
    status = F.when(~F.col("reviewed"), "complete_reviewed_chunk_set_required").when(F.coalesce("bad", F.lit(False)), "chunk_evidence_overlap_or_wrong_source").otherwise("merged")
    return reviewed.join(bad, "item_id", "left").select("item_id", status.alias("status"))
