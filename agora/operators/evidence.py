"""What published votes and quotes rest on: formal motions in minutes, quotes in transcripts, motions across versions, a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions.text import motion_words

# --- formal motions in minutes ---------------------------------------------------------------------------------------

#: The lines that open a formal motion (its seconder, or the main motion resumed) and the one that ends it.
SECONDED = r"[ \t]*\*{0,2}SECONDED(?:[ \t]+BY)?[ \t]*[:;][^\n]*"
RESUMED = r"[ \t]*\*{0,2}(?:On[ \t]+(?:the[ \t]+)?(?:Main[ \t]+)?Motion(?:[ \t]+as[ \t]+amended)?|Voting[ \t]+resumed[ \t]+on[ \t]+(?:the[ \t]+)?Main[ \t]+Motion)[ \t]*:?[ \t]*\*{0,2}[ \t]*$"
OUTCOME = r"[ \t]*\*{0,2}(?:Motion[ \t]+)?(?:CARRIED(?:[ \t]+UNANIMOUSLY)?|NOT CARRIED|DEFEATED|WITHDRAWN|TABLED)\b[^\n]*"
#: A clerk's line of names and their vote, which is no part of a motion's body.
DECLARED = r"(?im)^[ \t]*(?:opposed|in favour|abstained)[ \t]*:[^\n]*(?:\n|$)"


def compact(text: Column) -> Column:
    """Lower case letters and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def formal_motions(minutes: DataFrame) -> DataFrame:
    """A row for each formal motion of minutes (doc, text): the span from a seconder's line, or a main motion resumed, to its outcome.

    doc, kind, anchor_at, named_at (without the blanks before it), body_at, outcome_at, outcome_end (offsets in characters from 0), source_at (of a seconded motion: the
    line before the seconder's, which has the mover), body, body_compact (without the clerk's lines of names), outcome. An
    anchor that meets the next one, or the end, without an outcome has none, and neither has one without a body. Spans of a
    text don't overlap. The text is cut at the lines that matter, in one pass and without a shuffle.
    """
    cut = F.split(F.coalesce("text", F.lit("")), f"(?imd)(?=^(?:{SECONDED}|{RESUMED}|{OUTCOME}))")
    head = lambda pattern, piece: F.regexp_extract(piece, f"(?imd)\\A{pattern}", 0)

    def described(piece: Column) -> Column:
        kind = F.when(head(SECONDED, piece) != "", "seconded_motion").when(head(RESUMED, piece) != "", "resumed_main_motion").when(head(OUTCOME, piece) != "", "outcome")
        return F.struct(kind.alias("kind"), F.concat(head(SECONDED, piece), head(RESUMED, piece), head(OUTCOME, piece)).alias("head"), piece.alias("text"))

    pieces = minutes.select("doc", "text", F.transform(cut, described).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ats"))
    ats = F.aggregate("p", start, lambda acc, x: F.struct((acc["at"] + F.length(x["text"])).alias("at"), F.concat(acc["ats"], F.array(acc["at"])).alias("ats")), lambda acc: acc["ats"])
    pairs = pieces.withColumn("ats", ats).select("doc", "text", F.posexplode("p").alias("k", "a"), "p", "ats").where(F.col("a.kind").isin("seconded_motion", "resumed_main_motion") & (F.col("k") + 1 < F.size("p")))
    rows = pairs.select("doc", "text", "a", F.get("p", F.col("k") + 1).alias("b"), F.get("ats", F.col("k")).alias("anchor_at"), F.get("ats", F.col("k") + 1).alias("outcome_at")).where("b.kind = 'outcome'")
    # the seconder's line is taken with its end, a main motion's heading without
    opened = F.length("a.head") + ((F.col("a.kind") == "seconded_motion") & (F.length("a.text") > F.length("a.head"))).cast("int")
    raw = F.substr("a.text", opened + 1)
    before = F.regexp_replace(F.substr("text", F.lit(1), F.col("anchor_at")), r"\s+$", "")
    source_at = F.when(F.col("a.kind") == "seconded_motion", F.length(before) - F.length(F.substring_index(before, "\n", -1))).otherwise(F.col("anchor_at"))
    found = rows.select(
        "doc", F.col("a.kind").alias("kind"), "anchor_at", (F.col("anchor_at") + F.length(F.regexp_extract("a.head", "^[ \t]*", 0))).alias("named_at"), (F.col("anchor_at") + opened).alias("body_at"), "outcome_at", (F.col("outcome_at") + F.length("b.head")).alias("outcome_end"), source_at.alias("source_at"),
        stripped(raw).alias("body"), compact(F.regexp_replace(raw, DECLARED, "\n")).alias("body_compact"), F.trim("b.head").alias("outcome"),
    )
    return found.where("body <> ''")


def owned_motions(motions: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (doc, block, kind, at, outcome_at, text), as a parser cut them, held against the formal motions of the minutes.

    Of each block: matching (formal motions with its words), own (1 if its outcome lies in the outcome of one with its words
    and kind that begins in the block, or before it with nothing between) and status: unique, repeated, or unowned. Of each
    formal motion: whether a block owns it, else it is a lead to what the parser missed.

    Formal motions don't overlap; so the last one that begins its outcome at or before a block's is the only one that can
    hold it: one sweep over the sorted offsets of each text and wording, no pairs.
    """
    here = motions.select("doc", "kind", F.col("body_compact").alias("words"), "outcome_at", F.struct("anchor_at", "named_at", "outcome_end").alias("span"))
    there = blocks.select("doc", "block", "kind", compact(F.col("text")).alias("words"), "outcome_at", "at")
    both = here.withColumns({"block": F.lit(None).cast("long"), "at": F.lit(None).cast("int"), "_turn": F.lit(0)}).unionByName(there.withColumns({"span": F.lit(None).cast(here.schema["span"].dataType), "_turn": F.lit(1)}))
    sweep = Window.partitionBy("doc", "kind", "words").orderBy("outcome_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("over", F.last("span", ignorenulls=True).over(sweep)).where("_turn = 1")
    inside = (F.col("outcome_at") < F.col("over.outcome_end")) & (F.col("at") <= F.col("over.named_at"))
    met = met.withColumn("own", F.coalesce(inside, F.lit(False)))
    counts = motions.groupBy("doc", F.col("body_compact").alias("words")).agg(F.count("*").alias("matching"))
    judged = met.join(counts, ["doc", "words"], "left").select("doc", "block", F.coalesce("matching", F.lit(0)).alias("matching"), F.col("own").cast("int").alias("own"), "over", "kind")
    status = F.when((F.col("matching") == 1) & (F.col("own") == 1), "unique").when(F.col("matching") > 1, "repeated").otherwise("unowned")
    taken = judged.where("own = 1").select("doc", "kind", F.col("over.anchor_at").alias("anchor_at")).distinct().withColumn("owned", F.lit(True))
    leads = motions.join(taken, ["doc", "kind", "anchor_at"], "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    return judged.select("doc", "block", "matching", "own", status.alias("status")), leads


# --- quotes in transcripts ------------------------------------------------------------------------------------------

#: Kinds of statements.
STATEMENT_TYPES = ["claim", "proposal", "objection", "recommendation", "financial", "public_input"]


def spaced(text: Column) -> Column:
    """Single spaces, none at the ends; null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def edged(text: Column) -> Column:
    """A text with a mark at both ends of every word: one is in the other as whole words if it is so marked."""
    return F.regexp_replace(text, r"(?U)(\w+)", "\u0001$1\u0001")


def is_span(start: Column, end: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(finite(start) & finite(end) & (start >= 0) & (start < end), F.lit(False))


def bound_statements(statements: DataFrame, source: DataFrame, stored: DataFrame, receipts: DataFrame, people: DataFrame, bucket: int = 60) -> DataFrame:
    """Statements tied to the transcript that they quote: statement, status (bound or why it is held), segment_ids, start_time, person_id, speaker_name.

    statements: statement, meeting_id, evidence, sha, indexes, quote, kind. source: the original transcript's segments
    (meeting_id, sha, k from 0 without gaps, speaker, text, start, end). stored: its rows as kept since (id, meeting_id,
    person_id, start_time, end_time, text). receipts: applied identities (segment_id, meeting_id, person_id, sha, active).
    people: id, name.

    The indexes must be a run without gaps of one speaker, and the quote be in their joined text, word for word, across
    segments' borders; each segment must be the only one of its time and text, and lie in exactly one stored row. The first
    rule that fails names the reason. A person is named if receipts give all rows the same one, whose name is nobody else's.
    """
    source = source.select("meeting_id", "sha", "k", "speaker", "text", "start", "end")
    size = source.groupBy(F.col("meeting_id").alias("_m")).agg(F.count("*").alias("n"), F.min("sha").alias("_sha"))
    twins = source.groupBy("meeting_id", "start", "end", "text").agg(F.count("*").alias("_same"))
    kept = stored.where(is_span(F.col("start_time"), F.col("end_time"))).select("id", F.col("meeting_id").alias("_m"), "start_time", "end_time", spaced(F.col("text")).alias("_text"))
    slot = lambda x: F.floor(x / bucket).cast("long")
    kept = kept.withColumn("_slot", F.explode(F.sequence(slot(F.col("start_time")), slot(F.col("end_time")))))
    valid = source.where(is_span(F.col("start"), F.col("end")) & (spaced(F.col("text")) != ""))
    holds = valid.join(kept, (F.col("meeting_id") == F.col("_m")) & (slot(F.col("start")) == F.col("_slot")) & (F.col("start_time") <= F.col("start")) & (F.col("end") <= F.col("end_time")) & F.contains("_text", spaced(F.col("text"))))
    holds = holds.groupBy("meeting_id", "k").agg(F.count("*").alias("_rows"), F.min("id").alias("_row"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("meeting_id", "start", "end", "text")]
    known = source.alias("s").join(twins.alias("t"), same).select("s.*", "_same").drop("sha").join(holds, ["meeting_id", "k"], "left")

    of_meeting = statements.join(size, F.col("meeting_id") == F.col("_m"), "left").drop("_m")
    first, last = F.element_at("indexes", 1), F.element_at("indexes", -1)
    listed = F.coalesce((F.size("indexes") > 0) & ~F.exists("indexes", lambda x: x.isNull()), F.lit(False))
    run = F.coalesce(listed & (first >= 0) & (last < F.col("n")) & (first <= last) & (F.size("indexes") == last - first + 1) & F.forall(F.transform("indexes", lambda x, i: x == first + i), lambda x: x), F.lit(False))
    before = (
        F.when(~F.col("evidence").eqNullSafe("transcript"), "spoken_statement_requires_transcript_not_recorded_vote_or_summary")
        .when(F.col("n").isNull(), "source_context_unavailable")
        .when(~F.col("sha").eqNullSafe(F.col("_sha")), "original_transcript_hash_missing_or_changed")
        .when(~listed, "source_indexes_required")
        .when(~run, "source_indexes_not_unique_contiguous_in_range")
    )
    early = of_meeting.withColumn("_why", before)
    each = early.where("_why is null").select("statement", "meeting_id", "quote", "kind", F.explode("indexes").alias("k")).join(known, ["meeting_id", "k"])
    good = is_span(F.col("start"), F.col("end")) & (spaced(F.col("text")) != "")
    per = each.groupBy("statement", "meeting_id", "quote", "kind").agg(
        F.countDistinct(F.coalesce("speaker", F.lit("Unknown"))).alias("_speakers"),
        F.min(F.coalesce("speaker", F.lit("Unknown"))).alias("_label"),
        spaced(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")).alias("_said"),
        F.min_by("start", "k").alias("_start"),
        F.min(F.when(~good | (F.col("_same") > 1) | ~F.coalesce(F.col("_rows") == 1, F.lit(False)), F.struct("k", F.when(~good, "invalid_original_segment").when(F.col("_same") > 1, "original_source_tuple_not_unique").otherwise("persisted_source_tuple_missing_or_ambiguous").alias("why")))).alias("_bad"),
        F.sort_array(F.collect_set("_row")).alias("_ids"),
    )
    quote = spaced(F.col("quote"))
    quoted = (quote != "") & F.contains(edged(F.col("_said")), edged(quote))
    after = (
        F.when(F.col("_speakers") > 1, "source_quote_crosses_raw_speakers")
        .when(~quoted, "exact_quote_absent_from_original_selected_segments")
        .when(~F.coalesce(F.col("kind").isin(STATEMENT_TYPES), F.lit(False)), "unsupported_statement_type")
        .otherwise(F.col("_bad.why"))
    )
    per = per.select("statement", after.alias("_late"), "_ids", "_start", "_label", F.col("meeting_id").alias("_meeting"))

    sure = receipts.where("active").select("segment_id", F.col("meeting_id").alias("_rm"), F.col("person_id").alias("_rp"), F.col("sha").alias("_rsha")).distinct()
    rows = per.where("_late is null").select("statement", "_meeting", F.explode("_ids").alias("id")).join(stored.select("id", "person_id"), "id").join(size, F.col("_meeting") == F.col("_m"))
    admitted = rows.join(sure, (F.col("id") == F.col("segment_id")) & (F.col("_meeting") == F.col("_rm")) & (F.col("person_id") == F.col("_rp")) & (F.col("_sha") == F.col("_rsha")), "left")
    admitted = admitted.groupBy("statement").agg(F.when((F.count("*") == F.count("_rp")) & (F.countDistinct("_rp") == 1), F.min("_rp")).alias("_person"))
    named = people.select(F.col("id").alias("_pid"), F.col("name").alias("_name"), F.lower(spaced(F.col("name"))).alias("_key"))
    alone = named.join(named.groupBy("_key").agg(F.count("*").alias("_n")).where("_n = 1"), "_key").select("_pid", "_name")
    admitted = admitted.join(alone, F.col("_person") == F.col("_pid")).select("statement", F.col("_pid").alias("person_id"), F.col("_name").alias("speaker_name"))

    found = early.select("statement", "_why").join(per, "statement", "left").join(admitted, "statement", "left")
    why = F.coalesce("_why", "_late")
    label = F.when(F.col("_label").rlike(r"(?i)^speaker_[0-9]+$"), F.col("_label")).otherwise("Unidentified speaker")
    ok = why.isNull()
    return found.select("statement", F.coalesce(why, F.lit("bound")).alias("status"), F.when(ok, F.col("_ids")).alias("segment_ids"), F.when(ok, F.col("_start")).alias("start_time"), "person_id", F.when(ok, F.coalesce("speaker_name", label)).alias("speaker_name"))


# --- motions across versions of their source -------------------------------------------------------------------------


def source_key(meeting: Column, sha: Column, offset: Column, order: Column) -> Column:
    """A motion's identity: the digest of where it stands in which version of the minutes."""
    parts = F.concat(F.lit('{"meeting_id": '), meeting.cast("string"), F.lit(', "source_offset": '), offset.cast("string"), F.lit(', "source_order": '), order.cast("string"), F.lit(', "source_sha256": "'), sha, F.lit('"}'))
    return F.sha2(parts, 256)


def canonical_plan(blocks: DataFrame, existing: DataFrame, meetings: DataFrame, days: int = 1) -> DataFrame:
    """Which known motion each block of the minutes is: meeting_id, ord, key, status, motion_id, previous_keys.

    blocks: meeting_id, sha, at, ord, text, unique (the formal motion is the text's only one with these words), own. existing:
    id, meeting_id, text, key, previous (earlier keys). meetings: id, day, body, and of their source source_day, source_body.

    A key, present or earlier, is followed first, else the same words; either counts only if the words are those of one block
    alone, or the key is the block's present one. A known motion goes to one block at most, and a block to one motion: what
    is not one to one is held, on both sides. While a meeting has motions that belong to no block, no new one is made.
    Statuses: source_date_not_bound, source_voting_body_not_bound, original_formal_occurrence_not_unique,
    ambiguous_legacy_or_source_body, unmapped_legacy_records, kept, new.

    All sides grow with the minutes, and digests take far more room than Spark expects of them: every join is sort-merged.
    """
    words = motion_words
    by_sort = lambda df: df.hint("merge")
    b = blocks.select("meeting_id", "ord", "unique", "own", words("text").alias("words"), source_key(F.col("meeting_id"), F.col("sha"), F.col("at"), F.col("ord")).alias("key"))
    b = b.withColumn("_bodies", F.count("*").over(Window.partitionBy("meeting_id", "words")))
    e = existing.select(F.col("id").alias("motion_id"), "meeting_id", words("text").alias("e_words"), F.col("key").alias("e_key"), F.coalesce("previous", F.array().cast("array<string>")).alias("previous"))
    current = b.select("meeting_id", F.col("words").alias("c_words"), F.col("key").alias("c_key"), (F.col("own") == 1).alias("c_own"))
    bound = e.join(by_sort(current), (e["meeting_id"] == current["meeting_id"]) & (F.col("e_key") == F.col("c_key")) & (F.col("e_words") == F.col("c_words")) & F.col("c_own"))
    bound = bound.select("motion_id", F.col("c_key").alias("bound_to"))
    e = e.join(by_sort(bound), "motion_id", "left")
    by_key = e.select("*", F.explode(F.array_distinct(F.filter(F.concat(F.array("e_key"), "previous"), lambda x: x.isNotNull()))).alias("_k"))
    slim = ["motion_id", "e_words", "e_key", "previous", "bound_to"]
    keyed = b.join(by_sort(by_key.drop("meeting_id")), F.col("key") == F.col("_k")).select("meeting_id", "ord", "key", "words", "_bodies", *slim)
    with_key = keyed.select("key").distinct()
    alike = b.join(by_sort(with_key), "key", "left_anti").join(by_sort(e.select(F.col("meeting_id").alias("_m"), *slim)), (F.col("meeting_id") == F.col("_m")) & (F.col("words") == F.col("e_words"))).select("meeting_id", "ord", "key", "words", "_bodies", *slim)
    fits = F.coalesce(F.col("bound_to") == F.col("key"), F.lit(False)) | ((F.col("_bodies") == 1) & (F.col("e_words") == F.col("words")))
    choices = keyed.unionByName(alike).where(fits).groupBy("meeting_id", "ord", "key").agg(F.count("*").alias("n"), F.min(F.struct(*slim)).alias("old"))
    rows = b.join(by_sort(choices.drop("meeting_id", "ord")), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    taken = rows.where("n = 1").groupBy(F.col("old.motion_id").alias("motion_id")).agg(F.count("*").alias("_takers"))
    state = e.join(by_sort(taken), "motion_id", "left").groupBy("meeting_id").agg(F.sum(F.col("_takers").isNull().cast("int")).alias("_left"), F.min(F.col("bound_to").isNotNull()).alias("_all_bound"))
    rows = rows.join(by_sort(state), "meeting_id", "left").join(by_sort(taken.withColumnRenamed("motion_id", "_taken")), (F.col("n") == 1) & (F.col("old.motion_id") == F.col("_taken")), "left")
    m = meetings.select(F.col("id").alias("meeting_id"), "day", "body", "source_day", "source_body")
    rows = rows.join(by_sort(m), "meeting_id", "left")
    unresolved = F.coalesce("_left", F.lit(0)) > 0
    fresh = (F.col("n") == 0) & ~unresolved & F.coalesce("_all_bound", F.lit(True))
    is_bound = (F.col("n") == 1) & F.coalesce(F.col("old.bound_to") == F.col("key"), F.lit(False))
    dated = F.coalesce(F.abs(F.datediff("day", "source_day")) <= days, F.lit(False))
    status = (
        F.when(~dated, "source_date_not_bound")
        .when(~F.coalesce(F.col("body") == F.col("source_body"), F.lit(False)), "source_voting_body_not_bound")
        .when(~F.col("unique") & ~(fresh & (F.col("own") == 1)) & ~is_bound, "original_formal_occurrence_not_unique")
        .when((F.col("n") > 1) | (F.coalesce("_takers", F.lit(0)) > 1) | ((F.col("_bodies") != 1) & ~fresh & ~is_bound), "ambiguous_legacy_or_source_body")
        .when((F.col("n") == 0) & unresolved, "unmapped_legacy_records")
        .when(F.col("n") == 1, "kept")
        .otherwise("new")
    )
    rows = rows.withColumn("status", status)
    moved = F.when(F.col("old.e_key").isNotNull() & (F.col("old.e_key") != F.col("key")), F.array("old.e_key")).otherwise(F.array().cast("array<string>"))
    kept = F.col("status") == "kept"
    return rows.select("meeting_id", "ord", "key", "status", F.when(kept, F.col("old.motion_id")).alias("motion_id"), F.when(kept, F.array_sort(F.array_distinct(F.concat("old.previous", moved)))).alias("previous_keys"))


# --- a ledger of what was published ------------------------------------------------------------------------------------

#: Entries of a ledger whose digests one task joins, on average.
ENTRIES = 4096


def batch_digest(entries: DataFrame, of_group: int = ENTRIES) -> DataFrame:
    """batch, n, digest of a ledger's entries (batch, digest, 64 hex digits): the same for the same entries in any order.

    Entries are dealt by their digests to groups of about ``of_group``, each joined in order and hashed; so are the groups.
    """
    sized = entries.join(entries.groupBy("batch").agg(F.count("*").alias("n")), "batch")
    groups = F.greatest(F.ceil(F.col("n") / of_group), F.lit(1))
    slot = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), groups)
    inner = sized.groupBy("batch", "n", slot.alias("slot")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256).alias("part"))
    return inner.groupBy("batch", "n").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "part"))), lambda x: x["part"]), ""), 256).alias("digest"))


def chained(heads: DataFrame) -> DataFrame:
    """batch, n, digest and head of batches (batch, n, digest): each head is the digest of the head before it and its batch's own.

    One row a batch; they are joined in one place, as a chain must be.
    """
    start = F.struct(F.lit("").alias("head"), F.array().cast("array<struct<batch: bigint, n: bigint, digest: string, head: string>>").alias("done"))

    def link(acc: Column, x: Column) -> Column:
        head = F.sha2(F.concat(acc["head"], x["digest"]), 256)
        return F.struct(head.alias("head"), F.concat(acc["done"], F.array(F.struct(x["batch"].cast("bigint").alias("batch"), x["n"].cast("bigint").alias("n"), x["digest"].alias("digest"), head.alias("head")))).alias("done"))

    ordered = heads.agg(F.sort_array(F.collect_list(F.struct("batch", "n", "digest"))).alias("b"))
    return ordered.select(F.explode(F.aggregate("b", start, link, lambda acc: acc["done"])).alias("x")).select("x.*")
