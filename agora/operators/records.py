"""Record linkage of people, streets and bylaws; participants; queues and schedules; what the records work needs besides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.documents import ratio
from agora.functions.names import clean_name, name_score
from agora.operators.aggregates import n


def alike_surnames(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """_a, _b of distinct surnames (left _a, right _b) that are alike: by Ratcliff-Obershelp's ratio, or one within the other.

    Two that are so alike share two neighbouring letters and have lengths not far apart, and a contained one's first two
    letters are in the other; only such pairs are compared. Surnames of one letter are compared by that letter.
    """
    grams = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda k: F.substr(x, k, F.lit(2))))
    letters = lambda x: F.array_distinct(F.split(x, ""))
    a, b = left.where("_a <> ''").distinct(), right.where("_b <> ''").distinct()
    band = lambda x: F.floor(F.length(x) / 8).cast("int")
    near = a.select("_a", F.explode(grams(F.col("_a"))).alias("g"), band(F.col("_a")).alias("w")).join(b.select("_b", F.explode(grams(F.col("_b"))).alias("g"), F.explode(F.sequence(band(F.col("_b")) - 1, band(F.col("_b")) + 1)).alias("w")), ["g", "w"])
    near = near.where(F.abs(F.length("_a") - F.length("_b")) <= (1 - least) * (F.length("_a") + F.length("_b")))
    keys = lambda x: F.when(F.length(x) == 1, x).otherwise(F.substr(x, F.lit(1), F.lit(2)))
    parts = lambda x: F.concat(grams(x), letters(x))
    within = a.select("_a", keys(F.col("_a")).alias("g")).join(b.select("_b", F.explode(F.array_distinct(parts(F.col("_b")))).alias("g")), "g").where(F.contains("_b", F.col("_a")))
    around = b.select("_b", keys(F.col("_b")).alias("g")).join(a.select("_a", F.explode(F.array_distinct(parts(F.col("_a")))).alias("g")), "g").where(F.contains("_a", F.col("_b")))
    sure = within.select("_a", "_b").unionByName(around.select("_a", "_b")).distinct()
    close = near.select("_a", "_b").distinct().join(sure, ["_a", "_b"], "left_anti").where(ratio(F.col("_a"), F.col("_b")) >= least)
    return sure.unionByName(close)


def match_people(names: DataFrame, people: DataFrame) -> DataFrame:
    """row_id, person_id, how of each name: the same name (exact), else the only person of that surname (surname), else the
    first person, by id, who may be the same (alike): surnames are alike, and first names are (0.8), or one is an initial that
    the other begins with, or one side has none. Different spellings are compared once, however many rows have them.
    """
    spelt = F.lower(clean_name("name"))
    p = people.select(F.col("id").alias("person_id"), spelt.alias("_name")).where("_name <> ''").groupBy("_name").agg(F.min("person_id").alias("person_id"), F.count("*").alias("_n"))
    p = p.withColumn("_last", F.substring_index("_name", " ", -1))
    rows = names.select("row_id", spelt.alias("_own")).where("_own <> ''")
    own = rows.select("_own").distinct().withColumn("_own_last", F.substring_index("_own", " ", -1))
    exact = own.join(p, F.col("_own") == F.col("_name")).select("_own", "person_id", F.lit("exact").alias("how"))
    left = own.join(exact.select("_own"), "_own", "left_anti")
    single = p.groupBy("_last").agg(F.min("person_id").alias("person_id"), F.sum("_n").alias("_n")).where("_n = 1")
    surname = left.join(single, F.col("_own_last") == F.col("_last")).select("_own", "person_id", F.lit("surname").alias("how"))
    left = left.join(surname.select("_own"), "_own", "left_anti")
    pairs = alike_surnames(left.select(F.col("_own_last").alias("_a")), p.select(F.col("_last").alias("_b")))
    met = left.join(pairs, F.col("_own_last") == F.col("_a")).join(p, F.col("_b") == F.col("_last"))
    first = lambda x: F.when(F.contains(x, F.lit(" ")), F.substring_index(x, " ", 1)).otherwise(F.lit(""))
    met = met.withColumn("_f", first(F.col("_own"))).withColumn("_g", first(F.col("_name")))
    initial = lambda x: (F.length(x) == 1) | ((F.length(x) == 2) & x.endswith("."))
    either = initial(F.col("_f")) | initial(F.col("_g"))
    same_start = F.substring("_f", 1, 1) == F.substring("_g", 1, 1)
    simple = met.withColumn("_ok", F.when((F.col("_f") == "") | (F.col("_g") == "") | (F.col("_f") == F.col("_g")), True).when(either, same_start))
    doubtful = simple.where("_ok is null").select("_f", "_g").distinct().where(ratio(F.col("_f"), F.col("_g")) >= 0.8).withColumn("_near", F.lit(True))
    fits = simple.join(doubtful, ["_f", "_g"], "left").where(F.coalesce("_ok", "_near", F.lit(False)))
    alike = fits.groupBy("_own").agg(F.min("person_id").alias("person_id")).select("_own", "person_id", F.lit("alike").alias("how"))
    return rows.join(exact.unionByName(surname).unionByName(alike), "_own").select("row_id", "person_id", "how")


def resolved(candidates: DataFrame, key: str, score: str, margin: float = 0.06) -> DataFrame:
    """Each key's best candidate if it leads the next one by more than a margin."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), "candidate")
    rows = candidates.withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead(score).over(order))
    return rows.where((F.col("_k") == 1) & (F.col("_next").isNull() | (F.col(score) - F.col("_next") > margin))).select(key, "candidate", score)


def streets(names: DataFrame, known: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """row_id, street, how: the same street, an alias, or the only one of the same kind (last word) one edit away."""
    alias = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.lit(None)
    own = names.withColumn("_own", F.lower(F.trim("street"))).withColumn("_alias", alias[F.lower(F.trim("street"))] if aliases else alias)
    k = known.select(F.lower("street").alias("_street")).distinct().withColumn("_kind", F.substring_index("_street", " ", -1))
    exact = own.join(k, F.coalesce("_alias", "_own") == F.col("_street")).select("row_id", F.col("_street").alias("street"), F.when(F.col("_alias").isNotNull(), "alias").otherwise("exact").alias("how"), F.lit(1).alias("_s"))
    near = own.join(k, (F.substring_index("_own", " ", -1) == F.col("_kind")) & F.levenshtein("_own", "_street", 1).between(0, 1))
    one = near.groupBy("row_id").agg(F.min("_street").alias("street"), F.count(F.lit(1)).alias("_n")).where("_n = 1").select("row_id", "street", F.lit("one_edit").alias("how"), F.lit(2).alias("_s"))
    best = exact.unionByName(one).groupBy("row_id").agg(F.min(F.struct("_s", "street", "how")).alias("b"))
    return best.select("row_id", "b.street", "b.how")


def bylaw_links(bylaws: DataFrame, matters: DataFrame, amendments: DataFrame) -> DataFrame:
    """matter_id, number, rank: a matter's own bylaw (1) or, without, an older one that its own amends (2).

    The lowest rank wins; several numbers at it are ambiguous and link nothing. Aliases count for their canonical matter.
    """
    m = matters.select(F.coalesce("canonical_id", "id").alias("matter_id"), "number", "year")
    b = bylaws.select(F.col("number").alias("_number"), F.col("year").alias("_year"))
    own = m.join(b, F.col("number") == F.col("_number")).select("matter_id", "number", F.lit(1).alias("rank"))
    a = amendments.select(F.col("number").alias("_by"), F.col("amends").alias("_amends"))
    amended = m.join(a, F.col("number") == F.col("_by")).join(b, (F.col("_amends") == F.col("_number")) & (F.col("_year") <= F.col("year"))).select("matter_id", F.col("_amends").alias("number"), F.lit(2).alias("rank"))
    rows = own.unionByName(amended).distinct().withColumn("_best", F.min("rank").over(Window.partitionBy("matter_id"))).where("rank = _best")
    return rows.groupBy("matter_id").agg(F.min("number").alias("number"), F.first("rank").alias("rank"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def participants(segments: DataFrame, meetings: DataFrame, officials: DataFrame, today: str, recent: int = 6, top: int = 5) -> DataFrame:
    """Per public participant: seconds, segments, meetings, first and last date, top categories and recent meetings.

    Only speech of positive finite length up to today counts, and not of people who were officials on the day.
    """
    dated = segments.where("person_id is not null and end_time > start_time").join(meetings.select(F.col("id").alias("_m"), "meeting_date"), F.col("meeting_id") == F.col("_m")).where(F.col("meeting_date") <= F.lit(today).cast("date"))
    o = officials.select(F.col("person_id").alias("_o"), "start_date", "end_date")
    serving = (F.col("person_id") == F.col("_o")) & (F.col("start_date").isNull() | (F.col("start_date") <= F.col("meeting_date"))) & (F.col("end_date").isNull() | (F.col("meeting_date") <= F.col("end_date")))
    public = dated.join(o, serving, "left_anti").withColumn("_sec", F.col("end_time") - F.col("start_time"))
    totals = public.groupBy("person_id").agg(F.round(F.sum(F.col("_sec").cast("decimal(18,3)")), 1).cast("double").alias("seconds"), F.count(F.lit(1)).alias("segments"), F.countDistinct("meeting_id").alias("meetings"), F.min("meeting_date").alias("first_date"), F.max("meeting_date").alias("last_date"))
    kinds = public.groupBy("person_id", F.coalesce("category", F.lit("Public")).alias("kind")).agg(F.count(F.lit(1)).alias("_n"))
    kinds = kinds.withColumn("_k", F.row_number().over(Window.partitionBy("person_id").orderBy(F.col("_n").desc(), "kind"))).where(F.col("_k") <= top)
    kinds = kinds.groupBy(F.col("person_id").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "kind"))), lambda x: x["kind"]), ",").alias("categories"))
    seen = public.groupBy("person_id", "meeting_id", "meeting_date").agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.withColumn("_k", F.row_number().over(Window.partitionBy("person_id").orderBy(F.col("meeting_date").desc(), F.col("meeting_id").desc()))).where(F.col("_k") <= recent)
    seen = seen.groupBy(F.col("person_id").alias("_q")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "meeting_id"))), lambda x: x["meeting_id"].cast("string")), ",").alias("recent"))
    return totals.join(kinds, F.col("person_id") == F.col("_p")).join(seen, F.col("person_id") == F.col("_q")).drop("_p", "_q")


def title_status(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.contains("cancel"), "cancelled").when(low.contains("postpone") | low.contains("resched"), "postponed").otherwise("scheduled")


def calendar_events(events: DataFrame, types: Mapping[str, str], today: str, days: int = 180) -> DataFrame:
    """Events from today on for some days, each id once (the last seen), with their type and status."""
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.lower("kind")]
    day = F.lit(today).cast("date")
    rows = events.where((F.col("event_date") >= day) & (F.col("event_date") <= F.date_add(day, days)))
    once = rows.groupBy("source_id").agg(F.max_by(F.struct("event_date", "kind", "title"), "seen").alias("e")).select("source_id", "e.*")
    return once.select("source_id", "event_date", F.coalesce(kind, F.lit("other")).alias("type"), title_status(F.col("title")).alias("status"))


def incoming_term(terms: DataFrame, today: str) -> DataFrame:
    """The earliest term that is still to come."""
    return terms.where(F.col("start_date") > F.lit(today).cast("date")).orderBy("start_date", "id").limit(1)


def relinked(documents: DataFrame, items: DataFrame, choices: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, item_id of documents without an item whose supplied choice is probable enough and in the same meeting."""
    i = items.select(F.col("id").alias("_i"), F.col("meeting_id").alias("_m"))
    c = choices.where(F.col("probability") >= least).select(F.col("doc_id").alias("_d"), "item_id")
    return documents.where("item_id is null").select("doc_id", "meeting_id").join(c, F.col("doc_id") == F.col("_d")).join(i, (F.col("item_id") == F.col("_i")) & (F.col("meeting_id") == F.col("_m"))).select("doc_id", "item_id")


def bulk_selection(directory: DataFrame, media: DataFrame) -> DataFrame:
    """source, id, number, reason of every candidate: selected, or why not.

    Directory rows come first, one per number. Media rows count only for new numbers, if they read as bylaws, once per
    text hash; of a number the adopted, consolidated and newest one is taken.
    """
    first = Window.partitionBy("number").orderBy("id")
    d = directory.withColumn("_k", F.row_number().over(first)).select(F.lit("directory").alias("source"), "id", "number", F.when(F.col("_k") == 1, "selected").otherwise("same number").alias("reason"))
    known = directory.select(F.col("number").alias("_known")).distinct()
    m = media.join(known, F.col("number") == F.col("_known"), "left")
    usable = F.col("_known").isNull() & F.col("is_bylaw")
    m = m.withColumn("_use", usable).withColumn("_hash", F.row_number().over(Window.partitionBy("text_hash", "_use").orderBy("id")))
    fit = F.col("_use") & (F.col("_hash") == 1)
    m = m.withColumn("_fit", fit).withColumn("_k", F.row_number().over(Window.partitionBy("number", "_fit").orderBy(F.col("adopted").desc(), F.col("consolidated").desc(), F.col("uploaded").desc(), "id")))
    why = F.when(F.col("_known").isNotNull(), "in directory").when(~F.col("is_bylaw"), "not a bylaw").when(F.col("_hash") > 1, "same text").when(F.col("_k") > 1, "older version").otherwise("selected")
    return d.unionByName(m.select(F.lit("media").alias("source"), "id", "number", why.alias("reason")))


def supported(segments: DataFrame, coverage: float = 0.90, competing: float = 0.10) -> DataFrame:
    """Whether the time evidence (coverage and competing shares) supports a speaker."""
    return segments.withColumn("supported", (F.col("coverage") >= coverage) & (F.col("competing") <= competing))


def attendance_groups(segments: DataFrame, recorded: DataFrame, council: DataFrame, staff: DataFrame) -> DataFrame:
    """Per meeting the council, staff and other participants, from records and from speech, each person or name once."""
    spoken = segments.select("meeting_id", "person_id", F.lower(F.trim("speaker_name")).alias("_name"))
    rows = spoken.unionByName(recorded.select("meeting_id", "person_id", F.lit(None).cast("string").alias("_name")))
    c = council.select(F.col("person_id").alias("_c")).distinct()
    s = staff.select(F.col("person_id").alias("_s")).distinct()
    rows = rows.join(c, F.col("person_id") == F.col("_c"), "left").join(s, F.col("person_id") == F.col("_s"), "left")
    who = F.coalesce(F.concat(F.lit("p"), F.col("person_id").cast("string")), F.col("_name"))
    kind = F.when(F.col("_c").isNotNull(), "council").when(F.col("_s").isNotNull(), "staff").otherwise("other")
    return rows.groupBy("meeting_id", kind.alias("kind")).agg(F.countDistinct(who).alias("people"))


def evidence_for_topics(statements: DataFrame, votes: DataFrame, most_statements: int = 15, most_votes: int = 10) -> DataFrame:
    """person_id, topic, kind, id: each person's latest statements and votes on a topic."""

    def latest(rows: DataFrame, k: int, kind: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("person_id", "topic").orderBy(F.col("day").desc(), F.col("id").desc()))
        return rows.withColumn("_k", place).where(F.col("_k") <= k).select("person_id", "topic", F.lit(kind).alias("kind"), "id")

    return latest(statements, most_statements, "statement").unionByName(latest(votes, most_votes, "vote"))


def quote_meetings(quotes: DataFrame, statements: DataFrame, prefix: int = 80) -> DataFrame:
    """quote_id, meeting_id: by day and the beginning of the text, else by a day with one meeting."""
    s = statements.groupBy(F.col("day").alias("_d"), F.substring(F.lower(F.trim("text")), 1, prefix).alias("_t")).agg(F.min("meeting_id").alias("_m"))
    one = statements.groupBy(F.col("day").alias("_day")).agg(F.min("meeting_id").alias("_one"), F.countDistinct("meeting_id").alias("_n")).where("_n = 1")
    q = quotes.withColumn("_key", F.substring(F.lower(F.trim("text")), 1, prefix))
    rows = q.join(s, (F.col("day") == F.col("_d")) & (F.col("_key") == F.col("_t")), "left").join(one, F.col("day") == F.col("_day"), "left")
    return rows.select("quote_id", F.coalesce("_m", "_one").alias("meeting_id"))


def unioned(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several kinds under one schema, columns that a kind lacks null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def number_mismatch(a: Column, b: Column) -> Column:
    """Whether both texts have numbers and share none."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1))
    return (F.size(numbers(a)) > 0) & (F.size(numbers(b)) > 0) & ~F.arrays_overlap(numbers(a), numbers(b))


def fingerprint(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, rows, digest: SHA-256 of a key's rows in order of their JSON."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*columns))))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sha2(body, 256).alias("digest"))


def coverage_status(meetings: DataFrame, motions: DataFrame) -> DataFrame:
    """id, status of each meeting's history: no source, held, missing or incomplete decisions, complete."""
    m = motions.groupBy(F.col("meeting_id").alias("_m")).agg(F.count(F.lit(1)).alias("_n"), n(F.col("result").isNull()).alias("_open"))
    none = ~(F.coalesce("has_agenda", F.lit(False)) | F.coalesce("has_minutes", F.lit(False)) | F.coalesce("has_transcript", F.lit(False)))
    status = F.when(none, "source unavailable").when(F.col("status") == "Cancelled", "held").when(F.col("_n").isNull(), "missing decisions").when(F.col("_open") > 0, "review required").otherwise("complete")
    return meetings.join(m, F.col("id") == F.col("_m"), "left").select("id", status.alias("status"))


def arbitrated_number(own: Column, listed: Column, unconfirmed: Column, source: Column, text: Column) -> Column:
    """number and note of a bylaw whose document and listing may say different numbers.

    The document's own number wins, but in a directory whose document amends the listed bylaw.
    """
    amends = F.coalesce(F.regexp_like(F.substring(text, 1, 4000), F.concat(F.lit(r"(?is)\bamend[^.]{0,160}?\bBylaw\s+No\.?\s*0*"), listed, F.lit(r"\b"))), F.lit(False))
    made = lambda number, *note: F.struct(number.alias("number"), F.concat(*note).alias("note"))
    none, blank = F.lit(""), F.lit(None).cast("string")
    has_own, has_listed = F.coalesce(own != "", F.lit(False)), F.coalesce(listed != "", F.lit(False))
    differs = has_own & (own != listed)
    return (
        F.when(~has_listed, F.when(has_own, made(own, F.lit("number from the PDF"))).otherwise(made(blank, none)))
        .when(unconfirmed & (own == listed), made(own, none))
        .when(unconfirmed, F.when(has_own, made(own, F.lit("title read "), listed, F.lit(", PDF is Bylaw "), own)).otherwise(made(blank, none)))
        .when(differs & (source == "directory") & amends, made(listed, F.lit("PDF is amending Bylaw "), own, F.lit("; listed as "), listed))
        .when(differs, made(own, F.lit("listed as "), listed, F.lit(", PDF is Bylaw "), own))
        .otherwise(made(listed, none))
    )


def seeded_memberships(roster: DataFrame, people: DataFrame, organizations: DataFrame, memberships: DataFrame) -> DataFrame:
    """person_id, organization_id, role, start_date, end_date of a roster's rows (name, organization, role, dates) that aren't
    there yet: names of people and organisations are looked up, and a role that a person has there already is left alone."""
    p, o = people.select(F.col("id").alias("person_id"), F.col("name").alias("_p")), organizations.select(F.col("id").alias("organization_id"), F.col("name").alias("_o"))
    rows = roster.join(p, F.col("name") == F.col("_p")).join(o, F.col("organization") == F.col("_o"))
    known = memberships.select("person_id", "organization_id", "role").distinct()
    return rows.join(known, ["person_id", "organization_id", "role"], "left_anti").select("person_id", "organization_id", "role", "start_date", "end_date")


def kept_links(decisions: DataFrame, least: Mapping[str, float]) -> DataFrame:
    """The decisions (kind, probability) that are sure enough for their kind; kinds without a limit, and nulls, go."""
    limit = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("kind")]
    return decisions.where(F.coalesce(F.col("probability") >= limit, F.lit(False)))
