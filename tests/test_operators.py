"""Small literal cases for what SQL doesn't express or random tables don't reach."""

from __future__ import annotations

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agora.functions import dates, matters, names, text
from agora.operators import alignment, documents, entities, filters, incremental, joins, matching, search, windows
from agora.operators import votes as voting


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("category, wanted", [("Street Trees", "Environment"), ("Street lighting", "Environment"), ("Waterworks", "General"), ("REZONING", "Bylaw"), (None, "General"), ("Road budget", "Finance")])
def test_topic_takes_the_first_that_fits(spark, category, wanted):
    assert spark.createDataFrame([(category,)], "c string").select(text.topic("c")).first()[0] == wanted


@pytest.mark.parametrize("title, wanted", [("Amendment - Third Reading", "Amendment"), ("Bylaw 5 (First Reading), Second Reading", "Bylaw 5"), ("Plain", "Plain"), ("Zoning - Adoption", "Zoning"), ("Rates - Adoption", "Rates - Adoption"), ("Bylaw 7 (SECOND AND THIRD READINGS)", "Bylaw 7"), ("Permit for adoption (background report attached)", "Permit")])
def test_stage_is_stripped(spark, title, wanted):
    assert one(spark, text.strip_stage("t"), t=title) == wanted


def test_slug_is_cut_between_words(spark):
    assert one(spark, text.slug_capped("t", 16), t="The Parks and the Trails of Town") == "the-parks"
    assert one(spark, text.slug_capped("t", 60), t="Something to look for") == "something-to-look-for"
    assert one(spark, text.slug_capped("t", 5), t="abcdefgh") == "abcde" and one(spark, text.slug_capped("t", 9), t="the parks of") == "the-parks"


def test_uuid5_is_that_of_the_standard_library(spark):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, text.uuid5(space, "t"), t="person/7é") == str(uuid.uuid5(uuid.UUID(space), "person/7é"))


def test_scrub(spark):
    assert one(spark, text.scrub("t"), t="mail a.b@c.org, 250-555-0101; 12 Oak Street") == "mail [contact omitted], [contact omitted]; Oak Street"


@pytest.mark.parametrize("t, wanted", [("on June 29, 2026 at", "2026-06-29"), ("x 2024_2_9", "2024-02-09"), ("2024-13-40", None), ("none", None)])
def test_date_in_text(spark, t, wanted):
    got = one(spark, dates.date_in_text("t"), t=t)
    assert (str(got) if got else None) == wanted


def test_versions_compare_by_number(spark):
    assert one(spark, dates.older_version("v", "1.10"), v="1.9") and not one(spark, dates.older_version("v", "1.9"), v="1.10")


@pytest.mark.parametrize("length, wanted", [(20, []), (21, [21]), (150, [150]), (900, [900, 100]), (1000, [1000, 200]), (1001, [1000, 201]), (2500, [1000, 1000, 900, 100])])
def test_chunk_lengths(length, wanted):
    assert [len(x) for x in documents.chunk_text("x" * length)] == wanted


def test_chunks_end_at_breaks():
    early = "a" * 100 + "\n" + "b" * 700 + ". " + "c" * 600
    assert [len(x) for x in documents.chunk_text(early)] == [1000, 603]  # the line break is too early, the sentence end isn't tried
    assert [len(x) for x in documents.chunk_text("a" * 800 + ". " + "b" * 600)] == [801, 801]
    assert [len(x) for x in documents.chunk_text("a" * 800 + "\n" + "b" * 600)] == [800, 800]


def test_texts_are_split_by_stretches_of_a_batch(spark):
    """Long texts of one batch: the pieces of those split before aren't held while the last ones are split."""

    def held(text: str) -> list[str]:
        with open("/proc/self/statm") as f:
            pages = f.read().split()[1]
        return [text + ".", pages] if text else []

    rows = spark.range(1500).coalesce(1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("some words\n\n"), 8000)).alias("text"))
    found = documents.exploded(rows, "id", "text", held)
    assert [f.name for f in found.schema] == ["id", "place", "chunk"]
    pages = [int(r.chunk) for r in found.where("place = 1").select("chunk").collect()]
    assert len(pages) == sum(k % 7 > 0 for k in range(1500))
    assert (max(pages) - min(pages)) * 4096 < 60e6


def test_packed_paragraphs():
    pack = documents.packed_paragraphs
    assert [len(x) for x in pack("a" * 9000 + "\n\n" + "b" * 200)] == [9000, 200]
    assert pack("a" * 149) == [] and pack("a" * 150) == ["a" * 150]
    assert [len(x) for x in pack("a" * 4000 + "\n" + "b" * 3998)] == [8000] and [len(x) for x in pack("a" * 4000 + "\n" + "b" * 3999)] == [4000, 3999]
    assert [len(x) for x in pack("a" * 4000 + "\n\n \n" + "b" * 4000 + "\n\n" + "c" * 3999 + "\n\n" + "d" * 200)] == [4000, 8001, 200]
    assert pack(" x\n\n\n" + "y" * 200) == ["x\n\n" + "y" * 200]


def test_cover_density_counts_minimal_stretches():
    assert search.cover_density([[1, 10], [2]]) == pytest.approx(0.1 + 0.1 / 8)
    assert search.cover_density([[5]]) == 0.1 and search.cover_density([[1], []]) == 0.0


def test_web_query(spark):
    docs = spark.createDataFrame([(1, "red small ring"), (2, "small red ring"), (3, "widgets and more"), (4, "small ring economy"), (5, "rings, small"), (6, "")], "id long, t string")
    index = search.postings(docs, "id", ["t"])
    ids = lambda q: sorted(r.id for r in search.matches(index, "id", search.web_query(q)).collect())
    assert ids('"small ring"') == [1, 4]
    assert ids('"small ring" -economy or widget') == [1, 3]
    assert ids("ring small") == [1, 2, 4, 5]
    assert ids("-small") == []


def test_fusion_adds_both_arms(spark):
    t = spark.createDataFrame([(1, 9.0), (2, 5.0), (3, 5.0)], "id long, score double")
    v = spark.createDataFrame([(3, 0.9), (4, 0.8)], "id long, score double")
    got = {r.id: r.score for r in search.fused(t, v, 10).collect()}
    assert got == pytest.approx({1: 1 / 51, 2: 1 / 52, 3: 1 / 53 + 1 / 51, 4: 1 / 52})


def test_alias_chains_end_and_cycles_have_no_root(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (10, 11), (11, 10)]
    got = {r.id: r.root for r in joins.canonical(spark.createDataFrame(rows, "id long, canonical_id long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 10: None, 11: None}


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [None if x[0] is None else round(x[0], 9) for x in df.select(joins.cosine("a", "b")).collect()] == [None, 1.0]


def test_half_open_and_closed_windows(spark):
    p = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id long, start_time double").withColumn("m", F.lit(1))
    w = spark.createDataFrame([(1, 10.0, 20.0)], "m int, start double, end double")
    assert [r.id for r in joins.point_in_window(p, w, ["m"]).collect()] == [1]
    assert sorted(r.id for r in joins.point_in_window(p, w, ["m"], closed="both").collect()) == [1, 2]


def test_chain_prefers_weight_but_never_goes_back(spark):
    options = [(1, 0, 100.0, 4.0), (1, 1, 50.0, 3.0), (1, 1, 400.0, 3.5), (1, 2, 300.0, 4.0)]
    got = entities.monotonic_chain(spark.createDataFrame(options, "meeting_id long, item long, time double, score double")).collect()
    assert [(r["item"], r["time"]) for r in got] == [(0, 100.0), (2, 300.0)]


def test_clusters_respect_forbidden_pairs(spark):
    links = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.95), (1, 4, 5, 0.9)], "c long, a long, b long, confidence double")
    no = spark.createDataFrame([(1, 1, 3)], "c long, a long, b long")
    got = entities.complete_link(links, no, "c", 0.85).collect()
    assert sorted((r.cluster, r.member) for r in got) == [(2, 2), (2, 3), (4, 4), (4, 5)]


def test_interpolation(spark):
    rows = [(1, 1, 0, 10.0), (2, 1, 1, None), (3, 1, 2, None), (4, 1, 3, 40.0), (5, 1, 4, None)]
    got = {r.id: r.start_at for r in windows.interpolated(spark.createDataFrame(rows, "id long, meeting_id long, place long, start_time double")).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 30.0, 4: 40.0, 5: 42.0}


def test_serving_counts_the_last_day_and_not_the_gap(spark):
    m = spark.createDataFrame([(1, "2020-01-01", "2020-06-30"), (1, "2021-01-01", None)], "person_id long, s string, e string").select("person_id", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    v = spark.createDataFrame([(1, 1, "2020-06-30"), (2, 1, "2020-07-01"), (3, 1, "2023-01-01")], "id long, person_id long, d string").withColumn("meeting_date", F.to_date("d"))
    assert sorted(r.id for r in voting.serving(v, m).collect()) == [1, 3]


def test_keyset_pages_follow_each_other(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(20)], "id long, v long")
    first = filters.keyset_page(rows, "v", 8).orderBy("place").collect()
    last = first[-1]
    second = filters.keyset_page(rows, "v", 20, filters.cursor(last.v, last.id)).collect()
    assert [r.id for r in first] == list(range(19, 11, -1)) and first[0].has_more
    assert {r.id for r in second} == set(range(12)) and not second[0].has_more


def test_budget_of_zero_allows_nothing(spark):
    rows = spark.createDataFrame([(1, "d"), (2, "d")], "id long, day string")
    assert not any(r.allowed for r in incremental.within_budget(rows, "day", ["id"], 0).collect())
    with pytest.raises(ValueError):
        incremental.within_budget(rows, "day", ["id"], -1)


@pytest.mark.parametrize("t, wanted", [("tree bylaw", "keyword"), ("parking on main", "keyword"), ("one two three four", "question"), ("Tell me", "question"), ("compare rates", "question"), ("isle", "keyword"), ("parks?", "question"), ("", "keyword")])
def test_intent(spark, t, wanted):
    assert one(spark, text.intent("t"), t=t) == wanted


@pytest.mark.parametrize("a, b, wanted", [("Ann Leigh", "ANN LEIGH", 1.0), ("Anna Leigh", "Anna Leigk", 0.96), ("Anna Leigh", "Anne Leigh", 0.94), ("A. Leigh", "Ann Leigh", 0.92), ("Ann Lee", "Ann Lea", 0.0), ("Ann Leigh", "Anm Leigh", 0.0), ("Anna", "Anna", 0.0), ("Zoë Müller", "Zoe Muller", 1.0), ("An. Leigh", "Ann Leigh", 0.0), ("Anna May Leigh", "Anna Leigh", 0.0), ("Ann O'Brien-Day", "A O'Brien-Day", 0.92)])
def test_name_scores(spark, a, b, wanted):
    assert one(spark, names.name_score("a", "b"), a=a, b=b) == wanted == one(spark, names.name_score("b", "a"), a=a, b=b)


@pytest.mark.parametrize("name, wanted", [("Stafford Low", True), ("Staff", False), ("staff member", False), ("Publicover", True), ("Al", False), ("Unit 4", False), ("Plannerson", True), (None, False)])
def test_valid_names(spark, name, wanted):
    assert spark.createDataFrame([(name,)], "n string").select(names.valid_name("n")).first()[0] == wanted


def test_polarity(spark):
    assert one(spark, text.polarity("t"), t="THATCouncil NOT approve $1,000.50, 5% and 12; amend no defeat") == "$1,000.50 5% 12 | amend approve no not"


def test_natural_keys_hold_long_numbers(spark):
    key = lambda t: one(spark, text.natural_key("t"), t=t)
    assert key("x2") < key("x10") < key("x" + "9" * 15) < key("x1" + "0" * 15) and key("x007") == key("x7")


def test_spread_sample_over_a_tenure(spark):
    rows = [(1, k, f"2020-0{1 + k % 9}-15" if k < 9 else None, float(k)) for k in range(12)] + [(2, k, None, 1.0) for k in range(5)]
    frame = spark.createDataFrame(rows, "g int, id int, d string, s double").selectExpr("g", "id", "cast(d as date) d", "s", "date'2019-01-01' low", "date'2022-12-31' high")
    got = {(r.g, r.id): r.bucket for r in windows.spread_sample(frame, ["g"], "d", "s", "low", "high").collect()}
    assert sorted(k for g, k in got if g == 1) == [4, 5, 6, 7, 8, 9, 10, 11] and got[1, 8] == 1 and got[1, 11] is None and sum(g == 2 for g, _ in got) == 5


# --- matters --------------------------------------------------------------------------------------------------------


TOWN = {
    "harbour_pool": (["harbour pool", "seaside baths"], ["lease", "operating agreement", "rent"]),
    "north_arena": (["north arena", "old ice hall"], ["lease", "naming"]),
}


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("Bylaw No. 31; REZ 2011-44", ["Bylaw 31", "REZ 2011-44"]),
        ("517; 2033; 8", ["Bylaw 517", "2033"]),
        ("bylaws nos 9, 14-2 & 15", ["Bylaw 9", "Bylaw 14-2", "Bylaw 15"]),
        ("dvp07-0031 second try", ["DVP 07-0031"]),
        ("Planning SUB 03-1200", ["SUB 03-1200"]),
        ("Temporary Use Permit 1999/07;   Odd    words ", ["TUP 1999-07", "Odd words"]),
        ("", []),
        (None, []),
    ],
)
def test_identifiers(spark, raw, wanted):
    assert spark.createDataFrame([(raw,)], "x string").select(matters.identifiers("x")).first()[0] == wanted


def test_policies_and_entities(spark):
    policy = lambda t: one(spark, matters.policy_identity("t", TOWN), t=t)
    assert policy("Final Meadow & Pond Strategy (45 minutes)") == "meadow and pond strategy" == policy("Consideration of the Meadow & Pond Strategy (Approval)")
    assert policy("Meadow Plan funding") is None and policy("Proposed Plan") is None and policy("Meadow Plan 2031") == "meadow plan 2031"
    entity = lambda t: one(spark, matters.entity_in("t", TOWN), t=t)
    assert entity("Rent of the Seaside Baths") == "harbour_pool" and entity("A walk from the Harbour Pool") is None and entity("lease") is None


MATTER = "id long, identifier string, title string, addresses array<string>, first_seen date, last_seen date, canonical_id long, hidden boolean, clusters array<string>, canonical boolean"


def test_cascade(spark):
    from datetime import date
    from difflib import SequenceMatcher

    def titled(matter_id, a, b):
        r = SequenceMatcher(None, a, b).ratio()
        return matter_id, f"title_similarity:{r:.2f}", round(r, 4)

    known = [
        {"id": 11, "title": "Geese", "identifier": "Bylaw 20"},
        {"id": 12, "title": "Geese", "identifier": "Bylaw 21", "canonical_id": 11},
        {"id": 13, "title": "Three fees in one", "identifier": "Bylaw 30; Bylaw 31; Bylaw 32"},
        {"id": 14, "title": "Quiet hours under Bylaw No. 40"},
        {"id": 15, "title": "A variance from Bylaw No. 50 beside the quarry", "identifier": "Bylaw 50; the quarry"},
        {"id": 16, "title": "Two lots on Cedar Brook Road", "identifier": "bylaw 60"},
        {"id": 17, "title": "Wells", "identifier": "Bylaw 70", "addresses": ["3 Fir Pl"]},
        {"id": 18, "title": "Wells", "identifier": "Bylaw 70", "addresses": ["4 Fir Place"]},
        {"id": 19, "title": "Bees and hives", "identifier": "Bylaw 80"},
        {"id": 20, "title": "Kites", "identifier": "Bylaw 80"},
        {"id": 21, "identifier": "DP 2009-10; DVP 2009-11", "title": "x"},
        {"id": 22, "identifier": "DP 2009-10", "title": "y"},
        {"id": 23, "title": "Meadow Action Plan", "first_seen": date(2011, 1, 1), "last_seen": date(2012, 1, 1)},
        {"id": 24, "title": "Subdivision of 9 Cedar Brook Road", "addresses": ["9 Cedar Brook Rd"]},
        {"id": 25, "title": "Harbour Pool operating agreement", "canonical": True},
        {"id": 26, "title": "Harbour Pool rent"},
        {"id": 27, "title": "North Arena naming"},
        {"id": 28, "title": "A footbridge over the brook"},
        {"id": 29, "title": "Swings for the playground 5"},
    ]
    cases = [
        ({"identifier": "Bylaw No. 20", "title": "On geese"}, (11, "identifier_exact:Bylaw 20", 1.0)),
        ({"identifier": "Bylaw No. 21", "title": "On geese"}, (None, "no_match", 0.0)),
        ({"identifier": "Bylaw Nos. 32, 30 & 31", "title": "Fees"}, (13, "identifier_exact:Bylaw 32", 1.0)),
        ({"identifier": "Bylaw 30", "title": "Three fees in one"}, (None, "no_match", 0.0)),
        ({"identifier": "Bylaw 40", "title": "Reading"}, (14, "identifier_exact:Bylaw 40", 1.0)),
        ({"identifier": "Bylaw 50", "title": "Notice to vary Bylaw No. 50 at 6 Gull Lane"}, (None, "no_match", 0.0)),
        ({"identifier": "Bylaw 60; Bylaw 61", "title": "Houses at 5 & 7 Cedar Brook Rd"}, (16, "identifier_exact:Bylaw 60", 1.0)),
        ({"identifier": "Bylaw 70", "title": "x", "addresses": ["4 fir pl"]}, (18, "identifier_ambiguous_resolved_by_address", 0.95)),
        ({"identifier": "Bylaw 80", "title": "Bees and a hive"}, (19, "identifier_ambiguous_resolved_by_title:0.90", 0.9)),
        ({"identifier": "Bylaw 80", "title": "Owls"}, (None, "no_match", 0.0)),
        ({"identifier": "DVP 2009-11; DP 2009-10", "title": "z"}, (21, "identifier_multi_overlap:2", 0.98)),
        ({"title": "Proposed Meadow Action Plan"}, (23, "policy_exact_subject_and_year", 1.0)),
        ({"title": "Proposed Meadow Action Plan", "day": date(2019, 1, 1)}, (None, "policy_review", 0.0)),
        ({"title": "Proposed Pond Action Plan"}, (None, "policy_new", 0.0)),
        ({"title": "Subdivision request, 9 Cedar Brook Rd"}, (24, "address_category_match", 0.85)),
        ({"title": "Subdivision of lots 2 and 3", "addresses": ["9 Cedar Brook Rd"]}, (None, "no_match", 0.0)),
        ({"title": "Seaside Baths: a new operating agreement"}, (25, "entity_cluster:harbour_pool", 0.92)),
        ({"title": "Old Ice Hall lease"}, (27, "entity_cluster:north_arena", 0.88)),
        ({"title": "A footbridge over a brook - Second Reading"}, titled(28, "a footbridge over a brook", "a footbridge over the brook")),
        ({"title": "Swings for the playground 6"}, (None, "no_match", 0.0)),
        ({"title": "Swings for the playground 5 and 6"}, titled(29, "swings for the playground 5 and 6", "swings for the playground 5")),
    ]
    blank = {"identifier": None, "title": None, "addresses": [], "first_seen": None, "last_seen": None, "canonical_id": None, "hidden": False, "clusters": [], "canonical": False}
    matters_ = spark.createDataFrame([tuple((blank | k)[c.split()[0]] for c in MATTER.split(", ")) for k in known], MATTER)
    rows = [(k, *(({"identifier": None, "addresses": None, "day": date(2011, 5, 1)} | item)[c] for c in ("identifier", "title", "addresses", "day"))) for k, (item, _) in enumerate(cases)]
    found = matching.match_cascade(spark.createDataFrame(rows, "id long, identifier string, title string, addresses array<string>, day date"), matters_, TOWN).collect()
    got = {r.item_id: (r.matter_id, r.reason, round(r.confidence, 4)) for r in found}
    assert [got[k] for k in range(len(cases))] == [wanted for _, wanted in cases]


def test_best_titles_are_those_of_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    base = [" ".join(rng.choice(["park", "lot", "road", "light", "tree", "hall", "fire", "bench"]) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    change = lambda t: "".join(c if rng.random() > 0.12 else rng.choice("abcx ") for c in t).strip()
    left, right = [(k, change(rng.choice(base)) + rng.choice(["", " 7", " 8 9"])) for k in range(150)], [(k, change(t) + rng.choice(["", " 7", " 8"])) for k, t in enumerate(base * 2)]
    wanted = {}
    digits = lambda t: {w for w in t.split() if w.isdigit()}
    for k, a in left:
        best = (0.75, None)
        for j, b in right:
            p, q = digits(a), digits(b)
            if len(a) < 10 or len(b) < 10 or p and q and not p <= q and not q <= p:
                continue
            r = SequenceMatcher(None, a, b).ratio()
            if r > best[0] or r == best[0] and best[1] is None:
                best = (r, j)
        if best[1] is not None:
            wanted[k] = (best[1], round(best[0], 9))
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string")
    got = {r.item_id: (r.matter_id, round(r.similarity, 9)) for r in matching.best_titles(frame(left), frame(right), TOWN, piece=16).collect()}
    assert len(wanted) > 50 and got == wanted


@pytest.mark.parametrize(
    "t, wanted, enacted",
    [
        ("Dog Bylaw 77 Cedar Brook Lane", [], None),
        ("Dog Bylaw 77, 79 & 81a Gull Lane, Bylaw 5", ["5"], None),
        ("Levy Bylaw 1999; Levy Bylaw 1989", ["1989"], None),
        ("Levy Bylaw No. 1999, 2001", ["1999"], 2001),
        ("Omnibus No. 3, 1987 and bylaw 4, 1990", ["4"], 1987),
        ("By-law nos 3, 4 & no. 5 and 8 Fir Place", ["3", "4", "5"], None),
        ("Bylaw No. 3, 4", ["3"], None),
        ("(nos. 6, 7) of the Dog Bylaw ( No. 007", ["6", "7"], None),
        ("Amendment No. 9, bylaw 5.5 and bylaw 12345", [], None),
        ("bylaw #8, bylaw numbers 9, 10, bylaw 0", ["8", "9"], None),
        (None, [], None),
    ],
)
def test_referenced_bylaws(spark, t, wanted, enacted):
    row = spark.createDataFrame([(t,)], "t string").select(matters.referenced_bylaws("t", 2027).alias("x")).first()["x"]
    assert (row.numbers, row.enacted) == (wanted, enacted)


# --- alignment ------------------------------------------------------------------------------------------------------


def test_items_and_motions_in_a_transcript(spark):
    said = [(0, "good evening everyone"), (60, "item 8.1 the Oak Street rezoning"), (120, "we come to 8.10 now"), (200, "the rezoning of oak street again"), (400, "who wants to speak about budget"), (500, "I move that the budget increase be approved"), (520, "moved and seconded"), (900, "motion to adjourn"), (910, "we adjourn")]
    segments = spark.createDataFrame([(1, k, float(t), t + 20.0, x) for k, (t, x) in enumerate(said)], "meeting_id long, id long, start_time double, end_time double, text string")
    items = [(1, 1, "1", "Call to Order", None), (1, 2, "8.1", "Rezoning Oak Street", 190.0), (1, 3, "8.2", "Nothing said of it", None), (1, 4, "9", "Budget increase 2024", None), (1, 5, "10", "Adjournment", None), (1, 6, "9.1", "", None)]
    items = spark.createDataFrame(items, "meeting_id long, id long, number string, title string, start_time double")
    markers = alignment.item_markers(items, segments)
    assert {r.item_id: (r.at, round(r.score, 4)) for r in markers.collect()} == {1: (0.0, 2.0), 2: (60.0, 1.2), 4: (500.0, 0.5333), 5: (900.0, 2.0)}
    placed = alignment.placed_items(items, markers, spark.createDataFrame([(1, 0.0, 930.0)], "meeting_id long, opens double, closes double"))
    got = {r.id: (round(r.start_at, 3), round(r.end_at, 3)) for r in placed.collect()}
    assert got == {1: (0.0, 60.0), 2: (60.0, 280.0), 3: (280.0, 500.0), 4: (500.0, 700.0), 6: (700.0, 900.0), 5: (900.0, 930.0)}
    motions = [(1, 1, "THAT the budget increase be approved", 480.0, 600.0, False), (1, 2, "THAT nothing remarkable", 505.0, 530.0, False), (1, 3, "budget increase approved", 20.0, 30.0, False), (1, 4, "adjourn", 100.0, 110.0, False), (1, 5, "a b", 0.0, 1.0, False)]
    motions = spark.createDataFrame(motions, "meeting_id long, id long, text string, start_at double, end_at double, closes boolean")
    assert {r.motion_id: r.at for r in alignment.motion_markers(motions, segments).collect()} == {1: 500.0, 2: 520.0, 3: 500.0, 4: 910.0}


def test_an_earlier_but_surer_marker_replaces_the_last_anchor(spark):
    items = spark.createDataFrame([(1, k, str(k)) for k in range(1, 5)], "meeting_id long, id long, number string")
    bounds = spark.createDataFrame([(1, 0.0, 100.0), (2, 0.0, 50.0)], "meeting_id long, opens double, closes double")
    place = lambda rows: {r.id: r.start_at for r in alignment.placed_items(items, spark.createDataFrame(rows, "item_id long, at double, score double"), bounds).collect()}
    assert place([(1, 10.0, 1.0), (2, 60.0, 0.5), (3, 40.0, 0.9)]) == {1: 10.0, 2: 25.0, 3: 40.0, 4: 90.0}
    assert place([(1, 10.0, 1.0), (2, 60.0, 0.9), (3, 40.0, 0.5)]) == {1: 10.0, 2: 60.0, 3: 75.0, 4: 90.0}
    assert place([(9, 1.0, 1.0)]) == {1: 0.0, 2: 30.0, 3: 60.0, 4: 90.0}


def test_word_turns(spark):
    words = [(0, "Good", 0.0, 1.0), (1, " even", 1.0, 1.5), (2, "ing", 1.5, 2.0), (3, " all", 2.0, 3.0), (4, ",", 3.0, 3.0), (5, " yes", 3.0, 4.0), (6, " no", 4.0, 5.0), (7, " x", 5.0, 5.0), (8, " far", 5.0, 6.0), (9, " off", 8.0, 9.0)]
    tokens = spark.createDataFrame([(1, *w) for w in words], "parent_id long, k long, text string, start double, end double")
    turns = spark.createDataFrame([(1, "A", 0.0, 3.0), (1, "B", 3.0, 4.5), (1, "B", 4.4, 7.0), (1, "A", 4.95, 5.0)], "parent_id long, speaker string, start double, end double")
    parent = lambda text: spark.createDataFrame([(1, text, 0.0, 9.0)], "parent_id long, text string, start double, end double")
    got = [tuple(r) for r in alignment.word_turns(parent("Good evening all, yes no x far off"), tokens, turns).orderBy("first").collect()]
    ok = "alignment_candidate"
    assert got == [(1, 0, 4, "A", "Good evening all,", None, ok), (1, 5, 5, "B", "yes", None, ok), (1, 6, 6, None, "no", "word_crosses_measured_voice_boundary", ok), (1, 7, 7, None, "x", "unmeasured_lexical_token", ok), (1, 8, 8, "B", "far", None, ok), (1, 9, 9, None, "off", "mixed_or_insufficient_temporal_support", ok)]
    assert {r.status for r in alignment.word_turns(parent("other"), tokens, turns).collect()} == {"held_original_text_mismatch"}
    early = tokens.withColumn("start", F.col("start") - 1)
    assert [(r.first, r.last, r.status) for r in alignment.word_turns(parent("x"), early, turns).collect()] == [(0, 9, "held_invalid_input")]


def test_motion_sources(spark):
    blocks = spark.createDataFrame([(1, 1, "THATCouncil approve $5,000 for trees."), (1, 2, "That Council deny the permit"), (2, 1, "Approve the budget of 2024 as it was presented to the public"), (2, 2, "Approve the budget of 2025 as it was presented to the public"), (3, 1, "Adopt it"), (3, 2, "adopt it.")], "doc long, place long, text string")
    motions = spark.createDataFrame([(1, 1, "that council approve $5,000 for trees", None), (1, 2, "deny permit", "That Council deny the permit"), (1, 3, "approve permit", "That Council deny the permit"), (2, 4, "Approve the budget of 2024 as it was presented to the public", None), (3, 5, "adopt it", None)], "doc long, id long, text string, quote string")
    assert sorted(map(tuple, documents.motion_sources(motions, blocks).select("id", "place", "how").collect())) == [(1, 1, "exact_motion_text"), (2, 2, "verbatim_quote_exact_identity")]
