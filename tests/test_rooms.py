"""Presence within bounds, ballots, people in minutes and collages, against brute force and literal cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from agora.operators import ballots, research


def test_presence_is_that_of_brute_force(spark):
    rng = random.Random(9)
    roster = [(d, p, rng.choice([True, False, None])) for d in range(6) for p in range(5)]
    votes = [(d, 100 * d + v, *sorted(rng.sample(range(60), 2))) for d in range(7) for v in range(12)]
    changes = [(d, rng.randrange(6), low, low + rng.choice([0, 0, 3, 15]), rng.random() < 0.5) for d in range(6) for low in (rng.randrange(60) for _ in range(25))]
    wanted = {}
    for d, v, low, high in votes:
        for e, p, first in roster:
            if e == d:
                own = [c for c in changes if c[:2] == (d, p)]
                before = [c for c in own if c[3] <= low]
                known = max(before, key=lambda c: (c[3], c[2], not c[4]))[4] if before else first
                turned = any(c[2] < high and c[3] > low and c[4] != known for c in own)
                wanted[v, p] = "unknown" if known is None or turned else "present" if known else "absent"
    found = ballots.presence_at(spark.createDataFrame(votes, "doc int, vote int, low int, high int"), spark.createDataFrame(roster, "doc int, person int, present boolean"), spark.createDataFrame(changes, "doc int, person int, low int, high int, present boolean"))
    assert {(r.vote, r.person): r.state for r in found.collect()} == wanted and set(wanted.values()) == {"unknown", "present", "absent"}


def test_committee_ballots(spark):
    members = [(0, "mayor"), (1, "councillor"), (2, "councillor"), (3, "citizen"), (4, "citizen"), (5, "citizen"), (6, "visitor")]
    motions, roster, states, named, wanted = [], [], [], [], {}

    def case(status, outcome="passed", unanimous=False, rule=True, threshold=False, away=(), unsure=(), names=(), role=None, unproven=(), chair=1, yes=None, no=None):
        v = len(motions)
        motions.append((v, v, outcome, unanimous, rule, threshold))
        for p, kind in members:
            roster.append((v, p, (role or {}).get(p, kind), p not in unproven, p == chair))
            states.append((v, p, "absent" if p in away else "unknown" if p in unsure else "present"))
        named.extend((v, p, c) for p, c in names)
        wanted[v] = (status, yes, no)

    good = "reconstructable_candidate"
    case(good, yes=6, no=0)
    case(good, names=[(3, "No"), (3, "No")], yes=5, no=1)
    case(good, unanimous=True, rule=False, yes=6, no=0)
    case(good, rule=False, names=[(p, "Yes") for p in range(6)], yes=6, no=0)
    case(good, "failed", names=[(p, "No") for p in (0, 1, 2)], yes=3, no=3)
    case("not_a_yes_no_decision", "tabled")
    case("not_a_yes_no_decision", None)
    case("committee_councillor_office_not_proven", unproven=[2])
    case("committee_exofficio_mayor_not_proven", unproven=[0])
    case("committee_full_identity_not_proven", role={6: "unknown"})
    case(good, role={6: "unknown"}, away=[6], yes=6, no=0)
    case("initial_presence_unknown", unsure=[4])
    case(good, unsure=[6], yes=6, no=0)
    case("committee_quorum_or_chair_not_proven", away=[3])
    case("committee_quorum_or_chair_not_proven", chair=3)
    case("unresolved_dissent_names", names=[(99, "No")])
    case("named_choice_voter_not_present", names=[(6, "No")])
    case("conflicting_named_source_choices", names=[(3, "No"), (3, "Yes")])
    case("special_vote_or_recusal_needs_scope", names=[(3, "Recused")])
    case("special_vote_or_recusal_needs_scope", names=[(3, None)])
    case("unanimous_result_conflicts_with_named_choice", unanimous=True, names=[(3, "No")])
    case("recording_rule_not_refreshed", rule=False)
    case("special_voting_threshold_needs_validation", threshold=True)
    case("reconstructed_tally_conflicts_with_outcome", "failed")
    told, cast = ballots.committee_ballots(
        spark.createDataFrame([*motions, (77, 77, "passed", False, True, False)], "doc int, vote int, outcome string, unanimous boolean, rule boolean, threshold boolean"),
        spark.createDataFrame(roster, "doc int, person int, role string, proven boolean, chair boolean"),
        spark.createDataFrame(states, "vote int, person int, state string"),
        spark.createDataFrame(named, "vote int, person int, choice string"),
    )
    got = {r.vote: (r.status, r.yes, r.no) for r in told.collect()}
    assert got.pop(77) == ("committee_full_identity_not_proven", None, None) and got == wanted
    rows = cast.collect()
    assert {r.vote for r in rows} == {v for v, x in wanted.items() if x[0] == good} and all(r.person < 6 for r in rows)
    assert {r.person: (r.choice, r.evidence) for r in rows if r.vote == 1} == {p: ("No", "explicit_named") if p == 3 else ("Yes", "inferred_official_dissent_recording_rule") for p in range(6)}


def test_mentions_are_those_of_a_pattern(spark):
    rng = random.Random(5)
    people = [(1, "Ann Lee", ["A Lee"]), (2, "Annabel", None), (3, "Ann", ["ann lee", "the  chair"]), (4, "Zoë Æ", []), (5, None, None)]
    words = ["ann", "Ann", "lee", "LEE", "Lee,", "annabel", "a", "A.", "the", "chair", "Zoë", "æ", "xAnn", "Ann_", "-Ann-", "\n", "."]
    texts = [(k, " ".join(rng.choice(words) + rng.choice(["", "", " ", "\t"]) for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(99, None), (98, "")]
    named = research.aliases(spark.createDataFrame(people, "person int, name string, also array<string>"))
    listed = {}
    for r in sorted(named.collect(), key=lambda r: r.rank):
        listed.setdefault(r.person, []).append(r.alias)
    assert listed == {1: ["Ann Lee", "A Lee", "A. Lee"], 2: ["Annabel"], 3: ["Ann", "ann lee", "the chair"], 4: ["Zoë Æ", "Z. Æ"]}
    wanted = {}
    for k, t in texts:
        t = " ".join((t or "").split())
        for p, names in listed.items():
            found = [m.end() for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)", t, re.I)]
            if found:
                wanted[k, p] = found
    frame = spark.createDataFrame(texts, "doc int, text string")
    for most in (100_000, 2):
        got = {(r.doc, r.person): list(r.ends) for r in research.mentions(frame, named, most).collect()}
        assert got == wanted


@pytest.mark.parametrize(
    "t, wanted",
    [
        ("Bo Quill: we need 1200 Low Oak Road fixed", ": we need [address omitted] fixed"), ("Bo Quill of Elm - spoke up. B. Ann, of Elm, said", "spoke up."), ("Bo Quill " + "x" * 99 + " - far", "x" * 99 + " - far"), ("Bo Quill", ""), ("Bo Quill " + "word " * 99, ("word " * 52).strip()),
    ],
)
def test_excerpts(spark, t, wanted):
    assert spark.createDataFrame([(t,)], "t string").select(research.excerpt(F.col("t"), F.lit(8)).alias("x")).first()["x"] == wanted


def test_person_research(spark):
    minutes = spark.createDataFrame([(1, 10, "Ann spoke"), (2, 10, "Ann and Ann: yes"), (3, 10, "ann, ann"), (4, 11, "nobody")], "doc long, meeting_id long, text string")
    segments = spark.createDataFrame([(10, "Ann", 0.0, 2.5), (10, "Ann (public)", 5.0, 4.0), (12, "Ann", 1.0, 2.0), (13, "Anna", 1.0, 2.0)], "meeting_id long, speaker_name string, start_time double, end_time double")
    people = spark.createDataFrame([(7, "Ann", None)], "person long, name string, also array<string>")
    got = {r.meeting_id: (r.doc, r.name_mentions, list(r.excerpts), r.turns, r.timed_seconds) for r in research.person_research(people, minutes, segments).collect()}
    assert got == {10: (2, 2, ["and Ann: yes", ": yes"], 2, 2.5), 12: (None, 0, [], 1, 1.0)}


def test_collages_are_those_of_a_closure(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        x, y = rng.uniform(-50, 900), rng.uniform(0, 900)
        rows.append((k % 6, k, x, y, x + rng.choice([0, 5, 60, 300]), y + rng.choice([0, 8, 40])) if k % 29 else (k % 6, k, x, None, x, y))
    rows += [(6, 900, 0.0, 0.0, 10.0, 10.0), (6, 901, 40.0, 0.0, 50.0, 10.0), (6, 902, 80.001, 0.0, 90.0, 10.0), (6, 903, 20.0, 40.0, 21.0, 41.0)]
    near = lambda a, b: None not in a and None not in b and max(a[2] - b[4], b[2] - a[4], 0) <= 30 and max(a[3] - b[5], b[3] - a[5], 0) <= 30
    wanted = {r[1]: r[1] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[0] == b[0] and near(a, b) and wanted[a[1]] < wanted[b[1]]:
                    wanted[b[1]], changed = wanted[a[1]], True
    got = {r.id: r.collage for r in research.collages(spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got == wanted and got[901] == 900 and got[902] == 902 and got[903] == 900


def test_described_images(spark):
    images = spark.createDataFrame([(1, 5.0, 1), (1, 1.0, 2), (1, 9.0, 3), (2, 0.0, 4)], "page int, place double, id int")
    texts = spark.createDataFrame([(1, "a [Image: a map] [Image 2: City Logo] b")], "page int, text string")
    assert {r.id: r.description for r in research.described(images, texts).collect()} == {2: "a map", 3: None, 4: None}
