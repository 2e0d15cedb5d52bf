"""Slugs, links of sections, and meetings of sources' responses, against brute force and literal cases."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from agora.operators import documents, minutes
from agora.sources import connectors


def test_slugs_are_those_of_one_after_the_other(spark):
    rng = random.Random(8)
    bases = ["a", "a-2", "a-2-2", "a-3", "b", "c-9", "c", "", "-2", "a-b", "2"]
    rows = [(k, k % 3, rng.choice(bases)) for k in range(400)] + [(k, 7, "hot") for k in range(400, 700)]
    wanted, taken = {}, set()
    for k, scope, base in rows:
        slug, n = base, 2
        while (scope, slug) in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add((scope, slug))
        wanted[k] = slug
    frame = spark.createDataFrame(rows, "id long, scope int, base string")
    assert {r.id: r.slug for r in minutes.unique_slugs(frame, "scope").collect()} == wanted


def test_linked_items(spark):
    items = [(1, 1, "4.1.", "Approval of the harbour works"), (2, 1, "4.2", "Trees"), (3, 1, "5", "Budget for the old bridge repair"), (4, 1, "5", "Later item of one number"), (5, 2, "4.1", "Approval of the harbour works"), (6, 1, None, None)]
    cases = [
        (1, "4.1 anything", (1, "number")), (1, " 5. x", (4, "number")), (1, "9.9 Approval of the Harbour Works, part two", (1, "title")), (1, "of the harbour works", (1, "title")), (1, "the harbour", (1, "title")),
        (1, "harbour", None), (1, "On the old bridge repair: costs", (3, "words")), (1, "for the old one", None), (1, "Trees", None), (1, "About trees and more", None), (2, "approval of the harbour works", (5, "title")), (3, "4.1 alone", None), (1, "", None), (1, None, None),
    ]
    rows = [(m, m, k, t) for k, (m, t, _) in enumerate(cases)] + [(2, 2, 100 + k, f"4.1 part {k}") for k in range(12)]
    found = documents.linked_items(spark.createDataFrame(rows, "meeting_id long, doc long, place long, title string"), spark.createDataFrame(items, "id long, meeting_id long, number string, title string")).collect()
    got = {r.place: (r.item_id, r.how) for r in found}
    assert {k: got.get(k) for k in range(len(cases))} == {k: x for k, (_, _, x) in enumerate(cases)}
    assert sorted(p for p in got if p >= 100) == [100, 101]  # item 5 has thirteen sections, of which the first three stay


def test_meeting_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps([{"ID": 7, "MeetingName": "Täglich", "StartDate": "2024/03/05 18:00", "Url": "/m/7", "Extra": [1]}, {"ID": None, "StartDate": "2024/03/05"}, {"ID": "x"}]))
    (tmp_path / "a" / "2.json").write_bytes('[{"ID": "8", "MeetingName": "Café", "StartDate": "2024-01-02T10:00"}]'.encode("cp1252"))
    (tmp_path / "b.json").write_text("not a list")
    found = connectors.meeting_files(spark, str(tmp_path), "escribe").collect()
    assert sorted((r.source_id, r.title, r.date, r.url) for r in found) == [("7", "Täglich", "2024-03-05", "/m/7"), ("8", "Café", "2024-01-02", None)]


def test_meetings_on_a_page(spark):
    page = """<ul class="items"><li class="item new"><em class="when">March 5, 2024</em> <b class="what">A &amp; <i>B</i></b><a href="/x.html">x</a><a href="/a.pdf">a</a><a href="/b.pdf"></a></li>
      <li class="item"><em class="when">5 March</em><b class="what">No date</b></li><li class="item"><b class="what">C</b><em class="when">
      April 1, 2025 </em></li></ul>"""
    column = connectors.meetings_on_page(F.col("h"), "item", "when", "what")
    got = spark.createDataFrame([(page,), ("",), (None,)], "h string").select(column.alias("m")).collect()
    assert [(m.title, m.date, m.url) for m in got[0].m] == [("A & B", "2024-03-05", "/a.pdf"), ("C", "2025-04-01", None)]
    assert got[1].m == [] and got[2].m is None


def test_motion_sources_are_those_of_brute_force(spark):
    """Over a whole table of motions whose wordings are near to each other."""
    from difflib import SequenceMatcher

    from tests.conftest import DATA

    rows = [(r.p_partkey // 4, r.p_partkey, f"{r.p_name} {r.p_brand}") for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    blocks = [(d, k, t.upper()) for d, k, t in rows if k % 5 != 1]
    wanted = {}
    for d, k, t in rows:
        own = [b for b in blocks if b[0] == d]
        hits = [b for b in own if plain(b[2]) == plain(t)]
        rivals = [b for b in own if plain(b[2]) != plain(t) and SequenceMatcher(None, plain(t), plain(b[2]), False).ratio() > 0.94]
        if len(hits) == 1 and not rivals:
            wanted[k] = hits[0][1]
    motions = spark.createDataFrame([(*r, None) for r in rows], "doc long, id long, text string, quote string")
    got = {r.id: r.place for r in documents.motion_sources(motions, spark.createDataFrame(blocks, "doc long, place long, text string")).collect()}
    assert got == wanted and len(got) > 50
