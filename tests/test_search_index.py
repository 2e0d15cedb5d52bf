"""The stemmer on its published sample, the index, and ranks."""

from __future__ import annotations

import pytest

from agora.functions.stems import english_stem
from agora.operators import search

SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl
constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()


def test_stems_of_the_published_sample():
    assert {w: english_stem(w) for w in SAMPLE[::2]} == dict(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))


@pytest.mark.parametrize(
    "word, wanted",
    [
        ("skies", "sky"), ("news", "news"), ("dying", "die"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("bus", "bus"), ("agreed", "agre"), ("feed", "feed"), ("hoping", "hope"), ("hopping", "hop"),
        ("hoped", "hope"), ("luxuriated", "luxuri"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("inning", "inning"), ("generously", "generous"), ("communism", "communism"), ("arsenic", "arsenic"), ("relational", "relat"), ("vietnamization", "vietnam"),
        ("hopefulness", "hope"), ("sensibility", "sensibl"), ("apology", "apolog"), ("electricity", "electr"), ("formative", "format"), ("adoption", "adopt"), ("replacement", "replac"), ("rate", "rate"), ("rolling", "roll"), ("controlling", "control"), ("yes", "yes"), ("youth", "youth"), ("boys", "boy"), ("is", "is"), ("bylaws", "bylaw"), ("rezoning", "rezon"), ("councillors", "councillor"), ("nation's", "nation"),
    ],
)
def test_stems(word, wanted):
    assert english_stem(word) == wanted


def test_postings_and_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The rezoning of trees and the tree", None), (2, "trees, rezoned", "for parks"), (3, None, "Parking on the parkway"), (4, "adopted adoption adopts", "the")], "id int, title string, body string")
    index = search.postings(docs, "id", ["title", "body"])
    assert {(r.id, r.term): list(r.positions) for r in index.collect()} == {(1, "rezon"): [2], (1, "tree"): [4, 7], (2, "tree"): [1], (2, "rezon"): [2], (2, "park"): [4], (3, "park"): [1], (3, "parkway"): [4], (4, "adopt"): [1, 2, 3]}
    search.write_index(index, str(tmp_path / "index"), buckets=8)
    for text, wanted in (("parks", {2, 3}), ('"rezone tree"', set()), ('"tree rezoning"', {2}), ("tree -park", {1}), ("adopting or parkways", {3, 4}), ("the", set())):
        query = search.web_query(text)
        part = search.read_index(spark, str(tmp_path / "index"), query.terms, buckets=8)
        assert {r.id for r in search.matches(index, "id", query).select("id").collect()} == wanted == {r.id for r in search.matches(part, "id", query).select("id").collect()}
    one = search.read_index(spark, str(tmp_path / "index"), ["tree"], buckets=8)
    assert len({r.f.split("/bucket=")[1].split("/")[0] for r in one.selectExpr("input_file_name() f").collect()}) == 1


@pytest.mark.parametrize("positions, wanted", [([[3]], 0.1), ([[3, 9]], 0.2), ([[1], [2]], 0.1), ([[1], [4]], 0.1 / 3), ([[1, 5], [2]], 0.1 + 0.1 / 3), ([[1, 2], [3]], 0.1), ([[1], [2], [3]], 0.1), ([[1, 10], [2, 12], [5]], 0.1 / 3 + 0.1 / 7 + 0.1 / 6), ([[1], []], 0.0)])
def test_cover_density(positions, wanted):
    assert search.cover_density(positions) == pytest.approx(wanted)
