"""Rules of the small parsers and of matching people and matters, branch by branch."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from agora.functions import names
from agora.operators import minutes, records


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "t, wanted",
    [
        ("nine zero four one", "9041"), ("fifty-six", "56"), ("six point two point five", "6.2.5"), ("forty eight fifteen", "48 15"), ("twenty zero five", "25"), ("thirty nineteen", "30 19"), ("Bone tenfold one-off", "bone tenfold 1-off"),
        ("oh five", "05"), ("seven", "7"), ("item 4 .  2!", "item 4.2"), ("It’s $5,000 (five)", "it's 5 000 5"), ("eleven point one", "11.1"), ("fifty", "50"), (None, ""), ("éone", "one"), ("one  -  two", "12"), ("ten\ttwelve", "10 12"),
    ],
)
def test_spoken_numbers(spark, t, wanted):
    assert one(spark, names.spoken_numbers("t"), t=t) == wanted


@pytest.mark.parametrize(
    "t, wanted",
    [
        ("```md\n* a\n\n 2) b\n```", "- a\n- b"), ("plain\n**bold** and **more**", "plain\nbold and more"), ("– dash stays\n-no space\n12.   ten", "– dash stays\n-no space\n- ten"), ("  \n ", ""), (None, ""),
        ("a ``` b", "a ``` b"), ("• a\r\n • b", "- a\n- b"), ("** open\n- x**", "open\n- x"),
    ],
)
def test_bullets(spark, t, wanted):
    assert one(spark, minutes.bullets(F.col("t")), t=t) == wanted


def test_common_sequence_is_that_of_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, *(" ".join(rng.choice(["a", "b", "bb", "A", "ccc"]) for _ in range(rng.randint(0, 25))) for _ in range(2))) for k in range(300)] + [(900, None, "a b c"), (901, "a b c", None)]

    def longest(x, y):
        w, y = x.split(), f" {y} "
        return max((len(" ".join(w[i:j])) for i in range(len(w)) for j in range(i + 3, len(w) + 1) if f" {' '.join(w[i:j])} " in y), default=0)

    found = spark.createDataFrame(rows, "id int, a string, b string").select("id", names.common_sequence("a", "b").alias("n")).collect()
    assert {r.id: r.n for r in found} == {k: longest(a or "", b or "") for k, a, b in rows}
    assert names.WordRuns(["x"] * 5000).longest(["x"] * 4000, 3) == 7999


def test_lifecycle(spark):
    cases = [
        ("THAT Council adopt Bylaw No. 9", "Adopted"), ("THAT Council repeal Bylaws Nos. 9 and 8", "Repealed"), ("THAT Council adopt Bylaw 8", None), ("THAT Council adopt the report on Bylaw 9", None), ("THAT the clerk adopt Bylaw 9", None),
        ("THAT Council adopt Bylaw 9 upon receipt", None), ("I recommend that Council adopt Bylaw 9", None), ("THAT Council adopt Bylaw 8; Council adopt Bylaw 9", "Adopted"), ("THAT Council repeal Bylaw 8 AND THAT Council adopt Bylaw 9", None),
        ("THAT Council adopt Bylaw 8 and direct staff on Bylaw 9", None), ("THAT Council adopt Bylaw 9 and refer Bylaw 8", None), ("THAT Council not adopt Bylaw 9", None), ("THAT Council adopt Bylaw 9 and further that staff rest", "Adopted"),
    ]
    motion = lambda k, m, t, result="Carried ", kind=None, day="2020-01-01": (k, m, result, kind, t, day)
    rows = [motion(k, k, t) for k, (t, _) in enumerate(cases)]
    good = "THAT Council adopt Bylaw 9"
    rows += [motion(100, 100, good, "DEFEATED"), motion(101, 101, good, None), motion(102, 102, good, "passed", "Amended"), motion(103, 103, good, "ADOPTED", "Substantive"), motion(104, 104, "THAT Council adopt Bylaws 9; Council adopt Bylaw 10"), motion(105, 105, good), motion(106, 105, "THAT Council repeal Bylaw 9", day="2019-01-01"), motion(107, 106, good)]
    own = {104: ("Bylaw 9; Bylaw 10", "x"), 103: (None, "About Bylaw No. 9"), 106: ("Bylaw 9; Bylaw 11", "x"), 102: ("Bylaw 9", "x")}
    matters = spark.createDataFrame([(k, *own.get(k, ("Bylaw 9", "x"))) for k in range(110)], "id long, identifier string, title string")
    found = minutes.lifecycle(matters, spark.createDataFrame(rows, "id long, matter_id long, result string, disposition string, text string, meeting_date string")).collect()
    got = {r.matter_id: (r.state, r.motion_id) for r in found}
    assert {k: got.get(k, (None,))[0] for k in range(len(cases))} == {k: x for k, (_, x) in enumerate(cases)}
    assert {k: v for k, v in got.items() if k >= 100} == {103: ("Adopted", 103), 104: ("Adopted", 104), 105: ("Adopted", 105)}


def test_pair_verdicts(spark):
    cases = [
        ("Bylaw 7", "a", [], "Bylaw 7", "b", [], 0.0, 0.0, "same_matter"), ("Bylaw 7; Bylaw 8", "a", [], "Bylaw 7; Bylaw 8", "b", [], 0.0, 0.0, "judge"), ("TUP 16-0001; Bylaw 1", "a", [], "TUP16-0001; Bylaw 2", "b", [], 0.0, 0.0, "same_matter"),
        (None, "Receipt of letters", ["1 Fir St"], None, "b", ["1 Fir Street"], 0.99, 0.0, "different"), (None, "Amendment No. 3", [], None, "Amendment no 4", [], 0.99, 0.0, "different"), ("Bylaw 7", "a", [], "Bylaw 8", "b", [], 0.99, 0.0, "different"),
        ("Bylaw 7", "a", ["1 Fir St"], "Bylaw 8", "b", ["1 fir street"], 0.0, 0.0, "judge"), ("TUP 16-0001", "a", [], "TUP 16-0002", "b", [], 0.99, 0.0, "different"), (None, "Lot 12 Elm Road", [], None, "Lot 14 Elm Road", [], 0.99, 0.9, "different"),
        (None, "x Elm Road", [], None, "y Elm Road", [], 0.0, 0.72, "judge"), (None, "x Elm Road", [], None, "y Elm Road", [], 0.86, 0.1, "judge"), (None, "x", [], None, "y", [], 0.86, 0.9, "unrelated"), (None, "x", [], None, "y", [], 0.9, 0.0, "judge"), (None, "x", None, None, "y", None, None, None, "unrelated"),
        (None, "Notice on Bylaw 5", [], "Bylaw 5", "b", [], 0.0, 0.0, "same_matter"), (None, "To vary Bylaw 5", [], "Bylaw 5", "b", [], 0.0, 0.0, "unrelated"), (None, None, [], None, None, [], 0.0, 0.0, "unrelated"),
    ]
    rows = spark.createDataFrame([(k, *x[:8]) for k, x in enumerate(cases)], "k long, i string, t string, p array<string>, j string, u string, q array<string>, vectors double, titles double")
    a = minutes.pair_facts(rows.select(F.col("k").alias("id"), F.col("i").alias("identifier"), F.col("t").alias("title"), F.col("p").alias("addresses")), "a")
    b = minutes.pair_facts(rows.select(F.col("k").alias("id"), F.col("j").alias("identifier"), F.col("u").alias("title"), F.col("q").alias("addresses")), "b")
    pairs = a.join(b, F.col("id_a") == F.col("id_b")).join(rows.select("k", "vectors", "titles"), F.col("id_a") == F.col("k"))
    got = {r.a: r.verdict for r in minutes.pair_verdicts(pairs).collect()}
    assert [got[k] for k in range(len(cases))] == [x[-1] for x in cases]


def test_people_are_matched_as_by_brute_force(spark):
    rng = random.Random(4)
    first, last = ["Ann", "Anna", "Bo", "B.", "C", "Dora", "Dorah", "Zed", ""], ["Lee", "Leeson", "Lea", "Marten", "Martens", "Martin", "O", "Otto", "Quill", "Quills", "Quall", "X"]
    spell = lambda: f"{rng.choice(first)} {rng.choice(['', 'van '])}{rng.choice(last)}".strip()
    people, rows = [(k, spell()) for k in range(25)], [(k, rng.choice(["", "Mayor "]) + spell()) for k in range(250)] + [(900, None), (901, " "), (902, "Nobody Else")]

    def may_be(x, y):
        a, b = x.split(), y.split()
        p, q = a[-1], b[-1]
        if SequenceMatcher(None, p, q).ratio() < 0.85 and p not in q and q not in p:
            return False
        f, g = (a[0] if len(a) > 1 else ""), (b[0] if len(b) > 1 else "")
        short = lambda n: len(n) == 1 or len(n) == 2 and n[1] == "."
        if not f or not g:
            return True
        return f[0] == g[0] if short(f) or short(g) else SequenceMatcher(None, f, g).ratio() >= 0.8

    wanted = {}
    for k, raw in rows:
        n = (raw or "").removeprefix("Mayor ").strip().lower()
        known = [(i, p.lower()) for i, p in people]
        steps = [("exact", [i for i, p in known if p == n])]
        alone = [i for i, p in known if n and p.split()[-1] == n.split()[-1]]
        steps += [("surname", alone if len(alone) == 1 else []), ("alike", [i for i, p in known if n and may_be(n, p)])]
        hit = next(((how, min(found)) for how, found in steps if found), None)
        if hit:
            wanted[k] = hit
    frame = lambda x, c: spark.createDataFrame(x, f"{c} long, name string")
    got = {r.row_id: (r.how, r.person_id) for r in records.match_people(frame(rows, "row_id"), frame(people, "id")).collect()}
    assert got == wanted and {how for how, _ in got.values()} == {"exact", "surname", "alike"}
