"""Copies of titles, items and matters are compared once, and nothing is lost by it."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from agora.operators import documents, matching, minutes

PREPARED = "id long, entity string, clusters array<string>, canonical boolean, policy string, low string"


def test_copies_of_titles_are_compared_once(spark, monkeypatch):
    rows = spark.range(3000).select(F.lit("an alike title").alias("a"), F.concat(F.lit("an alike titel "), (F.col("id") % 2).cast("string")).alias("b")).coalesce(1)
    got = {r.b: r.r for r in rows.select("b", documents.ratio(F.col("a"), F.col("b")).alias("r")).distinct().collect()}
    assert got == {b: SequenceMatcher(None, "an alike title", b).ratio() for b in ("an alike titel 0", "an alike titel 1")}
    assert spark.createDataFrame([("x", None)], "a string, b string").select(documents.ratio(F.col("a"), F.col("b")).alias("r")).first().r is None


def test_attachments_of_many_copies(spark):
    titles = ["Storm Water Plan", "Storm Water Plans", "Budget for Parks", "Zoning of Mill Lane", "Sewer works"]
    files = [(k, k % 3, titles[k % 5] + ("s" if k % 2 else "")) for k in range(4000)]
    items = [(k, k % 3, titles[0] if k > 20 else titles[k % 5]) for k in range(4000)]
    items += [(9000, 0, "Repairs of the old bridge"), (9001, 1, "Sale of the old library"), (9002, 1, "Sale of the new library")]
    files += [(9100, 0, "Repairs of the old bridges"), (9101, 1, "sale of the old library"), (9102, 1, "Sale of the odd library"), (9103, 2, "Repairs of the old bridge")]
    got = {tuple(r) for r in minutes.attachments(spark.createDataFrame(files, "file_id long, meeting_id long, title string"), spark.createDataFrame(items, "id long, meeting_id long, title string")).collect()}
    assert {x for x in got if x[0] >= 9000} == {(9100, 9000), (9101, 9001)}


def test_copies_of_items_and_matters_by_entity(spark):
    """Four thousand items and matters of one entity, which would be sixteen million pairs of rows."""
    items = spark.range(4000).select("id", F.lit("pool").alias("entity"), F.concat(F.lit("pool lease "), (F.col("id") % 4).cast("string")).alias("low"), F.lit(None).cast("string").alias("policy"))
    matters = spark.range(4000).select((F.col("id") + 10_000).alias("id"), F.lit("pool").alias("entity"), F.array().cast("array<string>").alias("clusters"), F.lit(False).alias("canonical"), F.lit(None).cast("string").alias("policy"), F.concat(F.lit("pool lease "), (F.col("id") % 8).cast("string")).alias("low"))
    got = {r.item_id: (r.matter_id, r.reason) for r in matching.by_entity(items, matters).collect()}
    assert got == {k: (10_000 + k % 4, "entity_cluster_title:pool:1.00") for k in range(4000)}
    members, classes = matching.classed(items, "entity", "policy", "low")
    assert members.count() == 4000 and {(r.id, r.copies) for r in classes.collect()} == {(k, 1000) for k in range(4)}


def test_corroborated_sets_of_a_bylaw_that_all_have(spark):
    dice = random.Random(9)
    laws = ["Bylaw 1", "Bylaw 2", "Bylaw 3", "Bylaw 777"]

    def rows():
        return [(k, "; ".join(dice.sample(laws, dice.choice([0, 1, 2, 2, 3]))), dice.choice(["Sale of land", "Sale of lands", "zzz 12 Oak Road", "Works in Oak Road", ""]), dice.choice([None, [], ["1 Elm St"], ["1 elm street", "2 Elm St"], ["9 Low Rd"]])) for k in range(60)]

    made = [spark.createDataFrame(rows(), "id long, identifier string, title string, addresses array<string>") for _ in "im"]
    none = F.array().cast("array<string>")
    m = matching.m

    def side(df, p):
        laws_, places = m.bylaws_among(m.identifiers("identifier")), F.transform(F.coalesce("addresses", none), m.plain_address)
        return matching.prefixed(df.select("id", laws_.alias("bylaws"), places.alias("places"), m.streets_in("title").alias("streets"), F.lower(matching.strip_stage("title")).alias("stripped")), p)

    pairs = side(made[0], "i_").join(side(made[1], "m_"), F.arrays_overlap("i_bylaws", "m_bylaws"))
    wanted = {(r.i_id, r.m_id, r.i_bylaws == r.m_bylaws) for r in matching.borne_out(pairs).collect()}
    got = [tuple(r) for r in matching.corroborated(*made).select("item_id", "matter_id", "same").collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and any(not x[2] for x in wanted)


def test_links_of_many_equal_titles(spark):
    """Sections and items with one title: the first item of each meeting, without a row for each pair."""
    sections = spark.range(5000).select((F.col("id") % 2).alias("meeting_id"), F.col("id").alias("doc"), F.lit(1).cast("long").alias("place"), F.lit("Renewal of the harbour lease").alias("title"))
    items = spark.range(5000).select("id", (F.col("id") % 2).alias("meeting_id"), F.concat(F.lit("9."), F.col("id").cast("string")).alias("number"), F.lit("Renewal of the Harbour Lease").alias("title"))
    got = sorted(tuple(r) for r in documents.linked_items(sections, items).select("doc", "item_id", "how").collect())
    assert got == [(0, 0, "title"), (1, 1, "title"), (2, 0, "title"), (3, 1, "title"), (4, 0, "title"), (5, 1, "title")]


def test_verdicts_of_classes_are_those_of_pairs(spark):
    """Matters of a few kinds, in pieces of seven: the rows of all pairs, and one class for a thousand copies."""
    dice = random.Random(3)
    titles = ["a", None, "Receipt of letters", "Amendment No. 3", "Amendment no 4", "x Elm Road", "Lot 12 Elm Road", "Lot 14 Elm Road", "Notice on Bylaw 5", "To vary Bylaw 5"]
    laws = [None, "Bylaw 5", "Bylaw 7", "Bylaw 7; Bylaw 8", "TUP 16-0001; Bylaw 1", "TUP16-0002"]
    rows = [(k, dice.choice(laws), dice.choice(titles), dice.choice([None, [], ["1 Fir St"], ["1 fir street"], ["2 Fir St", "1 Fir St"]]), dice.choice(["p", "q", "r", None]), dice.randrange(30)) for k in range(120)]
    rows += [(200 + k, None, "odd one", [], "alone" if k else "p", 1) for k in range(2)] + [(5, "Bylaw 7", "again", [], "p", 3)]
    matters = spark.createDataFrame(rows, "id long, identifier string, title string, addresses array<string>, block string, v int")
    near, titled = F.lit(1) - (F.col("v_a") + F.col("v_b")) % 40 / 100.0, F.col("v_a") * F.col("v_b") % 10 / 10.0
    a, b = (minutes.pair_facts(matters, s, ["block", "v"]) for s in "ab")
    wanted = sorted(tuple(r) for r in minutes.pair_verdicts(a.join(b, (F.col("block_a") == F.col("block_b")) & (F.col("id_a") < F.col("id_b"))).withColumns({"vectors": near, "titles": titled})).collect())
    for piece in (7, 8192):
        assert sorted(tuple(r) for r in minutes.block_verdicts(matters, ["v"], near, titled, piece=piece).collect()) == wanted
    assert {x[2] for x in wanted} == {"same_matter", "different", "judge", "unrelated"}
    copies = spark.range(3000).select("id", F.lit("Bylaw 7").alias("identifier"), F.lit("a").alias("title"), F.array().cast("array<string>").alias("addresses"), F.lit("p").alias("block"), F.lit(1).alias("v"))
    got = minutes.block_verdicts(copies, ["v"], near, titled)
    assert got.where("verdict = 'same_matter' and a < b").count() == 3000 * 2999 // 2
