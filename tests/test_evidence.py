"""Formal motions, bound quotes, canonical motions and the ledger, against brute force and literal cases."""

from __future__ import annotations

import hashlib
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from agora.operators import evidence
from agora.streaming import ledger


# --- formal motions --------------------------------------------------------------------------------------------------


def spans(text):
    """Formal motions by a walk over the lines."""
    line, at, out, opened, solid = [], 0, [], None, 0
    for x in text.split("\n"):
        low = re.sub(r"^[ \t]*\*{0,2}", "", x)
        if re.match(r"(?i)seconded([ \t]+by)?[ \t]*[:;]", low):
            opened = ("seconded_motion", at, at + len(x) + 1, solid)
        elif re.fullmatch(r"(?i)(on[ \t]+(the[ \t]+)?(main[ \t]+)?motion([ \t]+as[ \t]+amended)?|voting[ \t]+resumed[ \t]+on[ \t]+(the[ \t]+)?main[ \t]+motion)[ \t]*:?[ \t]*\*{0,2}[ \t]*", low):
            opened = ("resumed_main_motion", at, at + len(x), at)
        elif re.match(r"(?i)(motion[ \t]+)?(carried([ \t]+unanimously)?|not carried|defeated|withdrawn|tabled)\b", low):
            if opened and text[opened[2] : at].strip():
                out.append((opened[0], opened[1], opened[2], at, at + len(x), opened[3], text[opened[2] : at].strip(), x.strip(" ")))
            opened = None
        if x.strip():
            solid = at
        line.append(x)
        at += len(x) + 1
    return out


def test_formal_motions(spark):
    rng = random.Random(2)
    kinds = ["MOVED BY: A. Bird", "Seconded by: B", "  **SECONDED ;", "SECONDED C", "That it be so", "", "   ", "On the Motion", "On the main motion as amended:**", "on motion x", "Voting resumed on Main Motion", "CARRIED", "carried unanimously (5-0)", "Motion not carried", "carriedx", "**DEFEATED**", "Tabled", "é long line of prose", "Opposed: X, Y", "\r"]
    rows = [(k, "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 40)))) for k in range(150)] + [(900, None), (901, "SECONDED: a"), (902, "SECONDED: a\nb\nCARRIED"), (903, "CARRIED\n\nSECONDED: a\n\tb  \n\nTABLED\n")]
    found = evidence.formal_motions(spark.createDataFrame(rows, "doc long, text string")).collect()
    got = sorted((r.doc, r.kind, r.anchor_at, r.body_at, r.outcome_at, r.outcome_end, r.source_at, r.body, r.outcome) for r in found)
    assert len(got) > 80 and got == sorted((k, *x) for k, t in rows if t for x in spans(t))


def test_owned_motions(spark):
    text = "M: a\n SECONDED: b\nDo it.\nCARRIED\nSECONDED: c\ndo it\nOpposed: X\nDEFEATED\nSECONDED: d\nOther\nCARRIED"
    motions = evidence.formal_motions(spark.createDataFrame([(1, text)], "doc long, text string"))
    at = [m.start() for m in re.finditer("CARRIED|DEFEATED", text)]
    rows = [(1, 10, "seconded_motion", 0, at[0], "Do it"), (1, 11, "seconded_motion", 0, at[1] + 3, "DO IT!"), (1, 12, "resumed_main_motion", 0, at[2], "other"), (1, 13, "seconded_motion", at[1] + 10, at[2], "other"), (1, 14, "seconded_motion", at[1] + 9, at[2] - 1, "other"), (1, 15, "seconded_motion", 0, at[2], "else"), (2, 16, "seconded_motion", 0, at[2], "other"), (1, 17, "seconded_motion", 7, at[0], "Do it")]
    judged, leads = evidence.owned_motions(motions, spark.createDataFrame(rows, "doc long, block long, kind string, at int, outcome_at int, text string"))
    assert {r.block: (r.matching, r.own, r.status) for r in judged.collect()} == {10: (2, 1, "repeated"), 11: (2, 1, "repeated"), 12: (1, 0, "unowned"), 13: (1, 0, "unowned"), 14: (1, 0, "unowned"), 15: (0, 0, "unowned"), 16: (0, 0, "unowned"), 17: (2, 0, "repeated")}
    assert {r.body: r.owned for r in leads.collect()} == {"Do it.": True, "do it\nOpposed: X": True, "Other": False}


# --- statements ----------------------------------------------------------------------------------------------------


def test_bound_statements(spark):
    said = [("speaker_1", "we  should wait", 0.0, 4.0), ("speaker_1", "until  spring", 4.0, 8.0), ("Chair", "thank you", 8.0, 9.0), ("Chair", "thank you", 8.0, 9.0), ("Chair", "order", 9.0, float("nan")), ("Chair", "next, please", 70.0, 130.0), (None, "mumble", 140.0, 150.0)]
    source = spark.createDataFrame([(1, "s", k, *x) for k, x in enumerate(said)], "meeting_id long, sha string, k long, speaker string, text string, start double, end double")
    rows = [(100, 1, 7, 0.0, 5.0, "we should wait"), (101, 1, 7, 4.0, 8.5, "yes, until spring"), (102, 1, 8, 60.0, 140.0, "next, please"), (103, 1, 8, 140.0, 150.0, "mumble"), (104, 1, 9, 139.0, 151.0, "mumble")]
    stored = spark.createDataFrame(rows, "id long, meeting_id long, person_id long, start_time double, end_time double, text string")
    receipts = spark.createDataFrame([(100, 1, 7, "s", True), (101, 1, 7, "s", True), (102, 1, 8, "s", False), (102, 1, 8, "old", True)], "segment_id long, meeting_id long, person_id long, sha string, active boolean")
    people = spark.createDataFrame([(7, "Ann  Bird"), (8, "Bo"), (9, "bo")], "id long, name string")
    cases = [
        ("transcript", "s", [0, 1], "wait until", "claim", "bound"),
        ("transcript", "s", [0, 1], "ait until", "claim", "exact_quote_absent_from_original_selected_segments"),
        ("transcript", "s", [0], "should wait", "claim", "bound"),
        ("transcript", "s", [5], "next, please", "proposal", "bound"),
        ("transcript", "s", [5], ", please", "proposal", "bound"),
        ("transcript", "s", [1, 2], "spring thank", "claim", "source_quote_crosses_raw_speakers"),
        ("transcript", "s", [2], "thank you", "claim", "original_source_tuple_not_unique"),
        ("transcript", "s", [4], "order", "claim", "invalid_original_segment"),
        ("transcript", "s", [6], "mumble", "claim", "persisted_source_tuple_missing_or_ambiguous"),
        ("transcript", "s", [0], "should wait", "rumour", "unsupported_statement_type"),
        ("transcript", "t", [0], "wait", "claim", "original_transcript_hash_missing_or_changed"),
        ("transcript", None, [0], "wait", "claim", "original_transcript_hash_missing_or_changed"),
        ("vote", "s", [0], "wait", "claim", "spoken_statement_requires_transcript_not_recorded_vote_or_summary"),
        ("transcript", "s", [], "wait", "claim", "source_indexes_required"),
        ("transcript", "s", None, "wait", "claim", "source_indexes_required"),
        ("transcript", "s", [0, None], "wait", "claim", "source_indexes_required"),
        ("transcript", "s", [0, 2], "wait", "claim", "source_indexes_not_unique_contiguous_in_range"),
        ("transcript", "s", [1, 0], "wait", "claim", "source_indexes_not_unique_contiguous_in_range"),
        ("transcript", "s", [0, 0], "wait", "claim", "source_indexes_not_unique_contiguous_in_range"),
        ("transcript", "s", [6, 7], "wait", "claim", "source_indexes_not_unique_contiguous_in_range"),
        ("transcript", "s", [0], "  ", "claim", "exact_quote_absent_from_original_selected_segments"),
    ]
    given = spark.createDataFrame([(k, 1, *x[:5]) for k, x in enumerate(cases)] + [(99, 2, "transcript", "s", [0], "wait", "claim")], "statement long, meeting_id long, evidence string, sha string, indexes array<long>, quote string, kind string")
    found = {r.statement: r for r in evidence.bound_statements(given, source, stored, receipts, people).collect()}
    assert [found[k].status for k in range(len(cases))] == [x[5] for x in cases] and found[99].status == "source_context_unavailable"
    assert (found[0].segment_ids, found[0].start_time, found[0].person_id, found[0].speaker_name) == ([100, 101], 0.0, 7, "Ann  Bird")
    assert (found[3].segment_ids, found[3].person_id, found[3].speaker_name) == ([102], None, "Unidentified speaker") and found[1].segment_ids is None


# --- canonical motions -----------------------------------------------------------------------------------------------


def key(meeting, sha, at, ord_):
    return hashlib.sha256(json.dumps({"meeting_id": meeting, "source_sha256": sha, "source_offset": at, "source_order": ord_}, sort_keys=True).encode()).hexdigest()


def test_canonical_plan(spark):
    from datetime import date

    blocks, known, meetings = [], [], []

    def meeting(m, texts, olds, day=date(2020, 1, 2), body="Council"):
        meetings.append((m, date(2020, 1, 1), "Council", day, body))
        blocks.extend((m, "s", 10 * k, k, t, texts.count(t) == 1, 1) for k, t in enumerate(texts))
        known.extend((100 * m + k, m, t, o, p) for k, (t, o, p) in enumerate(olds))

    meeting(1, ["Plant trees", "Pave it"], [("PLANT trees!", None, None), ("Pave it", key(1, "s", 10, 1), None)])
    meeting(2, ["Plant trees"], [("Plant trees", "older", ["oldest"])])
    meeting(3, ["Plant trees", "Pave it"], [("Plant trees", None, None), ("Plant trees", None, None)])
    meeting(4, ["Plant trees", "Pave it"], [("Plant trees", None, None), ("Cut trees", None, None)])
    meeting(5, ["Plant trees", "Pave it"], [("Plant trees", key(5, "s", 0, 0), None)])
    meeting(6, ["Adjourn", "Adjourn"], [("Adjourn", key(6, "s", 10, 1), None)])
    meeting(7, ["Adjourn", "Adjourn"], [])
    meeting(8, ["Plant trees"], [], day=date(2020, 1, 9))
    meeting(9, ["Plant trees"], [], body="Committee")
    meeting(10, ["Plant trees"], [("Plant shrubs", key(10, "s", 0, 0), None)])
    meeting(11, ["Plant trees"], [("Plant trees", "older", [key(11, "s", 0, 0)])])
    args = [
        spark.createDataFrame(blocks, "meeting_id long, sha string, at int, ord int, text string, unique boolean, own int"),
        spark.createDataFrame(known, "id long, meeting_id long, text string, key string, previous array<string>"),
        spark.createDataFrame(meetings, "id long, day date, body string, source_day date, source_body string"),
    ]
    found = evidence.canonical_plan(*args).collect()
    got = {(r.meeting_id, r.ord): (r.status, r.motion_id, r.previous_keys) for r in found}
    assert all(r.key == key(r.meeting_id, "s", 10 * r.ord, r.ord) for r in found)
    held = lambda why: (why, None, None)
    assert got == {
        (1, 0): ("kept", 100, []), (1, 1): ("kept", 101, []), (2, 0): ("kept", 200, ["older", "oldest"]), (3, 0): held("ambiguous_legacy_or_source_body"), (3, 1): held("unmapped_legacy_records"),
        (4, 0): ("kept", 400, []), (4, 1): held("unmapped_legacy_records"), (5, 0): ("kept", 500, []), (5, 1): ("new", None, None), (6, 0): ("new", None, None), (6, 1): ("kept", 600, []),
        (7, 0): ("new", None, None), (7, 1): ("new", None, None), (8, 0): held("source_date_not_bound"), (9, 0): held("source_voting_body_not_bound"), (10, 0): held("unmapped_legacy_records"),
        (11, 0): ("kept", 1100, sorted(["older", key(11, "s", 0, 0)])),
    }


# --- the ledger -----------------------------------------------------------------------------------------------------


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key long, text string")


def state(spark, folder):
    return sorted(map(tuple, ledger.entries(spark, folder).select("batch", "key", "text").collect())), sorted(map(tuple, ledger.heads(spark, folder).collect()))


def test_replayed_batches_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    publish = ledger.publisher(folder, "key")
    publish(rows(spark, (1, "a"), (2, "b"), (2, "b")), 0)
    publish(rows(spark, (2, "again"), (3, None)), 1)
    before = state(spark, folder)
    assert before[0] == [(0, 1, "a"), (0, 2, "b"), (1, 3, None)]
    publish(rows(spark, (9, "other rows under a known number")), 1)
    publish(rows(spark, (1, "a")), 0)
    assert state(spark, folder) == before
    with pytest.raises(ledger.LedgerConflict):
        publish(rows(spark, (5, "x")), -1)
    publish(rows(spark, (1, "a")), 2)
    assert [(r.batch, r.n) for r in ledger.heads(spark, folder).orderBy("batch").collect()] == [(0, 2), (1, 1), (2, 0)]
    assert {r.status for r in ledger.audit(spark, folder).collect()} == {"sound"}


def test_stream_that_starts_again(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "ledger")

    def run():
        stream = spark.readStream.schema("key long, text string").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(ledger.publisher(folder, "key")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    rows(spark, *[(k, f"t{k}") for k in range(50)]).coalesce(1).write.mode("append").parquet(source)
    run()
    rows(spark, *[(k, f"u{k}") for k in range(40, 90)]).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = state(spark, folder)
    assert sorted((k, t) for _, k, t in got[0]) == [(k, f"{'t' if k < 50 else 'u'}{k}") for k in range(90)]
    assert [h[0] for h in got[1]] == [0, 1] and {r.status for r in ledger.audit(spark, folder).collect()} == {"sound"}


def test_a_batch_without_its_head_is_not_there(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    publish = ledger.publisher(folder, "key")
    publish(rows(spark, (1, "a")), 0)
    rows(spark, (7, "left behind")).withColumn("row_sha256", F.lit("x")).write.parquet(f"{folder}/rows/batch=1")
    assert state(spark, folder)[0] == [(0, 1, "a")]
    publish(rows(spark, (2, "b")), 1)
    assert state(spark, folder)[0] == [(0, 1, "a"), (1, 2, "b")]


def test_changes_are_found(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    publish = ledger.publisher(folder, "key")
    for k in range(4):
        publish(rows(spark, (k, f"t{k}")), k)
    forged = rows(spark, (1, "forged")).withColumn("row_sha256", F.lit("0" * 64))
    forged.write.mode("overwrite").parquet(f"{folder}/rows/batch=1")
    head = next(Path(folder, "heads").glob("*2.json"))
    told = json.loads(head.read_text())
    for crc in Path(folder, "heads").glob(".*2.json.crc"):
        crc.unlink()
    head.write_text(json.dumps(told | {"head": "f" * 64}) + "\n")
    assert {r.batch: r.status for r in ledger.audit(spark, folder).collect()} == {0: "sound", 1: "rows_changed", 2: "chain_broken", 3: "chain_broken"}


def test_digests_don_t_depend_on_order(spark):
    entry = [(k % 3, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(300)]
    frame = lambda rows: {r.batch: (r.n, r.digest) for r in evidence.batch_digest(spark.createDataFrame(rows, "batch long, digest string"), of_group=16).collect()}
    assert frame(entry) == frame(entry[::-1]) and frame(entry)[0] != frame(entry[3:])[0]
