"""Removal of repeated word windows by level-wise doubling.

The levels are the window's length and its halves down to a few words (6, 12, 25, 50). Of the shortest windows, each
document takes those that are least by hash within any full window around them, so that equal full windows give equal
candidates. A candidate that two documents share survives, and it alone is extended to both sides to the next level's
length; one of the two extensions lies in the same full window. So it goes on until no candidate survives or the full
length is next. The last candidates are extended to the neighbourhood of all full windows around them: where a smaller
document has the same neighbourhood, they all go at once; in the smallest document that has it, the full windows are
compared one by one. The smallest document with a full window always takes part there, so that no repeat is lost.
Candidates are told apart by 62 bits; what decides about words, neighbourhoods and full windows, by 124 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import chunks, keyed, release, table, text_of
from agora.llm.textkernel import Rolling, Words, mix, spread, words

#: Words of the shortest candidates at least, if the window isn't shorter than twice that.
SHORTEST = 6
#: Keys that most windows have, so many, which are told to all tasks instead of drawing their windows to one: any other key
#: has at most this part of all windows.
HOTTEST = 1000
KEY = "id long, row_key int"


def levels(length: int) -> list[int]:
    """Lengths from the shortest candidates' to the full one's."""
    out = [max(1, length // 2), length]
    while out[0] // 2 >= SHORTEST:
        out.insert(0, out[0] // 2)
    return out


def sliding(values: np.ndarray, width: int, pick: np.ufunc, outside: int) -> np.ndarray:
    """pick over values[i : i + width] for every i, by doubling; ``outside`` stands beyond the end."""
    n, size = len(values), 1
    out = np.concatenate([values, np.full(width, outside, values.dtype)])
    while 2 * size <= width:
        out[: len(out) - size] = pick(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:n], out[rest : rest + n])


def anchors(w: Words, h: Rolling, length: int, short: int) -> np.ndarray:
    """The first words of the candidates: of each full window, the short windows in it with the least hash."""
    turns = length - short + 1
    n = len(w.starts)
    end = w.first[1:][w.doc()]
    at = np.arange(n)
    own = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    fits = at + short <= end
    own[fits] = mix(h.of(at[fits], at[fits] + short))
    least = sliding(own, turns, np.minimum, np.iinfo(np.uint64).max)
    least[at + length > end] = 0
    most = sliding(np.concatenate([np.zeros(turns - 1, np.uint64), least]), turns, np.maximum, 0)[:n]
    return np.flatnonzero(fits & (most == own))


def longs(x: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.view(np.int64), mask=missing)


def owner(w: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, at, side="right") - 1


def first_candidates(docs: DataFrame, length: int, short: int, longer: int) -> DataFrame:
    """id, row_key, pos, h of the shortest candidates, and of their extensions to the next level, right and left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            w = words(text_of(chunk, "text"))
            h = Rolling(w.hashes())
            at = anchors(w, h, length, short)
            doc = owner(w, at)
            ahead, behind = np.minimum(at + longer, len(w.starts)), np.maximum(at + short - longer, 0)
            right, left = mix(h.of(at, ahead)), mix(h.of(behind, at + short))
            no_right, no_left = at + longer > w.first[doc + 1], at + short - longer < w.first[doc]
            yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(doc)), chunk.column(1).take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)), longs(mix(h.of(at, at + short))), longs(right, no_right), longs(left, no_left)], names=["id", "row_key", "pos", "h", "right", "left"])

    return docs.select("id", "row_key", "text").mapInArrow(run, f"{KEY}, pos int, h long, right long, left long")


def marked(w: Words, spots: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and word index of each text's spots."""
    size = spots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    return doc, spots.flatten().to_numpy().astype(np.int64) + w.first[doc]


def extended(texts: DataFrame, short: int, longer: int, length: int) -> DataFrame:
    """id, row_key, pos, h of the spots' extensions to both sides, and around, again: a digest of each one's neighbourhood,
    all the full windows around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            w = words(text_of(chunk, "text"))
            h, g = Rolling(w.hashes()), Rolling(w.hashes(1), 1)
            doc, at = marked(w, chunk.column(3))
            at, doc = np.concatenate([at, at + short - longer]), np.concatenate([doc, doc])
            inside = (at >= w.first[doc]) & (at + longer <= w.first[doc + 1])
            at = np.unique(at[inside])
            doc = owner(w, at)
            low, high = np.maximum(w.first[doc], at + longer - length), np.minimum(w.first[doc + 1], at + length)
            form = (at - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (high - low).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(doc)), chunk.column(1).take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)), longs(mix(h.of(at, at + longer))), longs(mix(h.of(low, high)) ^ form), longs(mix(g.of(low, high)) ^ form)], names=["id", "row_key", "pos", "h", "around", "again"])

    return texts.select("id", "row_key", "text", "spots").mapInArrow(run, f"{KEY}, pos int, h long, around long, again long")


def full_windows(texts: DataFrame, short: int, length: int) -> DataFrame:
    """id, row_key, start, h, g of every full window around the candidates in ``spots``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            w = words(text_of(chunk, "text"))
            doc, at = marked(w, chunk.column(3))
            # One mark opens and one closes the starts that each candidate allows.
            low, high = np.maximum(w.first[doc], at + short - length), np.minimum(at, w.first[doc + 1] - length)
            marks = np.bincount(low, minlength=len(w.starts) + 1)[: len(w.starts) + 1] - np.bincount(high + 1, minlength=len(w.starts) + 1)[: len(w.starts) + 1]
            start = np.flatnonzero(np.cumsum(marks) > 0)
            doc = owner(w, start)
            h, g = (mix(Rolling(w.hashes(k), k).of(start, start + length)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([chunk.column(0).take(pa.array(doc)), chunk.column(1).take(pa.array(doc)), pa.array((start - w.first[doc]).astype(np.int32)), longs(h), longs(g)], names=["id", "row_key", "start", "h", "g"])

    return texts.select("id", "row_key", "text", "spots").mapInArrow(run, f"{KEY}, start int, h long, g long")


def shared(windows: DataFrame, *keys: str) -> DataFrame:
    """The keys (suffixed with an underscore) that two documents have, with the lesser id of those that have them."""
    found = windows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    return found.select(*(F.col(k).alias(f"{k}_") for k in keys), "least", "n")


def of_keys(windows: DataFrame, found: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The windows that have one of the keys (suffixed with an underscore, with n, in a table), with what the keys come
    with, and the table of the hottest keys, which the result reads."""
    hot = table(found.orderBy(F.col("n").desc()).limit(HOTTEST), "hot")
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{k}_") for k in keys))
    few = F.broadcast(hot)  # HOTTEST rows at most
    return windows.join(few, same).unionByName(windows.join(few, same, "left_anti").join(found, same)), hot


def with_spots(known: DataFrame, spots: DataFrame) -> DataFrame:
    """The texts of the documents that have spots."""
    at = spots.where(F.size("spots") > 0).select(F.col("id").alias("id_"), F.col("row_key").alias("key_"), "spots")
    return known.select("id", "row_key", "text").join(at, (F.col("id") == F.col("id_")) & (F.col("row_key") == F.col("key_")))


def gathered(windows: DataFrame) -> DataFrame:
    """A table of id, row_key, spots of the windows (id, row_key, pos, h) that two documents share."""
    found = table(shared(windows, "h"), "shared")
    rows, hot = of_keys(windows, found, "h")
    spots = table(rows.groupBy("id", "row_key").agg(F.collect_set("pos").alias("spots")), "spots")
    release(found, hot)
    return spots


def survivors(known: DataFrame, length: int, short: int, longer: int) -> DataFrame:
    """id, row_key, spots of the second level: extensions that two documents share of candidates that they share."""
    named = table(first_candidates(known, length, short, longer), "windows")
    found = table(shared(named, "h"), "shared")
    rows, hot = of_keys(named, found, "h")
    alive = table(rows.select("id", "row_key", "pos", "right", "left"), "alive")
    sides = F.explode(F.array(F.struct(F.col("pos").alias("pos"), F.col("right").alias("h")), F.struct((F.col("pos") + short - longer).alias("pos"), F.col("left").alias("h"))))
    spots = gathered(alive.select("id", "row_key", sides.alias("s")).select("id", "row_key", "s.pos", "s.h").where("h is not null"))
    release(named, alive, found, hot)
    return spots


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """of_id, of_key, covered (last candidates whose whole neighbourhood goes), starts (of other full windows that go)."""
    known = rows.where("id is not null")
    below = levels(length)[:-1]
    at = below[:2][-1]
    spots = survivors(known, length, below[0], at)
    # The last level below the full one takes the neighbourhoods along, even if the first step went so far already.
    for longer in below[2:] or [at]:
        if spots.isEmpty():
            return spots.select(F.col("id").alias("of_id"), F.col("row_key").alias("of_key"), F.col("spots").alias("covered"), F.col("spots").alias("starts"))
        windows = table(extended(with_spots(known, spots), at, longer, length), "windows")
        release(spots)
        at = longer
        if longer != below[-1]:
            spots = gathered(windows)
            release(windows)
    around = table(windows.groupBy("h", "around", "again").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")), "around")
    both = around.groupBy("h").agg(F.min("least").alias("low"), F.max("most").alias("high")).where("low < high").select(F.col("h").alias("shared"))
    alive = table(around.join(both, F.col("h") == F.col("shared"), "left_semi").select(F.col("h").alias("h_"), F.col("around").alias("around_"), F.col("again").alias("again_"), "least", "n"), "alive")
    rows, hot = of_keys(windows, alive, "h", "around", "again")
    first = F.col("least") == F.col("id")
    spots = table(rows.groupBy("id", "row_key").agg(F.collect_set(F.when(first, F.col("pos"))).alias("spots"), F.collect_set(F.when(~first, F.col("pos"))).alias("covered")), "spots")
    release(windows, around, alive, hot)
    full = table(full_windows(with_spots(known, spots), at, length), "full")
    least = table(shared(full, "h", "g"), "least")
    starts = full.join(least, (F.col("h") == F.col("h_")) & (F.col("g") == F.col("g_")) & (F.col("id") > F.col("least"))).groupBy("id", "row_key").agg(F.collect_set("start").alias("starts"))
    starts = table(starts.select(F.col("id").alias("id_"), F.col("row_key").alias("key_"), "starts"), "starts")
    release(full, least)
    joined = spots.where(F.size("covered") > 0).select("id", "row_key", "covered").join(starts, (F.col("id") == F.col("id_")) & (F.col("row_key") == F.col("key_")), "full_outer")
    found = table(joined.select(F.coalesce("id", "id_").alias("of_id"), F.coalesce("row_key", "key_").alias("of_key"), "covered", "starts"), "repeats")
    release(spots, starts)
    return found


def removed_words(w: Words, covered: pa.ListArray, starts: pa.ListArray, length: int) -> np.ndarray:
    """Which words go."""
    n = len(w.starts)
    marks = np.zeros(n + 1, np.int64)
    for spots, before in ((covered, length - levels(length)[-2]), (starts, 0)):
        doc, at = marked(w, spots)
        np.add.at(marks, np.maximum(w.first[doc], at - before), 1)
        np.add.at(marks, np.minimum(w.first[doc + 1], at + length), -1)
    return np.cumsum(marks)[:n] > 0


def without(texts: pa.Array, covered: pa.ListArray, starts: pa.ListArray, length: int) -> tuple[list, list, list, list]:
    """Of each text: words, words that go, SHA-256 of the kept words joined by spaces, and the text without the others.

    A run of words that go takes the white space after it along; nothing else of the text changes.
    """
    w = words(texts)
    gone = removed_words(w, covered, starts, length)
    raw = w.data.tobytes()
    counts, removed, digests, kept = w.counts.tolist(), [], [], []
    for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        top, bottom = int(w.bounds[k]), int(w.bounds[k + 1])
        out = gone[a:b]
        n = int(out.sum())
        removed.append(n)
        if not n:
            text = raw[top:bottom]
        else:
            turn = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
            edges = [int(w.starts[a + t]) if a + t < b else bottom for t in turn.tolist()]
            parts, at = [], top
            for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                parts.append(raw[at:lo])
                at = hi
            text = b"".join([*parts, raw[at:bottom]])
        digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
        kept.append(text.decode())
    return counts, removed, digests, kept


def dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """row (the columns of ``docs``), n_words, n_removed, kept_sha256 and kept (the text that stays) for every row.

    A word goes if it is in a window of ``length`` words whose word sequence also starts in a document with a smaller
    doc_id. Null and empty texts have no words; rows with a null doc_id are neither compared nor cut; rows that repeat a
    doc_id are compared with other ids, not with each other. Columns of any other name may be there.
    """
    rows = keyed(docs)
    found = repeats(rows, length)
    joined = rows.join(found, (F.col("id") == F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left").select("row", "text", "covered", "starts")
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            made = without(text_of(chunk, "text"), chunk.column(2), chunk.column(3), length)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([chunk.column(0), *(pa.array(x, kind) for x, kind in zip(made, kinds, strict=True))], names=schema.names)

    return joined.mapInArrow(run, schema)
