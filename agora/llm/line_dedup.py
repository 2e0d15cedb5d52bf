"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared trimmed and with A-Z lower-cased. Two lines are within one edit if they are equal, if deleting one
character of the longer gives the shorter, or if deleting the same position of both gives the same string. So every line
emits itself and each of its one-character deletions as a hashed key of 124 bits; lines meet by equal keys, a minimum per
key names the earliest, and Levenshtein's distance verifies the pair. Equal lines are those of one 128-bit BLAKE2 digest. Two exact filters spare most lines the full neighbourhood: lines
within one edit share a half, and share all but one of ``PARTS`` parts, at a known place; lines that share none go no further.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import chunks, keyed, offsets_of, release, table, text_of
from agora.llm.textkernel import BLOCK, SHIFT, Rolling, mix, powers, reduced, runs, spread

#: Lines with fewer characters are never dropped; without words to tell them apart they repeat by chance.
MIN_CHARS = 20
#: Parts of a line of which one may differ, in the second filter.
PARTS = 8
TRIM = " \t\n\r\x0b\x0c"
LOWER = {c: c + 32 for c in range(65, 91)}
KIND, SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Lines:
    """Trimmed, lower-cased lines of a chunk of texts as stretches of code points."""

    def __init__(self, texts: pa.Array):
        ends = offsets_of(texts)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = heads[ends - ends[0]]
        self.cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint32)
        breaks = np.flatnonzero(cp == 10)
        # A text's lines begin at its start and after each of its breaks; they end at each break and at its end.
        starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
        doc = np.sort(np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, side="right") - 1]), kind="stable")
        stops = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
        first = np.searchsorted(doc, np.arange(len(bounds) - 1))
        self.doc, self.number = doc, np.arange(len(doc)) - first[doc]
        solid = np.flatnonzero(~np.isin(cp, np.frombuffer(TRIM.encode("utf-32-le"), np.uint32)))
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, stops)
        some = b > a
        self.start, self.end = starts.copy(), starts.copy()
        self.start[some], self.end[some] = solid[a[some]], solid[b[some] - 1] + 1
        self.hash = Rolling(self.cp)

    def keep(self, mask: np.ndarray) -> None:
        self.doc, self.number, self.start, self.end = self.doc[mask], self.number[mask], self.start[mask], self.end[mask]

    @property
    def size(self) -> np.ndarray:
        return self.end - self.start

    def digests(self) -> list[bytes]:
        raw = self.cp.tobytes()
        return [blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]

    def shared_keys(self, parts: int) -> np.ndarray:
        """For lines of this size and of one more: hashes of all but one part, for each part."""
        out = []
        for less in (0, 1):
            size = self.size - less
            for q in range(parts):
                low, high = size * q // parts, size * (q + 1) // parts
                before = self.hash.of(self.start, self.start + low)
                after = self.hash.of(self.end - (size - high), self.end)
                out.append(mix(mix(before + np.uint64((q + 1) * int(KIND) % (1 << 64))) + after * SIZE + size.astype(np.uint64)))
        return np.stack(out, axis=1)

    def deletions(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Line index and deleted position of every one-character deletion, so many at once that they fit in memory."""
        for lo, hi in runs(self.size, BLOCK // 4):
            line, at = np.repeat(np.arange(lo, hi), self.size[lo:hi]), spread(np.zeros(hi - lo, np.int64), self.size[lo:hi])
            for k in range(0, len(line), BLOCK // 4):
                yield line[k : k + BLOCK // 4], at[k : k + BLOCK // 4]

    def without(self, line: np.ndarray, at: np.ndarray, h: Rolling) -> np.ndarray:
        """Hashes of lines without the character at a position, or of whole lines where it is -1."""
        start, end = self.start[line], self.end[line]
        cut = np.where(at < 0, end, start + at)
        rest = np.minimum(cut + 1, end)
        a, b = (reduced(x + reduced(y * powers(base, int((cut - start).max(initial=0)) + 1)[cut - start])) for base, x, y in zip(h.bases, h.residues(start, cut), h.residues(rest, end), strict=True))
        return mix(((a << SHIFT) | b) + ((end - start - (at >= 0)).astype(np.uint64) << np.uint64(40)))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def listed(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), signed(np.ascontiguousarray(x).ravel()))


def all_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            lines = Lines(text_of(chunk, "text"))
            lines.keep(lines.size >= min_chars)
            doc = pa.array(lines.doc)
            yield pa.RecordBatch.from_arrays([chunk.column(0).take(doc), chunk.column(1).take(doc), pa.array(lines.number.astype(np.int32)), pa.array(lines.digests(), pa.binary()), listed(lines.shared_keys(2))], names=["id", "row_key", "line", "h", "keys"])

    return rows.select("id", "row_key", "text").mapInArrow(run, "id long, row_key int, line int, h binary, keys array<long>")


def texts_of(docs: DataFrame) -> DataFrame:
    """n and text of the lines whose numbers are in ``lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            n, line = [], []
            for text, wanted in zip(text_of(chunk, "text").to_pylist(), chunk.column(1).to_pylist(), strict=True):
                own = text.split("\n")
                n += [x["n"] for x in wanted]
                line += [own[x["line"]].strip(TRIM).translate(LOWER) for x in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(line, pa.string())], names=["n", "text"])

    return docs.select("text", "lines").mapInArrow(run, "n long, text string")


def part_keys(suspects: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            lines = Lines(text_of(chunk, "text"))
            yield pa.RecordBatch.from_arrays([chunk.column(0), listed(lines.shared_keys(parts))], names=["n", "keys"])

    return suspects.select("n", "text").mapInArrow(run, "n long, keys array<long>")


def neighbourhood(suspects: DataFrame) -> DataFrame:
    """variant, check (its 124 bits), at (the deleted position, -1 for the line itself), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 250_000):
            lines = Lines(text_of(chunk, "text"))
            again = Rolling(lines.cp, 1)
            every = np.arange(chunk.num_rows)
            for line, at in ((every, np.full(len(every), -1)), *lines.deletions()):
                yield pa.RecordBatch.from_arrays([signed(lines.without(line, at, lines.hash)), signed(lines.without(line, at, again)), pa.array(at.astype(np.int32)), chunk.column(0).take(pa.array(line))], names=["variant", "check", "at", "n"])

    return suspects.select("n", "text").mapInArrow(run, "variant long, check long, at int, n long")


def sharing(keys: DataFrame) -> DataFrame:
    """n of the lines with a key that another line has, too."""
    each = keys.select("n", F.explode("keys").alias("key"))
    shared = table(each.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select(F.col("key").alias("shared")), "keys")
    found = table(each.join(shared, F.col("key") == F.col("shared"), "left_semi").select("n").distinct(), "sharing")
    release(shared)
    return found


def nearest_earlier(variants: DataFrame) -> DataFrame:
    """n and partner: of the lines that meet line ``n`` (with ``first``, its first place) in a variant, the earliest, if earlier.

    A variant is shared by lines of one length at most two edits apart: their number is bounded by that length times the
    alphabet, since only distinct lines come here.
    """
    me = F.struct("first", "n")
    of_variant = Window.partitionBy("variant", "check")
    same_place = Window.partitionBy("variant", "check", "at")
    itself = F.min(F.when(F.col("at") < 0, me)).over(of_variant)
    shorter = F.min(F.when(F.col("at") >= 0, me)).over(of_variant)
    met = variants.repartition("variant", "check").withColumn("itself", itself).withColumn("shorter", shorter).withColumn("there", F.min(me).over(same_place))
    partner = F.when(F.col("at") < 0, F.col("shorter")).otherwise(F.least("itself", "there"))
    return met.withColumn("partner", partner).where(F.col("partner.first") < F.col("first")).select("n", F.col("partner.n").alias("partner")).distinct()


def near_lines(known: DataFrame, distinct: DataFrame, bound: int, parts: int) -> DataFrame:
    """near: the distinct lines (n, first, keys) with another, earlier one within ``bound`` edits."""
    firsts = distinct.select(F.col("n").alias("n_"), "first")
    suspects = sharing(distinct.select("n", "keys"))
    wanted = F.collect_list(F.struct(F.col("first.line").alias("line"), F.col("n_").alias("n"))).alias("lines")
    at = firsts.join(suspects, F.col("n_") == F.col("n"), "left_semi").groupBy(F.col("first.id").alias("id_"), F.col("first.row_key").alias("key_")).agg(wanted)
    at = table(at, "suspects")
    docs = known.select("id", "row_key", "text").join(at.where(F.size("lines") > 0).hint("merge"), (F.col("id") == F.col("id_")) & (F.col("row_key") == F.col("key_")))
    # Rows repeated as a whole give their lines repeatedly.
    raw = table(texts_of(docs).dropDuplicates(["n"]), "texts")
    alike = sharing(part_keys(raw, parts))
    texts = table(raw.join(alike, "n", "left_semi").join(firsts, F.col("n") == F.col("n_")).select("n", "first", "text"), "texts")
    variants = neighbourhood(texts).join(texts.select(F.col("n").alias("n_"), "first"), F.col("n") == F.col("n_")).select("variant", "check", "at", "n", "first")
    pairs = table(nearest_earlier(variants), "pairs")
    mine = texts.select(F.col("n").alias("mine"), F.col("text").alias("text_a"))
    other = texts.select(F.col("n").alias("other"), F.col("text").alias("text_b"))
    verified = pairs.join(mine, F.col("n") == F.col("mine")).join(other, F.col("partner") == F.col("other")).where(F.levenshtein("text_a", "text_b", bound).between(0, bound))
    near = table(verified.select(F.col("n").alias("near")).distinct(), "near")
    release(suspects, at, raw, alike, texts, pairs)
    return near


def decisions(rows: DataFrame, bound: int, min_chars: int, parts: int = PARTS) -> DataFrame:
    """of_id, of_key, dropped: the numbers of each document's lines that go."""
    known = rows.where("id is not null")
    lines = table(all_lines(known, min_chars), "lines")
    place = F.struct("id", "line", "row_key")
    each = lines.groupBy("h").agg(F.min(place).alias("first"), F.first("keys").alias("keys"))
    distinct = table(each.withColumn("n", F.monotonically_increasing_id()), "distinct")
    firsts, read = distinct.select(F.col("h").alias("h_"), "first", "n"), [lines, distinct]
    if bound:
        near = near_lines(known, distinct, bound, parts)
        read.append(near)
        verdicts = firsts.join(near, F.col("n") == F.col("near"), "left").select("h_", "first", F.col("near").isNotNull().alias("goes"))
    else:
        verdicts = firsts.select("h_", "first", F.lit(False).alias("goes"))
    verdicts = table(verdicts, "verdicts")
    gone = lines.join(verdicts, F.col("h") == F.col("h_")).where(F.col("goes") | (place != F.col("first")))
    dropped = table(gone.groupBy(F.col("id").alias("of_id"), F.col("row_key").alias("of_key")).agg(F.collect_set("line").alias("dropped")), "dropped")
    release(*read, verdicts)
    return dropped


def dedup(docs: DataFrame, bound: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (the columns of ``docs``), n_lines, n_dropped and kept (the text without the dropped lines) for every row.

    A line of at least ``min_chars`` characters (trimmed) goes if an earlier line, by doc_id and then by place, is within
    ``bound`` (0 or 1) edits of it; whether that one stays doesn't matter. Null and empty texts have no lines and stay as
    they are; rows with a null doc_id are neither compared nor cut; rows that repeat doc_id and text count as one document.
    A text whose lines all go becomes empty. Columns of any other name may be there.
    """
    if bound not in (0, 1):
        raise ValueError("the bound is 0 or 1 edits")
    rows = keyed(docs)
    joined = rows.join(decisions(rows, bound, min_chars).hint("merge"), (F.col("id") == F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("dropped", i)), "\n")
    n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long")
    return joined.select("row", n.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"))
