"""Filter interaction audit: what each of five filters removes, alone, after others, and on average over all their orders.

Texts are scanned in place, over the bytes of Arrow buffers: classes of bytes by table look-up, counts per text by prefix
sums at the texts' borders. Distinct words of a text come from its words sorted by hash; neighbours with equal hashes are
compared byte by byte, and should two that differ have one hash, another hash is taken. The five verdicts of a text are
bits of a mask. What is shuffled is a digest and a mask; equal texts have equal masks, so that copies are summed up before
anything is joined, and the audit itself is a sum over at most 32 masks for each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.runtime import chunks, text_of
from agora.llm.textkernel import all_equal, stretch_hashes, words

FILTERS = "ABCDE"
#: Fewer words fail A; a share of distinct words below this, in percent, fails B; a share of capitals above this fails C.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
CAPITAL, SYMBOL, LEAD = (np.zeros(256, bool) for _ in range(3))
CAPITAL[ord("A") : ord("Z") + 1] = True
SYMBOL[list(b"#$%&*|")] = True
LEAD[:0x80], LEAD[0xC0:] = True, True  # the first byte of a code point


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def distinct_words(found) -> np.ndarray:
    """The number of different words of each text: its words sorted by hash, equal hashes verified."""
    size, doc, turn = found.ends - found.starts, found.doc(), 0
    while True:
        h = stretch_hashes(found.data, found.starts, found.ends, turn)
        order = np.lexsort((h, doc))
        a, b = order[:-1], order[1:]
        same = (doc[a] == doc[b]) & (h[a] == h[b])
        a, b = a[same], b[same]
        if np.array_equal(size[a], size[b]) and all_equal(found.data, found.starts[a], found.data, found.starts[b], size[a]):
            return found.counts - np.bincount(doc[b], minlength=len(found.bounds) - 1)
        turn += 1


def masks(texts: pa.Array) -> np.ndarray:
    """Which of A to D each text fails, as bits 0 to 3."""
    found = words(texts)
    n_words, points = found.counts, per_text(LEAD[found.data], found.bounds)
    fails = [
        n_words < MIN_WORDS,
        100 * distinct_words(found) < MIN_DISTINCT * n_words,
        100 * per_text(CAPITAL[found.data], found.bounds) > MAX_CAPITALS * points,
        per_text(SYMBOL[found.data], found.bounds) > 0,
    ]
    return sum(np.asarray(f).astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text), mask (A to D) of every row; a null text is empty, a null lang the empty part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            texts = text_of(chunk, "text")
            digests = pa.array([hashlib.sha256(x.as_py().encode()).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), digests, pa.array(masks(texts))], names=["doc_id", "part", "digest", "mask"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), docs["text"].alias("text"))
    return slim.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (A to E as bits 0 to 4), n, good, toxic: how many rows have it, and how many of those are labelled so.

    E fails what a smaller doc_id has word for word, anywhere in the table; rows without an id are before and after nothing.
    A document is good, or toxic, if any of its labels says so.
    """
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows with one id and text are summed first, then all copies of a text that count alike: no text is a large group when joined
    rows = scanned(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(judged, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    without = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), without.alias("without"))
    firsts = copies.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    first = F.coalesce(F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")), F.lit(0)) + F.col("without")
    split = copies.join(firsts, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see ``op11`` for the columns.

    Docs: doc_id, lang, text; labels: doc_id, quality, toxic. Every row of docs counts, repeated or not; extra columns are
    not looked at. An empty table has no parts and gives no rows.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    step = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    each = mask_counts(docs, labels).withColumn("filter_order", F.explode(orders)).withColumn("step", step)
    bit = {f: F.lit(1 << k) for k, f in enumerate(FILTERS)}
    at = lambda k: F.element_at(F.create_map(*[x for f, b in bit.items() for x in (F.lit(f), b)]), F.substr("filter_order", k, F.lit(1)))
    earlier = sum((F.when(F.col("step") > k, at(F.lit(k))).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    each = each.withColumn("own", at(F.col("step"))).withColumn("earlier", earlier)
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    count = lambda flag, n="n": F.sum(F.when(flag, F.col(n)).otherwise(0))
    # a filter removes what fails m filters in the orders that begin, among those m, with itself: one order in m
    share = F.when(fails, F.col("n") * F.floor(F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1)))).otherwise(0)
    return each.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )
