"""Best-fit packing of token sequences, certified by lower bounds and repaired by exchange.

Documents are cut into pieces of at most ``capacity`` tokens. Full pieces are sequences of their own. The others are
dealt to groups of bounded size; each group is packed by best-fit decreasing and certified by dual feasible functions,
which give a number of bins that no packing can undercut. A group with more bins than its bound keeps its full bins;
the documents of the others are pooled, dealt anew and packed again, round after round, until nothing is left to gain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.runtime import chunks, release, table, text_of
from agora.llm.token_counts import pretoken_table

#: Documents of a group at most, on average: what one task packs at once.
GROUP = 8192
#: Rounds of exchange after the first packing.
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, bin long, at long, done boolean"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every document's pieces with the CRC-32 of their ids. Null texts are empty; each row counts, repeated or not."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            rows = []
            for doc_id, ids in zip(chunk.column(0).to_pylist(), pretoken_table(vocab_path).encode(text_of(chunk, "text")), strict=True):
                raw = ids.tobytes() + np.array([end_id], "<u4").tobytes()
                rows += [(doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(ids) + 1, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's bin and its offset there; the longest first, each into the fullest bin that has room."""
    bins, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, made = 0, 0  # bit r of some: a bin has r tokens of room
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, b, made = capacity, made, made + 1
        bins[i], at[i] = b, capacity - r
        if r > n:
            room[r - n].append(b)
            some |= 1 << (r - n)
    return bins, at


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the bounds that two families of dual feasible functions give.

    A function f with sum f(x) <= capacity for every set of lengths that fits a bin bounds the bins by sum f / capacity.
    """
    if not len(lengths):
        return 0
    x, count = np.unique(lengths, return_counts=True)
    x = x.astype(np.int64)
    best = -(-int((x * count).sum()) // capacity)
    for small in np.unique(np.minimum(x, capacity - x)):
        if 0 < small <= capacity // 2:  # lengths over capacity - small leave no room for small ones
            f = np.where(x > capacity - small, capacity, np.where(x < small, 0, x))
            best = max(best, -(-int((f * count).sum()) // capacity))
    for k in range(1, 21):  # rounding to steps of capacity / k
        whole = (k + 1) * x % capacity == 0
        f = np.where(whole, x * k, capacity * ((k + 1) * x // capacity))
        best = max(best, -(-int((f * count).sum()) // (capacity * k)))
    return best


def packer(capacity: int, last: bool):
    """Packs one group. Bins of a certified group are done; of another, the full ones, or all in the last round."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable")
        lengths = group["length"].to_numpy(np.int64)
        bins, at = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        certified = n <= lower_bound(lengths, capacity)
        full = np.bincount(bins, weights=lengths, minlength=n) == capacity
        return pd.DataFrame({c: group[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"bin": bins + group["slot"].iloc[0] * (1 << 32), "at": at, "done": full[bins] | certified | last})

    return pack


def pack(docs: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 2, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``.

    Null and empty texts are one piece with the end id alone; null ids and repeated rows are packed like others; other
    columns are ignored. Lengths alone are shuffled, never ids or texts. Groups are numbered by a hash of the piece, so
    that they are even whatever the documents; a round that nothing is left for ends the exchange.
    """
    cut = table(pieces(docs, vocab_path, capacity, end_id), "pieces")
    full = F.col("length") == capacity
    one = F.xxhash64("doc_id", "piece", "ids_crc32")
    ready = cut.where(full).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    open_, done, read = cut.where(~full), [], [cut]
    for k in range(rounds + 1):
        n = open_.count()
        if not n:
            break
        groups = -(-n // group)
        last = k == rounds or groups == 1
        dealt = open_.withColumn("slot", F.pmod(F.xxhash64(one, F.lit(k)), F.lit(groups)).cast("long") + (k << 24))
        placed = table(dealt.groupBy("slot").applyInPandas(packer(capacity, last), PLACED), "packed")
        read.append(placed)
        done.append(placed.where("done").select(*cut.columns, (F.col("bin") + (1 << 61)).alias("sequence_id"), F.col("at").alias("offset")))
        open_ = placed.where(~F.col("done")).select(*cut.columns)
        if last:
            break
    for part in done:
        ready = ready.unionByName(part)
    packed = table(ready, "sequences")
    release(*read)
    return packed
