"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Two fingerprints with few differing bits agree in whole blocks: of ``radius + AGREE`` blocks at most ``radius`` can differ,
so that ``AGREE`` agree. Each fingerprint therefore goes to one shard for every choice of so many blocks, with the
bits it has there; a BK-tree indexes each shard, children keyed by their integer Hamming distance to the parent, and every
fingerprint of the shard follows only the edges within the radius. Shards of more than ``PIECE`` fingerprints are cut
into pieces: each pair of pieces is a task of its own, to which one piece's tree and the other's queries are sent. What a
task emits is a spanning forest, never all pairs. Trees go to the tasks that need them by shuffle instead of broadcast,
since their total grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from agora.llm.components import components
from agora.llm.runtime import chunks, release, table, text_of
from agora.llm.textkernel import spanning

#: Blocks that two fingerprints within the radius surely agree in, of as many more as the radius has bits.
AGREE = 2
#: Fingerprints of a shard that one tree holds at most, on average.
PIECE = 2048
#: Rows of whole shards that a task indexes at once.
FOREST = 60_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LANES = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).copy().view(np.uint64)[:, 0]


def hashes(raw: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - shingle + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, last)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the values have, counted in byte lanes of 255 rows."""
    if not len(h):
        return 0
    lanes = LANES[h.view(np.uint8).reshape(-1, 8)]
    padded = np.zeros((-(-len(h) // 255) * 255, 8), np.uint64)
    padded[: len(h)] = lanes
    counts = padded.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * counts > len(h)))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp, the 64 bits as a signed long; a null text has the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            made = np.array([majority(hashes(x.as_buffer().to_pybytes(), shingle)) for x in text_of(chunk, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def choices(radius: int, blocks: int | None = None) -> list[int]:
    """The masks of every choice of so many blocks that two fingerprints within the radius agree in one choice."""
    blocks = blocks or radius + AGREE
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    picked = [sum(c) for c in combinations(masks, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in picked]


class Forest:
    """BK-trees of many shards at once, built level by level: the first of the rows that share a path is the node."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        n = len(fp)
        self.fp = fp
        self.root = np.full(int(shard.max()) + 1 if n else 0, -1)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rows, group = np.arange(n), shard.astype(np.int64)
        above = np.full(len(self.root), -1)
        step = np.zeros(len(self.root), np.int64)
        while len(rows):
            ids, first, back = np.unique(group, return_index=True, return_inverse=True)
            node = rows[first]
            parent[node], edge[node] = above[ids], step[ids]
            top = above[ids] < 0
            self.root[shard[node[top]]] = node[top]
            rest = np.ones(len(rows), bool)
            rest[first] = False
            rows, under = rows[rest], node[back[rest]]
            d = np.bitwise_count(fp[rows] ^ fp[under]).astype(np.int64)
            keys, group = np.unique(under * 128 + d, return_inverse=True)
            above, step = keys // 128, keys % 128
        inner = np.flatnonzero(parent >= 0)
        keys = parent[inner] * 128 + edge[inner]
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], inner[order]

    def within(self, query: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query's index and a row within the radius."""
        at = np.arange(len(query))
        node = self.root[shard]
        at, node = at[node >= 0], node[node >= 0]
        while len(at):
            d = np.bitwise_count(query[at] ^ self.fp[node]).astype(np.int64)
            hit = d <= radius
            yield at[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 128 + d + radius, side="right")
            size = np.maximum(hi - lo, 0)
            inside = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            at, node = np.repeat(at, size), self.child[inside]


def links(rows: pa.Table, radius: int) -> pa.RecordBatch:
    """A spanning forest of the links within whole shards; rows: unit, tree boolean, query boolean, fp, node."""
    fp = rows.column("fp").to_numpy().view(np.uint64)
    ident = rows.column("node").to_numpy()
    _, unit = np.unique(rows.column("unit").to_numpy(), return_inverse=True)
    tree, query = (np.flatnonzero(rows.column(c).to_numpy()) for c in ("tree", "query"))
    a = b = np.zeros(0, np.int64)
    if len(tree) and len(query):
        units = int(unit.max()) + 1
        forest = Forest(fp[tree], unit[tree])
        forest.root = np.concatenate([forest.root, np.full(units - len(forest.root), -1)])
        for k in range(0, len(query), PIECE):
            part = query[k : k + PIECE]
            for at, node in forest.within(fp[part], unit[part], radius):
                x, y = part[at], tree[node]
                a, b = np.concatenate([a, x[x != y]]), np.concatenate([b, y[x != y]])
                if len(a) > 4 * len(fp) + 100_000:
                    label = spanning(a, b, len(fp))
                    a = np.flatnonzero(label != np.arange(len(fp)))
                    b = label[a]
    label = spanning(a, b, len(fp))
    a = np.flatnonzero(label != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(ident[a]), pa.array(ident[label[a]])], names=["a", "b"])


def whole_units(batches: Iterator[pa.RecordBatch], limit: int = FOREST) -> Iterator[pa.Table]:
    """Tables of whole units from batches that are sorted by unit."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(batch.schema.get_field_index("unit")).to_numpy()
        starts = np.flatnonzero(np.diff(unit) != 0) + 1
        before = held[-1].column(held[-1].schema.get_field_index("unit"))[-1].as_py() if held else None
        cuts = ([0] if held and before != unit[0] else []) + starts.tolist()
        at = 0
        for cut in cuts:
            if n + cut - at >= limit:
                held.append(batch.slice(at, cut - at))
                yield pa.Table.from_batches(held)
                held, n, at = [], 0, cut
        held.append(batch.slice(at))
        n += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def near_links(nodes: DataFrame, radius: int = 4, piece: int = PIECE) -> DataFrame:
    """a, b: a spanning forest of each shard's links of fingerprints (fp, node long, each fp once) that differ in at most
    ``radius`` bits."""
    keys = F.explode(F.array(*[F.struct(F.xxhash64(F.col("fp").bitwiseAND(F.lit(m)), F.lit(k)).alias("key")) for k, m in enumerate(choices(radius))]))
    dealt = nodes.select("fp", "node", keys.alias("k")).select("fp", "node", F.col("k.key").alias("key"))
    shared = table(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("shard"), F.ceil(F.col("n") / piece).cast("int").alias("pieces")), "shards")
    inside = dealt.join(shared, F.col("key") == F.col("shard")).withColumn("mine", F.pmod(F.xxhash64("fp", "key"), F.col("pieces")).cast("int"))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    units = inside.withColumn("other", F.explode(every)).select(
        F.xxhash64("key", low, high).alias("unit"),
        (F.col("mine") == low).alias("tree"),
        (F.col("mine") == high).alias("query"),
        "fp",
        "node",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches):
            yield links(rows, radius)

    found = table(units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(run, "a long, b long"), "links")
    release(shared)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``; component_id is the smallest doc_id reachable over links.

    Null and empty texts have the fingerprint zero and link like any other. Equal fingerprints are one node, however many
    rows have it. Rows with a null doc_id are returned with the component of their fingerprint's other rows, null if it
    has none; they link nothing. Repeated doc_ids are returned as often as they come. Other columns are ignored.
    """
    own = table(fingerprints(docs, shingle), "fingerprints")
    kept = table(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    nodes = kept.select("fp", "node")
    links_ = near_links(nodes, radius)
    roots = components(links_)
    named = nodes.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(F.col("fp").alias("print"), F.coalesce("root", "node").alias("component_id"))
    named = table(named, "named")
    found = table(own.join(named, F.col("fp") == F.col("print"), "left").select("doc_id", "fp", "component_id"), "near")
    release(own, kept, links_, named, roots)
    return found


def shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    return np.unique(hashes(raw, shingle))


def common_shingles(docs: DataFrame, shingle: int, sample: int = 20_000, least: int = 8, most: int = 200_000) -> np.ndarray:
    """Shingles that come often in a sample of the documents, rarest first. They only set the order of ``prefixes``, so that
    the bounds cost no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = np.concatenate([shingle_set(x.as_buffer().to_pybytes(), shingle) for x in text_of(chunk, "text")])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // sample))) == 0).select("doc_id", "text")
    found = part.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).toArrow()
    return found.column("h").to_numpy().view(np.uint64)[::-1].copy()


def needed(size: int, threshold: float) -> int:
    """Shingles that a set of so many shares at least with any set that is alike."""
    return math.ceil(threshold * size - 1e-9)


def parities(own: np.ndarray) -> bytes:
    """How many shingles fall on each bit, odd or even, with four to eight bits a shingle. Bits that differ between two sets
    are at most as many as the shingles that only one of them has."""
    bits = 64 << max(0, math.ceil(math.log2(max(len(own), 1) / 16)))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """The parities on so many 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, width), axis=0)


def hopeful(own: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the others may be alike, by sizes and parities: no pair that is alike is ruled out."""
    apart = np.bitwise_count(others ^ own).sum(axis=1, dtype=np.int64)
    close = np.minimum(sizes, size) >= threshold * np.maximum(sizes, size) - 1e-9
    return close & (apart <= (1 - threshold) / (1 + threshold) * (sizes + size) + 1e-6)


def hopeful_rows(rows: pa.Table, threshold: float) -> list[pa.RecordBatch]:
    """The rows of whole units that may be alike with one of another component there; rows: unit, tree boolean, query boolean,
    node, root, size, bits."""
    rows = rows.combine_chunks()
    unit, root, size, tree, query = (rows.column(c).to_numpy() for c in ("unit", "root", "size", "tree", "query"))
    bits = rows.column("bits").to_pylist()
    width = np.array([len(x) // 8 for x in bits])
    keep = np.zeros(len(unit), bool)
    cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        for w in np.unique(width[lo:hi]).tolist():
            at = lo + np.flatnonzero((width[lo:hi] == w) | (width[lo:hi] == 2 * w))  # sizes further apart are never alike
            if len(at) < 2:
                continue
            maps = np.stack([folded(bits[k], w) for k in at])
            for k in np.flatnonzero(width[at] == w):
                i = at[k]
                ok = hopeful(maps[k], size[i], maps, size[at], threshold) & (root[at] != root[i]) & ((tree[i] & query[at]) | (query[i] & tree[at]))
                keep[at[ok]] = True
                keep[i] |= ok.any()
    return rows.select(["unit", "tree", "query", "node", "root"]).filter(pa.array(keep)).to_batches()


def prefixes(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """doc_id, same (a hash of the shingle set), size, bits (parities) and prefix of every row: of the set, common shingles last, so many that
    any two sets that are alike have one of their prefixes' shingles in common."""
    common = common_shingles(docs, shingle)
    order = np.argsort(common)
    common = common[order]

    def prefix(own: np.ndarray) -> np.ndarray:
        length = len(own) - needed(len(own), threshold) + 1 if len(own) else 0
        at = np.searchsorted(common, own)
        often = np.zeros(len(own), bool)
        inside = at < len(common)
        often[inside] = common[at[inside]] == own[inside]
        return np.concatenate([own[~often], own[often][np.argsort(order[at[often]])]])[:length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            sets = [shingle_set(x.as_buffer().to_pybytes(), shingle) for x in text_of(chunk, "text")]
            same = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            size = pa.array(np.array([len(x) for x in sets], np.int32))
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(same), size, pa.array([parities(x) for x in sets], pa.binary()), lists([prefix(x) for x in sets])], names=["doc_id", "same", "size", "bits", "prefix"])

    return docs.mapInArrow(run, "doc_id long, same long, size int, bits binary, prefix array<long>")


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32))
    return pa.ListArray.from_arrays(edges, pa.array(np.concatenate(arrays).view(np.int64)))


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, set: all shingles of the documents that ``nodes`` (node, same) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            sets = [shingle_set(x.as_buffer().to_pybytes(), shingle) for x in text_of(chunk, "text")]
            same = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(same), lists(sets)], names=["doc_id", "same_", "set"])

    made = docs.join(nodes.select(F.col("node").alias("asked")), F.col("doc_id") == F.col("asked"), "left_semi").mapInArrow(run, "doc_id long, same_ long, set array<long>")
    return made.join(nodes, (F.col("doc_id") == F.col("node")) & (F.col("same_") == F.col("same"))).groupBy("node").agg(F.first("set").alias("set"))


def cross_links(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    """Links of alike sets of different components in whole units; rows: unit, tree boolean, query boolean, node, root, set.

    A pair that links found before in the unit connect already isn't compared.
    """
    rows = rows.combine_chunks()
    unit, node, root, tree, query = (rows.column(c).to_numpy() for c in ("unit", "node", "root", "tree", "query"))
    column = rows.column("set").combine_chunks()
    size = column.value_lengths().to_numpy().astype(np.int64)
    values, ends = column.flatten().to_numpy(), np.cumsum(size)
    a: list[int] = []
    b: list[int] = []
    cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi - lo < 2:
            continue
        begin = ends[lo] - size[lo]
        _, word = np.unique(values[begin : ends[hi - 1]], return_inverse=True)
        starts, n, label = ends[lo:hi] - size[lo:hi] - begin, size[lo:hi], root[lo:hi].copy()
        mark = np.zeros(int(word.max()) + 1, np.int32)
        later, asked = np.arange(hi - lo), query[lo:hi]
        both = tree[lo:hi] & asked
        for i in np.flatnonzero(tree[lo:hi]):
            open_ = asked & (label != label[i]) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9) & ~(both & both[i] & (later < i))
            if not open_.any():
                continue
            own = word[starts[i] : starts[i] + n[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[word], starts)
            mark[own] = 0
            for j in np.flatnonzero(open_ & (shared >= threshold * (n + n[i] - shared) - 1e-9)):
                if label[j] != label[i]:
                    a.append(node[lo + i])
                    b.append(node[lo + j])
                    label[label == label[j]] = label[i]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def similar_documents(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, piece: int = 512) -> DataFrame:
    """doc_id, component_id for every row of ``docs`` with an id: groups of documents whose shingle sets are alike.

    Documents link if their sets of word shingles have a Jaccard similarity of ``threshold`` or more, counted on whole sets.
    Null and empty texts are alike. Two such sets share a shingle of their prefixes, so that the documents of each prefix
    shingle are compared: first all with the least one, then, where these links leave several components, every pair of
    different components, in units of two pieces of the shingle's documents. Whole sets go only to the pairs and units that
    sizes and parities don't rule out. Of documents already connected no pair is listed.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = table(prefixes(docs, shingle, threshold), "prefixes")
    nodes = table(own.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix")), "nodes")
    each = nodes.select("node", "size", F.explode("prefix").alias("shingle"))
    met = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("head"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    # Shingles with the same documents are one.
    met = table(met.groupBy("n", "head", "last", "all").agg(F.min("shingle").alias("key")).select("key", "n", "head"), "met")
    members = table(each.join(met, F.col("shingle") == F.col("key")).select("key", "n", "head", "node", "size"), "members")
    maps = nodes.select(F.col("node").alias("member"), F.col("size").alias("size_"), "bits")

    def whole_sets(asked: DataFrame) -> DataFrame:
        return table(sets_of(docs, nodes.select("node", "same").join(asked, F.col("node") == F.col("asked"), "left_semi"), shingle), "sets")

    close = F.least("size", "head.size") >= threshold * F.greatest("size", "head.size") - 1e-9
    pairs = members.where((F.col("node") > F.col("head.node")) & close).select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct()
    mine = maps.select(F.col("member").alias("a_"), F.col("size_").alias("size_a"), F.col("bits").alias("bits_a"))
    other = maps.select(F.col("member").alias("b_"), F.col("size_").alias("size_b"), F.col("bits").alias("bits_b"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                w = min(len(x), len(y)) // 8
                keep.append(bool(hopeful(folded(x, w), n, folded(y, w)[None, :], np.array([m]), threshold)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(mine, F.col("a") == F.col("a_")).join(other, F.col("b") == F.col("b_")).select("a", "b", "bits_a", "bits_b", "size_a", "size_b")
    pairs = table(joined.mapInArrow(sift, "a long, b long"), "pairs")
    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("asked")).distinct())
    mine, other = sets.select(F.col("node").alias("mine"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("other"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = both >= threshold * (F.size("set_a") + F.size("set_b") - both) - 1e-9
    stars = table(pairs.join(mine, F.col("a") == F.col("mine")).join(other, F.col("b") == F.col("other")).where(alike).select("a", "b"), "stars")

    starred = components(stars)
    roots = starred.withColumnRenamed("node", "member")
    placed = table(members.where("n > 2").join(roots, F.col("node") == F.col("member"), "left").select("key", "n", "node", F.coalesce("root", "node").alias("root")), "placed")
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("key").alias("several"))
    pieces = F.ceil(F.col("n") / piece).cast("int")
    dealt = placed.join(several, F.col("key") == F.col("several"), "left_semi").withColumn("pieces", pieces).withColumn("mine", F.pmod(F.xxhash64("node", "key"), F.col("pieces")).cast("int"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(F.xxhash64("key", low, high).alias("unit"), (F.col("mine") == low).alias("tree"), (F.col("mine") == high).alias("query"), "node", "root")
    units = units.join(maps, F.col("node") == F.col("member")).select("unit", "tree", "query", "node", "root", F.col("size_").alias("size"), "bits")

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches, 4 * piece):
            yield from hopeful_rows(rows, threshold)

    sifted = units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(rough, "unit long, tree boolean, query boolean, node long, root long")
    units = table(sifted, "units")
    rest = whole_sets(units.select(F.col("node").alias("asked")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_units(batches, piece):
            yield cross_links(rows, threshold)

    full = units.join(rest.select(F.col("node").alias("member"), "set"), F.col("node") == F.col("member")).drop("member")
    crossed = table(full.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(run, "a long, b long"), "crossed")
    joined = components(stars.union(crossed))
    named = table(nodes.join(joined.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(F.col("same").alias("same_"), F.coalesce("root", "node").alias("component_id")), "named")
    found = table(own.select("doc_id", "same").join(named, F.col("same") == F.col("same_")).select("doc_id", "component_id"), "alike")
    release(own, nodes, met, members, pairs, sets, stars, starred, placed, units, rest, crossed, named, joined)
    return found
