"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector and sorts by the hashes, one after the other; similar vectors tend to stand close together,
so that each is compared with a bounded window of those after it. The first hash is the nearest of some vectors drawn for
the pass, the others are the signs of random projections of what is left when the mean around that one is taken away: so
vectors that all point one way, or in dense groups, are told apart, too. An audit compares a bounded number of vectors with
all rows; passes are added until the components hold so many of the links it finds as ``FOUND`` says. The verified pairs
of all passes are united to components. A component's links are then counted exactly: vectors within half the angle of its
centre all link with each other, and only the others are compared with the whole component, piece by piece.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.components import components
from agora.llm.runtime import release, table
from agora.llm.textkernel import spanning

WINDOW, BLOCK, BITS, SEED = 64, 1024, 56, 20_24
#: Vectors of a component's piece at most, on average, and at least; pieces of a component that isn't large.
PIECE, LEAST_PIECE, PIECES = 2048, 64, 16
#: Share of the audited links that the passes must have brought together.
FOUND = 0.995
#: Vectors drawn to centre by, of which a pass takes some; vectors that are audited; rows of these that a worker holds.
SAMPLE, PIVOTS, AUDIT = 2048, 64, 1024
#: Passes of the first round, of all rounds at most (beyond, the audit's figure is reported as a warning), and at once.
FIRST, MOST, STEP = 8, 128, 4


def passes_for(n: int, threshold: float, window: int = WINDOW) -> int:
    """Passes of the first round for n vectors: of evenly spread ones, neighbours in a window share log2(n / window) signs."""
    agree = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return min(MOST, max(FIRST, math.ceil(math.log(1 - FOUND) / math.log(1 - min(agree, 1 - 1e-9)))))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def drawn(nodes: DataFrame, n: int, salt: int) -> dict[int, np.ndarray]:
    """Up to n vectors of each length that is among n vectors picked by a hash of their id, of unit length."""
    rows = nodes.select("node", "embedding").orderBy(F.xxhash64("node", F.lit(salt)), "node").limit(n).toArrow().sort_by("node")
    column = rows.column("embedding").combine_chunks()
    size = column.value_lengths().to_numpy()
    return {int(d): matrix(column.take(pa.array(np.flatnonzero(size == d)))) for d in np.unique(size)}


def pass_keys(v: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The concatenated hashes of a pass as one number: the nearest pivot, then signs of what is left of its group's mean."""
    d = v.shape[1]
    rng = np.random.default_rng([SEED, k, d])
    planes = rng.standard_normal((d, BITS))
    signs = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    if not len(sample):
        return (v @ planes > 0) @ signs
    pivots = sample[rng.choice(len(sample), min(PIVOTS, max(1, len(sample) // 8)), replace=False)]
    near = np.argmax(sample @ pivots.T, axis=1)
    means = np.stack([sample[near == j].mean(axis=0) if (near == j).any() else pivots[j] for j in range(len(pivots))])
    own = np.argmax(v @ pivots.T, axis=1)
    return (own.astype(np.int64) << BITS) | ((v @ planes > (means @ planes)[own]) @ signs)


def sign_keys(nodes: DataFrame, passes: range, sample: dict[int, np.ndarray]) -> DataFrame:
    """node, size (of the vector) and keys, the hashes of each pass as one number."""
    held = nodes.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                column = part.column(1)
                size = column.value_lengths().to_numpy()
                keys = np.zeros((part.num_rows, len(passes)), np.int64)
                for d in np.unique(size):
                    own = np.flatnonzero(size == d)
                    v = matrix(column.take(pa.array(own)))
                    for k, number in enumerate(passes):
                        keys[own, k] = pass_keys(v, held.value.get(int(d), np.zeros((0, int(d)))), number)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(passes)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), lists], names=["node", "size", "keys"])

    return nodes.select("node", "embedding").mapInArrow(run, "node long, size int, keys array<long>")


def audit(nodes: DataFrame, named: DataFrame, threshold: float, n: int = AUDIT) -> float:
    """The share of the links of some n nodes, of all their links, that are inside one component (node, root)."""
    asked = nodes.select("node", "embedding").orderBy(F.xxhash64("node", F.lit(7)), "node").limit(n).join(named, "node", "left").select("node", "embedding", F.coalesce("root", "node").alias("root")).toArrow()
    node, root = (asked.column(c).to_numpy() for c in ("node", "root"))
    column = asked.column("embedding").combine_chunks()
    size = column.value_lengths().to_numpy()
    sides = {int(d): (np.flatnonzero(size == d), matrix(column.take(pa.array(np.flatnonzero(size == d))))) for d in np.unique(size)}
    held = nodes.sparkSession.sparkContext.broadcast((node, root, sides))  # at most AUDIT vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots, queries = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                links = inside = 0
                size = part.column(1).value_lengths().to_numpy()
                other, component = part.column(0).to_numpy(), part.column(2).to_numpy()
                for d in np.unique(size):
                    if int(d) in queries:
                        own = np.flatnonzero(size == d)
                        which, q = queries[int(d)]
                        x, y = np.nonzero(q @ matrix(part.column(1).take(pa.array(own))).T >= threshold)
                        apart = ids[which[x]] != other[own[y]]
                        links += int(apart.sum())
                        inside += int((apart & (roots[which[x]] == component[own[y]])).sum())
                yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([inside])], names=["links", "inside"])

    every = nodes.select("node", "embedding").join(named, "node", "left").select("node", "embedding", F.coalesce("root", "node").alias("root"))
    found = every.mapInArrow(run, "links long, inside long").agg(F.sum("links").alias("links"), F.sum("inside").alias("inside")).first()
    return found["inside"] / found["links"] if found["links"] else 1.0


def window_links(nodes: DataFrame, keyed: DataFrame, threshold: float, window: int, block: int) -> DataFrame:
    """A table of a, b: a spanning forest of the verified pairs of each block of neighbours, for the passes in ``keyed``.

    Hashes alone are sorted; the vectors join their places then.
    """
    each = keyed.select("node", "size", F.posexplode("keys").alias("pass", "key"))
    ordered = table(each.repartitionByRange("pass", "size", "key", "node").sortWithinPartitions("pass", "size", "key", "node").withColumn("place", F.monotonically_increasing_id()), "sorted")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).count().collect()  # a row per sorted partition
    before, offsets = 0, []
    for r in sorted(counts, key=lambda r: r["part"]):
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = nodes.sparkSession.createDataFrame(offsets, "part_ long, before long")
    ranked = ordered.join(F.broadcast(offsets), part == F.col("part_")).withColumn("rank", F.col("before") + at)
    home = F.floor(F.col("rank") / block)
    blocks = ranked.withColumn("block", F.explode(F.when((F.col("rank") % block < window) & (F.col("rank") >= block), F.array(home, home - 1)).otherwise(F.array(home))))
    blocks = blocks.select("block", "rank", "pass", "size", "node").join(nodes.select("node", "embedding"), "node")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        node, kind = rows.column("node").to_numpy(), rows.column("pass").to_numpy() * 1_000_000 + rows.column("size").to_numpy()
        a = b = np.zeros(0, np.int64)
        for same in np.unique(kind):
            own = np.flatnonzero(kind == same)
            v = matrix(rows.column("embedding").take(pa.array(own)))
            close = np.triu(np.tril(v @ v.T >= threshold, window), 1)
            x, y = np.nonzero(close)
            a, b = np.concatenate([a, own[x]]), np.concatenate([b, own[y]])
        label = spanning(a, b, len(node))
        a = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": node[a], "b": node[label[a]]})

    found = table(blocks.select("block", "rank", "pass", "size", "node", "embedding").groupBy("block").applyInArrow(compare, "a long, b long"), "links")
    release(ordered)
    return found


def count_links(members: DataFrame, threshold: float, piece: int) -> DataFrame:
    """node, n_links of every member (node, copies, embedding, root) of a component of several nodes.

    A component is dealt to pieces by a hash, 16 at least unless it is small, so that no task gets much of a large one. Each
    two pieces, and each piece with itself, meet once and count for both sides.
    """
    kind = members.schema["embedding"].dataType.simpleString()
    sizes = table(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n = F.col("n")
    pieces = F.greatest(F.ceil(n / piece), F.least(F.lit(PIECES), F.ceil(n / LEAST_PIECE))).cast("int")
    sized = members.join(sizes.select(F.col("root").alias("root_"), pieces.alias("pieces")), F.col("root") == F.col("root_")).drop("root_")
    placed = table(sized.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")), "members")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                size = part.column(1).value_lengths().to_numpy()
                root = part.column(0).to_numpy()
                for d in np.unique(size):
                    own = np.flatnonzero(size == d)
                    roots, group = np.unique(root[own], return_inverse=True)
                    sums = np.zeros((len(roots), int(d)))
                    np.add.at(sums, group, matrix(part.column(1).take(pa.array(own))))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(roots) + 1, dtype=np.int32) * int(d)), pa.array(sums.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(roots), lists], names=["root", "v"])

    sums = placed.select("root", "embedding").mapInArrow(add, "root long, v array<double>")
    centre = sums.select("root", F.posexplode("v").alias("k", "x")).groupBy("root", "k").agg(F.sum("x").alias("x"))
    centre = table(centre.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("c")).select(F.col("root").alias("root_"), F.col("c.x").alias("centre")), "centres")
    near = math.cos(math.acos(threshold) / 2) + 1e-9

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v, c = (part.column(part.schema.get_field_index(x)) for x in ("embedding", "centre"))
                inside = np.zeros(part.num_rows, bool)
                size = v.value_lengths().to_numpy()
                for d in np.unique(size):
                    own = pa.array(np.flatnonzero(size == d))
                    centres = c.take(own).flatten().to_numpy().reshape(len(own), -1)
                    norm = np.sqrt((centres**2).sum(axis=1))
                    inside[own.to_numpy()] = (matrix(v.take(own)) * centres).sum(axis=1) >= near * norm
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(inside)], names=[*part.schema.names[:-1], "core"])

    joined = placed.join(centre, F.col("root") == F.col("root_")).select("root", "node", "copies", "pieces", "piece", "embedding", "centre")
    cores = table(joined.mapInArrow(core, f"root long, node long, copies long, pieces int, piece int, embedding {kind}, core boolean"), "cores")
    inner = table(cores.groupBy("root").agg(F.sum(F.when(F.col("core"), F.col("copies"))).alias("inner"), F.bool_and("core").alias("all_core")).withColumnRenamed("root", "root_"), "inner")
    sure = cores.join(inner, F.col("root") == F.col("root_")).select("node", F.when(F.col("core"), F.col("inner") - 1).otherwise(F.col("copies") - 1).alias("n"))
    open_ = cores.join(inner.where(~F.col("all_core")), F.col("root") == F.col("root_"), "left_semi")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    units = open_.withColumn("other", other).select(F.xxhash64("root", F.least("piece", "other"), F.greatest("piece", "other")).alias("unit"), "root", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "node", "copies", "embedding", "core")

    def compare(rows: pa.Table) -> pa.Table:
        node, copies, core, piece, low, high = (rows.column(c).to_numpy() for c in ("node", "copies", "core", "piece", "low", "high"))
        v = matrix(rows.column("embedding"))
        a, b = np.flatnonzero(piece == low), np.flatnonzero(piece == high)
        same = bool(low[0] == high[0]) if len(low) else True
        n = np.zeros(len(node), np.int64)
        for at in range(0, len(a), 1024):
            x = a[at : at + 1024]
            close = (v[x] @ v[b].T >= threshold) & ~(core[x][:, None] & core[b][None, :]) & (node[x][:, None] != node[b][None, :])
            n[x] += close @ copies[b]
            if not same:
                n[b] += copies[x] @ close
        return pa.table({"node": node, "n": n})

    found = units.groupBy("unit", "root", "low", "high").applyInArrow(compare, "node long, n long")
    counted = table(sure.unionByName(found).groupBy("node").agg(F.sum("n").alias("n_links")), "counts")
    release(sizes, placed, centre, cores, inner)
    return counted


def found_components(nodes: DataFrame, threshold: float, window: int, block: int) -> tuple[DataFrame, float]:
    """node, root of the nodes that link with others, and the share of audited links that they hold."""
    n = nodes.count()
    sample = drawn(nodes, SAMPLE, 3) if n else {}
    links = [table(nodes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b")), "links")]
    done, ahead = 0, passes_for(n, threshold, window)
    while True:
        for first in range(done, done + ahead if n else done, STEP):
            keyed = sign_keys(nodes, range(first, min(first + STEP, done + ahead)), sample)
            links.append(window_links(nodes, keyed, threshold, window, block))
        done += ahead
        roots = components(reduce(DataFrame.union, links))
        share = audit(nodes, roots, threshold) if n else 1.0
        if share >= FOUND or done >= MOST:
            release(*links)
            return roots, share
        release(roots)
        ahead = min(done, MOST - done)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, window: int = WINDOW, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Vectors link at a cosine of ``threshold`` or more, in double precision; those of other lengths never do. Null, zero
    and empty vectors, those with null or non-finite components, and rows without an id link with nothing; their component
    is their own id. Equal vectors are compared once and counted as often as they come; rows that repeat a vec_id count as
    vectors of their own and get its results. Other columns are ignored. Warns if the audit stays below ``FOUND``.
    """
    double = vectors.schema["embedding"].dataType.simpleString() == "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    distinct = rows.where("fit").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = table(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    roots, share = found_components(nodes, threshold, window, block)
    if share < FOUND:
        warnings.warn(f"{share:.3f} of the audited links are in the components found, less than {FOUND}", stacklevel=2)
    members = table(nodes.join(roots, "node").select("node", "first", "copies", "embedding", "root"), "members")
    links = count_links(members.drop("first"), threshold, piece)
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = members.select("node", "embedding", "root").join(least, "root").join(links, "node").select(F.col("embedding").alias("same"), "component_id", "n_links")
    single = nodes.join(roots, "node", "left_anti").select(F.col("embedding").alias("same"), F.col("first").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    named = table(linked.unionByName(single), "named")
    alone = rows.where(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = rows.where("fit").join(named, F.col("embedding") == F.col("same")).select("vec_id", "n_links", "component_id")
    done = table(found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near")
    release(nodes, roots, members, links, named)
    return done
