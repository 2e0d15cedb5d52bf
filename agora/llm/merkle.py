"""Merkle manifest of a dataset: every row's leaf, its authentication path, and what a changed row folds to.

Each tree (one per language) is a hash tree of ``FAN`` children a node over its leaves in order; the trees' roots, in the
order of their names, are the leaves of one more tree, whose root stands for the whole dataset. A node is the SHA-256,
in lowercase hex, of its children's hex digests; a last run of nodes may be shorter, and one node alone is hashed, too.

The leaves of a tree lie in aligned blocks of ``FAN ** HEIGHT``. On the way up, a treehash stack per block makes its root;
blocks' roots are the leaves of the next round, until each tree has one root. On the way down, each block is traversed
leaf by leaf: the authentication path within the block is advanced by one treehash stack a level, which prepares the
run of nodes that the path needs next, and the path above the block, the same for all its leaves, is appended. A task holds
a block's leaves, the runs of its levels and the open nodes of the stacks: numbers that grow with the logarithm of a block.

Leaf positions come from one range partitioning of the digests by tree, order and digest, so that neither a large tree nor
a large group of equal rows lands in one task. Texts are read once; what is shuffled are digests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.runtime import release, table

#: Children of a node; levels of an aligned block; leaves of a block.
FAN, HEIGHT = 8, 3
BLOCK = FAN**HEIGHT
STEP = pa.struct([("at", pa.int32()), ("others", pa.binary())])
PATH = "array<struct<at: int, others: binary>>"


def node_hash(children: list[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in children).encode()).digest()


def levels(n: int) -> int:
    """Levels between n leaves and their root."""
    count = 0
    while n > 1:
        n, count = -(-n // FAN), count + 1
    return count


class TreeHash:
    """Makes the nodes of one level from leaves that come one by one; it holds at most FAN - 1 open nodes a level below."""

    def __init__(self, leaves: Callable[[int], bytes], level: int, first: int, stop: int):
        """Nodes of ``level`` over the leaves from ``first`` to before ``stop``, where the tree ends or the run does."""
        self.leaves, self.level, self.next, self.stop = leaves, level, first, stop
        self.open: list[list[bytes]] = [[] for _ in range(level + 1)]

    @property
    def made(self) -> list[bytes]:
        return self.open[self.level]

    @property
    def done(self) -> bool:
        return self.next >= self.stop

    @property
    def lowest(self) -> int:
        """The level of the lowest open node: what Szydlo's schedule goes by. Unstarted: the level that is made."""
        return next((k for k in range(self.level) if self.open[k]), self.level)

    @property
    def held(self) -> int:
        return sum(map(len, self.open))

    def feed(self) -> None:
        """Takes one leaf and closes the runs that it completes; the last leaf closes all that is open."""
        if self.done:
            return
        self.open[0].append(self.leaves(self.next))
        self.next += 1
        for k in range(self.level):
            run = self.open[k]
            if len(run) == FAN or self.done and run:
                self.open[k] = []
                self.open[k + 1].append(node_hash(run))


def tree_root(leaves: list[bytes], height: int) -> bytes:
    """The node ``height`` levels above the leaves, by one treehash stack."""
    stack = TreeHash(leaves.__getitem__, height, 0, len(leaves))
    while not stack.done:
        stack.feed()
    return stack.made[0]


class Traversal:
    """Authentication paths of the leaves 0, 1, 2, ... of a block, one after the other.

    For each level it holds the run of sibling nodes of the present leaf's ancestor, and a treehash stack that makes the
    next run there. A run of level k lasts for FAN ** (k + 1) leaves. Each step hands one leaf's work for each level that
    has work left to the stack with the lowest open node, so that few nodes are open at once; a stack that is needed before
    its turn came is finished on the spot.
    """

    def __init__(self, leaves: Callable[[int], bytes], count: int, height: int):
        self.leaves, self.count, self.height, self.at = leaves, count, height, 0
        self.runs: list[list[bytes]] = []
        self.coming: list[TreeHash] = []
        for k in range(height):
            self.runs.append(self.finished(self.stack(k, 0)))
            self.coming.append(self.stack(k, 1))

    def stack(self, level: int, run: int) -> TreeHash:
        width = FAN ** (level + 1)
        return TreeHash(self.leaves, level, min(run * width, self.count), min((run + 1) * width, self.count))

    @staticmethod
    def finished(stack: TreeHash) -> list[bytes]:
        while not stack.done:
            stack.feed()
        return stack.made

    def path(self) -> list[tuple[int, bytes]]:
        """For each level: the place of the ancestor in its run, and the digests of the others, left to right."""
        out = []
        for k, run in enumerate(self.runs):
            place = self.at // FAN**k % FAN
            out.append((place, b"".join(run[:place] + run[place + 1 :])))
        return out

    def advance(self) -> None:
        self.at += 1
        for k in range(self.height):
            if self.at % FAN ** (k + 1) == 0:
                self.runs[k] = self.finished(self.coming[k])
                self.coming[k] = self.stack(k, self.at // FAN ** (k + 1) + 1)
        for _ in range(self.height):
            open_ = [x for x in self.coming if not x.done]
            if not open_:
                break
            min(open_, key=lambda x: (x.lowest, x.level)).feed()

    @property
    def held(self) -> int:
        """Nodes in memory, besides the leaves."""
        return sum(map(len, self.runs)) + sum(x.held for x in self.coming)


def leaf_digest(*fields: Column | str) -> Column:
    """The SHA-256 of the fields, each ``-`` if null, else its UTF-8 length, ``:`` and its text, as 32 bytes."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """tree, pos, size, node, row for (tree, order, node, row), and the largest size: pos counts a tree's rows by order, then node.

    Rows with one order and node are alike for the tree; which comes first does not show. Null orders come first.
    """
    ordered = rows.select("*", F.monotonically_increasing_id().alias("turn")).repartitionByRange("tree", "order", "node", "turn").sortWithinPartitions("tree", "order", "node")
    lined_up = table(ordered.select("tree", "node", "row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")), "leaves")
    # one row for each partition and tree: as many as partitions and trees together
    parts = lined_up.groupBy("tree", "part").agg(F.min("line").alias("begin"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    parts = table(parts.select("tree", "part", "begin", (F.sum("n").over(before) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy("tree")).alias("size")), "parts")
    most = parts.agg(F.max("size").alias("m")).first()["m"] or 0
    found = lined_up.alias("a").join(parts.alias("b"), (F.col("a.part") == F.col("b.part")) & F.col("a.tree").eqNullSafe(F.col("b.tree")))
    out = table(found.select("a.tree", (F.col("line") - F.col("begin") + F.col("ahead")).alias("pos"), "size", "node", "row"), "placed")
    release(lined_up, parts)
    return out, most


def blocks(nodes: DataFrame) -> DataFrame:
    """tree, block, size (of the tree), leaves: an array of (pos, node, row) in order; at most BLOCK of them."""
    key = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    return nodes.groupBy("tree", key, "size").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "row"))).alias("leaves"))


def height_of(size: int) -> int:
    return min(HEIGHT, levels(size))


def rise(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Of (tree, pos, size, node, row): the tables of blocks, lowest first, and each tree's root (tree, node)."""
    made = []
    while True:
        made.append(table(blocks(nodes), "blocks"))

        def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, lists = batch.column(2).to_pylist(), batch.column(3)
                nodes = [tree_root([x["node"].as_py() for x in leaves.values], height_of(n)) for n, leaves in zip(sizes, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-n // BLOCK) for n in sizes], pa.int64()), pa.array(nodes, pa.binary())], names=["tree", "pos", "size", "node"])

        slim = made[-1].select("tree", "block", "size", F.transform("leaves", lambda x: F.struct(x["node"].alias("node"))).alias("leaves"))
        tops = slim.mapInArrow(roots, f"tree {nodes.schema['tree'].dataType.simpleString()}, pos long, size long, node binary")
        most = -(-most // BLOCK)
        if most <= 1:
            return made, tops.select("tree", "node")
        nodes = tops.withColumn("row", F.lit(None).cast("boolean"))


def descend(made: list[DataFrame], above: DataFrame) -> DataFrame:
    """node, path, row of the lowest blocks' leaves, and the columns of ``above`` (tree, path and others), a row for each tree.

    path: for each level from the leaf upwards, the place of the ancestor in its run and the digests of the others.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(made) - 1, -1, -1):
        found = made[k].alias("a").join(above.alias("b"), (F.col("a.block") == F.col("b.block")) & F.col("a.tree").eqNullSafe(F.col("b.tree")))
        found = found.select("a.tree", "a.block", "a.size", "a.leaves", F.col("b.path").alias("path"), F.struct(*[F.col(f"b.{c}") for c in extra], F.lit(0).alias("_")).alias("extra"))
        kinds = {f.name: f.dataType.simpleString() for f in found.schema}
        row = made[k].schema["leaves"].dataType.elementType["row"].dataType.simpleString()

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    leaves, over = batch.column(3)[i].values, batch.column(4)[i].as_py()
                    nodes = leaves.field("node").to_pylist()
                    walk, steps = Traversal(nodes.__getitem__, len(nodes), height_of(batch.column(2)[i].as_py())), []
                    upper = [(x["at"], x["others"]) for x in over]
                    for _ in nodes:
                        steps.append([{"at": a, "others": o} for a, o in walk.path() + upper])
                        walk.advance()
                    same = pa.array([i] * len(nodes), pa.int32())
                    columns = [batch.column(0).take(same), leaves.field("pos"), leaves.field("node"), pa.array(steps, pa.list_(STEP)), leaves.field("row"), batch.column(5).take(same)]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "node", "path", "row", "extra"])

        out = found.mapInArrow(paths, f"tree {kinds['tree']}, pos long, node binary, path {PATH}, row {row}, extra {kinds['extra']}")
        above = out.select("tree", F.col("pos").alias("block"), "node", "path", "row", *[F.col(f"extra.{c}").alias(c) for c in extra])
        if k:
            above = above.drop("row", "node")
    return above.drop("block")


def manifest(rows: DataFrame) -> DataFrame:
    """row, tree, node (the leaf), subroot, root (digests of 32 bytes) and path, for (tree, order, node, row).

    ``row`` is any column or struct that is carried along. A null tree is one of its own, before all others; those are
    ordered bytewise. Rows that are repeated are leaves each. An empty table gives no row. What comes back reads tables of
    the shared folder, which the caller's ``scratch`` deletes.
    """
    nodes, most = placed(rows)
    made, roots = rise(nodes, most)
    release(nodes)
    roots = table(roots, "roots")
    crowns = roots.select(F.lit(0).alias("tree"), F.col("tree").alias("order"), "node", F.struct("tree", "node").alias("row"))
    tops, many = placed(crowns)
    upper, root = rise(tops, many)
    release(tops)
    top = root.select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    subroots = table(descend(upper, top).select(F.col("row.tree").alias("tree"), "path", F.col("row.node").alias("subroot"), "root"), "subroots")
    release(roots, *upper)
    return descend(made, subroots)


def hex_of(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, path: Column) -> Column:
    """The root, in hex, that a leaf's digest and a path of siblings lead to."""

    def up(node: Column, step: Column) -> Column:
        left = step["at"] * 64
        others = hex_of(step["others"])
        return F.sha2(F.concat(F.substr(others, F.lit(1), left), node, F.substr(others, left + 1)), 256)

    return F.aggregate(path, hex_of(leaf), up)


def proof_digest(path: Column) -> Column:
    """The SHA-256 of all siblings' hex digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: hex_of(step["others"])), ""), 256)
