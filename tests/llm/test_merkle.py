"""The Merkle manifest against a tree built level by level, and the traversal against all siblings at once."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from agora.llm import merkle, queries

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, row string, tree long, pos long"


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def layers(nodes):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([H(*made[-1][i : i + 8]) for i in range(0, len(made[-1]), 8)])
    return made


def climb(made, at, node):
    proof = []
    for level in made[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        left, right = run[: at % 8], run[at % 8 + 1 :]
        proof += left + right
        node, at = H(*left, node, *right), at // 8
    return proof, node


def wanted(rows):
    first = lambda x: (x is not None, x)
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: sorted(((first(r[0]), leaf(r[0], r[3], n, r[4], r[1]), r) for r in rows if r[2] == n), key=lambda x: (x[0][0], x[0][1] or 0, x[1])) for n in names}
    made = {n: layers([x[1] for x in t]) for n, t in trees.items()}
    crown = layers([made[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, (_, h, r) in enumerate(trees[n]):
            lower = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            proof, node = climb(made[n], i, leaf(r[0], r[3], n, r[4], lower) if struck else h)
            more, root = climb(crown, k, node)
            out.append((r[0], h, made[n][-1][0], crown[-1][0], H(*proof, *more), root, root == crown[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "n", "r", 1, 2) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got], key=repr)


def test_manifest(spark, tmp_path):
    """Trees of one leaf, of a block and one leaf, of two blocks; a null language; null and repeated rows; long texts."""
    rng = random.Random(3)
    sizes = {"en": 1200, "fr": 513, "de": 512, "": 8, None: 9, "zh": 1, "É": 65}
    rows = [(len(sizes) * k + i, rng.choice(["Some Text", "other", "", "x\ny é", "A" * 5000]) + str(rng.randint(0, 99)), lang, f"s{k % 3}", k) for i, (lang, n) in enumerate(sizes.items()) for k in range(n)]
    rows += [(None, None, "fr", None, None), (None, "t", None, None, 1), (4, None, "en", None, None), rows[5], rows[5]]
    assert found(spark, rows, tmp_path) == wanted(rows)


@pytest.mark.parametrize("n", [0, 1, 70])
def test_few_documents_and_many_trees(spark, tmp_path, n):
    rows = [(k, f"Text {k}", f"lang {k}", "s", 3) for k in range(n)]
    assert found(spark, rows, tmp_path) == wanted(rows)


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 64, 65, 100, 511, 512])
def test_traversal_needs_few_nodes(count):
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(count)]
    made = layers([x.hex() for x in leaves])
    height = merkle.levels(count)
    walk = merkle.Traversal(leaves.__getitem__, count, height)
    for k in range(count):
        assert [x.hex() for _, x in walk.path()] == ["".join(run[: at % 8] + run[at % 8 + 1 :]) for level, at in ((made[j], k // 8**j) for j in range(height)) for run in [level[at // 8 * 8 : at // 8 * 8 + 8]]]
        # two runs a level, and at most seven open nodes of each level below for each stack
        assert walk.held <= 16 * height + 7 * height * (height - 1) // 2
        walk.advance()
    assert height == 0 or merkle.tree_root(leaves, height).hex() == made[-1][0]


def test_a_changed_sibling_shows(spark):
    rows = spark.range(40).select(F.lit("a").alias("tree"), F.col("id").alias("order"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("node"), F.col("id").alias("row"))
    proven = merkle.manifest(rows)
    bad = F.transform("path", lambda x: F.struct(x["at"].alias("at"), F.reverse(F.hex(x["others"])).cast("binary").alias("others")))
    assert proven.where(merkle.fold(F.col("node"), F.col("path")) == merkle.hex_of("root")).count() == 40
    assert proven.where(merkle.fold(F.col("node"), bad) == merkle.hex_of("root")).count() == 0
