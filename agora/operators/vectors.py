"""Vectors against vectors by blocks of a matrix: exact neighbours without a row for each pair compared."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a piece on average: two pieces are multiplied in one task.
PIECE = 1024


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def by_blocks(queries: DataFrame, vectors: DataFrame, block: str, schema: str, work: Callable[[pa.Table, pa.Table, np.ndarray], dict], extra: list[str], piece: int = PIECE) -> DataFrame:
    """What ``work`` makes of each pair of pieces: queries, vectors (vec_id, embedding, ``extra``), and their cosines.

    Only vectors of one block and length meet. Each side's blocks are dealt to pieces of bounded size, and every vector goes
    once to each piece of the other side. Null, zero and empty vectors take no part.
    """
    fit = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull())

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(fit).select("vec_id", "embedding", *extra, F.col(block).alias("block"), F.size("embedding").alias("length"), F.lit(name).alias("side"))

    q, e = side(queries, "q"), side(vectors, "e")
    pieces = lambda df, name: df.groupBy(F.col("block").alias(f"b{name}"), F.col("length").alias(f"l{name}")).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias(name))
    n = pieces(q, "nq").join(pieces(e, "ne"), (F.col("bnq") == F.col("bne")) & (F.col("lnq") == F.col("lne"))).select(F.col("bnq").alias("b_"), F.col("lnq").alias("l_"), "nq", "ne")
    own, every = (lambda k: F.pmod(F.xxhash64("vec_id"), F.col(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    met = lambda df: df.join(n, (F.col("block") == F.col("b_")) & (F.col("length") == F.col("l_")))
    columns = ["block", "length", "i", "j", "side", "vec_id", "embedding", *extra]
    units = met(q).withColumn("i", own("nq")).withColumn("j", every("ne")).select(columns).unionByName(met(e).withColumn("j", own("ne")).withColumn("i", every("nq")).select(columns))

    def compare(rows: pa.Table) -> pa.Table:
        is_query = pc.equal(rows.column("side"), "q")
        a, b = rows.filter(is_query).sort_by("vec_id"), rows.filter(pc.invert(is_query)).sort_by("vec_id")
        if not len(a) or not len(b):
            return empty
        made = work(a, b, unit_rows(a.column("embedding")) @ unit_rows(b.column("embedding")).T)
        return pa.table(made).cast(empty.schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    empty = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]).empty_table()
    return units.groupBy("block", "length", "i", "j").applyInArrow(compare, schema)


def similar(queries: DataFrame, vectors: DataFrame, block: str, threshold: float, k: int | None = None, near: tuple[str, int] | None = None, inclusive: bool = False) -> DataFrame:
    """q_id, vec_id, similarity of queries and vectors of one block with a cosine over the threshold, each query's ``k`` best.

    ``near`` names a number that differs by so much at most. A vector isn't its own neighbour; ties go to the least id.
    Each task keeps k rows a query, so that what is ranked in the end is bounded by k and the pieces.
    """

    def pick(a: pa.Table, b: pa.Table, s: np.ndarray) -> dict:
        q, v = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        keep = (s >= threshold if inclusive else s > threshold) & (q[:, None] != v[None, :])
        if near:
            x, y = a.column(near[0]).to_numpy(), b.column(near[0]).to_numpy()
            keep &= np.abs(x[:, None].astype(np.int64) - y[None, :].astype(np.int64)) <= near[1]
        if k is not None and k < s.shape[1]:
            order = np.argsort(np.where(keep, -s, np.inf), axis=1, kind="stable")[:, :k]
            first = np.zeros_like(keep)
            np.put_along_axis(first, order, True, axis=1)
            keep &= first
        i, j = np.nonzero(keep)
        return {"q_id": q[i], "vec_id": v[j], "similarity": s[i, j]}

    found = by_blocks(queries, vectors, block, "q_id long, vec_id long, similarity double", pick, [near[0]] if near else [])
    if k is None:
        return found
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def pooled(queries: DataFrame, vectors: DataFrame, block: str, group: str) -> DataFrame:
    """q_group, group, similarity: the largest cosine of the vectors of two groups (whole numbers); pooled in each task first."""

    def pool(a: pa.Table, b: pa.Table, s: np.ndarray) -> dict:
        p, x = np.unique(a.column(group).to_numpy(), return_inverse=True)
        q, y = np.unique(b.column(group).to_numpy(), return_inverse=True)
        most = np.full((len(p), len(q)), -np.inf)
        np.maximum.at(most, (x[:, None], y[None, :]), s)
        i, j = np.nonzero(most > -np.inf)
        return {"q_group": p[i].astype(np.int64), "group": q[j].astype(np.int64), "similarity": most[i, j]}

    found = by_blocks(queries, vectors, block, "q_group long, group long, similarity double", pool, [group])
    return found.groupBy("q_group", "group").agg(F.max("similarity").alias("similarity"))


def nearest_links(vectors: DataFrame, block: str, year: str, k: int, threshold: float, years: int) -> DataFrame:
    """a < b, similarity: each vector's k nearest of its block within some years, as unordered pairs."""
    best = similar(vectors, vectors, block, threshold, k, (year, years), inclusive=True)
    return best.select(F.least("q_id", "vec_id").alias("a"), F.greatest("q_id", "vec_id").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
