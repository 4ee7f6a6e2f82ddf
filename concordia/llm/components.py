"""Connected components over edges that may be many and skewed, and the forests that blocks of pairs leave of theirs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import discard, materialize


class Forest:
    """Union-find over 0..n-1 in arrays; a root is the least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        p = self.parent[i]
        while True:
            q = self.parent[p]
            if np.array_equal(p, q):
                break
            p = q
        self.parent[i] = p
        return p

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def stars(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges (id, least id of its component) of all members but the least."""
        every = np.arange(len(self.parent))
        root = self.roots(every)
        least = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        to = least[root]
        other = to != ids
        return ids[other], to[other]


def _is_star_forest(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("k"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionAll(e.select(F.col("v").alias("k"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    bad = ends.groupBy("k").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v")).where((F.col("as_u") > 1) | ((F.col("as_u") > 0) & (F.col("as_v") > 0)))
    return bad.isEmpty()


def contracted(edges: DataFrame, rows: int = 200_000) -> DataFrame:
    """Edges (a, b) that connect what the materialized edges (a, b) connect: the stars of pieces of about rows edges.

    Few edges are stars after that, which saves components() its rounds; more only become fewer.
    """

    def stars(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def piece() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest = Forest(len(ids))
            forest.union(ends[: len(a)], ends[len(a) :])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest.stars(ids)], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= rows:
                yield piece()
                held, size = [], 0
        if size:
            yield piece()

    return edges.select("a", "b").coalesce(max(1, -(-edges.count() // rows))).mapInArrow(stars, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of edges (a, b) that isn't a root itself.

    Large-star and small-star rounds: each is two minima, aggregated before the shuffle, and two joins that AQE can
    split, so a node with very many neighbours is never gathered. Every round is a table in the shared folder; a loop
    ends when the edges are stars, after a number of rounds that is logarithmic in the longest path.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _is_star_forest(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(m2.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "edges")
        discard(e)
        e = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
