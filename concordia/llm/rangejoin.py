"""Embedding near-duplicates: an exact metric range join by pivots.

Unit vectors with cosine >= t are at most r = sqrt(2 - 2t) apart. In a group of equal label and dimension each vector
lives in the cell of its nearest pivot p. A neighbour y of x, in the cell of q, has d(y, q) <= d(y, p), so the triangle
inequality gives d(x, q) <= d(x, p) + 2r; and as y lies on q's side of the plane between p and q, x lies at most r
beyond it: (d(x, q)^2 - d(x, p)^2) / 2 d(p, q) <= r. x is replicated to just the cells q that meet both bounds. Then a
cell's own vectors meet all their neighbours inside the cell, and cells are joined independently.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.common import materialize
from concordia.llm.components import Forest, components

#: A group of n vectors gets sqrt(n) / ROOTS pivots, GROUP_PIVOTS at most; LEAST is the smallest group that gets any.
#: PIVOTS bounds the pivots of all groups and so the broadcast: the largest groups, of which at most GROUPS are looked
#: at, come first, and a group without pivots is one cell. A cell of more than BLOCK members is joined as pairs of chunks.
ROOTS, LEAST, GROUP_PIVOTS, GROUPS, PIVOTS, BLOCK = 4, 32, 256, 4096, 32_768, 4096
#: Added to distances, far above the rounding of double precision and far below any difference that matters.
SLACK = 1e-9


def _unit(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return _scaled(flat.reshape(len(column), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; first divided by their largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def pivots(reps: DataFrame, sizes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Unit pivots of the largest groups, rows of least hash: a bounded sample that steers cells and never the result."""
    chosen, left = [], PIVOTS
    for r in sizes.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "label", "dim").limit(GROUPS).collect():
        k = min(GROUP_PIVOTS, max(2, math.isqrt(r["n"]) // ROOTS), left)
        if k < 2:
            break
        chosen.append((r["label"], r["dim"], k, 8 * k / r["n"]))
        left -= k
    large = reps.sparkSession.createDataFrame(chosen, "label int, dim int, k int, share double")
    draw = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = reps.join(F.broadcast(large), ["label", "dim"]).where(draw < F.col("share"))
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("rep", F.lit(3)), "rep")
    rows = sample.withColumn("i", F.row_number().over(order)).where("i <= k").select("label", "dim", "embedding").collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r["label"], r["dim"]), []).append(_scaled(np.array([r["embedding"]], dtype=float))[0])
    return {k: np.array(v) for k, v in out.items()}


def _cells(reps: DataFrame, cells: dict, radius: float) -> DataFrame:
    """label, dim, cell, home, rep, m, embedding: each vector in its own cell and in those near whose border it lies."""
    shared = reps.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            label, dim = b.column(0).to_numpy(), b.column(1).to_numpy()
            take, cell, home = [], [], []
            for key in dict.fromkeys(zip(label.tolist(), dim.tolist(), strict=True)):
                rows = np.flatnonzero((label == key[0]) & (dim == key[1]))
                p = shared.value.get(key)
                if p is None:
                    take.append(rows), cell.append(np.zeros(len(rows), np.int32)), home.append(np.ones(len(rows), bool))
                    continue
                x = _unit(b.column(4).take(pa.array(rows)))
                d = np.sqrt(np.maximum(0, 2 - 2 * (x @ p.T)))
                own, least = d.argmin(axis=1), d.min(axis=1)[:, None]
                apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[own]
                beyond = d * d - least * least <= 2 * apart * (radius + SLACK) + SLACK
                i, q = np.nonzero(beyond & (d <= least + 2 * radius + SLACK))
                take.append(rows[i]), cell.append(q.astype(np.int32)), home.append(own[i] == q)
            if not take:
                continue
            at = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(cell)), pa.array(np.concatenate(home)), b.column(2).take(at), b.column(3).take(at), b.column(4).take(at)], ["label", "dim", "cell", "home", "rep", "m", "embedding"])

    return reps.select("label", "dim", "rep", "m", "embedding").mapInArrow(run, "label int, dim int, cell int, home boolean, rep long, m long, embedding {}".format(reps.schema["embedding"].dataType.simpleString()))


def _join_cells(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """Rows (a, b, n): with b null, n links of a that one block found; else an edge of a forest of the links."""
    by = ["label", "dim", "cell"]
    large = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    dealt = members.join(large, by, "left").withColumn("nc", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")).withColumn("c", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("nc")).cast("int"))
    # Role 1: own vectors of chunk bi; role 2: members of chunk bj; role 3: both.
    as_member = F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda o: F.struct(o.alias("bi"), F.col("c").alias("bj"), F.when(F.col("home") & (o == F.col("c")), 3).otherwise(2).alias("role")))
    as_home = F.when(F.col("home"), F.filter(F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda o: F.struct(F.col("c").alias("bi"), o.alias("bj"), F.lit(1).alias("role"))), lambda s: s["bj"] != F.col("c")))
    dealt = dealt.withColumn("s", F.explode(F.concat(as_member, F.coalesce(as_home, F.filter(as_member, lambda s: F.lit(False))))))
    dealt = dealt.select(*by, "s.bi", "s.bj", "s.role", "rep", "m", "embedding")
    keys = [*by, "bi", "bj"]

    def work(table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """rep, links, and edges of one block."""
        role, rep, m = (table.column(c).to_numpy() for c in ("role", "rep", "m"))
        x = _unit(table.column("embedding").combine_chunks())
        own, all_ = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        forest, counts = Forest(len(rep)), np.zeros(len(own), np.int64)
        y, weight = x[all_], m[all_]
        for at in range(0, len(own), 512):
            i = own[at : at + 512]
            linked = x[i] @ y.T >= cosine
            linked &= rep[i][:, None] != rep[all_][None, :]
            counts[at : at + 512] = linked @ weight
            a, b = np.nonzero(linked)
            forest.union(i[a], all_[b])
        ea, eb = forest.stars(rep)
        return rep[own], counts, ea, eb

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def result(table) -> pa.RecordBatch:
            rep, counts, ea, eb = work(table)
            a = pa.array(np.concatenate([rep, ea]), pa.int64())
            b = pa.concat_arrays([pa.nulls(len(rep), pa.int64()), pa.array(eb, pa.int64())])
            n = pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(len(ea), pa.int64())])
            return pa.RecordBatch.from_arrays([a, b, n], schema=schema)

        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            t = pa.concat_tables(held)
            cols = [t.column(c).to_numpy() for c in keys]
            new = np.zeros(t.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield result(t.slice(lo, hi - lo))
            held = [t.slice(cuts[-1])]
        if held and held[0].num_rows:
            yield result(pa.concat_tables(held))

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their dimensions are equal and their cosine in double
    precision is at least cosine. A vector that is null, empty, zero or holds a null or non-finite component links with
    nothing, as does a row with a null vec_id: n_links 0, component_id = vec_id, kept true (null vec_id: kept null).
    Equal vectors of a label meet once, as a representative with a count; every copy gets the links to all others. The
    result holds all links' counts and components; links are never listed.
    """
    kind = dict(vectors.dtypes)["embedding"]
    e = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), e.alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    reps = materialize(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")).withColumn("dim", F.size("embedding")), "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    found = materialize(_join_cells(_cells(reps, pivots(reps, sizes), radius), cosine, block), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = reps.join(counts, reps["rep"] == counts["a"], "left").join(roots, reps["rep"] == roots["node"], "left")
    named = named.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = valid.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
