"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions; with very many sources the driver schedules blocks.

Each source's rows are cut into blocks of equal size. A fluid server gives every unfinished source a rate in
proportion to its target weight; block k of a source is released when the fluid server starts it and due when the
fluid server ends it. Earliest-deadline-first over released blocks gives every block a slot inside its window, so
after any number of slots no source is a whole block ahead of or behind its fluid share. A source that runs out leaves
its share to the others, and every row is placed exactly once.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.common import materialize, ranked

#: Slots of the schedule besides one partial block a source; a block holds about rows / MAX_BLOCKS rows.
MAX_BLOCKS = 4096
#: Sources up to which the schedule is one expression; with more, the driver computes the same schedule with heaps.
MAX_SOURCES = 512
SLOT_ROWS = 100_000


def _bound(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def queues(docs: DataFrame, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """source, queue (0 the largest source), n, weight of every source.

    Without weights a source's weight is its row count to the power alpha (1: natural proportions, 0: equal shares).
    A source that is missing from weights has weight 0 there and is served when all others have run out; None names the
    null source. Weights are joined as a table, so that their number doesn't matter.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(name, float(w)) for name, w in weights.items()], "__named string, __weight double")
        counts = counts.join(given, F.col("source").cast("string").eqNullSafe(F.col("__named")), "left")
        weight = F.coalesce("__weight", F.lit(0.0))
    order = Window.orderBy(F.desc("n"), F.asc_nulls_first("source"))
    return counts.select("source", (F.row_number().over(order) - 1).alias("queue"), "n", weight.alias("weight"))


def schedule(queue: DataFrame, rows_per_block: Column | int) -> DataFrame:
    """queue, block, release, deadline, slot and block_rows, block_start (rows in the slots before) of every block.

    queue has queue, n (rows) and weight, a bounded number of rows; the number of blocks is bounded by the caller. The
    loop over slots is one aggregate() expression over arrays in a single row.
    """
    size = rows_per_block if isinstance(rows_per_block, Column) else F.lit(rows_per_block)
    least = F.lit(1e-12)
    one = (
        queue.groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("queue", "n", "weight"))).alias("q"), F.sum("n").alias("total"))
        .withColumn("per", size)
        .withColumn("q", F.transform("q", lambda x: F.struct(x["queue"].alias("queue"), x["n"].alias("n"), F.ceil(x["n"] / F.col("per")).cast("long").alias("blocks"), F.greatest(x["weight"], least).alias("w"))))
        .where(F.size("q") > 0)
    )

    def fluid(v: Column) -> Column:
        return F.aggregate("q", F.lit(0.0), lambda acc, x: acc + F.least(x["w"] * v, x["blocks"].cast("double")))

    window = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda k: F.struct(F.floor(fluid(k / x["w"]) + 1e-6).cast("long").alias("release"), F.ceil(fluid((k + 1) / x["w"]) - 1e-6).cast("long").alias("deadline")))
    one = one.withColumn("win", F.transform("q", window)).withColumn("slots", F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x["blocks"]))
    one = materialize(one, "windows")  # one row, written so that the loop below reads its windows and doesn't compute them again in every step

    def step(state: Column, t: Column) -> Column:
        ready = F.filter(F.transform(state["next"], lambda k, i: F.when(k < F.col("q")[i]["blocks"], F.struct((F.col("win")[i][k]["release"] > t).alias("early"), F.col("win")[i][k]["deadline"].alias("due"), i.alias("i")))), lambda x: x.isNotNull())
        return _bound(F.array_min(ready)["i"], lambda best: F.struct(F.transform(state["next"], lambda k, j: F.when(j == best, k + 1).otherwise(k)).alias("next"), F.concat(state["order"], F.array(best)).alias("order")))

    start = F.struct(F.transform("q", lambda _: F.lit(0)).alias("next"), F.expr("cast(array() as array<int>)").alias("order"))
    served = one.withColumn("order", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), start, step, lambda s: s["order"]))
    slots = served.select("q", "win", "per", F.posexplode("order").alias("slot", "i"))
    slots = slots.withColumn("block", (F.row_number().over(Window.partitionBy("i").orderBy("slot")) - 1).cast("long"))
    at = F.col("win")[F.col("i")][F.col("block").cast("int")]
    rows = F.least(F.col("per"), F.col("q")[F.col("i")]["n"] - F.col("block") * F.col("per"))
    slots = slots.select(F.col("q")[F.col("i")]["queue"].alias("queue"), "block", at["release"].alias("release"), at["deadline"].alias("deadline"), F.col("slot").cast("long").alias("slot"), rows.cast("long").alias("block_rows"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("block_start", F.coalesce(F.sum("block_rows").over(before), F.lit(0)).cast("long"))


def schedule_many(queue: DataFrame, per: int) -> DataFrame:
    """The table of schedule() for many sources: the driver holds a few numbers for each source and block, never rows."""
    least = 1e-12
    q = queue.toPandas().sort_values("queue")
    names, n, w = q["queue"].to_numpy(np.int64), q["n"].to_numpy(np.int64), np.maximum(q["weight"].to_numpy(float), least)
    blocks = -(-n // per)
    # The fluid server has served sum(min(w v, blocks)) at virtual time v: sources are full in the order of blocks / w.
    by = np.argsort(blocks / w, kind="stable")
    ends, full = (blocks / w)[by], np.concatenate([[0], np.cumsum(blocks[by])])
    rate = np.concatenate([np.cumsum(w[by][::-1])[::-1], [0.0]])

    def fluid(v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ends, v, side="right")
        return full[at] + rate[at] * v

    i = np.repeat(np.arange(len(n)), blocks)
    starts = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    k = np.arange(len(i)) - starts[i]
    release = np.floor(fluid(k / w[i]) + 1e-6).astype(np.int64)
    deadline = np.ceil(fluid((k + 1) / w[i]) - 1e-6).astype(np.int64)
    following = starts.copy()  # the row of each source's next block
    ready: list[tuple[int, int, int]] = []  # released: (deadline, source, row)
    early = [(int(release[r]), s, int(r)) for s, r in enumerate(starts)]
    due = [(int(deadline[r]), s, int(r)) for s, r in enumerate(starts)]  # of all; entries of served blocks are passed over
    heapq.heapify(early)
    heapq.heapify(due)
    slot = np.empty(len(i), np.int64)
    for t in range(len(i)):
        while early and early[0][0] <= t:
            _, s, r = heapq.heappop(early)
            if following[s] == r:
                heapq.heappush(ready, (int(deadline[r]), s, r))
        if ready:
            _, s, r = heapq.heappop(ready)
        else:
            while True:
                _, s, r = heapq.heappop(due)
                if following[s] == r:
                    break
        slot[r] = t
        following[s] = r = r + 1
        if r < starts[s] + blocks[s]:
            heapq.heappush(early, (int(release[r]), s, r))
            heapq.heappush(due, (int(deadline[r]), s, r))
    rows = np.minimum(per, n[i] - k * per)
    order = np.argsort(slot)
    before = np.empty(len(i), np.int64)
    before[order] = np.cumsum(rows[order]) - rows[order]
    import pandas as pd

    columns = {"queue": names[i], "block": k, "release": release, "deadline": deadline, "slot": slot, "block_rows": rows, "block_start": before}
    return queue.sparkSession.createDataFrame(pd.DataFrame(columns), "queue long, block long, release long, deadline long, slot long, block_rows long, block_start long")


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, max_blocks: int = MAX_BLOCKS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """All rows of docs with queue, block, release, deadline, slot and position (0..n-1) in the mixed order.

    A source's rows are taken in the order of md5(doc_id), which shuffles them reproducibly. A null source is a source
    of its own, a null doc_id comes first in its source; repeated rows are placed side by side in any order. Columns of
    docs with the names of results are replaced. An empty table gives an empty one.
    """
    made = ["queue", "block", "release", "deadline", "slot", "position"]
    docs = docs.drop(*made)
    n = docs.select(F.lit(1).alias("one")).count()
    per = max(1, -(-n // max_blocks))
    named = queues(docs, weights, alpha)
    many = named.count() > max_sources
    plan = schedule_many(named.select("queue", "n", "weight"), per) if many else schedule(named.select("queue", "n", "weight"), F.lit(per).cast("long"))
    small = (lambda df: df) if many else F.broadcast
    keyed = docs.join(small(named.select(F.col("source").alias("__source"), F.col("queue"))), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    digits = next((d for d in (1, 2, 3, 4) if n / 16**d <= SLOT_ROWS / 4), 4)
    prefix = F.conv(F.substring("__md5", 1, digits), 16, 10).cast("long")
    numbered = ranked(keyed, ["queue"], [F.col("__md5"), F.col("doc_id")], prefix, 16**digits, "__rank").withColumn("block", F.expr(f"__rank div {per}L"))
    placed = numbered.join(small(plan), ["queue", "block"])
    return placed.withColumn("position", F.col("block_start") + F.col("__rank") % F.lit(per)).drop("__rank", "__md5", "block_rows", "block_start").select(*docs.columns, *made)
