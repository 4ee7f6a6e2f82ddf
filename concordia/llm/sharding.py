"""Sharding by a Feistel permutation with cycle walking over global row numbers, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import power_of_two, ranked

ROUNDS = 6
#: Walks that a row may need beyond the first application. The domain is less than sqrt(n) + 1 larger than n, so a walk
#: goes on with probability below 1/sqrt(n) each time; a row that needs more raises an error and is never misplaced.
WALKS = 24
SLOT_ROWS = 100_000


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n, both about sqrt(n), fewer than a numbers outside."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    while a > 1 and (a - 1) * (a - 1) >= n:
        a -= 1
    return a, max(1, -(-n // a))


def _mix(x: Column, k: Column | int, seed: int, m: Column | int) -> Column:
    return F.pmod(F.xxhash64(x, k if isinstance(k, Column) else F.lit(k), F.lit(seed)), m if isinstance(m, Column) else F.lit(m))


def _walk(x: Column, n: int, a: int, b: int, seed: int) -> Column:
    """Apply the permutation of a * b numbers again while x is not below n."""

    def once(v: Column) -> Column:
        start = F.struct((v % F.lit(a)).alias("l"), F.floor(v / F.lit(a)).cast("long").alias("r"))

        def step(s: Column, k: Column) -> Column:
            left, right = s["l"], s["r"]
            even = k % 2 == 0
            return F.struct(
                F.when(even, F.pmod(left + _mix(right, k, seed, a), F.lit(a))).otherwise(left).alias("l"),
                F.when(even, right).otherwise(F.pmod(right + _mix(left, k, seed, b), F.lit(b))).alias("r"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] + s["r"] * F.lit(a))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, lambda v, _: F.when(v < n, v).otherwise(once(v)))


def permuted(df: DataFrame, number: str, n: int, *, seed: int = 0, out: str = "position") -> DataFrame:
    """out = pi(number), a permutation of 0..n-1 that seed and n fix; number holds row numbers below n.

    Each round adds to one half a hash of the other (halves of size a and b, a * b >= n), so it is invertible; a
    result of n or more is permuted again until it falls below n (cycle walking).
    """
    a, b = sides(n)
    df = df.withColumn("__l", F.col(number) % F.lit(a)).withColumn("__r", F.expr(f"{number} div {a}L"))
    for k in range(ROUNDS):
        own, other, m = ("__l", "__r", a) if k % 2 == 0 else ("__r", "__l", b)
        df = df.withColumn(own, F.pmod(F.col(own) + _mix(F.col(other), k, seed, m), F.lit(m)))
    df = df.withColumn("__p", F.col("__l") + F.col("__r") * F.lit(a))
    walked = F.when(F.col("__p") < n, F.col("__p")).otherwise(_walk(F.col("__p"), n, a, b, seed))
    df = df.withColumn("__p", walked)
    checked = F.when(F.col("__p") < n, F.col("__p")).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))
    return df.withColumn(out, checked).drop("__l", "__r", "__p")


def shard(docs: DataFrame, *, shards: int = 16, seed: int = 0) -> DataFrame:
    """Deal all rows into shards of counts at most one apart, reproducibly shuffled: adds size, text_crc32, row_number,
    position, shard = position mod shards and slot = position div shards to doc_id.

    Global row numbers follow slots of rows hashed by (doc_id, size, crc32), then doc_id within a slot, so they depend
    on the rows alone; text itself is not shuffled. A null text counts as empty (size 1, crc32 0); a null doc_id is
    kept. Repeated rows get places of their own. Equal texts are not kept together: the law is equal row counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = docs.select(F.lit(1).alias("one")).count()
    slots = power_of_two(n / SLOT_ROWS, 64, 1 << 16)
    numbered = ranked(rows, [], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], F.xxhash64("doc_id", "size", "text_crc32"), slots, "row_number")
    placed = permuted(numbered, "row_number", max(n, 1), seed=seed)
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))
