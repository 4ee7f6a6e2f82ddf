"""What the pipeline operators share: intermediate tables in the shared folder, distributed ranks, token lists."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six separators of a word: space and 0x09-0x0D.
SEPARATORS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only on a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="concordia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/concordia/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._concordia_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Tables of materialize() by open scratch(), the innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Delete, at the end, every table that materialize() made inside; what is still needed must be written outside."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            discard(table)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing lazy reads any more."""
    path = getattr(df, "_concordia_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python so many rows at a time in this session, unless it has a setting of its own: a worker and its executor hold several copies of a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # the default
        spark.conf.set(key, rows)


def power_of_two(x: float, least: int, most: int) -> int:
    n = least
    while n < x and n < most:
        n *= 2
    return n


def ranked(df: DataFrame, group: list[str], order: list[Column], salt: Column, slots: int, out: str, *, rows_per_slot: bool = False) -> DataFrame:
    """Number the rows of each group from 0 (column out) without bringing a group to one task.

    The rows of a group are dealt into ``slots`` slots by salt; a slot starts where the slots before it end, and
    only the rows of one slot are sorted together. The numbering depends on the rows alone, not on partitions.
    """
    s = df.withColumn("__slot", F.coalesce(F.pmod(salt, F.lit(slots)).cast("int"), F.lit(0)))
    keys = [*group, "__slot"]
    before = Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(keys)], F.coalesce(F.sum("__n").over(before.partitionBy(*group) if group else before), F.lit(0)).alias("__start"))
    numbered = s.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = None
    for i, c in enumerate(keys):
        # Plain equality of what is never null keeps the window's partitions, so that whole rows aren't shuffled again.
        eq = F.col(c).eqNullSafe(F.col(f"__g{i}")) if s.schema[c].nullable else F.col(c) == F.col(f"__g{i}")
        on = eq if on is None else on & eq
    return numbered.join(starts, on).withColumn(out, (F.col("__rn") + F.col("__start")).cast("long")).drop("__slot", "__rn", "__start", *[f"__g{i}" for i in range(len(keys))])
