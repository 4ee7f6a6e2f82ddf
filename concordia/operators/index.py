"""A stored inverted index over words, trigrams or stems: a search reads the posting lists of its own terms alone.

``folder/postings`` is a Parquet table, partitioned by segment and by a hash bucket of the term. A row holds the postings
of one term in one block of documents (blocks are dealt by a hash of the id), with the row's maxima, so that a term of
most documents is many rows of bounded size. Files are sorted by term: buckets prune files, statistics prune row groups.
``folder/segments`` names the segments that can be read; a segment's row is written last, so a failed writer leaves
nothing that is seen. Appending writes a new segment and touches no other; replaced and deleted ids are listed in
``folder/removed`` and hide what earlier segments say of them; compact() merges all into one segment.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import english, text

#: Buckets of terms, documents of a block, blocks that a search scores before it prunes the others.
BUCKETS, BLOCK, WAVE = 64, 1024, 32
#: Blocks of one bucket that one task writes.
TASK_BLOCKS = 4096

_distinct = lambda f: lambda c: F.transform(f(c), lambda t: F.struct(t.alias("term"), F.lit(None).cast("array<int>").alias("positions")))
#: Kinds of terms: a text column to an array of (term, positions), each term once; where positions aren't kept they are null.
KINDS: dict[str, Callable[[Column], Column]] = {"tokens": _distinct(text.tokens), "trigrams": _distinct(text.trigrams), "words": english.words, "stems": english.lexemes}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Index:
    """An index of one kind in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, *, id_type: str = "string", block: int = BLOCK):
        self.spark, self.folder, self.kind, self.id_type, self.block = spark, folder, kind, id_type, block
        self.terms = KINDS[kind]

    # -- writing -------------------------------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def segments(self) -> list[int]:
        """The segments that count, in order: from the last one that replaced all before it."""
        if not self._exists("segments"):
            return []
        rows = self.spark.read.parquet(f"{self.folder}/segments").orderBy("segment").collect()
        start = max((k for k, r in enumerate(rows) if r["replaces_all"]), default=0)
        return [r["segment"] for r in rows[start:]]

    def _commit(self, segment: int, replaces_all: bool) -> None:
        self.spark.createDataFrame([(segment, replaces_all)], "segment long, replaces_all boolean").coalesce(1).write.mode("append").parquet(f"{self.folder}/segments")

    def _next(self) -> int:
        return max(self.segments(), default=-1) + 1

    def _write(self, entries: DataFrame, segment: int, n: int) -> None:
        """entries (id, size, term, positions), one a term and id, of n documents."""
        blocks = max(1, -(-n // self.block))
        placed = entries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        count = F.coalesce(F.size("positions"), F.lit(1))
        lists = placed.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("id", "size", "positions"))).alias("postings"), F.count(F.lit(1)).alias("n"), F.max(F.when(count < 1, 1).otherwise(count)).alias("most"), F.min("size").alias("least"))
        dealt = lists.withColumn("segment", F.lit(segment)).withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.expr(f"block div {TASK_BLOCKS}"))
        dealt.sortWithinPartitions("bucket", "term", "block").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.folder}/postings")

    def append(self, chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "chunk_text", upsert: bool = False) -> int:
        """Index the rows of chunks in a segment of their own; its number. With upsert, what earlier segments say of their ids is hidden.

        Rows without an id, and texts without a term, can't be found and have no posting. An id should come once; of
        repeated rows of one id the terms are those of each.
        """
        rows = chunks.select(F.col(id_col).cast(self.id_type).alias("id"), self.terms(F.col(text_col)).alias("terms")).where("id is not null and terms is not null")
        entries = rows.select("id", F.size("terms").alias("size"), F.explode("terms").alias("t")).select("id", "size", "t.term", "t.positions")
        segment = self._next()
        self._write(entries, segment, chunks.count())
        if upsert:
            self._hide(chunks.select(F.col(id_col).cast(self.id_type).alias("id")).where("id is not null").distinct(), segment)
        self._commit(segment, False)
        return segment

    def remove(self, ids: DataFrame, *, id_col: str = "chunk_id") -> int:
        """Hide ids from all segments so far."""
        segment = self._next()
        self._hide(ids.select(F.col(id_col).cast(self.id_type).alias("id")).distinct(), segment)
        self._commit(segment, False)
        return segment

    def _hide(self, ids: DataFrame, segment: int) -> None:
        ids.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{self.folder}/removed")

    def compact(self) -> int:
        """Write all that can be found into one segment, without the hidden; earlier segments are no longer read."""
        live = self._postings(self._rows()).select("id", "size", "term", "positions")
        n, segment = live.select("id").distinct().count(), self._next()
        self._write(live, segment, n)
        self._commit(segment, True)
        return segment

    # -- reading -------------------------------------------------------------------------------------------------------

    def _rows(self, terms: list[str] | None = None) -> DataFrame:
        """The rows of the terms given, or all."""
        live = self.segments()
        if not live or not self._exists("postings"):
            return self.spark.createDataFrame([], f"term string, block int, postings array<struct<id:{self.id_type},size:int,positions:array<int>>>, n long, most int, least int, segment int, bucket int")
        rows = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("segment").isin(live))
        if terms is not None:
            buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return rows

    def _postings(self, rows: DataFrame) -> DataFrame:
        """term, id, size, positions of rows, without what later segments hide."""
        out = rows.select("segment", "block", "term", F.explode("postings").alias("p")).select("segment", "block", "term", "p.*")
        if not self._exists("removed"):
            return out
        gone = self.spark.read.parquet(f"{self.folder}/removed").where(F.col("segment").isin(self.segments())).groupBy(F.col("id").alias("gone")).agg(F.max("segment").alias("since"))
        return out.join(gone, (F.col("id") == F.col("gone")) & (F.col("segment") < F.col("since")), "left_anti")

    def query_terms(self, query: str) -> list[str]:
        """The terms of a query text, in the order of their first places where positions are kept."""
        found = self.spark.createDataFrame([(query,)], "q string").select(self.terms(F.col("q")).alias("t")).first()["t"]
        return [r["term"] for r in sorted(found, key=lambda r: (r["positions"] or [0])[0])]

    def matches(self, query: str) -> DataFrame:
        """id, size, hits [(term, positions)] of every document with a term of the query."""
        return self._hits(self._rows(self.query_terms(query)))

    def _hits(self, rows: DataFrame) -> DataFrame:
        return self._postings(rows).groupBy("id", "segment", "block").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("term", "positions"))).alias("hits")).drop("segment")

    def search(self, query: str, limit: int, *, score: str = "share", least: float = 0.0) -> DataFrame:
        """id, sim of the limit best documents, ties by id; exact.

        score: ``share`` is the share of the query's terms that a document holds, ``jaccard`` the overlap of both sets
        of terms, ``rank`` counts and nearness, see rank(). A document's score can't exceed the bound that its block's
        maxima give; the WAVE blocks of the highest bounds are scored first, and then only blocks whose bound reaches
        the limit-th best score. Blocks are chosen from the maxima alone, without reading a posting.
        """
        own = self.query_terms(query)
        rows, q = self._rows(own), len(own)
        if not q:
            return self.spark.createDataFrame([], f"id {self.id_type}, sim double")
        m, d = F.count_distinct("term"), F.min("least")
        bound = {"share": m / q, "jaccard": m / (q + F.greatest(d, m) - m), "rank": F.sum(F.log1p(F.col("most"))) + F.greatest(m - 1, F.lit(0))}[score]
        bounds = rows.groupBy("segment", "block").agg(bound.alias("bound"))
        sim = {"share": F.size("hits") / q, "jaccard": F.size("hits") / (q + F.col("size") - F.size("hits")), "rank": rank(F.col("hits"), own)}[score]

        def scored(blocks: DataFrame) -> DataFrame:
            chosen = rows.join(F.broadcast(blocks) if blocks is first else blocks, ["segment", "block"], "left_semi")
            return self._hits(chosen).select("id", F.round(sim, 6).alias("sim")).where(F.col("sim") > least)

        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(WAVE).select("segment", "block")
        best = [r["sim"] for r in scored(first).orderBy(F.desc("sim")).limit(limit).select("sim").collect()]
        reach = best[-1] if len(best) == limit else 0.0
        return scored(bounds.where(F.col("bound") >= reach - 1e-6)).orderBy(F.desc("sim"), "id").limit(limit)


def rank(hits: Column, own: list[str]) -> Column:
    """Counts and nearness of the query's terms own (in its order): the sum of log(1 + count) over the terms a document holds,
    and for neighbouring terms of the query that it holds both, 1 over their least distance."""
    pairs = list(zip(own, own[1:], strict=False))

    @F.arrow_udf("double")
    def scores(h: pa.Array) -> pa.Array:
        import numpy as np

        out = []
        for row in h:  # one document's hits as objects at a time
            at = {r["term"]: np.sort(np.asarray(r["positions"])) for r in row.as_py()}
            total = sum(float(np.log1p(len(p))) for p in at.values())
            for a, b in pairs:
                if a in at and b in at:
                    x, y = at[a], at[b]
                    k = np.searchsorted(y, x)
                    near = np.minimum(np.abs(y[np.minimum(k, len(y) - 1)] - x), np.abs(y[np.maximum(k - 1, 0)] - x)).min()
                    total += 1.0 / max(int(near), 1)
            out.append(total)
        return pa.array(out, pa.float64())

    return scores(hits)
