"""Search over chunks: exact vectors, words, trigrams, and reciprocal rank fusion; access is filtered before anything is ranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import text
from concordia.functions.values import cosine

RRF_K = 60


def scoped(chunks: DataFrame, allowed: DataFrame | None = None, **equals) -> DataFrame:
    """Chunks of the given column values and, where allowed (document_id) is given, of those documents only."""
    for name, value in equals.items():
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    return chunks if allowed is None else chunks.join(allowed.select("document_id").distinct(), "document_id", "left_semi")


def top_k(chunks: DataFrame, vector: list[float] | Column, limit: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """The limit nearest chunks by exact cosine, ties by id; each task keeps its own best, so only limit rows a task move."""
    q = vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])
    return chunks.withColumn("sim", F.round(cosine(F.col(vector_col), q), digits)).where("sim is not null").orderBy(F.desc("sim"), id_col).limit(limit)


def top_k_each(chunks: DataFrame, questions: DataFrame, limit: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", digits: int = 6, block: int = 4096) -> DataFrame:
    """question, id, sim: the limit nearest chunks of every row of questions (question, vector_col) by exact cosine, ties by id.

    Questions are broadcast in blocks of so many rows, one pass over the chunks a block. A task multiplies the block with
    its Arrow batches and keeps the best of each question, so only limit rows a question and task are shuffled and never
    a pair. Vectors that are null, empty, zero or hold null or non-finite numbers have no cosine and are in no result,
    nor are vectors of other lengths compared; a question without a match has no row.
    """
    asked = questions.select("question", vector_col).where(f"question is not null and {vector_col} is not null")
    n = asked.count()
    parts = max(1, -(-n // block))
    kinds = dict(chunks.dtypes)[id_col], dict(asked.dtypes)["question"]
    out = None
    for part in range(parts):
        rows = (asked.where(F.pmod(F.xxhash64("question"), F.lit(parts)) == part) if parts > 1 else asked).collect()
        best = _best(chunks.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), rows, limit, digits, kinds)
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("question").orderBy(F.desc("sim"), "id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def _best(chunks: DataFrame, asked: list, limit: int, digits: int, kinds: tuple[str, str]) -> DataFrame:
    """question, id, sim of the best of each task."""
    import numpy as np

    def units(rows: list) -> dict[int, tuple[list[int], np.ndarray]]:
        """By length: which rows have a direction, and it."""
        out: dict[int, list] = {}
        for i, v in enumerate(rows):
            if v is not None and len(v) and None not in v:
                x = np.asarray(v, float)
                size = np.sqrt((x * x).sum())
                if np.isfinite(size) and size > 0:
                    out.setdefault(len(v), []).append((i, x / size))
        return {d: ([i for i, _ in p], np.stack([x for _, x in p])) for d, p in out.items()}

    names, own = [r[0] for r in asked], units([r[1] for r in asked])
    shared = chunks.sparkSession.sparkContext.broadcast((names, own))

    def run(batches):
        import pyarrow as pa

        names, own = shared.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for dim, (at, x) in units(b.column(1).to_pylist()).items():
                    if dim not in own:
                        continue
                    of, q = own[dim]
                    mine = ids[at]
                    for first in range(0, len(of), 512):
                        sims = np.round(q[first : first + 512] @ x.T, digits)
                        for k, row in zip(of[first : first + 512], sims, strict=True):
                            if k in held and len(held[k][0]) == limit:
                                near = np.flatnonzero(row >= held[k][0][-1])
                                if not len(near):
                                    continue
                            else:
                                near = np.arange(len(row))
                            s, i = row[near], mine[near]
                            if k in held:
                                s, i = np.concatenate([held[k][0], s]), np.concatenate([held[k][1], i])
                            order = np.lexsort((i, -s))[:limit]
                            held[k] = s[order], i[order]
        for k, (s, i) in held.items():
            yield pa.RecordBatch.from_pydict({"question": [names[k]] * len(s), "id": i.tolist(), "sim": s.tolist()}, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = StructType([StructField("question", _type(kinds[1])), StructField("id", _type(kinds[0])), StructField("sim", DoubleType())])
    schema = to_arrow_schema(fields)
    return chunks.where("id is not null").mapInArrow(run, fields)


def _type(name: str):
    from pyspark.sql.types import DataType

    return DataType.fromDDL(name)


def lexical(chunks: DataFrame, query: str, limit: int, *, id_col: str = "chunk_id", text_col: str = "chunk_text") -> DataFrame:
    """Chunks by the share of the query's words that they hold."""
    own = text.tokens(F.lit(query))
    return chunks.withColumn("sim", F.round(F.size(F.array_intersect(text.tokens(F.col(text_col)), own)) / F.size(own), 6)).where("sim > 0").orderBy(F.desc("sim"), id_col).limit(limit)


def trigram(chunks: DataFrame, query: str, limit: int, *, id_col: str = "chunk_id", text_col: str = "chunk_text", least: float = 0.0) -> DataFrame:
    """Chunks by the Jaccard similarity of trigrams, which finds codes with other separators."""
    return chunks.withColumn("sim", F.round(text.jaccard(text.trigrams(F.col(text_col)), text.trigrams(F.lit(query))), 6)).where(F.col("sim") > least).orderBy(F.desc("sim"), id_col).limit(limit)


def fuse(legs: list[DataFrame], limit: int, *, id_col: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of legs (id, sim), each of a bounded number of rows: id, score, in order."""
    order = Window.orderBy(F.desc("sim"), id_col)
    ranked = [leg.select(id_col, (F.lit(1.0) / (k + F.row_number().over(order))).alias("s")) for leg in legs]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.groupBy(id_col).agg(F.round(F.sum("s"), 10).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def retrieve(chunks: DataFrame, query: str, vector: list[float], *, limit: int = 10, depth: int = 50, rerank: Callable | None = None, allowed: DataFrame | None = None, **equals) -> DataFrame:
    """The limit best chunks of the three legs; rerank (a pandas function of query and texts) orders the depth best anew."""
    c = scoped(chunks, allowed, **equals)
    best = fuse([top_k(c, vector, depth), lexical(c, query, depth), trigram(c, query, depth)], depth)
    found = c.join(F.broadcast(best), "chunk_id")
    if rerank is not None:
        found = found.withColumn("score", F.pandas_udf(lambda s: rerank(query, s), "double")(F.col("chunk_text")))
    return found.orderBy(F.desc("score"), "chunk_id").limit(limit)


def embed(df: DataFrame, text_col: str, embedder: Callable, out: str = "embedding") -> DataFrame:
    """Embed texts by batches with an injected function of a pandas series."""
    return df.withColumn(out, F.pandas_udf(embedder, "array<float>")(F.col(text_col)))


def extract(df: DataFrame, text_col: str, extractor: Callable, schema: str, out: str = "extracted") -> DataFrame:
    """Extract by batches with an injected function that gives JSON texts, null for insufficient evidence."""
    return df.withColumn(out, F.from_json(F.pandas_udf(extractor, "string")(F.col(text_col)), schema))
