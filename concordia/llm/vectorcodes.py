"""Vector code compression: integer vectors in parts, each part coded as its nearest entry of a trained codebook.

Codebooks are broadcast. Tasks compute all distances of an Arrow batch as |x|^2 - 2xc + |c|^2 with exact int64 matrix
products and take the first least one. A round's sums and counts of each entry are added up in the task, merged by a
grouped shuffle, and divided on the driver, which holds one codebook a dimension and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import materialize

#: Rows whose distances are computed together; bytes of all codebooks, which are broadcast; groups whose totals are.
ROWS, CODEBOOK_BYTES, TOTALS = 2048, 64 << 20, 1 << 16
#: Far beyond what train() takes, and within 64 bits.
_FAR = 2.0**62


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of dim components, as equal as can be (equal where parts divide dim)."""
    at = [k * dim // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def assign(x: np.ndarray, codebook: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row (ties: the first), and the squared distance of the row; exact."""
    codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for k, part in enumerate(cuts(x.shape[1], parts)):
        c = codebook[:, part]
        square = (c * c).sum(axis=1)
        for lo in range(0, len(x), ROWS):
            y = x[lo : lo + ROWS, part]
            far = square - 2 * (y @ c.T)  # |x|^2 is the same for all entries
            best = far.argmin(axis=1)
            codes[lo : lo + ROWS, k] = best
            error[lo : lo + ROWS] += far[np.arange(len(y)), best] + (y * y).sum(axis=1)
    return codes, error


def _groups(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, places and integer vectors of the rows of a batch (dim, vector) that have that dimension."""
    import pyarrow as pa

    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        flat = batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield dim, at, flat.astype(np.int64).reshape(len(at), dim)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, dim, vector: components floor(scale * x) of the vectors that are whole and finite."""
    x = F.col("embedding").cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", bad))
    return whole.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(_FAR)), F.lit(-_FAR)))).alias("vector"))


def _seeds(rows: DataFrame, dims: list[int], entries: int) -> dict[int, np.ndarray]:
    out = {}
    for dim in dims:
        first = rows.where(F.col("dim") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vec_id", "vector").limit(entries).collect()
        out[dim] = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dim)
    return out


def _means(rows: DataFrame, books: dict[int, np.ndarray], parts: int) -> dict[int, np.ndarray]:
    """The codebooks after one round: each used entry is the floor of its parts' mean, the others stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _groups(b):
                book = shared.value[dim]
                codes, _ = assign(x, book, parts)
                total = sums.setdefault(dim, np.zeros(book.shape, np.int64))
                count = counts.setdefault(dim, np.zeros((len(book), parts), np.int64))
                for k, part in enumerate(cuts(dim, parts)):
                    order = np.argsort(codes[:, k], kind="stable")
                    used, first, n = np.unique(codes[order, k], return_index=True, return_counts=True)
                    total[used, part] += np.add.reduceat(x[order, part], first, axis=0)
                    count[used, k] += n
        for dim, total in sums.items():
            of = np.repeat(np.arange(parts), [p.stop - p.start for p in cuts(dim, parts)])
            n = counts[dim][:, of]
            entry, place = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), dim), pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(total[entry, place]), pa.array(n[entry, place])], ["dim", "entry", "place", "total", "n"])

    sums = rows.select("dim", "vector").mapInArrow(run, "dim int, entry int, place int, total long, n long")
    merged = sums.groupBy("dim", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = {dim: book.copy() for dim, book in books.items()}
    for r in merged.collect():
        out[r["dim"]][r["entry"], r["place"]] = r["total"] // r["n"]
    shared.unpersist()
    return out


def codebook_sha256(book: np.ndarray, parts: int) -> str:
    """Digest of all entries' components in decimal, by part, entry and place, joined by commas."""
    flat = np.concatenate([book[:, p].ravel() for p in cuts(book.shape[1], parts)])
    return hashlib.sha256(",".join(map(str, flat.tolist())).encode()).hexdigest()


def train(rows: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4) -> dict[int, np.ndarray]:
    """One codebook a dimension from integers() that can be read again: entries x dim, seeded by the least vec_ids.

    Fewer rows than entries give as many entries as rows; rows of equal vec_id come by their components, rows without
    one last. ValueError if a squared distance might not fit in 64 bits, or all codebooks together not in CODEBOOK_BYTES.
    """
    size = F.coalesce(F.array_max(F.transform("vector", lambda v: F.greatest(v, -v - 1))), F.lit(0))
    stats = rows.groupBy("dim").agg(F.max(size).alias("top")).limit(CODEBOOK_BYTES // 8).collect()
    if sum(8 * entries * r["dim"] for r in stats) > CODEBOOK_BYTES:
        raise ValueError("codebooks of all dimensions are too large to broadcast")
    for r in stats:
        if max(1, -(-r["dim"] // parts)) * 4 * (r["top"] + 1) ** 2 >= 1 << 62:
            raise ValueError(f"components of dimension {r['dim']} are too large for exact distances in 64 bits")
    books = _seeds(rows, sorted(r["dim"] for r in stats), entries)
    for _ in range(rounds if books else 0):
        books = _means(rows, books, parts)
    return books


def encode(rows: DataFrame, books: dict[int, np.ndarray], *, parts: int = 4) -> DataFrame:
    """vec_id, label, dim, code, error of integers(): entry numbers in part order, two hex digits each (as many as needed beyond 256 entries)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    digits = max([2, *(len(f"{len(b) - 1:x}") for b in books.values())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            code, error = np.empty((b.num_rows, parts), np.int64), np.empty(b.num_rows, np.int64)
            for dim, at, x in _groups(b):
                code[at], error[at] = assign(x, shared.value[dim], parts)
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("dim"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "dim", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, dim int, code string, error long")


def decode(codes: DataFrame, books: dict[int, np.ndarray], *, parts: int = 4) -> DataFrame:
    """codes (dim, code and any other columns but vector) with vector, the integer components that the code stands for."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<long>")
    def vector(dim, code):
        import pandas as pd

        out = []
        for d, c in zip(dim, code, strict=True):
            book, n = shared.value[d], len(c) // parts
            out.append(np.concatenate([book[int(c[n * k : n * k + n], 16), p] for k, p in enumerate(cuts(d, parts))]))
        return pd.Series(out)

    return codes.withColumn("vector", vector("dim", "code"))


def compress(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every whole and finite row of vectors (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite components are left out. Each dimension has codebooks of its own;
    an empty vector has empty parts, all coded 0 with no error. Repeated rows, and rows with a null vec_id or label, are
    coded like others; label_error adds the errors of equal labels, of null ones too. Only vec_id, embedding and label
    are read, so other columns cannot clash; an empty table gives an empty one. See train() for what is too large.
    """
    rows = materialize(integers(vectors, scale), "integers")
    books = train(rows, parts=parts, entries=entries, rounds=rounds)
    coded = materialize(encode(rows, books, parts=parts), "codes")
    totals = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    # Few labels are broadcast; many are joined by shuffle, where AQE splits a hot one.
    few = totals.limit(TOTALS + 1).count() <= TOTALS
    digests = vectors.sparkSession.createDataFrame([(d, codebook_sha256(b, parts)) for d, b in books.items()], "book int, codebooks_sha256 string")
    named = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")))
    return named.join(F.broadcast(digests), F.col("dim") == F.col("book")).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
