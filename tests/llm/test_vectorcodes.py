"""Vector codes against brute force in Python's own integers; the query against its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from concordia.llm import queries, vectorcodes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, dim string, vector string, x int"


def brute(rows, parts, entries, rounds, scale=1024):
    """{row number: (code, error)}, codebook digest a dimension."""
    whole = [(k, i, [math.floor(scale * v) for v in e]) for k, (i, e) in enumerate(rows) if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out, digests = {}, {}
    for dim in {len(x) for _, _, x in whole}:
        own = [(k, i, x) for k, i, x in whole if len(x) == dim]
        cut = [slice(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]
        first = sorted(own, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
        books = [[x[c] for _, _, x in first] for c in cut]
        near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            for c, book in zip(cut, books, strict=True):
                got = {}
                for _, _, x in own:
                    got.setdefault(near(x[c], book)[1], []).append(x[c])
                for e, members in got.items():
                    book[e] = [sum(v) // len(members) for v in zip(*members, strict=True)]
        for k, _, x in own:
            best = [near(x[c], book) for c, book in zip(cut, books, strict=True)]
            out[k] = "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)
        digests[dim] = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return out, digests


def table(spark, rows, labels):
    return spark.createDataFrame([(i, e, lab, "c", "d", "v", 1) for (i, e), lab in zip(rows, labels, strict=True)], SCHEMA)


def compare(spark, rows, labels, **how):
    want, digests = brute(rows, 4, how.get("entries", 256), how.get("rounds", 4))
    total = {}
    for k, (_, error) in want.items():
        total[labels[k]] = total.get(labels[k], 0) + error
    got = vectorcodes.compress(table(spark, rows, labels), **how).collect()
    expected = [(rows[k][0], code, error, labels[k], total[labels[k]], digests[len(rows[k][1])]) for k, (code, error) in want.items()]
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"], r["label_error"], r["codebooks_sha256"]) for r in got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("entries,totals", [(3, 0), (8, 1 << 16), (256, 1 << 16)])
def test_codes_are_those_of_brute_force(spark, monkeypatch, entries, totals):
    monkeypatch.setattr(vectorcodes, "TOTALS", totals)
    monkeypatch.setattr(vectorcodes, "ROWS", 7)
    rng = random.Random(entries)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.uniform(-3, 3)]) for _ in range(8)]) for i in range(60)]
    rows += [rows[5], rows[5], (5, [9.0] * 8), (None, [0.25] * 8), (None, None), (70, [0.0] * 7 + [None]), (71, [0.0] * 7 + [math.nan]), (72, [math.inf] * 8), (73, [0.0] * 8), (-4, [-0.0001] * 8)]
    rows += [(80, []), (81, [1.5]), (82, [0.1] * 6), (83, [0.2] * 6)]
    compare(spark, rows, [rng.choice([None, 1, 2]) for _ in rows], entries=entries)


def test_one_hot_group_and_ties(spark):
    rows = [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] + [(40 + i, [0.5 + i, 0.25, 0.0, -1.0]) for i in range(6)]
    compare(spark, rows, [7] * 46, entries=16)


def test_empty_table_and_large_components(spark):
    assert vectorcodes.compress(table(spark, [], [])).collect() == []
    assert vectorcodes.compress(table(spark, [(1, None), (2, [math.nan])], [1, 1])).collect() == []
    for far in (1e300, -1e300, 4e6):
        with pytest.raises(ValueError, match="too large"):
            vectorcodes.compress(table(spark, [(1, [far] * 16)], [1]))


def test_codes_are_read_back(spark):
    rng = random.Random(3)
    rows = vectorcodes.materialize(vectorcodes.integers(table(spark, [(i, [rng.uniform(-1, 1) for _ in range(10)]) for i in range(50)], [1] * 50), 1024), "integers")
    books = vectorcodes.train(rows, entries=8)
    coded = vectorcodes.decode(vectorcodes.encode(rows, books), books).withColumnRenamed("vector", "back").join(rows, ["vec_id"])
    for r in coded.collect():
        assert r["error"] == int(((np.array(r["back"]) - np.array(r["vector"])) ** 2).sum())


def test_query_equals_sql(spark):
    df = queries.op13_vector_codes(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(queries.CODES_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
