"""Periodic runs against brute force; the query against its SQL."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from concordia.llm import periodic, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            smaller = any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q))
            if j + q - i >= max(least, 2 * q) and not smaller:
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_rest(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(rng):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 5]))) for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 150]))]
    if len(w) > 12 and rng.random() < 0.6:
        a, p = rng.randrange(len(w)), rng.randrange(1, 20)
        w = w[:a] + [w[a + (i - a) % min(p, len(w) - a)] for i in range(a, len(w))]
    return w


@pytest.mark.parametrize("pairs", [7, 1 << 18])
def test_runs_are_those_of_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    rng = random.Random(4)
    for _ in range(60):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 6))]
        found, rest = periodic.search([[x.encode() for x in t] for t in texts])
        for t, f, r in zip(texts, found, rest, strict=True):
            want = brute_runs(t)
            assert [tuple(x) for x in f.tolist()] == want
            assert r.decode() == brute_rest(t, want)


def test_names_are_equal_where_windows_are():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([[90], rng.integers(0, 2, 60), np.tile([1, 2, 3], 20), [91]])
    levels = periodic.names(symbols)
    assert len(levels) > 4
    for j, level in enumerate(levels):
        windows = [tuple(symbols[i : i + 2**j]) for i in range(len(symbols) - 2**j + 1)]
        for a in range(len(windows)):
            for b in range(a):
                assert (level[a] == level[b]) == (windows[a] == windows[b])


@pytest.mark.parametrize("batch_words", [1, 1 << 19])
def test_awkward_rows(spark, monkeypatch, batch_words):
    monkeypatch.setattr(periodic, "BATCH_WORDS", batch_words)
    rng = random.Random(6)
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 12), (5, "a " * 11), (6, "A" * 40000), (7, "x y " * 3000), (None, "a b c " * 9), (4, "a " * 12), (8, "漢\x1c字 " * 14), (9, "\n".join(map(str, range(3000))))]
    texts += [(20 + i, " ".join(periodic_text(rng))) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], "doc_id long, text string, runs string, start string, collapsed string")
    got = periodic.periodic_runs(docs).collect()
    want = []
    for i, t in texts:
        w = WORD.findall(t or "")
        found = brute_runs(w) if len(w) < 2000 else [(0, len(w), 2)] if w[0] == "x" else []
        want.append((i, len(w), found, brute_rest(w, found)))
    key = repr
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(docs.where("false")).collect() == []


def test_planted_words(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(200)] + [(None, "a b c"), (500, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r in queries.planted(docs).collect():
        w = dict(texts)[r["doc_id"]]
        w = WORD.findall(w or "")
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        assert WORD.findall(r["text"] or "") == w


def test_query_equals_sql(spark):
    df = queries.op11_periodic_runs(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.RUNS_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
