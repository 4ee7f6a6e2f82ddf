"""Operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and empty tables."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from concordia.llm import chat, common, components, langmodel, mixing, packing, quality, queries, rangejoin, sharding, simhash, toxicity, warc
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, queue string, length string, label string, sequence_id string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), None, "x", "y", "z", "l", "q") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd():
    """Texts with every awkward case; two rows repeat and one id is null."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["ciónment", "漢字", "a\x1cb", "x\xa0y", "it's", "#$%"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(300)
    texts = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, base), (7, base), (8, base + " more"), (9, say(5000)), (10, "spam ham " * 2000), (11, "line\nline\n\nother\n" * 5), (12, "A" * 50000)]
    texts += [(20 + i, say(rng.randrange(1, 400))) for i in range(30)]
    return [*texts, texts[5], (None, say(40))]


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- quality -------------------------------------------------------------------------------------------------------


def brute_repeat(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    return len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)})


def test_quality_measures(spark, odd):
    got = rows(quality.assess(docs_of(spark, odd)))
    assert len(got) == len(odd)
    by = dict(odd)
    for r in got:
        text = by[r["doc_id"]] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
        assert r["n_repeat_words"] == brute_repeat(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * brute_repeat(words) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (r["reason"] is None)
    kept = {r["doc_id"] for r in rows(quality.keep_good(docs_of(spark, odd)).select("doc_id"))}
    assert kept == {r["doc_id"] for r in got if r["kept"]}
    assert rows(quality.assess(docs_of(spark, []))) == []


def test_quality_bands():
    rng = random.Random(1)
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(60))
    assert quality.measure(noise, quality.Bands(), z)[-1] == "incompressible"
    table = "\n".join(f"row {i} | value | {i % 7} | unit | same column text" for i in range(400))
    assert quality.measure(table, quality.Bands(), z)[-1] is not None
    assert quality.Bands.limit(((64, 1.0), (256, 0.5)), 128) == pytest.approx(0.75)


def test_quality_chunks_reach_the_end():
    import zstandard

    rng = random.Random(12)
    z, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(260)]
    clean = " ".join(rng.choice(words) for _ in range(2000))[: bands.chunk]
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(1900))
    *_, ratio, chunks, bad, reason = quality.measure(clean + noise, bands, z)
    assert ratio <= bands.limit(bands.high, 3948) and (chunks, bad, reason) == (2, 1, "chunks")
    assert quality.measure(clean + clean, bands, z)[7] == 2 and quality.measure(clean[:-1], bands, z)[7] == 0


# -- WARC ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, None), (8, "http://b/\r\nX: y", ""), (7, "http://c", "ünïcode\r\n\r\nWARC/1.1\r\n"), (4, " http://d%20 ", "z" * 300000), (3, "http://a/2", "same"), (None, "http://n", "same"), (11, "", "own")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha1 string")
    folder = warc.fresh_path(spark, "warc-test")
    index = warc.write_archives(df, folder, archive_bytes=2000)
    got = rows(warc.read_records(index, folder))
    want = []
    for i, url, html in pages:
        payload = (html or "").encode()
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = min(same)
        want.append((i, url, "response" if i == first else "revisit", None if i == first else first, warc.digest(payload), len(payload)))
    key = lambda r: repr(r)
    assert sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_length"]) for r in got), key=key) == sorted(want, key=key)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    some = rows(warc.read_records(index.where("page_id in (4, 7)"), folder))
    assert sorted(r["page_id"] for r in some) == [4, 7]
    assert {bytes(r["payload"]) for r in some} == {b"z" * 300000, "ünïcode\r\n\r\nWARC/1.1\r\n".encode()}
    # Small payloads are never revisits under a minimum.
    index = warc.write_archives(df, warc.fresh_path(spark, "warc-test"), min_bytes=5)
    assert {r["record_type"] for r in rows(index)} == {"response"}
    assert rows(warc.archive_and_read(df.where("false"))) == []


def test_warc_ranges_coalesce(spark):
    sel = spark.createDataFrame([("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 200, 10), ("b", 0, 4)], "archive string, offset long, length long")
    got = sorted((r["archive"], r["start"], r["end"], len(r["records"])) for r in rows(warc.ranges(sel, range_bytes=100, gap_bytes=10)))
    assert got == [("a", 0, 30, 3), ("a", 200, 210, 1), ("b", 0, 4, 1)]


# -- embeddings ----------------------------------------------------------------------------------------------------


def brute_components(ids, edges):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_range_join(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vecs = []
    for i in range(500):
        c = centres[rng.integers(12)]
        vecs.append((i, (c + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist(), int(rng.choice([0, 0, 0, 1, 2]))))
    vecs += [(600 + i, vecs[3][1], vecs[3][2]) for i in range(30)]
    vecs += [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] + [1.0] * 15, 0), (703, [None] + [1.0] * 15, 0), (704, vecs[3][1], None), (705, [], 0), (706, vecs[3][1][:8], 0), (707, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*v, 1, 2) for v in vecs], "vec_id long, embedding array<float>, label int, rep long, cell long")
    got = {r["vec_id"]: r for r in rows(rangejoin.near_duplicates(df, block=48))}
    ok = [v for v in vecs if v[0] < 700]
    x = np.array([v[1] for v in ok], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    links, edges = Counter(), []
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and s[a, b] >= 0.98:
                links[ok[a][0]] += 1
                links[ok[b][0]] += 1
                edges.append((ok[a][0], ok[b][0]))
    root = brute_components([v[0] for v in vecs], edges)
    assert len(got) == len(vecs)
    for v in vecs:
        r = got[v[0]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (links[v[0]], root[v[0]], root[v[0]] == v[0]), v[0]
    assert rows(rangejoin.near_duplicates(df.where("false"))) == []
    # The method as it stands: every label has several pivots, and cells keep most pairs apart.
    reps = df.where("vec_id < 600").select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("m"), "embedding", "label", F.lit(16).alias("dim"))
    found = rangejoin.pivots(reps, reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    assert set(found) == {(0, 16), (1, 16), (2, 16)} and min(map(len, found.values())) >= 2
    cells = rows(rangejoin._cells(reps, found, math.sqrt(0.04)).groupBy("label", "cell").agg(F.count_if("home").alias("own"), F.count(F.lit(1)).alias("n")))
    assert sum(r["own"] for r in cells) == 500
    assert sum(r["own"] * r["n"] for r in cells) < 0.7 * sum(r["n"] ** 2 for r in rows(reps.groupBy("label").agg(F.count(F.lit(1)).alias("n"))))


def test_range_join_of_very_large_and_small_numbers(spark):
    data = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [5e-324, 1e-323]), (5, [2.0, -1.0]), (6, [1.7e308, -0.85e308])]
    df = spark.createDataFrame([(*d, 0) for d in data], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(rangejoin.near_duplicates(df))}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1120)] + [(2000, i) for i in range(2001, 2300)]
    got = {r["node"]: r["root"] for r in rows(components.components(spark.createDataFrame(edges, "a long, b long")))}
    root = brute_components({x for e in edges for x in e}, edges)
    assert got == {i: r for i, r in root.items() if i != r}


# -- toxicity ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dense", [0, 8])
def test_toxicity_is_plain_tf_idf(dense):
    """Cosines, neighbours (ties by place included), votes and calibration against a matrix that is made from counts alone."""
    rng = np.random.default_rng(4)
    say = lambda: {int(t): int(rng.integers(1, 4)) for t in rng.choice(60, rng.integers(0, 8), replace=False)}
    data = [(i, int(i % 3 == 0), say()) for i in range(700)]
    data += [(1000 + i, i % 2, dict(data[i % 5][2])) for i in range(60)]  # equal examples: ties at the k-th place
    s = toxicity.Settings(block=8, wave=2, dense=dense, k=7)
    m = toxicity.fit(data, {f"t{i}": i for i in range(60)}, s)
    of = {i: (y, c) for i, y, c in data}
    n = len(data)
    idf = [math.log((1 + n) / (1 + sum(t in c for _, _, c in data))) + 1 for t in range(60)]

    def unit(c):
        v = np.zeros(60)
        for t, k in c.items():
            v[t] = (1 + math.log(k)) * idf[t]
        return v / (np.linalg.norm(v) or 1)

    matrix = np.stack([unit(of[i][1]) for i in m.ids.tolist()])
    y = np.array([of[i][0] for i in m.ids.tolist()])
    prior = (y.sum() + 0.1) / (n + 1)

    def brute(c, skip=None):
        full = matrix @ unit(c)
        if skip is not None:
            full[skip] = 0
        near = [i for i in np.lexsort((np.arange(n), -np.round(full, 12))) if full[i] > 1e-12][:7]
        votes = {}
        for t in c:
            who = [(full[i] / full[near[0]], y[i]) for i in near if matrix[i, t] > 0] if near else []
            every, ones = sum(w for w, _ in who), sum(w * b for w, b in who)
            votes[t] = (ones - every * prior) / math.sqrt(every * prior * (1 - prior) + 0.5)
        return near, full, sum(sorted(votes.values())[-3:])

    own = [(brute(of[i][1], k), k) for k, i in enumerate(m.ids.tolist())]
    knots = toxicity.monotone([(vote, float(y[k])) for (near, _, vote), k in own if near], prior)
    assert np.allclose(knots[0], m.knots[0]) and np.allclose(knots[1], m.knots[1])
    skipped = 0
    for c in [say() for _ in range(60)] + [data[k][2] for k in range(5)]:
        t, w = m.vector(c)
        near, cosines, read = m.nearest(t, w)
        want, full, vote = brute(c)
        assert np.allclose(cosines, full[want]) and (np.abs(full[near] - full[want]) < 1e-12).all()
        assert len(set(near.tolist())) == len(near)
        skipped += read < m.blocks
        p, term = m.judge(near, cosines, t)
        if len(want):
            if set(near.tolist()) == set(want):
                assert p == pytest.approx(float(np.interp(vote, *knots))) and term in c
        else:
            assert p == m.empty < 0.5 and term == -1
    assert skipped > 20  # bounds rule blocks out


def test_toxicity_scores(spark):
    words = [f"common{i}" for i in range(200)]
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append((i, " ".join(rng.choice(words) for _ in range(60)) + (" vile wretch" if bad else "")))
        labels.append((i, int(bad), 7))
    texts += [(900, None), (901, ""), (902, "common1 " * 50_000), (903, "never seen"), texts[0], texts[0], (None, texts[0][1]), (None, None)]
    docs, lab = docs_of(spark, texts), spark.createDataFrame([*labels, (0, 1, 7), (5000, 1, 7), (3, None, 7)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, lab)
    assert len(model.ids) == len(set(model.ids.tolist()))  # repeated rows are one example
    got = rows(toxicity.score(docs, model))
    assert len(got) == len(texts)
    first = next(r for r in got if r["doc_id"] == 0)
    assert [(r["score"], r["neighbours"]) for r in got if r["doc_id"] in (0, None)].count((first["score"], first["neighbours"])) == 4
    assert all(r["predicted"] == int(r["doc_id"] < 400 and r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1 for r in got if r["doc_id"] is not None)
    assert sum(bool(r["neighbours"]) for r in got) == len(got) - 4
    held = [r for r in rows(queries.op4_toxicity_knn(spark, "/root/testdata/sf0.1")) if r["held_out"]]
    truth = {r["doc_id"]: r["toxic"] for r in rows(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))}
    known = [(r["predicted"], truth[r["doc_id"]]) for r in held if r["doc_id"] in truth]
    assert sum(a == b for a, b in known) >= 0.98 * len(known)
    assert sum(bool(r["neighbours"]) for r in held) > 0.9 * len(held)


@pytest.mark.parametrize("labels", ["false", "toxic = 1", "toxic = 0"])
def test_labels_of_one_kind_reject_nothing(spark, labels):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet").where(labels)
    assert toxicity.keep_clean(docs, toxicity.train(docs, lab)).count() == docs.count()
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/one-sided-{abs(hash(labels))}"
    lab.write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == docs.count()


def test_toxicity_names_the_telling_term(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(80)}" for _ in range(40)] + (["vile"] if bad else []) + (["rare"] if i % 97 == 0 else [])
        texts.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = docs_of(spark, texts)
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(m.vocabulary) == {"vile", "rare", *(f"w{k}" for k in range(80))}  # every term of two examples
    scorer = toxicity.Scorer(m)
    p, near, cosines, term = scorer("w1 w2 w3 w4 w5 vile")
    assert p > 0.5 and term == "vile" and len(near) == 3 and (np.diff(cosines) <= 0).all()
    assert scorer("w1 w2 w3 w4 w5")[0] < 0.5


# -- SimHash -------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))


def test_simhash(spark, odd):
    got = rows(simhash.near_duplicates(docs_of(spark, odd)))
    by = dict(odd)
    assert len(got) == len(odd)
    fps = {i: brute_fingerprint(t) for i, t in odd}
    for r in got:
        assert r["fp"] & (1 << 64) - 1 == fps[r["doc_id"]]
    ids = [i for i in by if i is not None]
    root = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert all(r["component_id"] == root[r["doc_id"]] for r in got if r["doc_id"] is not None)
    kept = rows(simhash.deduplicated(docs_of(spark, odd)).select("doc_id"))
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None)) == sorted(set(root.values()))
    assert rows(simhash.near_duplicates(docs_of(spark, []))) == []


def test_simhash_links_through_rows_without_an_id(spark, monkeypatch):
    """Two fingerprints 4 bits apart are joined by one between them that only rows without an id have."""
    prints = [(1, 0b1111), (2, 0), (None, 0b11), (None, 0b11), (None, 0x0F0F0F0F0F0F0F0F), (9, 0x5555555555555555)]
    table = spark.createDataFrame(prints, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **how: table)
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in rows(simhash.near_duplicates(table))), key=repr)
    assert got == sorted([(1, 15, 1), (2, 0, 1), (None, 3, 1), (None, 3, 1), (None, 0x0F0F0F0F0F0F0F0F, None), (9, 0x5555555555555555, 9)], key=repr)


@pytest.mark.parametrize("block", [4096, 20])
def test_simhash_links_are_complete(spark, block):
    rng = random.Random(block)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in centres:
        fps |= {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for _ in range(25)}
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    got = brute_components(range(len(fps)), [(r["a"], r["b"]) for r in rows(simhash.links(df, block=block))])
    want = brute_components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == want

def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [4096, 3])
def test_near_copies(spark, odd, block):
    """No group joins what links of similarity 0.8 don't join, equal sets always meet, and few links are missed."""
    rng = random.Random(8)
    tail = " ".join(f"t{i}" for i in range(30))
    texts = list(odd)
    for f in range(25):
        base = [f"f{f}x{rng.randrange(500)}" for _ in range(120)] + tail.split() * (f % 2)
        for k in range(6):
            words = base[: len(base) - rng.randrange(8)]
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append((1000 + 10 * f + k, " ".join(words)))
    by = dict(texts)
    ids = [i for i in by if i is not None]
    sets = {i: brute_shingles(by[i]) for i in ids}
    like = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0)]
    root = brute_components(ids, like)
    got = rows(simhash.near_copies(docs_of(spark, texts), block=block))
    assert len(got) == len(texts)
    found = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert all(root[i] == root[c] and c <= i and found[c] == c for i, c in found.items())
    assert all(found[a] == found[b] for a, b in like if sets[a] == sets[b])
    assert len(like) > 150 and sum(found[a] == found[b] for a, b in like) >= 0.97 * len(like)
    assert len(set(found.values())) < len({brute_fingerprint(by[i]) for i in ids})
    import corpus_pipeline

    kept = rows(corpus_pipeline.drop_copies(spark, docs_of(spark, texts), SF).select("doc_id"))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(found.values()))
    assert rows(simhash.near_copies(docs_of(spark, []))) == []


@pytest.mark.parametrize("block", [7, 4096])
def test_near_copies_find_every_link(spark, block):
    """Long excerpts have other fingerprints than their texts; many share a passage and hold one large group of copies."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for f in range(120):
        words = [f"e{f}x{i}" for i in range(rng.randrange(60, 120))] + passage.split() * (f % 3 == 0)
        texts.append((10 * f, " ".join(words)))
        n = len(words) - 4
        texts.append((10 * f + 1, " ".join(words[: -(-4 * n // 5) + 4])))  # 0.8 or a little more, by length alone
        texts.append((10 * f + 2, " ".join(words[: -(-4 * n // 5) + 3])))  # a little less than 0.8 of the first
    base = [f"b{i}" for i in range(150)]
    for k in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"c{k}x{rng.randrange(10**6)}"
        texts.append((10_000 + k, " ".join(words)))
    by = dict(texts)
    sets = {i: brute_shingles(t) for i, t in by.items()}
    like = [(a, b) for a in by for b in by if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    root = brute_components(list(by), like)
    found = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_copies(docs_of(spark, texts), block=block))}
    assert found == root and len(like) > 500


@pytest.mark.parametrize("small", [2, 1000])
def test_pairs_by_prefix(small):
    """The prefixes of similar sets meet in any order of the members, and the bounds by place drop no similar pair."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, size=rng.integers(1, 60), dtype=np.uint64)
        for _ in range(9):
            kept = base[rng.random(len(base)) < rng.uniform(0.7, 1)]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, size=rng.integers(0, 4), dtype=np.uint64)])))
    sets = [s for s in sets if len(s)]
    joined = rng.integers(0, 40, size=len(sets))
    frequent = np.unique(np.concatenate([s[::3] for s in sets]))
    rank = rng.integers(1, 9, size=len(frequent)).astype(np.int8)
    heads = [simhash.prefix(s, frequent, rank) for s in sets]
    name = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    pos = np.concatenate([np.arange(len(h)) for h in heads])
    group = np.unique(np.concatenate(heads), return_inverse=True)[1]
    n = np.array([len(s) for s in sets])
    got = {(min(p), max(p)) for a, b in simhash._open_pairs(group, n[name], pos, name, joined[name], small) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if joined[a] != joined[b] and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert want <= got and len(want) > 50 and all(joined[a] != joined[b] for a, b in got)


def test_sketches_refute_only():
    """Sketches of any sizes differ in no more bits than the sets in members, and by enough to tell other sets."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 1 << 63, size=4000, dtype=np.uint64))
    sets = [np.sort(rng.permutation(base)[:n]) for n in (0, 1, 5, 60, 70, 250, 300, 1000, 1100, 3900, 4000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, size=len(s) // 10, dtype=np.uint64)])) for s in sets]
    x, y = (z.ravel() for z in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    real = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(x, y, strict=True)])
    for most in (256, simhash.SKETCH, simhash.WIDE):
        found = [simhash.sketch(s, most) for s in sets]
        assert found == [simhash.folded(simhash.sketch(s), most) for s in sets]
        differ = simhash.Sketches(pa.array(found, pa.binary())).differ(x, y)
        assert (differ <= real).all() and (differ[x == y] == 0).all()
        size = np.array([len(s) for s in sets])
        least, greatest = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        other = (9 * real > 3 * (least + greatest)) & (least >= 20) & (5 * least >= 4 * greatest) & (greatest <= most)
        assert other.any() and (9 * differ > size[x] + size[y])[other].all()


def test_open_pairs_of_a_large_group():
    """Sets that share a fifth of their members meet in every one of them: their number of pairs may not be its square."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    shared = np.sort(rng.integers(0, 1 << 63, size=20, dtype=np.uint64))
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, size=80, dtype=np.uint64)])) for _ in range(400)]
    sets += [np.unique(np.concatenate([s[:95], rng.integers(0, 1 << 63, size=4, dtype=np.uint64)])) for s in sets[:50]]
    n, name = np.array([len(s) for s in sets]), np.arange(len(sets))
    nothing = np.zeros(len(sets), np.int64)
    every = sum(len(a) for a, _ in simhash._open_pairs(nothing, n, nothing, name, name))
    pairs = simhash._open_pairs(nothing, n, nothing, name, name, sketches=simhash.Sketches(pa.array([simhash.sketch(s) for s in sets], pa.binary())))
    got = {(min(p), max(p)) for a, b in pairs for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert every == len(sets) * (len(sets) - 1) // 2 and {(k, 400 + k) for k in range(50)} <= got and len(got) < 60


def test_one_of_each(spark, monkeypatch):
    """Whatever the bitmap says of ids besides, the rows of least ids stay once, and all rows without an id."""
    texts = [(None, "x"), (None, "x"), (-1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "b"), (4, "c"), (5, "d"), (5, "d"), (6, "e")]
    found = [(None, None), (None, None), (-1, -1), (1, -1), (2, 2), (2, 2), (3, 2), (4, 4), (5, 5), (5, 5), (6, 6)]
    for marks in (64, 1 << 23):
        monkeypatch.setattr(simhash, "MARKS", marks)
        kept = simhash.one_of_each(docs_of(spark, texts), spark.createDataFrame(found, "doc_id long, component_id long"))
        assert sorted((r["doc_id"] or 0 for r in rows(kept.select("doc_id")))) == [-1, 0, 0, 2, 4, 5, 6]
        assert kept.columns == docs_of(spark, texts).columns


def test_sets_that_meet():
    """Keys of several names are kept whole, whatever the batches; repeated names of a key count once."""
    import pyarrow as pa

    data = [(1, 5, 0), (2, 5, 1), (2, 5, 1), (3, 5, 2), (3, 6, 0), (3, 6, 0), (3, 7, 4), (4, 1, 0), (5, 2, 0), (5, 3, 9)]
    want = [x for x in dict.fromkeys(data) if x[0] in (3, 5)]
    for size in (1, 2, 3, 4, 100):
        pieces = [data[i : i + size] for i in range(0, len(data), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["key", "name", "pos"]) for p in pieces]
        assert [tuple(r.values()) for b in simhash._meeting(iter(batches)) for r in b.to_pylist()] == want
    assert list(simhash._meeting(iter([]))) == []


def test_contracted_edges_connect_the_same(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    table = common.materialize(spark.createDataFrame(edges, "a long, b long"), "test-edges")
    want = brute_components(list(range(300)), edges)
    for size in (1, 37, 1000):
        got = {r["node"]: r["root"] for r in rows(components.components(components.contracted(table, size)))}
        assert {i: got.get(i, i) for i in range(300)} == want
    assert rows(components.contracted(table.where("false"))) == []
    assert components._is_star_forest(components.contracted(table).toDF("u", "v"))


# -- language model ------------------------------------------------------------------------------------------------


def test_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 62, 20000)
    c = np.exp(rng.uniform(0, 8, 20000)).astype(np.int64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(h, c, strict=True)], "h long, c long")
    f = langmodel.build_filter(df, langmodel.Settings(segment_bits=1 << 14))
    q = f.levels(h.view(np.uint64))
    true = langmodel.quantised(c)
    assert (true == np.floor(np.log2(c)).astype(int) + 1).all()
    assert (q >= true).all() and (q == true).mean() > 0.97
    # At full load, which the size keeps whatever the number of entries.
    assert (f.levels(rng.integers(0, 1 << 62, 20000).view(np.uint64)) > 0).mean() < 0.03
    assert f.levels(h.view(np.uint64), true - 1).tolist() == (true - 1).tolist()


def test_long_words_have_hashes_of_their_own():
    """The Thue-Morse word and its complement have one polynomial hash modulo 2^64, whatever the base is."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    other = word.translate({97: "b", 98: "a"})
    a, b, c, d = langmodel.Tokens().hashes(f"{word} {other} {word.upper()} x".encode()).tolist()
    assert a == c and len({a, b, d}) == 3


def test_tokens_are_words_of_any_window():
    texts = [None, b"", b"one", "Ünï A\x1cB ".encode() * 40, b"x" * 500, b"a b\tc\nd\x0be\x0cf\rg", b"Abc aBC abc cba", b" lead and trail "]
    whole, ends = langmodel.Tokens().documents(texts)
    words = [[w.lower() for w in (t or b"").split()] + [b"\xff"] for t in texts]
    assert np.diff(ends, prepend=0).tolist() == [len(w) for w in words]
    names = {}
    for h, w in zip(whole.tolist(), [x for w in words for x in w], strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    for window in (1, 16, 100):
        again = langmodel.Tokens(window).documents(texts)
        assert (again[0] == whole).all() and (again[1] == ends).all()


def test_routed_probes_give_the_scores_of_a_broadcast_filter(spark, odd):
    docs = docs_of(spark, odd)
    whole, parts = (sorted(map(tuple, langmodel.score(docs, settings=langmodel.Settings(max_bits=bits, segment_bits=1 << 12, hot_tokens=hot)).collect()), key=repr) for bits, hot in ((1 << 29, 1 << 18), (1 << 10, 40)))
    plain = lambda found: [(*r[:4], pytest.approx(r[4]), pytest.approx(r[5])) for r in found]  # noqa: E731  sums of parts may differ in the last digit
    assert parts == plain(whole)
    counts = packing.materialize(langmodel.ngram_counts(docs), "test-ngrams")
    totals = langmodel.Totals.of(counts)
    built = langmodel.build_filter(counts, langmodel.Settings(segment_bits=1 << 12))
    assert built.segments > 4
    have = counts.toPandas()
    assert (built.levels(have["h"].to_numpy().view("uint64")) >= langmodel.quantised(have["c"])).all()
    # Quantised counts are renormalised: the unigram probabilities sum to 1 within 1 %.
    own = have["h"].to_numpy() & 1 == 0
    level = built.levels(have["h"].to_numpy()[own].view("uint64"))
    assert ((totals.means[0][level] + 1).sum() + 1) / (totals.tokens + totals.vocabulary + 1) == pytest.approx(1, abs=0.01)


def test_lm_scores_are_those_of_a_model_without_a_filter(spark, odd):
    """With so many bits an entry that no probe errs, each score is that of exact counts, quantised by hand."""
    settings = langmodel.Settings(bits_per_entry=400, hot_tokens=7)
    got = rows(langmodel.score(docs_of(spark, odd), settings=settings))
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    low = lambda t: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), "\n"]
    one, two, texts = Counter(), Counter(), 0
    for i, t in odd:
        if i is not None and fold(i) != 2:
            words = low(t)
            one.update(words)
            two.update(zip(["<s>", *words], words))
            texts += 1
    level = lambda c: c.bit_length()

    def means(counts):
        by = defaultdict(list)
        for c in counts.values():
            by[level(c)].append(c)
        return {0: 0, **{q: sum(c) / len(c) for q, c in by.items()}}

    of_one, of_two = means(one), means(two)
    start = of_one.get(level(texts), (1.5 * 2 ** level(texts) - 1) / 2)
    want = defaultdict(list)
    for i, t in odd:
        words, total = low(t), 0.0
        for h, w in zip(["<s>", *words], words):
            own, seen = of_one[level(one[w])], start if h == "<s>" else of_one[level(one[h])]
            cap = min(level(one[w]), level(texts) if h == "<s>" else level(one[h]))
            pair = min(of_two.get(min(level(two[h, w]), cap), 0), own, seen)
            total += math.log10((pair + settings.mu * (own + 1) / (sum(one.values()) + len(one) + 1)) / (seen + settings.mu))
        want[i].append(total)
    for r in got:
        assert any(r["score"] == pytest.approx(x, rel=1e-9) for x in want[r["doc_id"]]), r


@pytest.mark.parametrize("hot", [1 << 18, 5])
def test_lm_base_scores_are_exact(spark, odd, hot):
    got = rows(langmodel.score(docs_of(spark, odd), settings=langmodel.Settings(hot_tokens=hot)))
    assert len(got) == len(odd)
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    count = Counter(w for i, t in odd if i is not None and fold(i) != 2 for w in [*WORD.findall(low(t)), "\n"])
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for i, t in odd:
        tokens = [*WORD.findall(low(t)), "\n"]
        want[i].append((len(tokens), sum(count[w] > 0 for w in tokens), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)))
    for r in got:
        assert any((r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3], rel=1e-9) for w in want[r["doc_id"]]), r
        assert r["score"] < 0 or r["n_tokens"] == 1
    assert len(rows(langmodel.score(docs_of(spark, odd), train="false"))) == len(odd)
    assert rows(langmodel.score(docs_of(spark, []))) == []


# -- chat ----------------------------------------------------------------------------------------------------------


def test_escape_is_reversible():
    pieces = ["<|end|>", "<\\|end|>", "<", "|", "\\", "[INST]", "[\\/INST]", "</s>", "<\\\\/s>", "[", "x", "<<SYS>>", "<|turn|>", "<|body|"]
    rng = random.Random(0)
    for _ in range(5000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(t)) == t
        assert not re.search(r"<\|(turn|body|end)\|>|\[/?INST\]|</?s>", chat.escape(t))


@pytest.mark.parametrize("part_tokens", [1 << 16, 20])
def test_chat_round_trip(spark, part_tokens):
    given = [(1, 1, "assistant", "Hello <|end|> [INST]"), (1, 0, "user", "hi\nthere"), (2, 0, "system", ""), (2, 1, None, None), (2, 2, "assistant", None), (2, 3, "assistant", "漢字 \U0001f600 é"), (3, None, "we<|turn|>ird", "x" * 5000), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (None, 0, "user", "q"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*g, 9, 9) for g in given], "conv_id long, turn long, role string, text string, part int, ids int")
    parts = chat.format_chats(df, queries.tokenizer(), part_tokens=part_tokens)
    got = {r["conv_id"]: r for r in rows(chat.read_back(parts, queries.tokenizer()))}
    by = defaultdict(list)
    for c, t, r, x in sorted(given, key=lambda g: (g[0] is not None, g[0] or 0, g[1] is not None, g[1] or 0, g[2] is not None, g[2] or "", g[3] is not None, g[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        marks = sum(map(len, chat.MARKS))
        assert got[c]["formatted_chars"] == sum(len(chat.escape(r)) + len(chat.escape(x)) + marks for r, x in turns)
    assert rows(chat.read_back(chat.format_chats(df.where("false"), queries.tokenizer()), queries.tokenizer())) == []


# -- sharding ------------------------------------------------------------------------------------------------------


def test_sharding(spark, odd):
    got = rows(sharding.shard(docs_of(spark, odd), shards=4, seed=1))
    assert sorted(r["position"] for r in got) == list(range(len(odd))) == sorted(r["row_number"] for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        texts = [(t or "").encode() for i, t in odd if i == r["doc_id"]]
        assert (r["size"], r["text_crc32"]) in [(len(t) + 1, zlib.crc32(t)) for t in texts]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = rows(sharding.shard(docs_of(spark, odd[::-1]).repartition(3), shards=4, seed=1))
    key = lambda rs: sorted((str(r["doc_id"]), r["position"]) for r in rs)
    assert [p for _, p in key(got)] == [p for _, p in key(again)] and key(got) != key(rows(sharding.shard(docs_of(spark, odd), shards=4, seed=2)))
    assert rows(sharding.shard(docs_of(spark, []))) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 12345])
def test_feistel_is_a_permutation(spark, n):
    p = [r[0] for r in sharding.permuted(spark.range(n), "id", n, seed=n).select("position").collect()]
    assert sorted(p) == list(range(n))
    a, b = sharding.sides(n)
    assert a * b >= n and a * b - n < max(a, 1)


# -- mixing --------------------------------------------------------------------------------------------------------


def fluid_shares(blocks, weights, t):
    """Blocks that a fluid server has served of each source after t slots."""
    left, done, now = dict(blocks), {s: 0.0 for s in blocks}, 0.0
    while now < t - 1e-12 and left:
        w = sum(weights[s] for s in left)
        step = min(min((left[s] * w / weights[s] for s in left)), t - now)
        for s in list(left):
            x = step * weights[s] / w
            done[s] += x
            left[s] -= x
            if left[s] < 1e-9:
                del left[s]
        now += step
    return done


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 1.0, "c": 2.0, "d": 2.0}])
def test_mixing(spark, weights):
    sizes = {"a": 90, "b": 31, "c": 17, "d": 2, None: 1}
    texts, sources = [], {}
    for s, n in sizes.items():
        for _ in range(n):
            sources[len(texts)] = s
            texts.append((len(texts), "t"))
    got = rows(mixing.mix(docs_of(spark, texts, sources), weights=weights, max_blocks=60))
    n, per = len(texts), 3
    assert sorted(r["position"] for r in got) == list(range(n))
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    w = {s: max((weights or {}).get(s, 0.0), 1e-12) if weights else sizes[s] ** 0.5 for s in sizes}
    blocks = {s: -(-k // per) for s, k in sizes.items()}
    by_slot = {r["slot"]: r["source"] for r in got}
    assert sorted(by_slot) == list(range(sum(blocks.values())))
    served = Counter()
    for t in range(len(by_slot)):
        served[by_slot[t]] += 1
        share = fluid_shares(blocks, w, t + 1)
        assert all(abs(served[s] - share[s]) < 1 + 1e-5 for s in blocks), t
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert [r["slot"] for r in sorted(got, key=lambda r: r["position"])] == sorted(r["slot"] for r in got)
    few = rows(mixing.mix(docs_of(spark, texts, sources), max_blocks=60, max_sources=2))
    assert sorted(r["position"] for r in few) == list(range(n))
    assert rows(mixing.mix(docs_of(spark, []))) == []


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "s3": 4.0, "s17": 2.0, "s39": 9.0}])
def test_mixing_of_many_sources_is_the_same_schedule(spark, weights):
    rng = random.Random(6)
    names = ["a"] * 80 + [None] * 5 + [f"s{rng.randrange(40)}" for _ in range(240)]
    docs = docs_of(spark, [(i, "t") for i in range(len(names))], dict(enumerate(names)))
    made = ["doc_id", "queue", "block", "release", "deadline", "slot", "position"]
    own, many = (sorted(map(tuple, mixing.mix(docs, weights=weights, max_blocks=100, max_sources=m).select(made).collect())) for m in (512, 3))
    assert many == own


def test_mixing_takes_thousands_of_weights(spark):
    """As many explicit weights as sources: a permutation, and no source a block off its fluid share."""
    rng = random.Random(3)
    n = 3000
    names = [f"s{k}" for k in range(n)] + [f"s{rng.randrange(40)}" for _ in range(500)]
    weights = {f"s{k}": float(rng.choice([1, 2, 3, 8])) for k in range(n)}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "doc_id long, source string")
    got = rows(mixing.mix(docs, weights=weights, max_blocks=4000))
    assert sorted(r["position"] for r in got) == list(range(len(names)))
    blocks = dict(Counter(names))
    by_slot = {r["slot"]: r["source"] for r in got}
    served = Counter()
    for t in range(len(by_slot)):
        served[by_slot[t]] += 1
        if t % 400 == 7:
            share = fluid_shares(blocks, weights, t + 1)
            assert all(abs(served[s] - share[s]) < 1 + 1e-5 for s in blocks), t
    one = rows(mixing.mix(docs.where("source in ('s0', 's1')"), weights={None: 1.0, **weights}))
    assert sorted(r["position"] for r in one) == list(range(len(one)))


# -- packing -------------------------------------------------------------------------------------------------------


def naive_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= s]
        if fits:
            left, i = min(fits)
            bins[i] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_rules_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    sizes = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.choice([1, 50, 800]))]
    left, ends = defaultdict(lambda: capacity), defaultdict(list)
    count = Counter()
    for size, rank0, n, first, each, off in packing.best_fit_decreasing(dict(Counter(sizes)), capacity):
        assert rank0 == count[size]
        count[size] += n
        for r in range(n):
            left[first + r // each] -= size
            ends[first + r // each].append((off + r % each * size, size))
    assert count == Counter(sizes)
    assert sorted(left.values()) == naive_best_fit(sizes, capacity)
    assert sorted(left) == list(range(len(left)))
    for places in ends.values():
        at = 0
        for o, s in sorted(places):
            assert o == at
            at += s


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    got = rows(packing.pack_documents(docs_of(spark, odd), queries.tokenizer(), capacity=128, end_id=2))
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, text in {i: x for i, x in odd}.items():
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[i], key=lambda r: r["piece"])
        if sum(j == i for j, _ in odd) > 1:
            pieces = pieces[::2]
        ids = [x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == want, i
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1].tolist()]
        assert all(r["length"] == 128 for r in pieces[1:]) and len(pieces) == -(-len(want) // 128)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 128
    assert sorted(128 - sum(n for _, n in p) for p in seqs.values()) == naive_best_fit([r["length"] for r in got], 128)
    assert rows(packing.pack_documents(docs_of(spark, []), queries.tokenizer())) == []


def test_cached_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(queries.tokenizer()), packing.CachedEncoder(queries.tokenizer(), bound=50)
    t.encode_special_tokens = True
    rng = random.Random(8)
    pieces = [" ", "  ", "\n", "\t", "\r\n", "\xa0", " ", "\x1c", "\x85", "word", "Word's", "'ll", "12", "½", ".", "...", "漢字", "é", "\U0001f600", "<|endoftext|>", "_", "á", "​", "﻿"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(e) <= 50


def test_gzip_members_are_standard():
    raw = warc.record(1, "http://x", b"abc", warc.digest(b"abc"), None, "1970-01-01T00:00:00Z")
    assert warc.parse(gzip.decompress(gzip.compress(raw)))[6] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


# -- pipeline and registration -------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in rows(docs.select("doc_id"))}
        out = stage(spark, docs, SF)
        assert out.columns == every.columns, name
        after = {r["doc_id"] for r in rows(out.select("doc_id"))}
        if name == "toxicity":
            want = {r["doc_id"] for r in rows(toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))) if not r["predicted"]}
        elif name == "quality_rules":
            want = {r["doc_id"] for r in rows(quality.assess(docs)) if r["kept"]}
        elif name == "simhash_dedup":
            want = {r["component_id"] for r in rows(simhash.near_copies(docs))}
            # Of the pairs of similarity 0.8 or more, found by brute force, all but a few are in one group.
            sets = {r["doc_id"]: brute_shingles(r["text"]) for r in rows(docs)}
            group = {r["doc_id"]: r["component_id"] for r in rows(simhash.near_copies(docs))}
            like = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0]
            assert sum(group[a] == group[b] for a, b in like) >= 0.95 * len(like) > 0
        else:
            want = before
        assert after == want, name
        docs = packing.materialize(out, "test-stage")
    packed = rows(corpus_pipeline.run(spark, SF))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows(docs.select("doc_id"))}
    empty = every.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_stages_take_awkward_rows(spark, odd):
    """Null texts, ids and sources, repeated rows and other columns, through every stage on its own."""
    import corpus_pipeline

    docs = packing.materialize(docs_of(spark, odd, {5: None, 9: "other"}), "test-odd")
    every = Counter(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept = Counter((r["doc_id"], r["text"]) for r in rows(out))
        assert not kept - every, name
        if name in ("toxicity", "pfair_mixing"):
            assert kept == every, name
        elif name == "quality_rules":
            assert (1, None) not in kept and (2, "") not in kept and kept[6, odd[5][1]] in (0, 2) and kept
        else:
            assert (1, None) in kept and (2, "") not in kept and kept[6, odd[5][1]] == 1 and sum(n for (i, _), n in kept.items() if i is None) == 1
    mixed = packing.materialize(corpus_pipeline.mix_sources(spark, docs, SF), "test-mixed")
    packed = rows(corpus_pipeline.pack_sequences(spark, mixed, SF))
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(i for i, _ in odd)


def test_pipeline_packs_in_mixed_order(spark, monkeypatch):
    import corpus_pipeline

    docs = docs_of(spark, [(i, "some words " * (1 + i % 40)) for i in range(300)], {i: "abc"[i % 3] for i in range(300)}).select(*corpus_pipeline.COLUMNS)
    mix, results = mixing.mix, []
    for weights in ({"a": 9.0, "b": 1.0, "c": 1.0}, {"a": 1.0, "b": 1.0, "c": 9.0}):
        monkeypatch.setattr(mixing, "mix", lambda d, alpha, weights=weights: mix(d, weights=weights))
        place = {r["doc_id"]: r["position"] for r in rows(mix(docs, weights=weights))}
        mixed = packing.materialize(corpus_pipeline.mix_sources(spark, docs, SF), "test-mixed")
        ordered = rows(packing.file_order(mixed, "position").select("doc_id", "position"))
        assert {r["doc_id"]: r["position"] for r in ordered} == place
        packed = rows(corpus_pipeline.pack_sequences(spark, mixed, SF))
        assert len(packed) == 300
        first, filled = {}, Counter()
        for r in packed:
            first[r["sequence_id"]] = min(first.get(r["sequence_id"], 1 << 60), place[r["doc_id"]])
            filled[r["sequence_id"]] += r["length"]
        assert sorted(first) == list(range(len(first))) and max(filled.values()) <= 1024
        assert [first[k] for k in sorted(first)] == sorted(first.values())
        for length in {r["length"] for r in packed}:
            assert len({(r["sequence_id"], r["offset"]) for r in packed if r["length"] == length}) == sum(r["length"] == length for r in packed)
        results.append({(r["doc_id"], r["sequence_id"], r["offset"]) for r in packed})
    assert results[0] != results[1]


def test_mixing_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.oracle_sql()["op9_pfair_mixing"])
    names = [d[0] for d in cur.description]
    got = queries.op9_pfair_mixing(spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())


def test_range_join_takes_double_vectors(spark):
    vecs = [(1, [1.0, 0.0], 1), (2, [1.0, 1e-12], 1), (3, [0.0, 1.0], 1)]
    got = rows(rangejoin.near_duplicates(spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int")))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names


def test_schemas_are_plain(spark):
    for name in ("op2_warc_index", "op3_embedding_range_join", "op7_chat_tokens", "op8_feistel_sharding", "op9_pfair_mixing"):
        df = queries.queries()[name](spark, SF)
        assert not any(isinstance(f.dataType, T.NullType) for f in df.schema.fields)
        assert df.select(F.count("*")).first()[0] > 0


def test_ranked_shuffles_whole_rows_once(spark):
    """The starts of slots are joined where the rows already are."""
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        table = spark.range(100).select(F.coalesce(F.col("id") % 3, F.lit(0)).alias("queue"), "id", F.lit("x").alias("text"))
        out = common.ranked(table, ["queue"], [F.col("id")], F.xxhash64("id"), 4, "rank")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {q: sorted(r["rank"] for r in out.where(f"queue = {q}").collect()) for q in range(3)}
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
    assert got == {q: list(range(34 if q == 0 else 33)) for q in range(3)}
    # The rows once, and the small table of starts by slot, by group and by slot again.
    assert plan.count("Exchange hashpartitioning") == 4
