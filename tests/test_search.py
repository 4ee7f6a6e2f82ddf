"""The stored index, stems, many questions and exact thresholds against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from concordia.functions import english
from concordia.operators import confidence, index, retrieval
from concordia.operators.index import Index
from concordia.sources.folders import checkpoint_folder

# Published pairs of words and stems.
STEMS = """consigned consign consignment consign consistency consist consolations consol consolatory consolatori consolingly consol consonant conson
conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneaded knead
knightly knight knives knive knocker knocker knitting knit generate generat generally general generically generic generously generous community communiti
hopping hop hoping hope ties tie cries cri gas gas kiwis kiwi happily happili say say cry cri by by relational relat conditional condit rational ration
digitizer digit hopefulness hope controlling control rolling roll early earli dying die news news proceeds proceed formative format sensational sensat
replacement replac homologous homolog communism communism activate activ effective effect skies sky only onli herring herring""".split()


def test_stems():
    for word, stem in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert english.stem(word) == stem, word


def test_lexemes(spark):
    texts = [None, "", "The cats' toys and THE cat’s toy", "Überprüfung 漢字 naïve", "word " * 5000, "and the of"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(english.lexemes("t"), "i").orderBy("i").collect()]
    assert got[0] is None and got[1] == [] and got[5] == []
    assert [(r["term"], r["positions"]) for r in got[2]] == [("cat", [2, 6]), ("toy", [3, 7])]
    assert {r["term"] for r in got[3]} == {"überprüfung", "漢字", "naïv"}
    assert got[4][0]["positions"] == list(range(1, 5001))
    assert english.STOP_WORDS >= {"the", "and"} and len(english.STOP_WORDS) > 100


def rank_of(text, own):
    at = defaultdict(list)
    for i, w in enumerate(re.findall("[0-9a-z]+", text.lower()), 1):
        at[w].append(i)
    s = sum(np.log1p(len(at[w])) for w in set(own) if w in at)
    return s + sum(1 / max(1, min(abs(x - y) for x in at[a] for y in at[b])) for a, b in zip(own, own[1:]) if a in at and b in at)


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    weights = [40 / (i + 1) for i in range(40)]
    return {f"c{i:04d}": " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60))) for i in range(400)}


@pytest.mark.parametrize("score,kind", [("share", "tokens"), ("jaccard", "tokens"), ("rank", "words")])
def test_index_search_is_exact(spark, chunks, monkeypatch, score, kind):
    monkeypatch.setattr(index, "WAVE", 2)
    rows = [*chunks.items(), ("empty", ""), ("null", None), (None, "w1 w2")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "chunk_id string, chunk_text string, term string, id string")
    ix = Index(spark, checkpoint_folder(spark), kind, block=16)
    assert ix.search("w1", 3).collect() == []
    ix.append(df)
    for query in ("w30 w31 w32 w32 nothing", "w0 w39", ""):
        own = list(dict.fromkeys(re.findall("[0-9a-z]+", query)))
        want = []
        for i, t in chunks.items():
            have = set(t.split())
            both = len(have & set(own))
            if both:
                sim = {"share": both / len(own), "jaccard": both / len(have | set(own)), "rank": rank_of(t, own)}[score]
                want.append((-round(float(sim), 6), i))
        got = [(-r["sim"], r["id"]) for r in ix.search(query, 7, score=score).collect()]
        assert [i for _, i in got] == [i for _, i in sorted(want)[:7]]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in sorted(want)[:7]], abs=2e-6)


def test_index_is_appended_replaced_and_compacted(spark, chunks):
    items = list(chunks.items())
    df = lambda rows: spark.createDataFrame(rows, "chunk_id string, chunk_text string")
    found = lambda ix, q: {r["id"]: r["size"] for r in ix.matches(q).collect()}
    size = lambda rows, q: {i: len(set(t.split())) for i, t in rows if q in t.split()}
    ix = Index(spark, checkpoint_folder(spark), "tokens", block=32)
    ix.append(df(items[:300]))
    files = lambda: {(r[0], r[1]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{ix.folder}/postings").select("path", "modificationTime").collect()}
    before = files()
    ix.append(df(items[300:]))
    assert before < files()  # earlier segments stay as they are
    assert found(ix, "w3") == size(items, "w3")
    new = {i: "w3 unheard" for i, _ in items[:50]}
    ix.append(df(list(new.items())), upsert=True)
    ix.remove(df(items[50:60]))
    now = [(i, new.get(i, t)) for i, t in items if i not in dict(items[50:60])]
    assert found(ix, "w3") == size(now, "w3") and len(found(ix, "unheard")) == 50
    # A writer that fails before its last step leaves nothing that is seen.
    ix._write(df([("lost", "w3")]).selectExpr("chunk_id AS id", "1 AS size", "'w3' AS term", "cast(null AS array<int>) AS positions"), 77, 1)
    assert "lost" not in found(ix, "w3")
    ix.compact()
    assert found(ix, "w3") == size(now, "w3") and len(ix.segments()) == 1
    ix.append(df([("c0001", "w3 again")]), upsert=True)
    assert found(ix, "again") == {"c0001": 2} and found(ix, "w3")["c0001"] == 2


def test_index_reads_its_terms_buckets_alone(spark, chunks):
    ix = Index(spark, checkpoint_folder(spark), "tokens")
    ix.append(spark.createDataFrame(list(chunks.items()), "chunk_id string, chunk_text string"))
    plan = ix._rows(["w7"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#", plan) and re.search(r"PushedFilters: \[.*term", plan)
    assert len({r[0] for r in ix._rows(["w7"]).selectExpr("input_file_name()").collect()}) == 1


@pytest.mark.parametrize("block", [4096, 3])
def test_many_questions(spark, block):
    rng = np.random.default_rng(5)
    vectors = [(f"v{i}", rng.normal(size=6).round(1).tolist()) for i in range(300)]
    vectors += [("twin", vectors[3][1]), ("zero", [0.0] * 6), ("null", None), ("hole", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("nan", [float("nan")] * 6), ("short", [1.0, 2.0]), (None, vectors[3][1])]
    asked = [(k, v) for k, (_, v) in enumerate(vectors[:11])] + [(90, None), (91, [0.0] * 6), (92, [3.0, 1.0]), (93, [1.0])]
    c = spark.createDataFrame([(i, v, 1.0) for i, v in vectors], "chunk_id string, embedding array<double>, sim double").repartition(4)
    q = spark.createDataFrame(asked, "question long, embedding array<double>")
    got = defaultdict(list)
    for r in retrieval.top_k_each(c, q, 5, block=block).collect():
        got[r["question"]].append((-r["sim"], r["id"]))
    good = lambda v: v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    for k, v in asked:
        own = []
        if good(v):
            for i, x in vectors:
                if i is not None and good(x) and len(x) == len(v):
                    own.append((-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 6), i))
        assert [i for _, i in sorted(got[k])] == [i for _, i in sorted(own)[:5]]
    assert retrieval.top_k_each(c.where("false"), q, 5).collect() == [] == retrieval.top_k_each(c, q.where("false"), 5).collect()


@pytest.mark.parametrize("slots", [2, 256])
def test_thresholds_are_exact(spark, slots):
    rng = random.Random(slots)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5, 0.25, rng.random()]), rng.random() < 0.8) for _ in range(500)]
    rows += [("a", None, True), ("only null", None, True), ("never", 0.4, False), ("open", 0.7, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "tier string, score double, correct boolean, n int")
    curve = {(r["tier"], r["score"]): (r["n"], r["precision"], r["coverage"]) for r in confidence.risk_coverage(df, ["tier"], slots).collect()}
    want, taus = {}, {}
    for tier in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tier]
        for s in sorted({r[1] for r in own if r[1] is not None}, reverse=True):
            above = [r for r in own if r[1] is not None and r[1] >= s]
            precision = sum(bool(r[2]) for r in above) / len(above)
            want[tier, s] = (len(above), pytest.approx(precision), pytest.approx(len(above) / len(own)))
            if precision >= 0.8:
                taus[tier] = (s, pytest.approx(len(above) / len(own)))
    assert curve == want
    assert {r["tier"]: (r["threshold"], r["coverage"]) for r in confidence.thresholds(df, ["tier"], 0.8, slots).collect()} == taus
    assert confidence.thresholds(df.where("false"), ["tier"], 0.8).collect() == []


def test_terms_of_long_texts_are_not_all_held_as_objects():
    """A batch of long texts is located in pieces: positions wait as Arrow integers, not as Python objects."""
    import random
    import tracemalloc

    import pyarrow as pa
    from concordia.functions import english

    rng = random.Random(1)
    one = " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000))
    texts = pa.array([one] * 40 + [None, ""])
    tracemalloc.start()
    got = english._simple.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    first = {r["term"]: r["positions"] for r in got[0].as_py()}
    assert [t for t, _ in sorted(((t, p) for t, ps in first.items() for p in ps), key=lambda x: x[1])] == one.split()
    assert got[0] == got[39] and got[40].as_py() is None and got[41].as_py() == []
