"""Cases of the operators: verdicts, severity, identity, guards, chains, chunks, sinks and streams."""

import datetime as dt
import io
import zipfile

import pytest
from concordia.functions import text, values
from concordia.operators import audit, claims, confidence, conflicts, documents, identity, jobs, retrieval, security
from concordia.plans import policy, schema
from concordia.plans.jobs import run as run_stages
from concordia.sources import sinks
from concordia.streaming import streams
from pyspark.sql import functions as F

BASE = {"document_id": "d", "component_category": "pv", "supplier": "s", "model": "m", "nameplate": None, "field_name": "nameplate_power", "extractor_version": "v1", "condition": None, "value": None, "unit": None, "verbatim_value": None, "source_tier": "system_of_record", "source_ref": None, "confidence": 0.9, "extracted_at": None}


def value(v):
    if v is None:
        return None
    out = dict.fromkeys(("kind", "num", "is_int", "txt", "flag", "items", "entries", "band", "canon"))
    if isinstance(v, bool):
        return out | {"kind": "flag", "flag": v, "canon": repr(v)}
    if isinstance(v, int | float):
        return out | {"kind": "num", "num": float(v), "is_int": isinstance(v, int), "canon": repr(v)}
    if isinstance(v, list):
        return out | {"kind": "list", "items": v, "canon": repr(v)}
    return out | {"kind": "text", "txt": v, "canon": repr(v)}


def claim(v, **more):
    tier = more.get("source_tier", "system_of_record")
    doc = more.pop("doc", "d" if tier == "system_of_record" else None)
    url = more.pop("url", None if doc else "http://x")
    authority = more.pop("authority", None)
    cond = dict.fromkeys((*schema.DIMENSIONS, "note", "derived")) | more.pop("cond", {})
    ref = dict.fromkeys(("document_id", "page", "section", "extractor_version", "bounding_box", "url", "page_title", "retrieved_at", "source_authority")) | {"document_id": doc, "url": url, "source_authority": authority}
    return BASE | {"document_id": doc, "value": value(v), "condition": cond, "source_ref": ref} | more


def frame(spark, rows):
    order = list(BASE)
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema.CLAIM)


WEB = {"source_tier": "web_supplement"}
V = "verbatim_value"
VERDICTS = [
    ("nameplate_power", (650, {}), (650.0, {}), False, None),
    ("nameplate_power", (650, {}), (651.0, {}), False, None),
    ("nameplate_power", (650, {}), (651.01, {}), True, "intra_document"),
    ("nameplate_power", (650, {}), (655, {}), True, "intra_document"),
    ("temp_coeff_pmax", (-0.29, {V: "-0.29 %/degC"}), (-0.294, {}), False, None),
    ("temp_coeff_pmax", (-0.29, {}), (-0.33, {}), True, "intra_document"),
    ("max_system_voltage", (1500, {}), (1500.0, {}), False, None),
    ("max_system_voltage", (1000, {}), (1500, {}), True, "intra_document"),
    ("module_efficiency", (22.0, {V: "22"}), (22.4, {}), False, None),
    ("module_efficiency", (22.0, {V: "22.0"}), (22.4, {}), True, "intra_document"),
    ("rated_ac_power", (100.0, {}), (101.005, {}), False, None),
    ("rated_ac_power", (100.0, {}), (101.02, {}), True, "intra_document"),
    ("no_load_loss", (5000, {}), (3000, WEB), False, None),
    ("no_load_loss", (5000, {}), (5700, WEB), False, None),
    ("no_load_loss", (5000, {}), (5800, WEB), True, "record_vs_web"),
    ("no_load_loss", (100, {V: "100 kW"}), (109, {"doc": "e"}), True, "inter_document"),
    ("no_load_loss", (100, {V: "100"}), (100.4, {}), False, None),
    ("no_load_loss", (100.0, {V: "100.0"}), (100.4, {}), True, "intra_document"),
    ("impedance_percent", (9.0, {}), (9.89, {}), False, None),
    ("impedance_percent", (10.0, {}), (10.9, {}), True, "intra_document"),
    ("cec_efficiency", (96.0, {"authority": "CEC list"}), (96.25, {}), False, None),
    ("cec_efficiency", (96.0, {}), (96.25, {}), True, "intra_document"),
    ("certifications", ("IEC 61215", {}), ("IEC 61730", {}), True, "intra_document"),
    ("certifications", ("IEC 61215", {}), (" iec  61215", {}), False, None),
    ("certifications", ("IEC 61215:2021", {}), ("IEC 61215 : 2016", {}), True, "temporal"),
    ("certifications", ("IEC 61215:2021", {}), ("IEC 61215", {}), False, None),
    ("certifications", ("ﬁre", {}), ("fire", {}), False, None),
    ("standards", (["a", "b"], {}), (["b", "a"], {}), True, "intra_document"),
    ("standards", (["a"], {}), (["a"], {"doc": "e"}), False, None),
    ("standards", (True, {}), (1, {}), True, "intra_document"),
    ("nameplate_power", (None, {}), (5, {}), False, None),
    ("nameplate_power", (650, {"unit": "W"}), (650, {"unit": "Wp"}), True, "unit_normalization"),
    ("nameplate_power", (650, {"unit": " w"}), (650, {"unit": "W "}), False, None),
    ("power_tolerance", (650, {}), (650.4, {}), False, None),
    ("power_tolerance", (650, {}), (700, {}), True, "intra_document"),
]


def test_verdicts(spark):
    rows = []
    for i, (field, (a, ma), (b, mb), _, _) in enumerate(VERDICTS):
        rows += [claim(a, field_name=field, model=str(i), **ma), claim(b, field_name=field, model=str(i), **mb, extractor_version="v2")]
    got = {int(r["model"]): (r["conflicts"], r["conflict_class"]) for r in conflicts.detect(frame(spark, rows)).collect()}
    want = {i: (c, k) for i, (*_, c, k) in enumerate(VERDICTS)}
    assert {i: (VERDICTS[i], got.get(i)) for i in want if got.get(i) != want[i]} == {}


def test_declared_bands(spark):
    band = "struct<low:double,high:double,kind:string,unit:string>"
    cases = [(650.0, (0.0, 10.0, "absolute"), 655.0, (0.0, 10.0, "absolute"), True), (647.0, None, 650.0, (0.0, 5.0, "absolute"), False), (653.0, None, 650.0, (0.0, 5.0, "absolute"), True), (650.0, (0.0, 5.0, "absolute"), 656.0, None, False), (650.0, (0.0, 5.0, "absolute"), 652.0, (0.0, 3.0, "relative"), True), (650.0, (0.0, 5.0, "absolute"), 700.0, (0.0, 3.0, "relative"), False)]
    df = spark.createDataFrame([(i, a, (*x, "W") if x else None, b, (*y, "W") if y else None) for i, (a, x, b, y, _) in enumerate(cases)], f"i int, a double, x {band}, b double, y {band}")
    (al, ah), (bl, bh) = conflicts.resolve_band(F.col("a"), F.col("x")), conflicts.resolve_band(F.col("b"), F.col("y"))
    got = [r["ok"] for r in df.select("i", ((al <= bh) & (bl <= ah)).alias("ok")).orderBy("i").collect()]
    assert got == [c[-1] for c in cases]
    one = spark.range(1).select(*conflicts.resolve_band(F.lit(-0.29), F.struct(F.lit(-3.0).alias("low"), F.lit(3.0).alias("high"), F.lit("relative").alias("kind")))).first()
    assert one[0] == pytest.approx(-0.2987) and one[1] == pytest.approx(-0.2813)
    # A band that stands on another field of the document qualifies the value.
    rows = [claim(650, field_name="power_tolerance"), claim(655, field_name="power_tolerance", doc="e")]
    bands = spark.createDataFrame([("pv", "s", "m", "d", "power_tolerance", (0.0, 10.0, "absolute", "W"))], f"component_category string, supplier string, model string, document_id string, field_name string, band {band}")
    assert not conflicts.detect(frame(spark, rows), bands=bands).first()["conflicts"]


PAIRS = [
    ([(650, {}), (700, {"basis": "stc"}), (645, {"basis": "stc"})], 3),
    ([(650, {"basis": "stc"}), (700, {"basis": "stc", "temperature_c": 25.0})], 1),
    ([(352, {"temperature_c": 30.0}), (320.865, {"temperature_c": 40.0})], 0),
    ([(650, {})], 0),
]


def test_pairs(spark):
    for members, n in PAIRS:
        rows = [claim(v, cond=c, extractor_version=str(i)) for i, (v, c) in enumerate(members)]
        for order in (rows, rows[::-1]):
            ready = conflicts.prepare(frame(spark, order))
            assert conflicts.comparison_pairs(ready).count() == n
    assert conflicts.comparison_groups(conflicts.prepare(frame(spark, [claim(1), claim(2), claim(3, cond={"basis": "stc"})]))).count() == 2


def test_golden_fixtures(spark):
    trio = [claim(v, field_name="rated_ac_power", unit="kVA", cond={"temperature_c": t}) for v, t in ((352, 30.0), (320, 40.0), (295, 50.0))]
    df = frame(spark, trio)
    assert conflicts.detect(df).isEmpty()
    fields = claims.project(df).collect()
    assert len(fields) == 3 and {r["conflict_status"] for r in fields} == {"none"}
    pair = [claim(650, unit="Wp", confidence=0.97), claim(655, unit="Wp", confidence=0.88, **WEB)]
    found = conflicts.detect(frame(spark, pair), carry=conflicts.QUEUED)
    r = found.first()
    assert (r["conflicts"], r["conflict_class"], r["severity"]) == (True, "record_vs_web", 2)
    q = conflicts.queue(found, F.lit("2024-01-01").cast("timestamp"))
    assert q.count() == 1 and conflicts.blocking(q, 2).isEmpty() and conflicts.blocking(q, 1).count() == 1
    assert conflicts.gate_blocks(q, 1).first()["blocks"] and conflicts.manifest(q).count() == 1
    assert conflicts.ageing(q, F.lit("2024-01-02").cast("timestamp")).first()["age_seconds"] == 86400


SEVERITIES = [
    ("nameplate_power", [(650, {}), (651.5, {})], 2),
    ("nameplate_power", [(650, {}), (6.5, {})], 3),
    ("nameplate_power", [(650, {}), (660, {})], 3),
    ("nameplate_power", [(650.0, {}), (659.9, {})], 2),
    ("rated_ac_power", [(10000, {}), (10150, {})], 2),
    ("nameplate_power", [(650, {}), (652, {"doc": "e"})], 3),
    ("nameplate_power", [(650, {}), (652, WEB)], 2),
    ("price_per_watt_dc", [(0.35, {}), (35.0, {})], 4),
    ("warranty_years", [(25, {}), (30, {})], 3),
    ("warranty_years", [(2.5, {}), (25.0, {})], 4),
    ("warranty_years", [(2.5, {}), (24.75, {})], 3),
    ("max_system_voltage", [(0, {}), (55, {})], 1),
    ("max_system_voltage", [(-55, {}), (55, {})], 1),
    ("certifications", [("a", {}), ("b", {})], 4),
    ("unheard_of", [(1, {}), (5, {})], 4),
    ("rated_ac_power", [(1, {"unit": "MW"}), (1000, {"unit": "kW"})], 0),
]


def test_severity(spark):
    rows = [claim(v, field_name=f, model=str(i), extractor_version=str(j), **m) for i, (f, members, _) in enumerate(SEVERITIES) for j, (v, m) in enumerate(members)]
    got = {int(r["model"]): r["severity"] for r in conflicts.detect(frame(spark, rows)).collect()}
    assert got == {i: s for i, (*_, s) in enumerate(SEVERITIES)}
    three = [claim(v, extractor_version=str(i)) for i, v in enumerate((650, 655, 700))]
    assert min(r["severity"] for r in conflicts.detect(frame(spark, three)).collect()) == 3


def test_policy_tables():
    assert len(policy.CRITICALITY) == 124 and len(policy.TOLERANCES) == 24 and len(policy.TIERS) == 42
    assert sum(t == "a" for t in policy.TIERS.values()) == 28
    policy.check_tolerances()
    with pytest.raises(ValueError):
        policy.check_tolerances([("x", "absolute", None, None, None)])
    with pytest.raises(ValueError):
        schema.Settings(gate_severity_threshold=4)


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    key = lambda s: one(text.manufacturer_key(F.lit(s)))
    assert key("Trina Solar Co.,Ltd") == key("﻿Trina Solar") == "trina solar"
    assert (key("AS Solar"), key("Solar, Inc."), key("Co., Ltd."), key("Hanwha Q CELLS GmbH")) == ("as solar", "solar", None, "qcells")
    assert one(text.manufacturer_key_ascii(F.lit("Trina Solar Co.,Ltd"))) == "trina solar" and one(text.manufacturer_key_ascii(F.lit("Co., Ltd."))) is None
    assert one(text.token(F.lit("-stc"))) == "stc" and one(text.token(F.lit("\ufeffS\u00adTC"))) == "stc" and one(text.token(F.lit("a\u200eb"))) == "a\u200eb"
    assert one(text.token(F.lit("ANSI / IEEE"))) == "ieee" and one(text.token(F.lit("Cell-Temp x"))) == "cell_temp_x"
    assert [one(text.python_repr(F.lit(x))) for x in (1e7, 1e-4, 650.0)] == ["10000000.0", "0.0001", "650.0"]
    assert one(values.printed_decimals(F.lit("@ 25 degC: 22.35 %"), F.lit(22.35), F.lit(False), F.lit("22.35"))) == 2
    assert one(values.printed_decimals(F.lit("1,500 V"), F.lit(1500.0), F.lit(True), F.lit("1500"))) == 0
    assert one(values.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    same = one(text.jaccard(text.trigrams(F.lit("JKM610N-66HL4M-V")), text.trigrams(F.lit("JKM610N 66HL4M V"))))
    assert same == 1.0


DECOMPOSED = [("Alpha Pure-R 410 BLK", (410.0,), "alpha pure r #", 410.0, ["blk"]), ("FS-367", (267.0,), "fs 367", None, []), ("FS-267", (267.0,), "fs #", 267.0, []), ("ABC-267-500", (500.0, 267.0), "abc 267 #", 500.0, []), ("TSM-700NEG21C.20", (705.0, 700.0), "tsm 700 neg 21 c 20", None, []), ("TSM-700NEG21C.20", (699.0,), "tsm #", 700.0, ["neg", "21", "c", "20"]), ("TSM-700NEG21C.20", (698.0,), "tsm 700 neg 21 c 20", None, []), ("x 5", (None,), "x 5", None, [])]


def test_decompose(spark):
    for model, plates, family, watts, variants in DECOMPOSED:
        r = spark.range(1).select(identity.decompose(identity.model_tokens(text.model_text(F.lit(model))), *[F.lit(p).cast("double") for p in plates]).alias("d")).first()["d"]
        assert (r["family"], r["bin_watts"], r["variants"]) == (family, watts, variants), model


REC, MAX = "REC Solar Pte. Ltd.", "Maxeon Solar Technologies, Ltd."
SCORES = [
    ((REC, "Alpha 410", 410.0, 410.0), (REC, "Alpha 410 BLK", 410.0, 410.0), "same_product"),
    ((REC, "Alpha 410", 410.0, 410.0), (REC, "Alpha 410 BW", 410.0, 410.0), "variant_mismatch"),
    ((MAX, "M 410", 410.0, 410.0), (MAX, "M 410 BLK", 410.0, 410.0), "variant_mismatch"),
    (("Adani", "A 510", 510.0, 509.9), ("Adani", "A 510", 510.0, 518.2), "variant_mismatch"),
    (("Co., Ltd.", "A", 1.0, 1.0), ("Qcells", "A", 1.0, 1.0), "distinct"),
    (("Qcells", "Q 410", 410.0, 410.0), ("Hanwha Q Cells", "Q 410", 410.0, 410.5), "same_product"),
    (("Qcells", "Q 410", 410.0, None), ("Qcells", "Q 410", 410.0, 415.0), "variant_mismatch"),
    (("Jinko", "JKM 66HL", None, 610.0), ("Jinko", "JKM 78HL", None, 610.0), "distinct"),
]


def test_identity_scores(spark):
    rows = [(i, side, *x) for i, (a, b, _) in enumerate(SCORES) for side, x in enumerate((a, b))]
    df = spark.createDataFrame(rows, "pair int, id int, manufacturer string, model string, nameplate double, pmax double").withColumns({"voc": F.lit(None).cast("double"), "isc": F.lit(None).cast("double")})
    scored = identity.score(identity.candidate_pairs(identity.prepared(df), ["pair"], "id"))
    got = {r["l"]["pair"]: (r["outcome"], r["score"]) for r in scored.collect()}
    assert {i: o for i, (o, _) in got.items()} == {i: w for i, (*_, w) in enumerate(SCORES)}
    assert got[1][1] >= 0.9 and got[4][1] == 0.0
    flipped = identity.score(identity.candidate_pairs(identity.prepared(df.withColumn("id", 1 - F.col("id"))), ["pair"], "id"))
    assert {r["l"]["pair"]: (r["outcome"], r["score"]) for r in flipped.collect()} == got
    keys = identity.identity_keys(df).where("pair = 1").first()
    assert len(keys["surrogate_id"]) == 16
    assert identity.in_order(identity.identity_keys(df).withColumn("component_category", F.lit("pv"))).count() == len(rows)


def test_projection_and_commit(spark):
    a, b = claim(650, confidence=0.9), claim(655, confidence=0.95, **WEB)
    stored = claims.project(frame(spark, [a]))
    p = claims.project(frame(spark, [a, b, b])).first()
    assert (p["value"]["num"], p["conflict_status"], p["n_claims"]) == (650.0, "open", 3)
    assert claims.project(frame(spark, [claim(650), claim(None, extractor_version="v2")])).first()["conflict_status"] == "open"
    assert claims.canonical_claims(frame(spark, [a, a, b])).count() == 2
    assert claims.contradictions(frame(spark, [claim(1), claim(2)])).count() == 1
    assert claims.commit(stored, frame(spark, [a])).count() == 1
    assert claims.commit(stored, frame(spark, []).limit(0)).count() == 1
    for bad in ([claim(1), claim(2)], [claim(5, cond={"basis": "stc"})], [b]):
        with pytest.raises(claims.CommitRefusedError):
            claims.commit(stored, frame(spark, bad))
    assert claims.as_candidates(frame(spark, [a])).first()["source_ref"]["extractor_version"] == "v1"
    assert claims.preferred(frame(spark, [a, b])).where("rank = 1").first()["value"]["num"] == 650.0
    valid, refused = schema.quarantine(frame(spark, [a, claim(float("nan")), claim(1, confidence=2.0)]), schema.claim_checks())
    assert valid.count() == 1 and {tuple(r["error_class"]) for r in refused.collect()} == {("finite_value",), ("confidence",)}


def test_fields(spark):
    a, b = frame(spark, [claim(650)]), frame(spark, [claim(650), claim(655, extractor_version="v2")])
    assert claims.ensemble([a, b]).count() == 2
    both = frame(spark, [claim(None), claim(1, **WEB)])
    assert both.where(claims.is_missing()).count() == 1 and both.where(claims.is_web_supplemented()).count() == 1
    f = spark.createDataFrame([("resolved", None), ("resolved", "r"), ("open", None), ("odd", None)], "conflict_status string, resolution string")
    assert schema.quarantine(f, claims.field_checks())[0].count() == 2
    assert claims.takes_a_write_handle(lambda writer: 0) and not claims.takes_a_write_handle(claims.project)


def test_security(spark):
    docs = spark.createDataFrame([("o", False), ("x", True), ("n", None)], "document_id string, access_restricted boolean")
    assert [r[0] for r in security.secure(docs, security.Principal()).collect()] == ["o"]
    assert security.secure(docs, security.Principal("ingest")).count() == 3
    chunks = spark.createDataFrame([("o", True), ("x", False)], "document_id string, access_restricted boolean")
    assert {r["access_restricted"] for r in security.inherit(chunks, docs).collect()} == {True}
    with pytest.raises(Exception, match="no document"):
        security.inherit(spark.createDataFrame([("zz", False)], "document_id string, access_restricted boolean"), docs).collect()
    found = security.document_is_restricted(spark.createDataFrame([("o",), ("x",), (None,), ("zz",)], "document_id string"), docs)
    assert {r["document_id"]: r["is_restricted"] for r in found.collect()} == {"o": False, "x": True, None: False, "zz": True}
    assert security.appended_only(docs, docs.where("document_id <> 'o'")).count() == 1


def test_audit(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("doc:a", "a", "ingest", "u", f'{{"n":{i}}}', t + dt.timedelta(seconds=i)) for i in range(5)], "stream string, document_id string, event_type string, actor string, payload_canonical string, recorded_at timestamp")
    c = audit.chain(e).cache()
    assert audit.broken_links(c).isEmpty() and audit.forks(c).isEmpty() and audit.recomputed(c).isEmpty()
    more = audit.chain(e.withColumn("recorded_at", F.col("recorded_at") + F.expr("interval 1 hour")), audit.tips(c))
    assert audit.broken_links(c.unionByName(more)).isEmpty()
    assert audit.recomputed(c.withColumn("payload_canonical", F.when(F.col("seq") == 2, '{"n":9}').otherwise(F.col("payload_canonical")))).count() == 1
    assert audit.broken_links(c.where("seq <> 2")).first()["reason"] == "gap"
    assert audit.broken_links(c.withColumn("prev_hash", F.when(F.col("seq") == 3, "f").otherwise(F.col("prev_hash")))).first()["reason"] == "parent"
    second = c.where("seq = 0").withColumn("hash", F.lit("g"))
    assert not audit.forks(c.unionByName(second)).isEmpty() and not audit.broken_links(c.unionByName(second)).isEmpty()


def test_documents(spark):
    def archive(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "xl/workbook.xml stands in the bytes of this member, which is stored")
        return out.getvalue()

    sig = lambda b: spark.range(1).select(documents.content_signature(F.lit(b))).first()[0]
    assert [sig(x) for x in (b"%PDF-1.7", b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"a,b\n1,2", b"RIFF\x00\x00\x00\x00WEBP", b"\x00\x00\x00\x18ftypheic", b"\x00\x01", archive("xl/workbook.xml"), archive("word/document.xml"), archive("notes/xl/workbook.xml", "word/ xl/workbook.xml"), b"PK\x03\x04 xl/workbook.xml")] == ["pdf", "jpg", "png", "csv", "webp", "heic", "unknown", "xlsx", "docx", "zip", "zip"]
    unit = lambda s: tuple(spark.range(1).select(documents.normalize_unit(F.lit(s)).alias("u")).first()["u"])[:2]
    assert [unit(x) for x in ("1,500 V", "0,35 %/°C", "1.234,5 kW", "abc")] == [(1500.0, "v"), (0.35, "%/k"), (1234.5, "kw"), (None, "abc")]
    d = spark.createDataFrame([("a", " ".join(map(str, range(25)))), ("b", ""), ("c", None), ("d", "one")], "document_id string, text string")
    got = documents.chunks(d, size=10, overlap=0.1).orderBy("document_id", "chunk_no").collect()
    assert [(r["document_id"], r["start"], r["n_words"]) for r in got] == [("a", 0, 10), ("a", 9, 10), ("a", 18, 7), ("d", 0, 1)]
    parsed = spark.createDataFrame([("a", 5, 10, 0, False), ("b", 0, 10, 0, False), ("c", 5, 10, 0, True)], "id string, n_chars int, raw_chars int, n_cells int, has_table boolean")
    assert [r["parse_status"] for r in documents.parse_audit(parsed).orderBy("id").collect()] == ["parsed", "parse_failed", "parse_failed"]
    both = documents.fall_back(parsed.select("id"), [lambda x: x.join(parsed, "id"), lambda x: x.withColumns({"n_chars": F.lit(9), "raw_chars": F.lit(9), "n_cells": F.lit(1), "has_table": F.lit(False)})])
    assert both.count() == 3 and both.where("parse_status = 'parsed'").count() == 3


def test_retrieval(spark):
    rows = [(f"c{i}", f"d{i % 2}", f"text number {i} JKM610N-66HL4M-V" if i == 3 else f"text number {i}", [float(i == j) for j in range(8)], "pv") for i in range(8)]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_text string, embedding array<float>, category string")
    q = [0.0] * 8
    q[5] = 1.0
    assert [r["chunk_id"] for r in retrieval.top_k(c, q, 3).collect()][0] == "c5" and retrieval.top_k(c, q, 3).count() == 3
    assert retrieval.retrieve(c, "JKM610N 66HL4M V", q, limit=2).first()["chunk_id"] in ("c3", "c5")
    allowed = spark.createDataFrame([("d0",)], "document_id string")
    assert {r["document_id"] for r in retrieval.retrieve(c, "text", q, limit=8, allowed=allowed).collect()} == {"d0"}
    best = retrieval.retrieve(c, "text", q, limit=1, rerank=lambda q, s: s.str.endswith("7").astype(float)).first()
    assert best["chunk_id"] == "c7"


def test_jobs(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    t = dt.datetime(2024, 1, 1, 11)
    rows = [(1, "pending", 0, 3, t, None, None), (2, "running", 1, 3, t, "w", t), (3, "running", 3, 3, t, "w", t), (4, "running", 1, 3, t, "w", dt.datetime(2024, 1, 2))]
    j = spark.createDataFrame([(*r, t, t, f"k{r[0]}") for r in rows], "job_id long, status string, attempt int, max_attempts int, next_attempt_at timestamp, lease_owner string, lease_expires_at timestamp, created_at timestamp, updated_at timestamp, idempotency_key string")
    assert [r["job_id"] for r in jobs.claim(j, now, "me", 5).collect()] == [1]
    assert {r["job_id"]: r["status"] for r in jobs.sweep(j, now).collect()} == {1: "pending", 2: "pending", 3: "quarantined", 4: "running"}
    assert jobs.inconsistent(jobs.sweep(j, now)).isEmpty()
    assert jobs.enqueue(j, j).isEmpty()
    again = {r["job_id"]: (r["status"], r["next_attempt_at"]) for r in jobs.failed(j, now, "e").collect()}
    assert again[3] == ("quarantined", None) and again[2] == ("pending", dt.datetime(2024, 1, 1, 12, 1))
    c = spark.createDataFrame([(0, "done"), (3, "done")], "reopen_count int, queue_status string")
    assert sorted(tuple(r) for r in jobs.reopen(c).collect()) == [(1, "pending"), (3, "done")]


def test_confidence(spark):
    full = {k: F.lit(True) for k in confidence.WEIGHTS} | {"ocr_confidence": F.lit(0.5)}
    none = {k: F.lit(None).cast("boolean") for k in confidence.WEIGHTS}
    r = spark.range(1).select(confidence.fuse(full), confidence.fuse(none)).first()
    assert tuple(r) == (0.9, 0.5)
    f = spark.range(1).select(confidence.flags(F.lit(False), F.lit("web_supplement"), F.lit(0.85), F.lit("open"), 0.85)).first()[0]
    assert f == ["missing_data", "web_supplemented", "unresolved_conflict"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1e7), ("a", 0.5)], "k string, v double")
    assert list(sinks.json_lines(df, ["k"])) == ['{"k":"a","v":0.5}', '{"k":"b","v":10000000.0}']
    one = sinks.write_workbook({"Summary": df.orderBy("k")}, tmp_path / "a.xlsx").read_bytes()
    two = sinks.write_workbook({"Summary": df.repartition(3).orderBy("k")}, tmp_path / "b.xlsx").read_bytes()
    assert one == two
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert z.namelist()[0] == sinks.FIRST and z.infolist()[0].date_time == sinks.EPOCH
    orders = {"components": ["k"], "conflicts": ["k"], "sources": ["k"]}
    assert sinks.projection(df, df, df, orders, {"p": 1}) == sinks.projection(df.repartition(2), df, df, orders, {"p": 1})
    assert sinks.TABS == ("PV Modules", "Inverters-PCS", "Trackers & Mounting", "Transformers", "Cabling & Wiring", "Combiner Boxes", "BESS", "EMS-SCADA & Controls", "Executive Summary", "Conflicts & Open Items", "Sources & Provenance", "Compliance Matrix", "Tax Incentives")
    assert tuple(sinks.CATEGORY_TABS.values()) == sinks.TABS[:8]


def test_sheets(spark, tmp_path):
    from concordia.sources.readers import SheetSource, files, ingest

    (tmp_path / "x.csv").write_text("note\n\nname,power\nA,5\nB,\n")
    spark.dataSource.register(SheetSource)
    got = spark.read.format("sheet").schema("power string, name string").option("headerrow", 3).load(f"file://{tmp_path}/x.csv").collect()
    assert [tuple(r) for r in got] == [("5", "A"), (None, "B")]
    raw = files(spark, f"file://{tmp_path}/x.csv")
    docs, elements = ingest(raw, raw.limit(0), {"csv": lambda b: [("body", b.decode() + " datasheet", 1)]})
    assert docs.first()["document_type"] == "spec_sheet" and elements.count() == 1
    docs, elements = ingest(raw, raw, {})
    assert docs.count() == 0 and elements.count() == 0


def test_documents_are_typed_by_their_whole_content(spark, tmp_path):
    from concordia.sources.readers import files, ingest

    long = b"x" * (1 << 17)

    def office(name):
        """An archive whose telling member comes after a large one that names the other format."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("media/image.bin", long + b"word/document.xml xl/workbook.xml")
            z.writestr(name, "x")
        return out.getvalue()

    kind = lambda t: spark.range(1).select(documents.classify(F.lit(t))).first()[0]
    assert [kind(t) for t in ("One contract was named.", "The contract and this contract, an agreement", "Price list and contract, price and contract", "DATA SHEET of the contract", "", None)] == [None, "contract_tos", None, "spec_sheet", None, None]
    contents = [(long + b",y\n1,2", "csv"), (b"a;b\n" + b"1;2\n" * 9, "csv"), (b"<p>a,b\n<p>c,d", "unknown"), (b"one, two\nthree", "unknown"), (b"a\tb\r\nc\td", "csv"), (b"\0\0\0\x18ftyphevc", "heic"), (b"a,b" + long + b"\0", "unknown"), (office("word/document.xml"), "docx"), (office("xl/workbook.xml"), "xlsx"), (office("xl/other.xml"), "zip"), (b"PK\x03\x04" + long + b"xl/workbook.xml", "zip")]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(contents)], "i int, c binary")
    got = df.select("i", documents.content_signature(F.col("c")).alias("s")).collect()
    assert [r["s"] for r in sorted(got)] == [s for _, s in contents]
    (tmp_path / "long.csv").write_text("a,b\n1,2\n")
    raw = files(spark, f"file://{tmp_path}/long.csv")
    docs, _ = ingest(raw, raw.limit(0), {"csv": lambda b: [("body", "plain" if k < 49 else "warranty", k) for k in range(50)]})
    assert docs.first()["document_type"] == "warranty"


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i % 3, "claim" if i % 2 == 0 else "finish", "w", t + dt.timedelta(minutes=i), "e", 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "job_id long, action string, owner string, ts timestamp, event_type string, value double")
    path = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    s = streams.stream(spark, path, df.schema)
    got = streams.run_available(streams.tumbling(s, "5 minutes"), "t_tumbling", f"{tmp_path}/c1", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.tumbling(df, "5 minutes").collect()))
    once = streams.run_available(streams.first_seen(s, "job_id"), "t_first", f"{tmp_path}/c2")
    assert once.count() == 3
    for n in range(2):
        streams.append_new(s, f"{tmp_path}/out", "job_id", f"{tmp_path}/c3-{n}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    changes = streams.run_available(streams.leases(s), "t_leases", f"{tmp_path}/c4").collect()
    assert {r["cause"] for r in changes} >= {"claim", "finish"}


def test_stages(spark):
    out = run_stages({"detect_conflicts": lambda t: t["ingest"].limit(1), "ingest": lambda t: spark.range(5)}, {})
    assert out["detect_conflicts"].count() == 1
    with pytest.raises(ValueError):
        run_stages({"x": None}, {})


def test_fixture_bytes():
    assert sinks.fixture_bytes({"b": [1], "a": "é"}) == '{\n  "a": "é",\n  "b": [\n    1\n  ]\n}\n'.encode()


def test_documents_are_routed(spark):
    from concordia.sources.readers import routed

    docs = spark.createDataFrame([("a", "warranty"), ("b", "warranty"), ("c", None), ("d", "pricing"), ("e", None)], "content_hash string, document_type string")
    long = "x" * 300
    elements = spark.createDataFrame([("a", "body", long, 1), ("a", "body", "short", 2), ("b", "body", long, 1), ("b", "body", "", 2), ("b", "body", None, 3), ("c", "body", long, None), ("d", "body", long, 1), ("d", "parse_failed", "why", None)], "content_hash string, kind string, text string, page int")
    got = {r["content_hash"]: (r["route"], r["pages"], r["thin_pages"]) for r in routed(docs, elements).collect()}
    assert got == {"a": ("index", 2, 1), "b": ("ocr", 3, 2), "c": ("review", 1, 0), "d": ("failed", 1, 0), "e": ("failed", None, None)}


def test_canonical_claims_are_shuffled_once_and_unsorted(spark):
    """Rows aren't sorted before they are with their equals, and carry no JSON text of all their columns."""
    a = claim(650, unit="Wp")
    df = claims.canonical_claims(frame(spark, [a, a, claim(650, unit=None), claim(650, unit="")]))
    assert df.count() == 2 and df.columns == claims.with_condition_text(frame(spark, [a])).columns
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan.split("Exchange")[-1] and "__id" not in plan


def test_values_are_counted_where_claims_are_gathered(spark):
    stc, noct = {"basis": "stc"}, {"temperature_c": 25.0}
    rows = [claim(v, cond=c, model=m, extractor_version=str(i)) for m in ("1", "2") for c in ({}, stc, noct) for i, v in enumerate((1, 1.0, True, None, "a", "a", 2, None, ["x"])) if m == "1" or i in (3, 7)]
    rows.append(claim(1, model=None))
    df, keys = frame(spark, rows), [*conflicts.COMPONENT, "field_name"]
    got = {(*(r[k] for k in keys), r["condition_text"]): r["distinct_values"] for r in conflicts.gathered(df).collect()}
    want = {(*(r[k] for k in keys), r["condition_text"]): r["distinct_values"] for r in conflicts.value_counts(df).collect() if r["model"]}
    assert got == want and sorted(want.values()) == [0, 0, 0, 4, 4, 4]
    assert conflicts.gathered(df).count() == len(rows) - 1


def test_entries_are_counted_by_their_ids(spark):
    """Copies of a claim give entries of one id each; all are counted, with and without copies known."""
    rows = [claim(v, model=m, doc=d) for m, v, d in (("1", 650, "a"), ("1", 655, "b"), ("1", 655, "b"), ("1", 660, "c"), ("2", 650, "a"), ("2", 655, "b"), ("3", 650, "a"))]
    for carry in (conflicts.QUEUED, ("value", "source_ref", "confidence")):
        q = conflicts.queue(conflicts.detect(frame(spark, rows), carry=carry), F.lit("2024-01-01").cast("timestamp"))
        ids = [r["entry_id"] for r in q.collect()]
        got = q.agg(conflicts.n_different().alias("n"), F.count("shared_id").alias("shared")).first()
        assert (len(ids), len(set(ids)), got["n"], got["shared"]) == (6, 4, 4, 4 if "copies" in carry else 6)
