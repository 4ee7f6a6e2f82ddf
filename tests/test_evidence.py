"""Candidate sets, the versioned store, aliases and identities, roles, user functions and workbooks."""

import datetime
import itertools
import random
import zipfile

import pytest
from concordia.functions import udfs
from concordia.operators import aliases, roles, severity_sets
from concordia.sources import readers, workbooks
from concordia.sources.folders import checkpoint_folder
from concordia.sources.store import StaleBaseError, Store
from pyspark.sql import functions as F


# -- candidate sets ------------------------------------------------------------------------------------------------


def test_maximal_sets():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(0, 8)
        near = {frozenset(p) for p in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        masks = [sum(1 << j for j in range(n) if frozenset((i, j)) in near) for i in range(n)]
        good = [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(frozenset(p) in near for p in itertools.combinations(c, 2))]
        want = sorted(sorted(c) for c in good if not any(c < d for d in good))
        assert sorted(map(sorted, severity_sets.maximal_sets(masks))) == want


def test_sets_are_graded_once(spark):
    import sys

    sys.path.insert(0, "tests")
    from test_operators import claim, frame

    stc, noct = {"basis": "stc"}, {"basis": "noct"}
    # 300 and 330 disagree; the claim without a basis is comparable with both bases, so it is in both sets.
    rows = [claim(300.0, model="1", cond=stc, doc="a"), claim(330.0, model="1", cond=stc, doc="b"), claim(300.0, model="1", doc="c"), claim(300.0, model="1", cond=noct, doc="d")]
    rows += [claim(v, model="2", cond=stc, doc=d) for v, d in ((300.0, "a"), (302.0, "b"), (304.0, "c"))]
    rows += [claim(300.0, model="3", cond=stc, doc="a")]
    # Two units of one family that reconcile, and a record against the web.
    rows += [claim(300.0, model="4", unit="W", doc="a"), claim(0.3, model="4", unit="kW", doc="b")]
    rows += [claim(300.0, model="5", doc="a"), claim(302.0, model="5", source_tier="web_supplement"), claim(300.0, model="5", doc="b")]
    got = {}
    for r in severity_sets.graded_sets(frame(spark, rows)).collect():
        got[r["model"], r["condition"]["basis"]] = (r["n_claims"], r["n_values"], r["conflicts"], r["conflict_class"], r["severity"])
    # Criticality 2; +1 for ten times the tolerance, +1 for records alone, +1 for three values under one condition; tier A is 3 at least.
    assert got == {("1", "stc"): (3, 2, True, "inter_document", 4), ("1", "noct"): (2, 1, False, None, None), ("2", "stc"): (3, 3, True, "inter_document", 4), ("4", None): got["4", None], ("5", None): (3, 2, True, "record_vs_web", got["5", None][4])}
    assert got["4", None][3] in (None, "unit_normalization") and got["5", None][4] <= 3


def test_memberships(spark):
    import sys

    sys.path.insert(0, "tests")
    from concordia.operators import conflicts
    from test_operators import claim, frame

    rng = random.Random(8)
    rows = [claim(1, model=str(k), cond={"basis": rng.choice((None, "stc", "noct")), "temperature_c": rng.choice((None, 25.0, 1e22, float("nan"))), "tap_position_pct": rng.choice((None, -2.5))}) for k in range(12) for _ in range(7)]
    fits = lambda a, b: all(x is None or y is None or str(x) == str(y) for x, y in ((a[d], b[d]) for d in a if d not in ("note", "derived")))
    got = {r["model"]: r["sets_of"] for r in severity_sets.memberships(frame(spark, rows), conflicts.COMPONENT).collect()}
    text = F.to_json(conflicts.condition_key(F.col("condition")))
    named = {(r["model"], repr(tuple(r["condition"])[:10])): r["t"] for r in frame(spark, rows).withColumn("t", text).collect()}
    for k in range(12):
        of = {named[str(k), repr(tuple(r["condition"].values())[:10])]: r["condition"] for r in rows if r["model"] == str(k)}
        sets = {n: {t for t in of if n in got[str(k)][t]} for t in of for n in got[str(k)][t]}
        good = [set(c) for n in range(1, len(of) + 1) for c in itertools.combinations(of, n) if all(fits(of[a], of[b]) for a, b in itertools.combinations(c, 2))]
        assert sorted(map(sorted, sets.values())) == sorted(sorted(c) for c in good if not any(c < d for d in good))


# -- the store -----------------------------------------------------------------------------------------------------


def test_store(spark):
    store = Store(spark, checkpoint_folder(spark))
    rows = lambda *r: spark.createDataFrame(list(r), "field_name string, value double, version string")
    read = lambda v=None: sorted((tuple(r) for r in store.read(v).collect()), key=repr)
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.read()
    first = [("a", 1.0, None), ("b", 2.0, "x"), (None, 9.0, "n")]
    assert store.commit(rows(*first), 0) == 1
    pinned = store.read()

    def fail():
        raise RuntimeError("lost between files")

    with pytest.raises(RuntimeError):
        store.commit(rows(("a", 5.0, None)), 1, before_publishing=fail)
    assert store.version() == 1 and read() == sorted(first, key=repr)
    # Two writers of version 1: the first is in, the second is refused and nothing of it is seen.
    with pytest.raises(StaleBaseError):
        store.commit(rows(("b", 7.0, None)), 1, before_publishing=lambda: store.commit(rows(("a", 6.0, None), ("a", 7.0, None)), 1))
    assert read() == sorted([("a", 6.0, None), ("a", 7.0, None), *first[1:]], key=repr)
    assert sorted((tuple(r) for r in pinned.collect()), key=repr) == read(1) == sorted(first, key=repr)
    store.commit(rows((None, 1.5, "z")), 2, replaced=["b"])
    assert read() == sorted([("a", 6.0, None), ("a", 7.0, None), (None, 1.5, "z")], key=repr)
    assert store.commit(rows(), 3, replaced=["a", None]) == 4 and read() == []
    assert store.vacuum(keep=2) == [1, 2] and store.versions() == [3, 4] and len(read(3)) == 3


# -- aliases and identities ----------------------------------------------------------------------------------------


def test_alias_closure(spark):
    rng = random.Random(5)
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(60)] + [("hub", f"h{k}") for k in range(200)] + [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(70)] + [("self", "self"), (None, "x"), ("y", None)]
    group = {}
    for a, b in pairs:
        if a and b:
            ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
            for n in gb | ga:
                group[n] = ga | gb
            for n in group[a]:
                group[n] = group[a]
    closure = aliases.closed(spark.createDataFrame(pairs, "a string, b string"))
    assert {r["name"]: r["canonical"] for r in closure.collect()} == {n: min(g) for n, g in group.items()}
    some = aliases.resolved(F.col("m"), closure, spark.createDataFrame([("n60",), ("new",), (None,)], "m string"))
    assert sorted(some.collect(), key=repr) == [("n60", "n0"), ("new", "new"), (None, None)]
    assert aliases.closed(spark.createDataFrame([], "a string, b string")).collect() == []


def test_identities(spark):
    base = ("Acme Solar Inc.", "SC 4200 UP-US", 1500, 630, 3850, 1, ["UL 1741", "IEEE 1547"])
    change = lambda **c: tuple(c.get(n, v) for n, v in zip(("manufacturer", "model", "dc", "ac", "amps", "mppt", "certs"), base, strict=True))
    rows = [base, change(model="SC4400/UP/US"), change(model="sc 4200 up-dom-us {690 V}"), change(model="SC 4200 UP"), change(ac=690), change(dc=None), change(certs=["ieee 1547", "ul 1741 ", "UL 1741"]), change(certs=None), change(manufacturer=None), change(model=None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, manufacturer string, model string, dc_voltage_class int, ac_nominal_voltage int, ac_nominal_current int, mppt_count int, certifications array<string>")
    got = {r["i"]: (r["inverter_key"], r["domestic"]) for r in aliases.inverter_keys(df).collect()}
    key = got[0][0]
    assert [i for i in got if got[i][0] == key] == [0, 1, 2, 6] and [i for i in got if got[i][1]] == [2]
    assert got[3][0] not in (key, None) and got[4][0] not in (key, None, got[3][0]) and {got[i][0] for i in (5, 7, 8, 9)} == {None}
    assert [r[0] for r in df.where("i = 2").select(aliases.braced(F.col("model"))).collect()] == [["690 V"]]
    stores = spark.createDataFrame([(0, "Acme", "ST5015UX-4H-US", 5015), (1, "ACME ", "st 5015 ux 4h us", 5015), (2, "Acme", "Grid Stack", 5015), (3, "Acme", None, 1), (4, "Acme", "ST5015UX-2H-US", 5015), (5, "Acme", "ST5015UX-4H-US", None)], "i int, manufacturer string, model string, capacity_kwh int")
    got = {r["i"]: (r["group"], r["storage_key"]) for r in aliases.storage_keys(stores).collect()}
    assert got[0] == got[1] and got[0][1] is not None and got[4][1] not in (None, got[0][1])
    assert [got[i] for i in (2, 3, 5)] == [("marketing", None), ("unnamed", None), ("structured", None)]


# -- roles ---------------------------------------------------------------------------------------------------------


def test_roles(spark):
    docs = spark.createDataFrame([(1, False, "v"), (2, True, "v"), (3, None, "v")], "document_id int, access_restricted boolean, data_vintage string")
    chunks = docs.withColumnRenamed("data_vintage", "chunk_text")
    claims = spark.createDataFrame([(1, "x")], "claim_id int, value string")
    c = roles.Catalogue({"document": docs, "chunk": chunks, "claim": claims}, {("app", "document"): ("document_id",)})
    app, full, ingest = roles.Session("app"), roles.Session("app", True), roles.Session("ingest")
    for owner in ("core_owner", "audit_owner"):
        with pytest.raises(PermissionError):
            roles.Session(owner)
    with pytest.raises(ValueError):
        roles.Session("root")
    ids = lambda df: sorted(r["document_id"] for r in df.collect())
    assert [ids(c.view(s, "document")) for s in (app, full, ingest)] == [[1], [1, 2, 3], [1, 2, 3]]
    assert c.view(app, "document").columns == ["document_id"] and len(c.view(ingest, "document").columns) == 3
    for table, columns in (("document", ["data_vintage", "document_id"]), ("claim", ["value", "claim_id"])):
        change = c.tables[table].select(*columns)
        if table == "claim":
            with pytest.raises(PermissionError):
                c.update(app, table, change, "claim_id")
            with pytest.raises(PermissionError):
                c.delete(ingest, table, change, "claim_id")
    with pytest.raises(PermissionError):
        c.update(ingest, "document", docs.selectExpr("document_id", "'z' AS other"), "document_id")
    # Nobody declassifies what they can't see.
    open_all = docs.selectExpr("document_id", "false AS access_restricted")
    assert sorted(map(tuple, c.update(app, "document", open_all, "document_id").collect())) == sorted(map(tuple, docs.collect()))
    assert all(r["access_restricted"] is False for r in c.update(full, "document", open_all, "document_id").collect())
    assert ids(c.delete(app, "chunk", docs, "document_id")) == [2, 3] and ids(c.delete(ingest, "chunk", docs, "document_id")) == []
    assert c.insert(app, "claim", claims).count() == 2
    with pytest.raises(ValueError):
        c.insert(app, "claim", claims.select("claim_id"))
    assert ("app", "document", "update", "data_vintage") in roles.rights() and not any(r[0].endswith("owner") for r in roles.rights())


# -- user functions ------------------------------------------------------------------------------------------------


def test_user_functions(spark):
    udfs.register(spark)
    spark.createDataFrame([(1, "a b\xa0c d e"), (2, None), (3, " ")], "i int, t string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT i, w.* FROM some_texts, LATERAL word_windows(t, 2, 'text') w").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, "a b\xa0c"), (1, 1, 2, "d e")]
    for bad in ("word_windows(t, 0)", "word_windows(t, 2, 'x')"):
        with pytest.raises(Exception, match="word_windows"):
            spark.sql(f"SELECT * FROM some_texts, LATERAL {bad}").collect()
    g = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("a", None), ("b", -1.0)], "k string, v double").groupBy("k").agg(udfs.geometric_mean(F.col("v")).alias("m"))
    assert {r["k"]: r["m"] for r in g.collect()} == {"a": pytest.approx(4.0), "b": None}
    assert tuple(spark.sql("SELECT severity_name(4), severity_name(9), relative_gap(0, 0), relative_gap(1, -1)").first()) == ("critical", None, None, 2.0)


# -- workbooks -----------------------------------------------------------------------------------------------------

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheet_xml, *, strings=(), date1904=False):
    """A workbook with two sheets: the XML given, and one inline cell."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {_NS} xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="Main &amp; more" sheetId="1" r:id="r1"/><sheet name="Notes" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="x" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{sheet_xml}</sheetData><mergeCells><mergeCell ref=\"A4:A6\"/><mergeCell ref=\"C4:D4\"/></mergeCells></worksheet>")
        z.writestr("xl/worksheets/other.xml", f'<worksheet {_NS}><sheetData><row><c t="inlineStr"><is><t>maker</t></is></c></row><row><c t="inlineStr"><is><t>only</t></is></c></row></sheetData></worksheet>')


def test_workbook_source(spark, tmp_path):
    spark.dataSource.register(workbooks.WorkbookSource)
    strings = ["<t>maker</t>", "<r><t>Ac</t></r><r><t>me</t></r><rPh><t>ignored</t></rPh>", "<t>power</t>", "<t xml:space=\"preserve\"> two\nlines </t>"]
    xml = '<row r="1"><c r="A1" t="inlineStr"><is><t>a title</t></is></c></row>'
    xml += '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>2</v></c><c r="C3" t="str"><v>since</v></c><c r="D3" t="inlineStr"><is><t>ok</t></is></c><c r="AA3" t="s"><v>3</v></c></row>'
    xml += '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><v>450.5</v></c><c r="C4"><v>45292</v></c></row>'
    xml += '<row r="5"><c r="B5"><v>450</v></c><c r="D5" t="b"><v>1</v></c><c r="AA5" t="s"><v>3</v></c></row><row r="6"/><row r="9"><c r="B9" t="e"><v>#N/A</v></c></row>'
    workbook(tmp_path / "one.xlsx", xml, strings=strings)
    read = lambda path, schema, **o: spark.read.format("workbook").schema(schema).options(path=f"file://{tmp_path}/{path}", headerrow=3, **o).load()
    got = read("one.xlsx", "_sheet string, _row int, maker string, power double, since date, ok boolean, missing string", sheet="Main & more").orderBy("_row").collect()
    new_year = datetime.date(2024, 1, 1)
    assert [tuple(r) for r in got] == [("Main & more", 4, "Acme", 450.5, new_year, None, None), ("Main & more", 5, "Acme", 450.0, None, True, None), ("Main & more", 6, "Acme", None, None, None, None)]
    assert [tuple(r) for r in read("one.xlsx", "power long, `two\nlines` string", sheet="Main & more").collect()] == [(450, " two\nlines ")]
    assert [r["maker"] for r in read("one.xlsx", "_row int, maker string", sheet="Main & more", fillmerged="false").collect()] == ["Acme"]
    every = spark.read.format("workbook").schema("_sheet string, maker string").options(path=f"file://{tmp_path}/one.xlsx").load()
    assert every.rdd.getNumPartitions() == 2 and [tuple(r) for r in every.collect()] == [("Notes", "only")]
    workbook(tmp_path / "two.xlsx", xml, strings=strings, date1904=True)
    assert read("two.xlsx", "since date", sheet="Main & more").first()[0] == datetime.date(2028, 1, 2)
    assert workbooks.place("A1") == (0, 0) and workbooks.place("$AA$12") == (11, 26)


def test_quoted_cells_keep_their_line_ends(spark, tmp_path):
    spark.dataSource.register(readers.SheetSource)
    (tmp_path / "s.csv").write_bytes('﻿title\r\nname,note\r\na,"two\r\nlines, ""quoted"""\r\nb,\r\n'.encode())
    got = spark.read.format("sheet").schema("name string, note string").options(path=f"file://{tmp_path}/s.csv", headerrow=2).load().collect()
    assert [tuple(r) for r in got] == [("a", 'two\r\nlines, "quoted"'), ("b", None)]
