"""Queries of candidate sets, versions of the claim store, roles, aliases and user functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.functions import udfs
from concordia.operators import aliases, claims, documents, roles, severity_sets
from concordia.plans.queries import _CLAIMS, _PAIRS, KEYS, line_claims, query, table
from concordia.sources.folders import checkpoint_folder
from concordia.sources.store import Store

_SET_PAIRS = _PAIRS.replace("SELECT a.part, a.field_name,", "SELECT a.part, a.field_name, a.basis AS ab, b.basis AS bb,")


@query(f"""WITH {_SET_PAIRS}, st AS (SELECT DISTINCT part, basis AS sb FROM c WHERE basis IS NOT NULL UNION SELECT part, NULL FROM c GROUP BY part HAVING count(basis) = 0),
m AS (SELECT st.part, sb, any_value(field_name) AS field_name, min(v) AS lo, max(v) AS hi, count(*) AS n_claims, count(DISTINCT v) AS n_values, count(DISTINCT tier) AS tiers, bool_and(tier = 'system_of_record') AS rec, count(DISTINCT doc) AS docs, max(dv) AS dv
  FROM st JOIN c ON c.part = st.part AND (sb IS NULL OR c.basis IS NULL OR c.basis = sb) JOIN n ON n.part = c.part AND n.basis IS NOT DISTINCT FROM c.basis GROUP BY st.part, sb HAVING count(*) > 1),
x AS (SELECT st.part, sb, bool_or(conflicts) AS conflicts FROM d JOIN st ON d.part = st.part AND (sb IS NULL OR coalesce(ab, sb) = sb AND coalesce(bb, sb) = sb) GROUP BY ALL),
g AS (SELECT m.*, coalesce(conflicts, false) AS conflicts, CASE WHEN tiers > 1 THEN 'record_vs_web' WHEN docs = 1 THEN 'intra_document' ELSE 'inter_document' END AS cls,
  CASE field_name WHEN 'nameplate_power' THEN 1.0 WHEN 'rated_ac_power' THEN 0.01 * hi WHEN 'no_load_loss' THEN 0.15 * hi WHEN 'impedance_percent' THEN 0.075 * hi END AS band FROM m LEFT JOIN x ON x.part = m.part AND x.sb IS NOT DISTINCT FROM m.sb)
SELECT part, field_name, sb AS basis, n_claims, n_values, conflicts, CASE WHEN conflicts THEN cls END AS conflict_class, CASE WHEN conflicts THEN least(4, (CASE WHEN field_name IN ('warranty_years', 'price_per_watt_dc') THEN 3 ELSE 2 END)
  + (CASE WHEN (CASE WHEN band > 0 THEN hi - lo >= 10 * band ELSE hi / lo >= 10 END) THEN 1 ELSE 0 END) + (CASE WHEN cls = 'inter_document' AND rec THEN 1 ELSE 0 END) + (CASE WHEN dv >= 3 THEN 1 ELSE 0 END)) END AS severity FROM g""")
def graded_sets(spark, sf_dir):
    """Maximal sets of mutually comparable claims, each graded once."""
    g = severity_sets.graded_sets(line_claims(spark, sf_dir), KEYS, ascii_only=True)
    return g.select(*KEYS, "condition.basis", "n_claims", "n_values", "conflicts", "conflict_class", "severity")


_REPLACED = ("nameplate_power", "warranty_years")
_PREFERRED = "SELECT part, field_name, basis, v AS preferred, n_claims FROM (SELECT *, row_number() OVER (PARTITION BY part, basis ORDER BY tier <> 'system_of_record', confidence DESC, CAST(doc AS VARCHAR), CAST(CAST(v AS DECIMAL(18,1)) AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY part, basis) AS n_claims FROM c {}) WHERE rn = 1"


@query(f"WITH {_CLAIMS}, a AS ({_PREFERRED.format('WHERE doc % 2 = 0')}), b AS ({_PREFERRED.format('')}) SELECT 1 AS version, * FROM a UNION ALL SELECT 2, * FROM a WHERE field_name NOT IN {_REPLACED} UNION ALL SELECT 2, * FROM b WHERE field_name IN {_REPLACED}")
def store_versions(spark, sf_dir):
    """Two versions of a claim store: half of the claims, then two fields replaced from all; both are read after the second commit."""
    c, store = line_claims(spark, sf_dir), Store(spark, checkpoint_folder(spark))
    slim = lambda df: claims.project(df, KEYS).select(*KEYS, "condition.basis", F.col("value.num").alias("preferred"), "n_claims")
    store.commit(slim(c.where(F.col("document_id").cast("long") % 2 == 0)), 0)
    store.commit(slim(c.where(F.col("field_name").isin(*_REPLACED))), 1)
    one, two = (store.read(v).withColumn("version", F.lit(v)) for v in (1, 2))
    return one.unionByName(two)


@query("""WITH RECURSIVE e AS (SELECT 'maker ' || p_partkey AS a, 'maker ' || p_partkey // 2 AS b FROM part WHERE p_partkey % 4 = 0), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS name, a AS other FROM two UNION SELECT r.name, two.b FROM r JOIN two ON two.a = r.other) SELECT name, min(other) AS canonical FROM r GROUP BY name""")
def closed_aliases(spark, sf_dir):
    """Alias pairs closed: the least name that each is another name of."""
    p = table(spark, sf_dir, "part").where("p_partkey % 4 = 0")
    maker = lambda c: F.concat(F.lit("maker "), c.cast("string"))
    return aliases.closed(p.select(maker(F.col("p_partkey")).alias("a"), maker(F.expr("p_partkey div 2")).alias("b")))


_INVERTER = """i AS (SELECT p_partkey, lower(trim(regexp_replace(p_brand, '[.,()/&+\\-\\s]+', ' ', 'g'))) AS maker, p_partkey % 5 = 0 AS domestic, p_type AS series, CASE WHEN p_size % 10 > 0 THEN 1000 + 500 * (p_size % 2) END AS dc, 600 + 30 * (p_partkey % 3) AS ac, 3850 AS amps, p_size % 4 AS mppt FROM part)"""


@query(rf"""WITH {_INVERTER} SELECT p_partkey, domestic, lower(series) || ' up us' AS model_family, CASE WHEN dc IS NOT NULL AND maker <> '' THEN left(sha256(maker || chr(31) || lower(series) || ' up us' || chr(31) || dc || chr(31) || ac || chr(31) || amps || chr(31) || mppt || chr(31) || 'ieee 1547,ul 1741'), 16) END AS inverter_key FROM i""")
def inverter_identities(spark, sf_dir):
    """The power number and the origin are no part of an inverter's key; a missing class leaves it without one."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    origin = F.when(k % 5 == 0, "-DOM").otherwise("")
    model = F.concat("p_type", F.lit(" "), (F.col("p_size") * 100).cast("string"), F.when(k % 2 == 0, " UP").otherwise("/UP"), origin, F.lit("-US"), F.when(k % 3 == 0, " {690 V}").otherwise(""))
    rows = p.select("p_partkey", F.col("p_brand").alias("manufacturer"), model.alias("model"), F.when(F.col("p_size") % 10 > 0, 1000 + 500 * (F.col("p_size") % 2)).alias("dc_voltage_class"), (600 + 30 * (k % 3)).alias("ac_nominal_voltage"), F.lit(3850).alias("ac_nominal_current"), (F.col("p_size") % 4).alias("mppt_count"), F.array(F.lit("UL 1741"), F.lit("IEEE 1547 "), F.lit("ul 1741")).alias("certifications"))
    return aliases.inverter_keys(rows, ascii_only=True).select("p_partkey", "domestic", "model_family", "inverter_key")


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'marketing' WHEN p_partkey % 7 = 1 THEN 'unnamed' ELSE 'structured' END AS "group",
CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 7 <> 1 THEN left(sha256(lower(trim(regexp_replace(p_brand, '[.,()/&+\-\s]+', ' ', 'g'))) || chr(31) || 'st ' || p_size || ' ux 4 h us' || chr(31) || CAST(p_retailprice AS BIGINT)), 16) END AS storage_key FROM (SELECT *, floor(p_retailprice) AS r FROM part)""".replace("CAST(p_retailprice AS BIGINT)", "CAST(r AS BIGINT)"))
def storage_identities(spark, sf_dir):
    """Storage systems by structured model; marketing names without a number get no key."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    model = F.when(k % 3 == 0, F.lit("Grid Stack")).when(k % 7 == 1, F.lit(None)).otherwise(F.concat(F.when(k % 2 == 0, "ST").otherwise("st "), F.col("p_size").cast("string"), F.lit("UX-4H-US")))
    rows = p.select("p_partkey", F.col("p_brand").alias("manufacturer"), model.alias("model"), F.floor("p_retailprice").alias("capacity_kwh"))
    return aliases.storage_keys(rows, ascii_only=True).select("p_partkey", "group", "storage_key")


# -- roles ---------------------------------------------------------------------------------------------------------


def _catalogue(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("old").alias("data_vintage"), F.when(F.col("doc_id") % 5 > 0, F.col("source") == "src0").alias("access_restricted"))
    return roles.Catalogue({"document": d}, {("app", "document"): ("doc_id", "lang")})


_ROLE_ROWS = "d AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 > 0 THEN source = 'src0' END AS r FROM documents)"


@query(f"WITH {_ROLE_ROWS} SELECT 'app' AS role, doc_id, lang, false AS sees_flag FROM d WHERE NOT r UNION ALL SELECT 'app, entitled', doc_id, lang, false FROM d UNION ALL SELECT 'ingest', doc_id, lang, true FROM d")
def role_views(spark, sf_dir):
    """What each role sees of documents: rows by confidentiality, columns by grant; the owners can't log in."""
    c, out = _catalogue(spark, sf_dir), []
    for name, session in (("app", roles.Session("app")), ("app, entitled", roles.Session("app", True)), ("ingest", roles.Session("ingest"))):
        v = c.view(session, "document")
        out.append(v.select(F.lit(name).alias("role"), "doc_id", "lang", F.lit("access_restricted" in v.columns).alias("sees_flag")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_ROLE_ROWS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT coalesce(r, true) THEN 'new' ELSE 'old' END AS by_app, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS by_ingest FROM d")
def role_updates(spark, sf_dir):
    """The same update by two roles: the serving role can't touch rows that it can't see."""
    c = _catalogue(spark, sf_dir)
    changes = c.tables["document"].where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("data_vintage"))
    app, ingest = (c.update(roles.Session(r), "document", changes, "doc_id").select("doc_id", F.col("data_vintage").alias(f"by_{r}")) for r in roles.LOGIN)
    return app.join(ingest, "doc_id")


# -- user functions ------------------------------------------------------------------------------------------------


@query(r"WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents) SELECT doc_id, CAST(k AS INTEGER) AS window_no, CAST(least(100, n - 100 * k) AS INTEGER) AS n_words FROM (SELECT doc_id, n, unnest(range(CAST(ceil(n / 100.0) AS BIGINT))) AS k FROM w)")
def lateral_windows(spark, sf_dir):
    """A table function, used laterally, whose columns follow from its arguments."""
    udfs.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("windowed_documents")
    return spark.sql("SELECT doc_id, window_no, n_words FROM windowed_documents, LATERAL word_windows(text, 100)")


@query("SELECT l_orderkey, round(exp(avg(ln(l_extendedprice))), 4) AS typical FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_orderkey")
def typical_prices(spark, sf_dir):
    """A grouped aggregate over Arrow arrays, for the few lines of an order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(udfs.geometric_mean(F.col("l_extendedprice")), 4).alias("typical"))


@query("SELECT o_orderkey, list_extract(['informational', 'low', 'medium', 'high', 'critical'], CAST(o_orderkey % 6 + 1 AS INTEGER)) AS severity, round(abs(o_totalprice - 1000.0) / greatest(abs(o_totalprice), 1000.0), 6) AS gap FROM orders")
def named_severities(spark, sf_dir):
    """SQL functions of the session."""
    udfs.register(spark)
    table(spark, sf_dir, "orders").createOrReplaceTempView("named_orders")
    return spark.sql("SELECT o_orderkey, severity_name(CAST(o_orderkey % 6 AS INT)) AS severity, round(relative_gap(o_totalprice, 1000.0), 6) AS gap FROM named_orders")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 0.5 AS value, u AS unit, CASE WHEN u = 'furlong' THEN NULL WHEN u = 'mwh' THEN 'wh' ELSE 'w' END AS family, round((l_quantity + 0.5) * CASE u WHEN 'kwp' THEN 1000.0 WHEN 'mwh' THEN 1000000.0 WHEN 'wp' THEN 1.0 END, 3) AS base
FROM (SELECT *, list_extract(['kwp', 'mwh', 'wp', 'furlong'], CAST(l_partkey % 4 + 1 AS INTEGER)) AS u FROM lineitem)""")
def canonical_quantities(spark, sf_dir):
    """Printed quantities in the base unit of their family; an unknown unit has none."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.element_at(F.array(F.lit("kWp"), F.lit("MWh"), F.lit(" Wp"), F.lit("furlong")), (F.col("l_partkey") % 4 + 1).cast("int"))
    q = documents.canonical_quantity(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5 "), unit))
    return li.withColumn("q", q).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q.value", "q.unit", "q.family", F.round("q.base", 3).alias("base"))
