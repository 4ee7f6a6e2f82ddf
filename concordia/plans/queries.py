"""Queries over the test tables, by operator, and the SQL that gives the same rows.

Line items are read as claims: the part is the component, the order the document, the quantity the value, the line status
the source tier and the return flag the condition; which field a part's claims are about follows from its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import values
from concordia.operators import audit, claims, confidence, conflicts, documents, identity, jobs, retrieval, security
from concordia.plans import policy
from concordia.plans.schema import DIMENSIONS
from concordia.sources.folders import checkpoint_folder
from concordia.streaming import streams

FIELDS = ("nameplate_power", "rated_ac_power", "no_load_loss", "impedance_percent", "warranty_years", "price_per_watt_dc")
KEYS = ("part", "field_name")
AS_OF = "2024-02-01 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- line items as claims ------------------------------------------------------------------------------------------


def line_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with part in place of the component's columns."""
    li = table(spark, sf_dir, "lineitem")
    field = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (F.col("l_partkey") % len(FIELDS) + 1).cast("int"))
    condition = F.struct(*[(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")) if d == "basis" else F.lit(None).cast("string" if d in ("side", "weighting", "standards_regime", "rte_boundary") else "double")).alias(d) for d in DIMENSIONS], F.lit(None).cast("string").alias("note"))
    ref = F.struct(F.col("l_orderkey").cast("string").alias("document_id"), F.lit(None).cast("string").alias("url"), F.concat_ws("-", "l_linenumber", "l_suppkey").alias("section"), F.lit(None).cast("string").alias("source_authority"))
    return li.select(
        F.col("l_partkey").alias("part"), field.alias("field_name"), F.col("l_orderkey").cast("string").alias("document_id"), F.lit("v1").alias("extractor_version"), condition.alias("condition"),
        values.number(F.col("l_quantity").cast("double"), canon=F.col("l_quantity").cast("decimal(18,1)").cast("string")).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("verbatim_value"),
        F.when(F.col("l_linestatus") == "F", "system_of_record").otherwise("web_supplement").alias("source_tier"), ref.alias("source_ref"), (1 - F.col("l_discount")).alias("confidence"),
    )


_CLAIMS = f"""c AS (SELECT l_partkey AS part, list_extract({list(FIELDS)}, CAST(l_partkey % {len(FIELDS)} + 1 AS INTEGER)) AS field_name, l_orderkey AS doc,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS basis, CAST(l_quantity AS DOUBLE) AS v, CASE WHEN l_linestatus = 'F' THEN 'system_of_record' ELSE 'web_supplement' END AS tier,
  1 - l_discount AS confidence, l_linenumber, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem)"""
_PAIRS = f"""{_CLAIMS}, n AS (SELECT part, basis, count(DISTINCT v) AS dv FROM c GROUP BY ALL),
p AS (SELECT a.part, a.field_name, a.doc AS ad, b.doc AS bd, a.tier AS ta, b.tier AS tb, a.v AS av, b.v AS bv, na.dv AS adv, nb.dv AS bdv FROM c a JOIN c b ON a.part = b.part AND a.id < b.id
  AND coalesce(a.basis = b.basis, true) JOIN n na ON na.part = a.part AND na.basis IS NOT DISTINCT FROM a.basis JOIN n nb ON nb.part = b.part AND nb.basis IS NOT DISTINCT FROM b.basis),
k AS (SELECT *, CASE WHEN ta <> tb THEN 'record_vs_web' WHEN ad = bd THEN 'intra_document' ELSE 'inter_document' END AS cls, CASE WHEN ta = 'system_of_record' THEN av ELSE bv END AS decl,
  CASE WHEN ta = 'system_of_record' THEN bv ELSE av END AS meas, greatest(abs(av), abs(bv)) AS big, abs(av - bv) AS diff FROM p),
d AS (SELECT *, CASE field_name WHEN 'nameplate_power' THEN diff > 1.0 WHEN 'rated_ac_power' THEN diff > greatest(0.01 * big, 0.05) WHEN 'no_load_loss' THEN (CASE WHEN ta = tb THEN diff > 0.05 ELSE meas - decl > greatest(0.15 * abs(decl), 0.05) END)
  WHEN 'impedance_percent' THEN diff > greatest((CASE WHEN big < 10 THEN 0.10 ELSE 0.075 END) * big, 0.05) ELSE diff > 0.05 END AS conflicts,
  CASE field_name WHEN 'nameplate_power' THEN 1.0 WHEN 'rated_ac_power' THEN 0.01 * big WHEN 'no_load_loss' THEN 0.15 * big WHEN 'impedance_percent' THEN 0.075 * big END AS band FROM k),
s AS (SELECT *, CASE WHEN conflicts THEN least(4, greatest(0, (CASE WHEN field_name IN ('warranty_years', 'price_per_watt_dc') THEN 3 ELSE 2 END)
  + (CASE WHEN (CASE WHEN band > 0 THEN diff >= 10 * band ELSE big / least(av, bv) >= 10 END) THEN 1 ELSE 0 END)
  + (CASE WHEN cls = 'inter_document' AND ta = 'system_of_record' AND tb = 'system_of_record' THEN 1 ELSE 0 END) + (CASE WHEN greatest(adv, bdv) >= 3 THEN 1 ELSE 0 END))) END AS sev FROM d)"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.detect(line_claims(spark, sf_dir), KEYS, ascii_only=True)


@query(f"WITH {_PAIRS} SELECT field_name, conflicts, CASE WHEN conflicts THEN cls END AS conflict_class, sev AS severity, count(*) AS n FROM s GROUP BY ALL")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which comparable claims about one field disagree, in what way and how gravely."""
    return _detected(spark, sf_dir).groupBy("field_name", "conflicts", "conflict_class", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIRS} SELECT part, field_name, count(*) AS n_pairs, sum(av * bv) AS products, max(abs(av - bv)) AS farthest FROM p GROUP BY ALL")
def comparison_pairs(spark, sf_dir):
    slim = line_claims(spark, sf_dir).select(*KEYS, F.struct("document_id", "source_ref.section", "value.num", "source_tier", "confidence", "condition.basis").alias("ord"), "condition")
    return conflicts.comparison_pairs(slim, KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("l.ord.num") * F.col("r.ord.num")).alias("products"), F.max(F.abs(F.col("l.ord.num") - F.col("r.ord.num"))).alias("farthest"))


@query(f"WITH {_PAIRS} SELECT t.threshold, count_if(s.sev > t.threshold) AS n_blocking, count_if(s.sev > t.threshold) > 0 AS blocks FROM s, (VALUES (2), (3)) t(threshold) GROUP BY ALL")
def gate_blocks(spark, sf_dir):
    graded = _detected(spark, sf_dir).select("severity", F.lit(None).cast("string").alias("resolution"))
    return conflicts.gates(graded, (2, 3))


@query(f"WITH {_CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY part, basis ORDER BY tier <> 'system_of_record', confidence DESC, CAST(doc AS VARCHAR), CAST(CAST(v AS DECIMAL(18,1)) AS VARCHAR)) AS rn, count(DISTINCT v) OVER (PARTITION BY part, basis) AS dv, count(*) OVER (PARTITION BY part, basis) AS n_claims FROM c) SELECT part, field_name, basis, v AS preferred, tier AS source_tier, round(confidence, 4) AS confidence, n_claims, CASE WHEN dv > 1 THEN 'open' ELSE 'none' END AS conflict_status FROM r WHERE rn = 1")
def canonical_projection(spark, sf_dir):
    p = claims.project(line_claims(spark, sf_dir), KEYS)
    return p.select(*KEYS, "condition.basis", F.col("value.num").alias("preferred"), "source_tier", F.round("confidence", 4).alias("confidence"), "n_claims", "conflict_status")


def _component_claims(spark, sf_dir):
    c = line_claims(spark, sf_dir)
    return c.withColumns({"component_category": F.lit("pv"), "supplier": F.lit("s"), "model": F.col("part").cast("string"), "nameplate": F.lit(None).cast("double")}).drop("part")


@query(f"WITH {_CLAIMS} SELECT part, doc AS document_id, basis, count(DISTINCT v) AS n_asserted FROM c GROUP BY ALL HAVING count(DISTINCT v) > 1")
def contradictions(spark, sf_dir):
    found = claims.contradictions(_component_claims(spark, sf_dir))
    return found.select(F.col("model").cast("long").alias("part"), F.col("document_id").cast("long").alias("document_id"), F.get_json_object("condition_text", "$.basis").alias("basis"), "n_asserted")


@query(f"WITH {_CLAIMS}, u AS (SELECT DISTINCT part, field_name, doc, basis, v, tier, confidence, l_linenumber, l_suppkey FROM c) SELECT CAST(part AS VARCHAR) AS model, field_name, count(*) AS n, max(v) AS top, min(doc) AS first_document FROM u GROUP BY ALL")
def canonical_claims(spark, sf_dir):
    c = _component_claims(spark, sf_dir)
    return claims.canonical_claims(c.unionByName(c)).groupBy("model", "field_name").agg(F.count(F.lit(1)).alias("n"), F.max("value.num").alias("top"), F.min(F.col("document_id").cast("long")).alias("first_document"))


@query(f"WITH {_CLAIMS} SELECT part, basis, count(*) AS n_members, min(v) AS least FROM c GROUP BY ALL")
def comparison_groups(spark, sf_dir):
    c = line_claims(spark, sf_dir).withColumn("ord", F.struct(F.col("value.num").alias("v"), "document_id", "source_ref.section"))
    g = conflicts.comparison_groups(c.select(*KEYS, "ord", "condition", "confidence"), KEYS)
    return g.select("part", "condition_key.basis", F.size("members").alias("n_members"), F.col("members")[0]["ord"]["v"].alias("least"))


@query(f"WITH {_CLAIMS} SELECT part, basis, count(DISTINCT v) AS distinct_values, count(DISTINCT v) >= 3 AS matcher_failure FROM c GROUP BY ALL")
def matcher_failures(spark, sf_dir):
    v = conflicts.value_counts(line_claims(spark, sf_dir), KEYS)
    return v.select("part", F.get_json_object("condition_text", "$.basis").alias("basis"), "distinct_values", (F.col("distinct_values") >= 3).alias("matcher_failure"))


@query(f"WITH {_CLAIMS}, s AS (SELECT DISTINCT part, field_name, coalesce(basis, '-') AS b FROM c), i AS (SELECT DISTINCT part, field_name, coalesce(basis, '-') AS b FROM c WHERE tier = 'web_supplement') SELECT s.part, s.b AS basis FROM s WHERE part IN (SELECT part FROM i) AND (part, b) NOT IN (SELECT part, b FROM i)")
def lost_groups(spark, sf_dir):
    c = claims.with_condition_text(line_claims(spark, sf_dir))
    stored = c.select(*KEYS, "condition_text", "value", "condition.basis").dropDuplicates([*KEYS, "condition_text"])
    incoming = c.where("source_tier = 'web_supplement'").select(*KEYS, "condition_text").distinct()
    return claims.lost_groups(stored, incoming, KEYS).select("part", F.coalesce("basis", F.lit("-")).alias("basis"))


@query(f"WITH {_CLAIMS}, r AS (SELECT DISTINCT part, coalesce(basis, '-') AS b FROM c WHERE tier = 'system_of_record'), w AS (SELECT part, coalesce(basis, '-') AS b, doc FROM c WHERE tier = 'web_supplement') SELECT part, count(*) AS n FROM w WHERE (part, b) IN (SELECT part, b FROM r) GROUP BY ALL")
def overwrite_guard(spark, sf_dir):
    c = claims.with_condition_text(line_claims(spark, sf_dir))
    return claims.overwrites(c, c, KEYS).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_POLICY = "pol AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {c})" for f, c in sorted(policy.CRITICALITY.items())) + ") t(field_name, criticality)), tier AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{t}')" for f, t in sorted(policy.TIERS.items())) + ") t(field_name, tier)), tol AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{r}', {'NULL' if m is None else m})" for f, r, m, _, _ in policy.TOLERANCES) + ") t(field_name, rule, magnitude))"


@query(f"WITH {_POLICY}, f AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'cycle_life' WHEN 1 THEN 'load_loss' WHEN 2 THEN 'certifications' ELSE lower(p_brand) END AS field_name FROM part) SELECT f.field_name, coalesce(rule, 'exact') AS rule, magnitude, coalesce(criticality, 4) AS criticality, coalesce(tier, 'b') AS tier FROM f LEFT JOIN tol USING (field_name) LEFT JOIN pol USING (field_name) LEFT JOIN tier USING (field_name)")
def policy_lookup(spark, sf_dir):
    k = F.col("p_partkey") % 4
    f = table(spark, sf_dir, "part").select(F.when(k == 0, "cycle_life").when(k == 1, "load_loss").when(k == 2, "certifications").otherwise(F.lower("p_brand")).alias("field_name")).distinct()
    return policy.with_policy(f).select("field_name", "rule", "magnitude", "criticality", "tier")


@query("SELECT p_brand AS brand, count(*) AS n, count_if(p_retailprice - p_retailprice * p_size / 100.0 <= l_extendedprice / l_quantity AND l_extendedprice / l_quantity <= p_retailprice + p_retailprice * p_size / 100.0) AS n_agree FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def declared_bands(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size").cast("double")
    low, high = conflicts.resolve_band(F.col("p_retailprice"), F.struct((-size).alias("low"), size.alias("high"), F.lit("relative").alias("kind")))
    point = F.col("l_extendedprice") / F.col("l_quantity")
    return j.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"), F.count_if((low <= point) & (point <= high)).alias("n_agree"))


def _supplier_claims(spark, sf_dir, value: Column, unit: Column, field: str):
    s = table(spark, sf_dir, "supplier")
    none = F.struct(*[F.lit(None).cast("string" if d in ("basis", "side", "weighting", "standards_regime", "rte_boundary") else "double").alias(d) for d in DIMENSIONS], F.lit(None).cast("string").alias("note"))
    ref = F.struct(F.col("s_suppkey").cast("string").alias("document_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("source_authority"))
    return s.select(F.col("s_nationkey").alias("part"), F.lit(field).alias("field_name"), F.col("s_suppkey").cast("string").alias("document_id"), F.lit("v1").alias("extractor_version"), none.alias("condition"), value.alias("value"), unit.alias("unit"), F.lit(None).cast("string").alias("verbatim_value"), F.lit("web_supplement").alias("source_tier"), ref.alias("source_ref"), F.lit(0.9).alias("confidence"))


@query("WITH t AS (SELECT s_nationkey AS part, s_suppkey AS id, 'iec ' || (s_suppkey % 3) AS base, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 2015 + s_suppkey % 4 END AS y FROM supplier) SELECT CASE WHEN a.base <> b.base THEN 'inter_document' WHEN a.y <> b.y THEN 'temporal' END AS conflict_class, count(*) AS n FROM t a JOIN t b ON a.part = b.part AND a.id < b.id GROUP BY ALL")
def text_verdicts(spark, sf_dir):
    k = F.col("s_suppkey")
    year = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" :"), (k % 4 + 2015).cast("string")))
    c = _supplier_claims(spark, sf_dir, values.text(F.concat(F.lit("IEC  "), (k % 3).cast("string"), year)), F.lit(None).cast("string"), "standards")
    return conflicts.detect(c, KEYS, ascii_only=True).groupBy("conflict_class").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT s_nationkey AS part, s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'kw' ELSE 'w' END AS u, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 1000.0 END * (s_suppkey % 3 + 1) AS v, CASE WHEN s_suppkey % 2 = 0 THEN 1000.0 ELSE 1.0 END AS k FROM supplier), n AS (SELECT part, count(DISTINCT v) AS dv FROM t GROUP BY ALL), p AS (SELECT a.u <> b.u AS unit, a.v * a.k AS x, b.v * b.k AS y, dv FROM t a JOIN t b ON a.part = b.part AND a.id < b.id JOIN n ON n.part = a.part), r AS (SELECT *, CASE WHEN unit THEN 'unit_normalization' WHEN x <> y AND greatest(x, y) * 1.0 > least(x, y) THEN 'inter_document' END AS cls FROM p) SELECT cls AS conflict_class, CASE WHEN cls IS NOT NULL THEN greatest(0, least(4, 2 + (CASE WHEN greatest(x, y) / least(x, y) >= 10 THEN 1 ELSE 0 END) + (CASE WHEN dv >= 3 THEN 1 ELSE 0 END) - (CASE WHEN unit AND x = y THEN 2 ELSE 0 END))) END AS severity, count(*) AS n FROM r GROUP BY ALL")
def unit_reconciliation(spark, sf_dir):
    k = F.col("s_suppkey")
    v = F.when(k % 2 == 0, 1.0).otherwise(1000.0) * (k % 3 + 1)
    c = _supplier_claims(spark, sf_dir, values.number(v, canon=v.cast("decimal(18,1)").cast("string")), F.when(k % 2 == 0, "kW").otherwise("W"), "rating_mva")
    return conflicts.detect(c, KEYS, ascii_only=True).groupBy("conflict_class", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= 10 THEN 2 ELSE 3 END AS decimals FROM lineitem")
def printed_decimals(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    printed = F.concat(F.lit("@ 25 degC: "), F.when(q >= 10, F.concat(q.cast("int").cast("string"), F.lit(".00"))).otherwise(F.concat(q.cast("int").cast("string"), F.lit(".000"))), F.lit(" %"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.printed_decimals(printed, q, F.lit(False), F.lit("0.0")).alias("decimals"))


# -- confidence ----------------------------------------------------------------------------------------------------

_SIGNALS = "g AS (SELECT d.doc_id, d.source, l.quality, l.toxic, least(1.0, d.n_chars / 4000.0) AS ocr FROM documents d LEFT JOIN labels l USING (doc_id)), f AS (SELECT *, round(0.30 * coalesce(CAST(quality = 1 AS INTEGER), 0.5) + 0.25 * coalesce(CAST(toxic = 0 AS INTEGER), 0.5) + 0.20 * coalesce(ocr, 0.5) + 0.15 * 0.5 + 0.05 * CAST(ocr > 0.1 AS INTEGER) + 0.05 * 1, 10) AS confidence, CASE WHEN doc_id % 7 = 0 THEN 'a' ELSE 'b' END AS tier FROM g)"


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ocr = F.least(F.lit(1.0), F.col("n_chars") / 4000.0)
    signals = {"schema_valid": F.col("quality") == 1, "cross_field_consistent": F.col("toxic") == 0, "ocr_confidence": ocr, "second_read_agrees": F.lit(None).cast("boolean"), "unit_normalised": ocr > 0.1, "had_text_layer": F.lit(True)}
    return d.select("doc_id", "source", "quality", "toxic", confidence.fuse(signals).alias("confidence"), F.when(F.col("doc_id") % 7 == 0, "a").otherwise("b").alias("tier"))


@query(f"WITH {_SIGNALS} SELECT doc_id, round(confidence, 6) AS confidence, tier = 'a' OR confidence < 0.7 AS requires_review FROM f")
def confidence_routing(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("doc_id", F.round("confidence", 6).alias("confidence"), confidence.requires_review(F.col("tier"), F.col("confidence"), 0.7).alias("requires_review"))


@query(f"WITH {_SIGNALS} SELECT round(avg(CAST(tier = 'a' OR confidence < 0.7 AS DOUBLE)), 6) AS review_share FROM f")
def review_share(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("requires_review", confidence.requires_review(F.col("tier"), F.col("confidence"), 0.7))
    return confidence.review_share(s).select(F.round("review_share", 6).alias("review_share"))


@query(f"WITH {_SIGNALS}, r AS (SELECT tier, confidence AS score, count(*) OVER w AS n, sum(CAST(quality = 1 AS INTEGER)) OVER w / count(*) OVER w AS precision, count(*) OVER w / count(*) OVER (PARTITION BY tier) AS coverage FROM f WHERE quality IS NOT NULL WINDOW w AS (PARTITION BY tier ORDER BY confidence DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT tier, min(score) AS threshold, round(max(coverage), 6) AS coverage FROM r WHERE precision >= 0.9 GROUP BY ALL")
def precision_thresholds(spark, sf_dir):
    s = _scored(spark, sf_dir).where("quality is not null").withColumn("correct", F.col("quality") == 1).withColumnRenamed("confidence", "score")
    return confidence.thresholds(s, ["tier"], 0.9).select("tier", "threshold", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_SIGNALS} SELECT DISTINCT tier, confidence AS score, count(*) OVER w AS n, round(sum(CAST(quality = 1 AS INTEGER)) OVER w / count(*) OVER w, 9) AS precision, round(count(*) OVER w / count(*) OVER (PARTITION BY tier), 9) AS coverage FROM f WHERE quality IS NOT NULL WINDOW w AS (PARTITION BY tier ORDER BY confidence DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def risk_coverage(spark, sf_dir):
    """Every point of the curve, by prefix sums over ranges of scores."""
    s = _scored(spark, sf_dir).where("quality is not null").withColumn("correct", F.col("quality") == 1).withColumnRenamed("confidence", "score")
    return confidence.risk_coverage(s, ["tier"]).select("tier", "score", "n", F.round("precision", 9).alias("precision"), F.round("coverage", 9).alias("coverage"))


@query(f"WITH {_SIGNALS} SELECT doc_id, concat_ws(',', CASE WHEN quality IS NULL THEN 'missing_data' END, CASE WHEN source = 'src0' THEN 'web_supplemented' END, CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN toxic = 1 THEN 'unresolved_conflict' END) AS flags FROM f")
def cell_flags(spark, sf_dir):
    tier = F.when(F.col("source") == "src0", "web_supplement").otherwise("system_of_record")
    status = F.when(F.col("toxic") == 1, "open").otherwise("none")
    return _scored(spark, sf_dir).select("doc_id", F.array_join(confidence.flags(F.col("quality").isNotNull(), tier, F.col("confidence"), status, 0.7), ",").alias("flags"))


@query(f"WITH {_CLAIMS}, o AS (SELECT part, field_name FROM c GROUP BY part, field_name, basis HAVING count(DISTINCT v) > 1) SELECT part, array_to_string(list_sort(list(DISTINCT field_name)), ',') AS unresolved FROM o GROUP BY ALL")
def unresolved_fields(spark, sf_dir):
    u = confidence.unresolved_fields(claims.project(line_claims(spark, sf_dir), KEYS), ["part"])
    return u.select("part", F.array_join("unresolved", ",").alias("unresolved"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN abs(l_extendedprice - l_quantity * l_tax * 1000) > 0.005 * l_extendedprice THEN 'power' END, CASE WHEN l_quantity <= 10 THEN 'voltage' END, CASE WHEN l_tax <= l_discount THEN 'current' END) AS broken FROM lineitem")
def plausibility(spark, sf_dir):
    q, imp = F.col("l_quantity").cast("double"), F.col("l_tax") * 1000
    none = F.lit(None).cast("double")
    broken = confidence.plausible_module(F.col("l_extendedprice"), q, imp, 2 * q - 10, imp + F.col("l_tax") - F.col("l_discount"), none, none)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(broken, ",").alias("broken"))


@query("SELECT l_orderkey, count(*) AS n, count_if(l_linenumber % 3 = 0 AND has_other OR l_discount > 0.08) AS n_gated FROM (SELECT *, max(CAST(l_linenumber % 3 <> 0 AS INTEGER)) OVER (PARTITION BY l_orderkey) = 1 AS has_other FROM lineitem) GROUP BY ALL")
def hard_gates(spark, sf_dir):
    t = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("string"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", t.alias("value_text"), F.concat(F.lit("qty "), F.coalesce(t, F.lit(""))).alias("source_text"), F.lit(True).alias("parsers_agree"), (F.col("l_discount") <= 0.08).alias("plausible"), F.lit(False).alias("poor_scan"))
    return confidence.hard_gates(d, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("hard_gate").alias("n_gated"))


@query(f"WITH {_CLAIMS} SELECT CASE WHEN field_name = 'nameplate_power' THEN coalesce(basis, 'stc') ELSE coalesce(basis, 'rated') END AS basis, basis IS NULL AS derived, count(*) AS n FROM c GROUP BY ALL")
def condition_defaults(spark, sf_dir):
    c = line_claims(spark, sf_dir)
    c = c.withColumn("condition", F.col("condition").withField("derived", F.lit(None).cast("array<string>")))
    d = claims.default_conditions(c, {"nameplate_power": {"basis": "stc"}}, {"basis": "rated"})
    return d.groupBy("condition.basis", (F.size("condition.derived") > 0).alias("derived")).agg(F.count(F.lit(1)).alias("n"))


# -- identity ------------------------------------------------------------------------------------------------------

#: Four spellings of two names, two families with odd hyphens and widths, voltages that only precision tells apart.
_MODEL = """m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN 'rec solar' ELSE 'trina solar' END AS mk, CASE WHEN p_partkey % 2 = 0 THEN 'tsm #' ELSE 'jkm #' END AS family, p_size, p_partkey // 4 % 2 = 0 AS blk, 400.0 + p_size AS nameplate,
  CASE WHEN p_partkey % 5 <> 0 THEN 400.0 + p_size + (p_partkey % 2) * 0.5 END AS pmax, CASE WHEN p_partkey % 7 = 0 THEN 10000000.0 + (p_partkey % 4 // 2) * 0.4 END AS voc FROM part)"""


def _products(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    name = F.when(k % 3 == 2, F.when(k % 2 == 0, "REC Solar Pte. Ltd.").otherwise("REC\u2003SOLAR (Pte) Ltd")).otherwise(F.when(k % 2 == 0, "Trina Solar Co., Ltd").otherwise("Tr\u00edna Solar GmbH"))
    series = F.when(k % 4 == 0, "TSM-").when(k % 4 == 2, "Tsm\u2010").when(k % 4 == 1, "JKM ").otherwise("\uff2aKM-")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), name.alias("manufacturer"), F.concat(series, (F.col("p_size") + 400).cast("string"), F.when(F.floor(k / 4) % 2 == 0, " BLK").otherwise("")).alias("model"), (size + 400).alias("nameplate"), F.when(k % 5 != 0, size + 400 + (k % 2) * 0.5).alias("pmax"),
        F.when(k % 7 == 0, F.lit(1e7) + F.floor(k % 4 / 2) * 0.4).alias("voc"), F.lit(None).cast("double").alias("isc"),
    )


@query(f"WITH {_MODEL} SELECT id, mk AS manufacturer_key, family AS model_family, substr(sha256(mk || chr(31) || family || chr(31) || CAST(CAST(nameplate AS DECIMAL(18,1)) AS VARCHAR)), 1, 16) AS surrogate_id FROM m")
def identity_keys(spark, sf_dir):
    return identity.identity_keys(_products(spark, sf_dir)).select("id", "manufacturer_key", "model_family", "surrogate_id")


@query(f"""WITH {_MODEL}, k AS (SELECT *, row_number() OVER (ORDER BY mk, family, p_size, blk, pmax, voc) AS c FROM (SELECT mk, family, p_size, blk, pmax, voc, count(*) AS n FROM m GROUP BY ALL)),
p AS (SELECT CASE WHEN a.c = b.c THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n, a.family = b.family AS fam, abs(a.p_size - b.p_size) <= 1 AS bin, a.blk = b.blk OR a.mk = 'rec solar' AS ok, abs(a.pmax - b.pmax) <= 1 AS pm, abs(a.voc - b.voc) <= 0.05 AS vo FROM k a JOIN k b ON a.mk = b.mk AND a.c <= b.c),
t AS (SELECT n, ok, coalesce(pm, true) AND coalesce(vo, true) AND coalesce(pm, vo) IS NOT NULL AS el, 35 + 30 * CAST(fam AS INTEGER) + 15 * CAST(bin AS INTEGER) + 10 * CAST(ok AS INTEGER) AS s FROM p),
u AS (SELECT n, ok, el, s + 10 * CAST(el AS INTEGER) AS s FROM t)
SELECT s / 100.0 AS score, CASE WHEN s >= 90 AND el AND ok THEN 'same_product' WHEN s >= 70 THEN 'variant_mismatch' ELSE 'distinct' END AS outcome, CAST(sum(n) AS BIGINT) AS n FROM u WHERE n > 0 GROUP BY ALL""")
def identity_scores(spark, sf_dir):
    """All pairs of one manufacturer, counted by score and outcome."""
    return identity.class_scores(_products(spark, sf_dir)).groupBy(F.round("score", 4).alias("score"), "outcome").agg(F.sum("n_pairs").alias("n"))


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_nationkey, s_name, s_suppkey) AS place FROM supplier")
def component_order(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0").alias("component_category"), F.lit("").alias("manufacturer_key"), F.col("s_name").alias("manufacturer"), F.lit(None).cast("string").alias("model_family"), F.lit("m").alias("model"), F.lit(None).cast("double").alias("nameplate"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0").alias("surrogate_id"))
    return identity.placed(c, checkpoint_folder(spark)).select("id", "place")


# -- documents -----------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src0'), i AS (SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE source <> 'src0' GROUP BY ALL) SELECT doc_id, content_hash FROM i WHERE content_hash NOT IN (SELECT h FROM e)")
def content_ingest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", documents.content_hash(F.col("text")).alias("content_hash"))
    return documents.new_documents(d.where("source <> 'src0'"), d.where("source = 'src0'"), "doc_id").select("doc_id", "content_hash")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def natural_key_duplicates(spark, sf_dir):
    return documents.refuse_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def upserted_state(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", (F.col("event_type") == "error").alias("deleted"))
    return documents.upserted(log, "user_id", "ts", "deleted").select("user_id", "event_id", "event_type")


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(generate_series(0, CAST(greatest(ceil((len(w) - 512) / 461.0), 0) AS BIGINT))) AS chunk_no FROM w WHERE len(w) > 0) SELECT doc_id, chunk_no, least(512, len(w) - chunk_no * 461) AS n_words, md5(array_to_string(list_slice(w, chunk_no * 461 + 1, chunk_no * 461 + 512), ' ')) AS chunk_md5 FROM c")
def text_chunks(spark, sf_dir):
    c = documents.chunks(table(spark, sf_dir, "documents"), id_col="doc_id", size=512, overlap=0.10)
    return c.select("doc_id", "chunk_no", "n_words", F.md5("chunk_text").alias("chunk_md5"))


@query("WITH r AS (SELECT l_orderkey AS d, l_linenumber AS rn, list_sort(list({'h': h, 'v': v})) AS l FROM (SELECT l_orderkey, l_linenumber, 'qty' AS h, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'flag', l_returnflag FROM lineitem) GROUP BY ALL), f AS (SELECT 'table_row' AS chunk_kind, d, md5(array_to_string(list_transform(l, lambda x: x.h || ': ' || x.v), '; ')) AS m FROM r) SELECT chunk_kind, count(*) AS n, count(DISTINCT m) AS n_distinct FROM f GROUP BY ALL UNION ALL SELECT 'table_full', count(DISTINCT l_orderkey), NULL FROM lineitem UNION ALL SELECT 'table_summary', count(DISTINCT l_orderkey), NULL FROM lineitem")
def table_index(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cell = F.explode(F.array(F.struct(F.lit("qty").alias("header"), F.col("l_quantity").cast("int").cast("string").alias("value")), F.struct(F.lit("flag").alias("header"), F.col("l_returnflag").alias("value")))).alias("x")
    cells = li.select(F.col("l_orderkey").alias("document_id"), F.lit("t").alias("table_id"), F.col("l_linenumber").alias("row_no"), cell).select("document_id", "table_id", "row_no", "x.*")
    c = documents.table_chunks(cells)
    return c.groupBy("chunk_kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("chunk_kind") == "table_row", F.md5("chunk_text"))).alias("n_distinct")).withColumn("n_distinct", F.when(F.col("chunk_kind") == "table_row", F.col("n_distinct")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 0.5 AS value, CASE WHEN l_returnflag = 'A' THEN '%/k' ELSE 'wp' END AS unit FROM lineitem")
def unit_parsing(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    raw = F.when(F.col("l_returnflag") == "A", F.concat(q, F.lit(",5 %/°C"))).otherwise(F.concat(q, F.lit(".5 Wp")))
    n = documents.normalize_unit(raw)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n["value"].alias("value"), n["unit"].alias("unit"))


_EVIDENCE = ", ".join(f"('{w}', '{t}', {x})" for w, t, x in documents.EVIDENCE)


@query(f"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'purchase order' ELSE lower(html) END AS h FROM pages), e AS (SELECT * FROM (VALUES {_EVIDENCE}) e(word, type, weight)),
s AS (SELECT page_id, type, round(sum(weight * ln(1 + (length(h) - length(replace(h, word, ''))) / length(word))), 9) AS s FROM p, e GROUP BY ALL), r AS (SELECT page_id, list({{'s': s, 't': type}} ORDER BY s DESC, type DESC) AS r FROM s GROUP BY page_id)
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'csv' WHEN 2 THEN 'pdf' ELSE 'unknown' END AS signature, CASE WHEN r[1].s >= {documents.DECIDED} AND r[1].s - r[2].s >= {documents.LEAD} THEN r[1].t END AS document_type FROM r""")
def content_routing(spark, sf_dir):
    """Pages as they are, and in place of some of them a table with quoted delimiters, a PDF, and prose with commas."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    content = F.when(k == 1, F.concat(F.lit('id;"a;b"\n'), n, F.lit(';"x, y"\n'))).when(k == 2, F.concat(F.lit("%PDF-1.7 "), n, F.lit(",1\n2,3"))).when(k == 3, F.concat(F.lit("Purchase order "), n, F.lit(", two, three\nand one line more, as text\n"))).otherwise(F.col("html"))
    p = table(spark, sf_dir, "pages").select("page_id", content.alias("content"))
    return p.select("page_id", documents.content_signature(F.col("content").cast("binary")).alias("signature"), documents.classify(F.col("content")).alias("document_type"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 OR n_chars < 0.1 * (n_chars + doc_id * 10) OR doc_id % 11 = 0 THEN 'parse_failed' ELSE 'parsed' END AS parse_status FROM documents")
def parse_audits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") + F.col("doc_id") * 10).alias("raw_chars"), F.lit(0).alias("n_cells"), (F.col("doc_id") % 11 == 0).alias("has_table"))
    return documents.parse_audit(d).select("doc_id", "parse_status")


# -- retrieval -----------------------------------------------------------------------------------------------------


def _first_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS sim FROM embeddings, q WHERE label = 3 ORDER BY sim DESC, vec_id LIMIT 10")
def exact_top_k(spark, sf_dir):
    e = retrieval.scoped(table(spark, sf_dir, "embeddings"), label=3)
    return retrieval.top_k(e, _first_vector(spark, sf_dir), 10, id_col="vec_id").select("vec_id", "sim")


_QUERY = "the thing and other station"


@query(f"WITH q AS (SELECT list_distinct(regexp_extract_all(lower('{_QUERY}'), '[0-9a-z]+')) AS q) SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+')), q)) / len(q), 6) AS sim FROM documents, q WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]+')), q)) > 0 ORDER BY sim DESC, doc_id LIMIT 20")
def lexical_search(spark, sf_dir):
    return retrieval.lexical(table(spark, sf_dir, "documents"), _QUERY, 20, id_col="doc_id", text_col="text").select("doc_id", "sim")


_TRI = "list_distinct(list_transform(generate_series(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 3)))"


@query(f"WITH s AS (SELECT s_suppkey AS id, '  ' || trim(regexp_replace(lower(s_name), '[^0-9a-z]+', ' ', 'g')) || ' ' AS t FROM supplier), g AS (SELECT id, {_TRI} AS g FROM s), q AS (SELECT {_TRI} AS q FROM (SELECT '  supplier 000000001 ' AS t)) SELECT id, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS sim FROM g, q WHERE len(list_intersect(g, q)) > 0 ORDER BY sim DESC, id LIMIT 15")
def trigram_search(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return retrieval.trigram(s, "Supplier#000000001", 15, id_col="id", text_col="name").select("id", "sim")


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), a AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS sim FROM embeddings, q ORDER BY sim DESC, vec_id LIMIT 50), b AS (SELECT vec_id, round(1.0 / (1 + label), 6) AS sim FROM embeddings ORDER BY sim DESC, vec_id LIMIT 50), r AS (SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY sim DESC, vec_id)) AS s FROM a UNION ALL SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY sim DESC, vec_id)) FROM b) SELECT vec_id, round(sum(s), 8) AS score FROM r GROUP BY ALL ORDER BY score DESC, vec_id LIMIT 20")
def rank_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = retrieval.top_k(e, _first_vector(spark, sf_dir), 50, id_col="vec_id")
    b = e.withColumn("sim", F.round(1.0 / (1 + F.col("label")), 6)).orderBy(F.desc("sim"), "vec_id").limit(50)
    return retrieval.fuse([a, b], 20, id_col="vec_id").select("vec_id", F.round("score", 8).alias("score"))


# -- security ------------------------------------------------------------------------------------------------------


def _secured(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "lang", "n_chars", (F.col("source") == "src0").alias("access_restricted"))


@query("SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE NOT coalesce(source = 'src0', true) GROUP BY ALL")
def row_security(spark, sf_dir):
    return security.secure(_secured(spark, sf_dir), security.Principal()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT d.doc_id % 2 = 0 OR d.source = 'src0' AS restricted, count(*) AS n FROM documents d GROUP BY ALL")
def inherited_restriction(spark, sf_dir):
    d = _secured(spark, sf_dir)
    chunks = d.select("document_id", (F.col("document_id").cast("long") % 2 == 0).alias("access_restricted"))
    return security.inherit(chunks, d).groupBy(F.col("access_restricted").alias("restricted")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS d FROM events) SELECT CASE WHEN l.d IS NULL THEN false ELSE coalesce(x.source = 'src0', true) END AS is_restricted, count(*) AS n FROM l LEFT JOIN documents x ON x.doc_id = l.d GROUP BY ALL")
def restriction_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("document_id"))
    return security.document_is_restricted(e, _secured(spark, sf_dir)).groupBy("is_restricted").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 7 = 0)")
def visible_conflicts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"))
    cand = li.select(F.col("l_orderkey").alias("entry_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), F.col("l_suppkey").cast("string").alias("document_id"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("document_id"), (F.col("s_suppkey") % 7 == 0).alias("access_restricted"))
    return security.visible_conflicts(entries, cand.select("entry_id", "claim_id"), cand.select("claim_id", "document_id").distinct(), docs, security.Principal())


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphaned_rows(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return security.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", parents, "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


# -- audit ---------------------------------------------------------------------------------------------------------

_CHAIN = "e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS payload FROM events), h AS (SELECT *, sha256(user_id || '|' || seq || '|' || payload) AS hash FROM e), l AS (SELECT *, lag(hash) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_hash FROM h)"


def _linked(spark, sf_dir):
    c = audit.simple_chain(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return c.withColumn("stream", F.col("user_id").cast("string"))


@query(f"WITH {_CHAIN} SELECT user_id, event_id, seq, hash, prev_hash FROM l")
def chain_links(spark, sf_dir):
    return _linked(spark, sf_dir).select("user_id", "event_id", "seq", "hash", "prev_hash")


@query(f"WITH {_CHAIN} SELECT user_id, seq, hash FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM l) WHERE rn = 1")
def chain_tips(spark, sf_dir):
    return audit.tips(_linked(spark, sf_dir)).select(F.col("stream").cast("long").alias("user_id"), "seq", "hash")


@query(f"WITH {_CHAIN}, t AS (SELECT * FROM l WHERE event_id % 97 <> 0), x AS (SELECT *, lag(seq) OVER w AS last, lag(hash) OVER w AS before FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT user_id, event_id, CASE WHEN last IS NULL THEN 'missing_start' ELSE 'gap' END AS reason FROM x WHERE seq <> coalesce(last + 1, 0)")
def chain_breaks(spark, sf_dir):
    # Every 97th event is taken away: the verifier must name each link after one.
    return audit.broken_links(_linked(spark, sf_dir).where("event_id % 97 <> 0")).select("user_id", "event_id", "reason")


@query(f"WITH {_CHAIN}, t AS (SELECT * FROM l UNION ALL SELECT user_id, event_id, seq, payload, 'forged' || event_id, prev_hash FROM l WHERE event_id % 50 = 0) SELECT user_id, count(*) AS n_forks FROM (SELECT user_id, prev_hash FROM t GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL")
def chain_forks(spark, sf_dir):
    c = _linked(spark, sf_dir)
    forged = c.where("event_id % 50 = 0").withColumn("hash", F.concat(F.lit("forged"), F.col("event_id").cast("string")))
    f = audit.forks(c.unionByName(forged)).where("reason = 'fork'")
    return f.groupBy(F.col("stream").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n_forks"))


_TEXT = "CASE WHEN value = round(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
_FULL_CHAIN = f"""e AS (SELECT 'doc:' || user_id AS stream, event_type AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, '{{{{"event_id":' || event_id || coalesce(',"value":' || {_TEXT}, '') || '}}}}' AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, CAST(event_id AS VARCHAR)) - 1 AS seq FROM events),
b AS (SELECT stream, seq, '{{{{"actor":"driver","event_type":"' || t || '","payload":' || payload || ',"prev_hash":' AS head, ',"recorded_at":"' || stamp || '","seq":' || seq || ',"stream":"' || stream || '","v":1}}}}' AS tail FROM e),
h AS (SELECT stream, seq, CAST(NULL AS VARCHAR) AS prev_hash, sha256(head || 'null' || tail) AS hash FROM b WHERE seq = 0 UNION ALL SELECT b.stream, b.seq, h.hash, sha256(b.head || '"' || h.hash || '"' || b.tail) FROM h JOIN b ON b.stream = h.stream AND b.seq = h.seq + 1)""".replace("{{", "{").replace("}}", "}")


@query(f"WITH RECURSIVE {_FULL_CHAIN} SELECT stream, seq, prev_hash, hash FROM h")
def full_chain(spark, sf_dir):
    """The sequential chain with canonical JSON preimages, doubles among their numbers."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("doc:"), "user_id").alias("stream"), F.col("user_id").cast("string").alias("document_id"), "event_type", F.lit("driver").alias("actor"), F.to_json(F.struct("event_id", "value")).alias("payload_canonical"), F.col("ts").cast("timestamp").alias("recorded_at"))
    return audit.chain(e).select("stream", "seq", "prev_hash", "hash")


# -- jobs ----------------------------------------------------------------------------------------------------------

_JOBS = f"j AS (SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status, CAST(event_id % 4 AS INTEGER) AS attempt, ts AS created_at, ts + INTERVAL 1 DAY AS next_attempt_at, ts + INTERVAL 15 MINUTE AS lease_expires_at, TIMESTAMP '{AS_OF}' AS as_of FROM events)"


def _jobs(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    running = F.col("event_type") == "view"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.when(running, "running").when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), t.alias("created_at"), (t + F.expr("INTERVAL 1 DAY")).alias("next_attempt_at"),
        F.when(running, "w1").alias("lease_owner"), F.when(running, t + F.expr(jobs.LEASE)).alias("lease_expires_at"), t.alias("updated_at"), F.concat_ws(":", "user_id", "event_type").alias("idempotency_key"),
    )


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


@query(f"WITH {_JOBS} SELECT job_id, 'running' AS status, attempt + 1 AS attempt, as_of + INTERVAL 15 MINUTE AS lease_expires_at FROM j WHERE status = 'pending' AND next_attempt_at <= as_of ORDER BY created_at, job_id LIMIT 25")
def lease_claim(spark, sf_dir):
    return jobs.claim(_jobs(spark, sf_dir), _as_of(), "w2", 25).select("job_id", "status", "attempt", F.col("lease_expires_at").cast("timestamp_ntz").alias("lease_expires_at"))


@query(f"WITH {_JOBS} SELECT CASE WHEN status = 'running' AND lease_expires_at < as_of THEN CASE WHEN attempt >= 3 THEN 'quarantined' ELSE 'pending' END ELSE status END AS status, count(*) AS n FROM j GROUP BY ALL")
def lease_sweep(spark, sf_dir):
    return jobs.sweep(_jobs(spark, sf_dir), _as_of()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("WITH k AS (SELECT event_id AS job_id, user_id || ':' || event_type AS idempotency_key FROM events) SELECT min(job_id) AS job_id, idempotency_key FROM k WHERE job_id % 3 <> 0 AND idempotency_key NOT IN (SELECT idempotency_key FROM k WHERE job_id % 3 = 0) GROUP BY ALL")
def idempotent_enqueue(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return jobs.enqueue(j.where("job_id % 3 = 0"), j.where("job_id % 3 <> 0")).select("job_id", "idempotency_key")


@query(f"WITH {_JOBS} SELECT CASE WHEN attempt >= 3 THEN 'quarantined' ELSE 'pending' END AS status, CASE WHEN attempt < 3 THEN as_of + to_seconds(CAST(60 * pow(2, attempt - 1) AS BIGINT)) END AS next_attempt_at, count(*) AS n FROM j WHERE status = 'failed' GROUP BY ALL")
def retry_backoff(spark, sf_dir):
    f = jobs.failed(_jobs(spark, sf_dir).where("status = 'failed'"), _as_of(), "x")
    return f.groupBy("status", F.col("next_attempt_at").cast("timestamp_ntz").alias("next_attempt_at")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_JOBS} SELECT job_id, CAST(epoch(as_of) - epoch(date_trunc('second', created_at)) AS BIGINT) AS age_seconds FROM j WHERE status <> 'failed'")
def queue_ageing(spark, sf_dir):
    c = _jobs(spark, sf_dir).where("status <> 'failed'").select("job_id", F.date_trunc("second", "created_at").alias("detected_at"), F.lit(None).cast("string").alias("resolution"))
    return conflicts.ageing(c, _as_of()).select("job_id", "age_seconds")


# -- streams and summaries -----------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    return _plain(streams.tumbling(_events(spark, sf_dir)))


@query("SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    return _plain(streams.tumbling(_events(spark, sf_dir), "1 hour", slide="30 minutes"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid")
def session_counts(spark, sf_dir):
    return _plain(streams.sessions(_events(spark, sf_dir)))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_counts(spark, sf_dir):
    """The same windows by a stream that reads the table once; its result is that of the batch."""
    schema = table(spark, sf_dir, "events").schema
    s = streams.stream(spark, f"{sf_dir}/events*.parquet", schema)
    name = f"streamed_{uuid.uuid4().hex}"
    return _plain(streams.run_available(streams.tumbling(s, "1 day"), name, checkpoint_folder(spark), "complete"))


@query("SELECT category, supplier, grouping(category) + grouping(supplier) AS level, count(*) AS n, round(sum(price), 2) AS price FROM (SELECT p_brand AS category, l_suppkey % 10 AS supplier, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ROLLUP (category, supplier)")
def summary_rollup(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("category"), (F.col("l_suppkey") % 10).alias("supplier"), "l_extendedprice")
    return j.rollup("category", "supplier").agg((F.grouping("category").cast("int") + F.grouping("supplier").cast("int")).alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT p_brand AS supplier, p_type AS model, min(CASE WHEN p_size <= 15 THEN p_name END) AS small, min(CASE WHEN p_size > 15 AND p_size <= 30 THEN p_name END) AS middle, min(CASE WHEN p_size > 30 THEN p_name END) AS large FROM part GROUP BY ALL")
def workbook_tab(spark, sf_dir):
    from concordia.sources import sinks

    p = table(spark, sf_dir, "part").select(F.lit("pv").alias("component_category"), F.col("p_brand").alias("supplier"), F.col("p_type").alias("model"), F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 30, "middle").otherwise("large").alias("field_name"), F.col("p_name").alias("value_text"))
    p = p.groupBy("component_category", "supplier", "model", "field_name").agg(F.min("value_text").alias("value_text"))
    return sinks.tab(p, "pv", ["small", "middle", "large"])


@query("WITH r AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45) SELECT p_partkey AS model FROM part WHERE p_partkey NOT IN (SELECT p FROM r)")
def field_gaps(spark, sf_dir):
    comp = table(spark, sf_dir, "part").select(F.lit("pv").alias("component_category"), F.lit("s").alias("supplier"), F.col("p_partkey").cast("string").alias("model"))
    contract = spark.range(1).select(F.lit("pv").alias("component_category"), F.lit("x").alias("field_name"))
    own = _component_claims(spark, sf_dir).withColumn("field_name", F.lit("x")).withColumn("value", F.when(F.col("value.num") > 45, F.col("value")))
    return claims.gaps(comp, contract, own).select(F.col("model").cast("long").alias("model"))


def queries() -> dict:
    from concordia.plans import claim_queries, evidence_queries, search_queries  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from concordia.plans import claim_queries, evidence_queries, search_queries  # noqa: F401

    return dict(SQL)
