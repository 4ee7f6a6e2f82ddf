"""More queries over the test tables: candidates, checks, bands, queues, retrieval and audit chains, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.functions import text, values
from concordia.operators import audit, claims, confidence, conflicts, documents, jobs, retrieval, security
from concordia.plans import policy
from concordia.plans.queries import _CLAIMS, KEYS, _component_claims, _jobs, _JOBS, _supplier_claims, line_claims, query, table
from concordia.plans.schema import claim_checks, violations
from concordia.sources.folders import checkpoint_folder
from concordia.streaming import streams


# -- candidates and checks -----------------------------------------------------------------------------------------


@query(f"WITH {_CLAIMS} SELECT CAST(part AS VARCHAR) AS model, field_name, tier AS source_tier, 'v1' AS stamped, count(*) AS n, max(v) AS top FROM c GROUP BY ALL")
def stamped_candidates(spark, sf_dir):
    c = claims.as_candidates(_component_claims(spark, sf_dir))
    return c.groupBy("model", "field_name", "source_tier", F.col("source_ref.extractor_version").alias("stamped")).agg(F.count(F.lit(1)).alias("n"), F.max("value.num").alias("top"))


@query(f"WITH {_CLAIMS} SELECT part, field_name, count_if(basis IS NULL) AS n_unstated, count(*) AS n FROM c GROUP BY ALL")
def unstated_conditions(spark, sf_dir):
    return line_claims(spark, sf_dir).groupBy(*KEYS).agg(F.count_if(conflicts.is_unstated(F.col("condition"))).alias("n_unstated"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CLAIMS} SELECT part, v < 5 AS missing, tier = 'web_supplement' AS web, count(*) AS n FROM c GROUP BY ALL")
def missing_and_web(spark, sf_dir):
    c = line_claims(spark, sf_dir).withColumn("value", F.when(F.col("value.num") >= 5, F.col("value")))
    return c.groupBy("part", claims.is_missing().alias("missing"), claims.is_web_supplemented().alias("web")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 1 THEN 'resolved_has_resolution' END, CASE WHEN o_orderstatus = 'P' THEN 'conflict_status' END) AS broken FROM orders")
def field_violations(spark, sf_dir):
    k = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == "F", "resolved").when(k == "O", "open").otherwise("unheard").alias("conflict_status"), F.when(F.col("o_orderkey") % 2 == 0, "select_value").alias("resolution"))
    return o.select("o_orderkey", F.array_join(violations(claims.field_checks()), ",").alias("broken"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_linenumber = 3 THEN 'source_identified' END, CASE WHEN l_suppkey % 7 = 0 THEN 'source_tier' END, CASE WHEN l_discount > 0.05 THEN 'confidence' END, CASE WHEN l_linenumber = 5 THEN 'finite_value' END) AS broken FROM lineitem")
def row_violations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", F.when(F.col("l_linenumber") == 5, F.lit(float("inf"))).otherwise(F.col("l_quantity").cast("double")).alias("v"))
    ref = F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_orderkey").cast("string")).alias("document_id"), F.lit(None).cast("string").alias("url"))
    condition = F.struct(*[F.lit(None).cast("double").alias(d) for d in ("temperature_c", "duration_h", "reference_temperature_c", "tap_position_pct", "base_mva")])
    c = li.withColumns({"source_ref": ref, "value": values.number(F.col("v"), canon=F.col("v").cast("string")), "confidence": F.when(F.col("l_discount") > 0.05, 1.5).otherwise(0.5), "nameplate": F.lit(None).cast("double"), "condition": condition, "source_tier": F.when(F.col("l_suppkey") % 7 == 0, "rumour").otherwise("system_of_record")})
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(violations(claim_checks()), ",").alias("broken"))


@query("SELECT user_id AS entry_id, event_id AS resolution_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_resolutions(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("entry_id"), F.col("event_id").alias("resolution_id"), F.col("ts").alias("resolved_at"))
    return claims.resolutions_first(r).select("entry_id", "resolution_id")


@query(f"WITH {_CLAIMS}, u AS (SELECT DISTINCT part, field_name, doc, basis, v, tier, confidence, l_linenumber, l_suppkey FROM c) SELECT field_name, tier AS source_tier, count(*) AS n, sum(v) AS total FROM u GROUP BY ALL")
def ensemble_claims(spark, sf_dir):
    c = _component_claims(spark, sf_dir)
    both = claims.ensemble([c, c.where("value.num < 25"), c.where("source_tier = 'web_supplement'")])
    return both.groupBy("field_name", "source_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("value.num").alias("total"))


@query("SELECT l_orderkey AS entry_id, count(*) AS n, arg_min(l_linenumber, l_linenumber * 100000 + l_suppkey) AS first_claim, sum(l_quantity) AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem) GROUP BY ALL")
def rebuilt_candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("claim_id"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("ord"), F.col("l_quantity").cast("double").alias("q")).dropDuplicates(["claim_id"])
    junction = conflicts.with_ordinals(li.select("entry_id", "claim_id", "ord")).select("entry_id", "claim_id", "ordinal")
    built = conflicts.rebuild_candidates(junction, li.select("claim_id", "l_linenumber", "q"))
    return built.select("entry_id", F.size("candidates").alias("n"), F.col("candidates")[0]["l_linenumber"].alias("first_claim"), F.aggregate("candidates", F.lit(0.0), lambda s, x: s + x["q"]).alias("total"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1, 3) AS tier_a FROM part")
def tier_a_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "spare_parts_price").when(k == 1, "iec_certification").when(k == 2, F.lower("p_brand")).otherwise("glass_warranty_years")
    return table(spark, sf_dir, "part").select("p_partkey", policy.looks_tier_a(name).alias("tier_a"))


# -- text and values -----------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, 'éclair ' || lower(s_name) || ' fine x' AS folded, CASE s_suppkey % 3 WHEN 0 THEN 'ieee' WHEN 1 THEN 'dc_dc_terminals' ELSE 'full_power' END AS token FROM supplier")
def folded_texts(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    token = F.when(k == 0, "ANSI / ­IEEE").when(k == 1, "-DC-dc Terminals").otherwise("﻿Full  Power")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.fold(F.concat(F.lit("  ÉCLAIR "), F.col("s_name"), F.lit("  ﬁne Ｘ"))).alias("folded"), text.token(token).alias("token"))


@query("WITH t AS (SELECT s_nationkey AS part, s_suppkey AS id, 'iec ' || (s_suppkey % 3) AS base, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 2015 + s_suppkey % 4 END AS y FROM supplier) SELECT CASE WHEN a.base <> b.base THEN 'inter_document' WHEN a.y <> b.y THEN 'temporal' END AS conflict_class, CASE WHEN a.base <> b.base THEN 'texts differ' WHEN a.y <> b.y THEN 'editions differ' ELSE 'texts agree' END AS reason, count(*) AS n FROM t a JOIN t b ON a.part = b.part AND a.id < b.id GROUP BY ALL")
def folded_verdicts(spark, sf_dir):
    """The same verdicts as in ASCII, of texts in full width and odd white space."""
    k = F.col("s_suppkey")
    year = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" : "), (k % 4 + 2015).cast("string")))
    name = F.when(k % 2 == 0, F.lit("ＩＥＣ ")).otherwise(F.lit("Iec  "))
    c = _supplier_claims(spark, sf_dir, values.text(F.concat(name, (k % 3).cast("string"), year)), F.lit(None).cast("string"), "standards")
    return conflicts.detect(c, KEYS).groupBy("conflict_class", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, '{''a'': ''' || p_type || ''', ''b'': ''' || p_brand || '''}' AS entries, 'list[''' || p_brand || ''', ''' || p_type || ''']' AS items, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS flag, CAST(CAST(p_size AS DECIMAL(18, 1)) AS VARCHAR) AS num FROM part")
def value_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", values.mapping(F.create_map(F.lit("b"), F.col("p_brand"), F.lit("a"), F.col("p_type")))["canon"].alias("entries"), values.listing(F.array("p_brand", "p_type"))["canon"].alias("items"), values.boolean(F.col("p_size") > 25)["canon"].alias("flag"), values.number(F.col("p_size").cast("double"))["canon"].alias("num"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(97 - l_quantity / 10 - (100 - 2 - l_tax * 10 * (25 - 1))) <= 0.5 AS plausible FROM lineitem")
def plausible_warranties(spark, sf_dir):
    end = F.lit(97.0) - F.col("l_quantity") / 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", confidence.plausible_warranty(end, F.lit(2.0), F.col("l_tax") * 10, F.lit(25)).alias("plausible"))


# -- bands and queues ----------------------------------------------------------------------------------------------

_BAND = "t AS (SELECT s_nationkey AS part, s_suppkey AS id, s_suppkey % 5 * 10.0 AS v, CASE WHEN s_suppkey % 2 = 0 THEN 15.0 END AS w FROM supplier), p AS (SELECT CASE WHEN a.w IS NULL AND b.w IS NULL THEN abs(a.v - b.v) > 0.05 ELSE NOT (a.v - coalesce(a.w, 0) <= b.v + coalesce(b.w, 0) AND b.v - coalesce(b.w, 0) <= a.v + coalesce(a.w, 0)) END AS conflicts FROM t a JOIN t b ON a.part = b.part AND a.id < b.id)"


def _banded(spark, sf_dir):
    k = F.col("s_suppkey")
    v = k % 5 * 10.0
    c = _supplier_claims(spark, sf_dir, values.number(v, canon=v.cast("decimal(18,1)").cast("string")), F.lit(None).cast("string"), "power_tolerance")
    band = F.struct(F.lit(-15.0).alias("low"), F.lit(15.0).alias("high"), F.lit("absolute").alias("kind"), F.lit(None).cast("string").alias("unit"))
    bands = table(spark, sf_dir, "supplier").where(k % 2 == 0).select(F.col("s_nationkey").alias("part"), k.cast("string").alias("document_id"), F.lit("power_tolerance").alias("field_name"), band.alias("band"))
    return conflicts.detect(c, KEYS, bands=bands, carry=conflicts.QUEUED)


@query(f"WITH {_BAND} SELECT conflicts, count(*) AS n FROM p GROUP BY ALL")
def band_verdicts(spark, sf_dir):
    return _banded(spark, sf_dir).groupBy("conflicts").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BAND} SELECT 'power_tolerance' AS field_name, 'open' AS status, 2 AS n_candidates, count(*) AS n, count(*) AS n_ids FROM p WHERE conflicts GROUP BY ALL HAVING count(*) > 0")
def queue_manifest(spark, sf_dir):
    q = conflicts.queue(_banded(spark, sf_dir), F.lit("2024-01-01").cast("timestamp"), KEYS)
    m = conflicts.manifest(q.withColumn("n_candidates", F.size("candidates")), ("n_candidates", "shared_id"))
    return m.groupBy("field_name", "status", "n_candidates").agg(F.count(F.lit(1)).alias("n"), conflicts.n_different().alias("n_ids"))


@query("SELECT 4 AS severity, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'F' HAVING count(*) > 0")
def blocking_entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.when(F.col("o_orderkey") % 5 == 0, 4).otherwise(2).alias("severity"), F.when(F.col("o_orderstatus") == "F", "defer").alias("resolution"))
    return conflicts.blocking(o, 2).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_JOBS} SELECT job_id FROM j WHERE status = 'running' AND job_id % 3 = 0 OR status <> 'running' AND job_id % 5 = 0")
def inconsistent_leases(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    running = F.col("status") == "running"
    broken = j.withColumn("lease_owner", F.when(running & (F.col("job_id") % 3 == 0), None).when(~running & (F.col("job_id") % 5 == 0), "ghost").otherwise(F.col("lease_owner")))
    return jobs.inconsistent(broken).select("job_id")


@query("SELECT CASE WHEN event_id % 5 < 3 THEN 'pending' ELSE 'resolved' END AS queue_status, CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 ELSE event_id % 5 END AS reopen_count, count(*) AS n FROM events GROUP BY ALL")
def reopened_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit("resolved").alias("queue_status"), (F.col("event_id") % 5).alias("reopen_count"))
    return jobs.reopen(e).groupBy("queue_status", "reopen_count").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0")
def tampered_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("price"))
    after = o.where("o_orderkey % 18 <> 0").withColumn("price", F.when(F.col("o_orderkey") % 9 == 0, "0").otherwise(F.col("price")))
    return security.appended_only(o, after).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus = 'F' AND l_returnflag <> 'N' AND l_quantity > 10 AS overwrites FROM lineitem")
def overwrite_flags(spark, sf_dir):
    tier = lambda c: F.when(c, "system_of_record").otherwise("web_supplement")
    flag = security.assert_no_overwrite(F.when(F.col("l_quantity") > 10, F.col("l_quantity")), tier(F.col("l_linestatus") == "F"), tier(F.col("l_returnflag") == "N"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag.alias("overwrites"))


# -- retrieval -----------------------------------------------------------------------------------------------------

_WORDS = "blue station part 17"
_LEGS = f"""q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
c AS (SELECT p_partkey AS id, p_name AS t, CAST(embedding AS DOUBLE[]) AS e FROM part JOIN embeddings ON p_partkey = vec_id WHERE p_size > 10 AND p_partkey % 7 <> 0),
w AS (SELECT list_distinct(regexp_extract_all('{_WORDS}', '[0-9a-z]+')) AS w), tri AS (SELECT list_distinct(list_transform(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3))) AS g FROM (SELECT '  {_WORDS} ' AS s)),
g AS (SELECT id, list_distinct(list_transform(generate_series(1, greatest(length(s) - 2, 1)), lambda i: substr(s, i, 3))) AS g FROM (SELECT id, '  ' || trim(regexp_replace(lower(t), '[^0-9a-z]+', ' ', 'g')) || ' ' AS s FROM c)),
l1 AS (SELECT id, round(list_cosine_similarity(e, q), 6) AS sim FROM c, q ORDER BY sim DESC, id LIMIT 50),
l2 AS (SELECT id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(t), '[0-9a-z]+')), w)) / len(w), 6) AS sim FROM c, w WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(t), '[0-9a-z]+')), w)) > 0 ORDER BY sim DESC, id LIMIT 50),
l3 AS (SELECT id, round(len(list_intersect(g.g, tri.g)) / len(list_distinct(list_concat(g.g, tri.g))), 6) AS sim FROM g, tri WHERE len(list_intersect(g.g, tri.g)) > 0 ORDER BY sim DESC, id LIMIT 50),
r AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY sim DESC, id)) AS s FROM l1 UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY sim DESC, id)) FROM l2 UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY sim DESC, id)) FROM l3),
f AS (SELECT id, round(sum(s), 10) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 50)"""


def _catalogue(spark, sf_dir):
    """Parts as chunks with vectors, and the documents that the reader may see."""
    p = table(spark, sf_dir, "part").where("p_size > 10").join(table(spark, sf_dir, "embeddings"), F.col("p_partkey") == F.col("vec_id"))
    chunks = p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").cast("string").alias("document_id"), F.col("p_name").alias("chunk_text"), "embedding")
    allowed = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("document_id"), (F.col("p_partkey") % 7 == 0).alias("access_restricted"))
    return chunks, security.secure(allowed, security.Principal())


def _question(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"WITH {_LEGS} SELECT id AS chunk_id, round(score, 8) AS score FROM f ORDER BY score DESC, id LIMIT 10")
def retrieved_chunks(spark, sf_dir):
    """Vectors, words and trigrams fused, of allowed documents alone."""
    chunks, allowed = _catalogue(spark, sf_dir)
    return retrieval.retrieve(chunks, _WORDS, _question(spark, sf_dir), limit=10, allowed=allowed).select("chunk_id", F.round("score", 8).alias("score"))


@query(f"WITH {_LEGS} SELECT f.id AS chunk_id, CAST(length(t) AS DOUBLE) AS score FROM f JOIN c USING (id) ORDER BY score DESC, f.id LIMIT 10")
def reranked_chunks(spark, sf_dir):
    """The fused best, put in a new order by an injected reranker (here: the longest text first)."""
    chunks, allowed = _catalogue(spark, sf_dir)
    return retrieval.retrieve(chunks, _WORDS, _question(spark, sf_dir), limit=10, allowed=allowed, rerank=lambda q, s: s.str.len().astype(float)).select("chunk_id", "score")


@query("SELECT p_partkey, len(regexp_split_to_array(p_name, ' ')) AS n_words, CASE WHEN p_size > 25 THEN p_brand END AS brand FROM part")
def injected_models(spark, sf_dir):
    """An embedder and an extractor in Arrow batches; the extractor abstains where it has no evidence."""
    p = retrieval.embed(table(spark, sf_dir, "part").withColumn("t", F.concat_ws("|", "p_brand", "p_size")), "p_name", lambda s: s.str.split(" ").map(lambda w: [float(len(w))]))
    p = retrieval.extract(p, "t", lambda s: s.map(lambda x: '{"brand": "%s"}' % x.split("|")[0] if int(x.split("|")[1]) > 25 else None), "brand string")
    return p.select("p_partkey", F.col("embedding")[0].cast("int").alias("n_words"), F.col("extracted.brand").alias("brand"))


@query("WITH s AS (SELECT o_orderkey, CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS section, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0 GROUP BY ALL) SELECT CAST(o_orderkey AS VARCHAR) AS document_id, section, 'prose' AS chunk_kind, 0 AS chunk_no, 2 * n AS n_words FROM s UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'c', 'table_full', 0, 5 FROM orders WHERE o_orderkey % 4 <> 0")
def indexed_documents(spark, sf_dir):
    """Chunks by section, tables whole, of documents whose content is not in the index yet."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    doc = F.col("o_orderkey").cast("string").alias("document_id")
    prose = li.select(doc, F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.when(F.col("l_linenumber") <= 3, "a").otherwise("b").alias("section"), F.lit("prose").alias("kind"), F.concat(F.lit(" line "), F.col("l_partkey").cast("string"), F.lit("\n")).alias("text"))
    tables = table(spark, sf_dir, "orders").select(doc, F.lit("t").alias("position"), F.lit("c").alias("section"), F.lit("table").alias("kind"), F.concat_ws(" ", F.lit("order of"), "o_orderstatus", F.lit("and"), "o_custkey").alias("text"))
    docs = table(spark, sf_dir, "orders").select(doc, documents.content_hash(F.col("o_orderkey").cast("string")).alias("content_hash"))
    stored = docs.where(F.col("document_id").cast("long") % 4 == 0)
    out = documents.index_documents(docs, prose.unionByName(tables), stored, lambda s: s.str.len().map(lambda n: [float(n)]))
    return out.where("embedding[0] > 0").select("document_id", "section", "chunk_kind", "chunk_no", "n_words")


# -- audit ---------------------------------------------------------------------------------------------------------

_STREAM = "CASE WHEN event_id % 3 = 0 THEN 'run:' || event_type ELSE 'doc:' || user_id END"
_FULL = f"""e AS (SELECT {_STREAM} AS stream, event_id, event_type AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp, row_number() OVER (PARTITION BY {_STREAM} ORDER BY ts, event_type, '{{"event_id":' || event_id || '}}') - 1 AS seq FROM events),
b AS (SELECT stream, event_id, seq, '{{"actor":"driver","event_type":"' || t || '","payload":{{"event_id":' || event_id || '}},"prev_hash":' AS head, ',"recorded_at":"' || stamp || '","seq":' || seq || ',"stream":"' || stream || '","v":1}}' AS tail FROM e),
h AS (SELECT stream, event_id, seq, CAST(NULL AS VARCHAR) AS prev_hash, sha256(head || 'null' || tail) AS hash FROM b WHERE seq = 0 UNION ALL SELECT b.stream, b.event_id, b.seq, h.hash, sha256(b.head || '"' || h.hash || '"' || b.tail) FROM h JOIN b ON b.stream = h.stream AND b.seq = h.seq + 1)"""


def _audited(spark, sf_dir):
    """Events of documents and of runs (every third event, by type), as audit events."""
    e = table(spark, sf_dir, "events")
    run = F.col("event_id") % 3 == 0
    stream = F.when(run, F.concat(F.lit("run:"), "event_type")).otherwise(F.concat(F.lit("doc:"), "user_id"))
    return e.select(stream.alias("stream"), F.when(~run, F.col("user_id").cast("string")).alias("document_id"), "event_type", F.lit("driver").alias("actor"), F.to_json(F.struct("event_id")).alias("payload_canonical"), F.col("ts").cast("timestamp").alias("recorded_at"))


@query(f"WITH RECURSIVE {_FULL} SELECT stream, seq, prev_hash, hash FROM h")
def preimage_chain(spark, sf_dir):
    """Each hash over the canonical JSON of the whole event and the hash before it."""
    return audit.chain(_audited(spark, sf_dir)).select("stream", "seq", "prev_hash", "hash")


@query(f"WITH RECURSIVE {_FULL} SELECT stream, seq FROM h WHERE event_id % 50 = 0")
def tampered_events(spark, sf_dir):
    """Every event is hashed anew; those whose payload was changed afterwards don't have their hash."""
    c = audit.chain(_audited(spark, sf_dir))
    changed = F.get_json_object("payload_canonical", "$.event_id").cast("long") % 50 == 0
    return audit.recomputed(c.withColumn("payload_canonical", F.when(changed, F.lit('{"event_id":-1}')).otherwise(F.col("payload_canonical")))).select("stream", "seq")


_CUTS = ("2024-01-11", "2024-01-16")


@query(f"WITH RECURSIVE {_FULL} SELECT stream, max(seq) AS seq, arg_max(hash, seq) AS hash FROM h GROUP BY stream")
def continued_chain_tips(spark, sf_dir):
    """Tips of document and run streams that were stored in two goes, the second continuing the first, equal those of one go."""
    e = _audited(spark, sf_dir)
    cut = F.lit(_CUTS[1]).cast("timestamp")
    first = audit.chain(e.where(F.col("recorded_at") < cut))
    second = audit.chain(e.where(F.col("recorded_at") >= cut), start=audit.tips(first))
    return audit.tips(first.select("stream", "seq", "hash").unionByName(second.select("stream", "seq", "hash")))


@query(f"WITH RECURSIVE {_FULL} SELECT stream, seq, prev_hash, hash FROM h")
def streamed_chain(spark, sf_dir):
    """The same chains by a stream whose state is the tips, fed in three goes."""
    folder, e, before = checkpoint_folder(spark), _audited(spark, sf_dir), None
    for cut in (*_CUTS, None):
        at = F.col("recorded_at")
        late = at < F.lit(cut).cast("timestamp") if cut else F.lit(True)
        e.where(late & (at >= F.lit(before).cast("timestamp") if before else F.lit(True))).write.mode("append").parquet(f"{folder}/events")
        arrived = spark.readStream.schema(e.schema).parquet(f"{folder}/events")
        streams.append_batches(streams.chained(arrived), f"{folder}/chain", f"{folder}/checkpoint").awaitTermination()
        before = cut
    return spark.read.parquet(f"{folder}/chain").select("stream", "seq", "prev_hash", "hash")
