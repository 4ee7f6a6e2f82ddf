"""One query for each operator, with production parameters over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import chat, langmodel, mixing, packing, periodic, quality, rangejoin, sharding, simhash, tokenfiles, toxicity, vectorcodes, warc


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(_table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op3_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "neighbours", "cosines", "term")


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 7"
    scored = langmodel.score(_table(spark, sf_dir, "documents"), train=f"{fold} <> 2")
    return scored.select("doc_id", F.expr(f"{fold} = 2").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    parts = chat.format_chats(given.unionByName(probe), tokenizer())
    return chat.read_back(parts, tokenizer())


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), shards=16, seed=20)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"), alpha=0.5)
    return mixed.select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer(), capacity=1024, end_id=2)
    slim = packing.materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(slim, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) % 10 = 0, the words from a place on repeat those that follow it. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(w):
        g, n = F.floor(h / 10), F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        copies = F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), F.flatten(copies)), F.lit(1), n), " ")

    text = F.when((h % 10 == 0) & (F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]")) > 0), F.transform(F.array(words), repeated)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted(_table(spark, sf_dir, "documents")))
    # The struct with the greatest length, then the least start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    out = found.withColumn("best", best)
    length, start, period = F.col("best")[F.lit("length")], -F.col("best")["col2"], -F.col("best")["col3"]
    return out.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = tokenfiles.encode_and_read(_table(spark, sf_dir, "documents"), tokenizer(), end_id=0)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(rounds: int) -> str:
    """Vectors as parts; each round pairs every part with every entry of its codebook and takes the mean of the nearest."""
    out = [
        """
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, x[1 + p * len(x) // 4 : (p + 1) * len(x) // 4] AS x FROM v, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, entry, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 256) USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': entry}}) AS near FROM x JOIN c{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            out.append(f"s{r} AS (SELECT p, entry, place, sum(x) AS s, count(*) AS n FROM (SELECT p, near.entry AS entry, unnest(x) AS x, unnest(range(len(x))) AS place FROM a{r}) GROUP BY ALL)")
            out.append(f"m{r} AS (SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS m FROM s{r} GROUP BY p, entry)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.entry, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.p = c{r}.p AND m{r}.entry = c{r}.entry)")
    out.append(f"b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM c{rounds})")
    out.append(f"e AS (SELECT vec_id, string_agg(format('{{:02x}}', near.entry), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    out.append("l AS (SELECT label, sum(error) AS label_error FROM v JOIN e USING (vec_id) GROUP BY label)")
    return ",\n".join(out) + "\nSELECT v.vec_id, code, error, CAST(label_error AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label, b"


CODES_SQL = _codes_sql(4)

#: Neighbouring pairs of equal words at one distance are islands; an island with its distance is a stretch of that period.
RUNS_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, xor(CAST(4294967295 AS BIGINT), list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)]), CAST(4294967295 AS BIGINT))) AS h FROM documents, crc),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
i AS (SELECT *, unnest(range(n)) AS i FROM p),
pw AS (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM i),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM pw x JOIN pw y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
stretch AS (SELECT doc_id, min(i) AS s, max(i) + q + 1 - min(i) AS l, q FROM island GROUP BY doc_id, q, island HAVING max(i) + q + 1 - min(i) >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretch GROUP BY doc_id, s, l),
r AS (SELECT doc_id, count(*) AS n_runs, first(s ORDER BY l DESC, s, q) AS start, first(l ORDER BY l DESC, s, q) AS length, first(q ORDER BY l DESC, s, q) AS period, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM pw ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM p LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: The schedule is a recursion over slots; blocks hold one row up to 4096 rows of documents, ceil(n / 4096) beyond.
MIXING_SQL = """
WITH RECURSIVE per AS (SELECT CAST(greatest(1, ceil(count(*) / 4096.0)) AS BIGINT) AS per FROM documents),
s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w, row_number() OVER (ORDER BY count(*) DESC, source NULLS FIRST) AS queue FROM documents GROUP BY source),
q AS (SELECT list({'n': n, 'w': w, 'blocks': CAST(ceil(n / CAST(per AS DOUBLE)) AS BIGINT)} ORDER BY queue) AS q FROM s, per),
b AS (SELECT queue, k, k / w AS v0, (k + 1) / w AS v1, least(per, n - k * per) AS block_rows FROM (SELECT *, unnest(range(CAST(ceil(n / CAST(per AS DOUBLE)) AS BIGINT))) AS k FROM s, per)),
f AS (SELECT queue, k, block_rows, CAST(floor(list_sum(list_transform(q, lambda x: least(x.w * v0, x.blocks))) + 1e-6) AS BIGINT) AS release, CAST(ceil(list_sum(list_transform(q, lambda x: least(x.w * v1, x.blocks))) - 1e-6) AS BIGINT) AS deadline FROM b, q),
win AS (SELECT list(win ORDER BY queue) AS win, list(blocks ORDER BY queue) AS blocks, sum(blocks) AS slots FROM (SELECT queue, list({'r': release, 'd': deadline} ORDER BY k) AS win, count(*) AS blocks FROM f GROUP BY queue)),
e AS (SELECT CAST(-1 AS BIGINT) AS slot, list_transform(blocks, lambda x: CAST(0 AS BIGINT)) AS nxt, CAST(0 AS BIGINT) AS queue FROM win
  UNION ALL SELECT slot, list_transform(nxt, lambda k, i: CAST(k + CAST(i = best AS INTEGER) AS BIGINT)), best FROM (
    SELECT e.slot + 1 AS slot, e.nxt, CAST(list_min(list_filter(list_transform(e.nxt, lambda k, i: CASE WHEN k < blocks[i] THEN {'early': win[i][k + 1].r > e.slot + 1, 'd': win[i][k + 1].d, 'i': i} END), lambda x: x IS NOT NULL)).i AS BIGINT) AS best FROM e, win WHERE e.slot + 1 < slots)),
o AS (SELECT slot, queue, row_number() OVER (PARTITION BY queue ORDER BY slot) - 1 AS k FROM e WHERE slot >= 0),
p AS (SELECT o.slot, o.queue, o.k, f.release, f.deadline, coalesce(sum(f.block_rows) OVER (ORDER BY o.slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM o JOIN f ON f.queue = o.queue AND f.k = o.k),
d AS (SELECT doc_id, documents.source, s.queue, row_number() OVER (PARTITION BY s.queue ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents JOIN s ON documents.source IS NOT DISTINCT FROM s.source)
SELECT d.doc_id, d.source, p.k AS block, p.release, p.deadline, p.slot, CAST(p.start + d.rank % per AS BIGINT) AS position FROM d, per JOIN p ON p.queue = d.queue AND p.k = d.rank // per
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_compression, op2_warc_index, op3_embedding_range_join, op4_toxicity_knn, op5_simhash_pivots, op6_lm_bloom, op7_chat_tokens, op8_feistel_sharding, op9_pfair_mixing, op10_best_fit_packing, op11_periodic_runs, op12_token_files, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op9_pfair_mixing": MIXING_SQL, "op11_periodic_runs": RUNS_SQL, "op13_vector_codes": CODES_SQL}
