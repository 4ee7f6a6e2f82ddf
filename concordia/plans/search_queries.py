"""Queries of the stored index, full text, and many questions at once, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.functions import english
from concordia.operators import retrieval
from concordia.operators.index import Index
from concordia.plans.queries import _QUERY, SQL, query, table
from concordia.sources.folders import checkpoint_folder


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _indexed(spark, chunks, kind, id_col, text_col, id_type="long"):
    index = Index(spark, checkpoint_folder(spark), kind, id_type=id_type)
    index.append(chunks, id_col=id_col, text_col=text_col)
    return index


@query(SQL["lexical_search"])
def indexed_lexical_search(spark, sf_dir):
    """lexical_search's rows out of the stored index."""
    return _indexed(spark, _documents(spark, sf_dir), "tokens", "doc_id", "text").search(_QUERY, 20).withColumnRenamed("id", "doc_id")


@query(SQL["trigram_search"])
def indexed_trigram_search(spark, sf_dir):
    """trigram_search's rows out of the stored index."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return _indexed(spark, s, "trigrams", "s_suppkey", "s_name").search("Supplier#000000001", 15, score="jaccard")


@query("""WITH s AS (SELECT s_suppkey AS id, '  ' || trim(regexp_replace(lower(CASE WHEN s_suppkey % 4 = 1 THEN 'Renamed ' || s_name ELSE s_name END), '[^0-9a-z]+', ' ', 'g')) || ' ' AS t FROM supplier WHERE s_suppkey % 4 <> 2),
g AS (SELECT id, list_distinct(list_transform(generate_series(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 3))) AS g FROM s),
q AS (SELECT list_distinct(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3))) AS q FROM (SELECT '  supplier 000000001 ' AS t))
SELECT id, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS sim FROM g, q WHERE len(list_intersect(g, q)) > 0""")
def appended_index_search(spark, sf_dir):
    """An index built in two goes, with a quarter of the names replaced and a quarter deleted afterwards, then compacted: all matches."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = F.col("s_suppkey") % 4
    index = _indexed(spark, s.where(part < 2), "trigrams", "s_suppkey", "s_name")
    index.append(s.where(part >= 2), id_col="s_suppkey", text_col="s_name")
    index.append(s.where(part == 1).withColumn("s_name", F.concat(F.lit("Renamed "), "s_name")), id_col="s_suppkey", text_col="s_name", upsert=True)
    index.remove(s.where(part == 2), id_col="s_suppkey")
    index.compact()
    own = len(index.query_terms("Supplier#000000001"))
    n = F.size("hits")
    return index.matches("Supplier#000000001").select("id", F.round(n / (own + F.col("size") - n), 6).alias("sim"))


_RANK = "the thing and other"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM w),
p AS (SELECT doc_id, term, list(place) AS p FROM t WHERE term IN ('{"', '".join(_RANK.split())}') GROUP BY ALL),
near AS (SELECT a.doc_id, sum(1.0 / list_min(list_transform(a.p, lambda x: list_min(list_transform(b.p, lambda y: abs(x - y)))))) AS near
  FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in zip(_RANK.split(), _RANK.split()[1:], strict=False))}) q(x, y) JOIN p a ON a.term = x JOIN p b ON b.term = y AND b.doc_id = a.doc_id GROUP BY a.doc_id),
c AS (SELECT doc_id, sum(ln(1 + len(p))) AS s FROM p GROUP BY doc_id)
SELECT doc_id, round(s + coalesce(near, 0), 6) AS sim FROM c LEFT JOIN near USING (doc_id) ORDER BY sim DESC, doc_id LIMIT 25""")
def ranked_search(spark, sf_dir):
    """Words with positions, ranked by their counts and nearness."""
    return _indexed(spark, _documents(spark, sf_dir), "words", "doc_id", "text").search(_RANK, 25, score="rank").withColumnRenamed("id", "doc_id")


@query()
def stemmed_terms(spark, sf_dir):
    """Stems of all documents, with the documents that hold them and their places; tested against words stemmed one by one."""
    t = _documents(spark, sf_dir).select("doc_id", F.explode(english.lexemes(F.col("text"))).alias("t"))
    return t.groupBy("t.term").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.size("t.positions")).alias("n_places"), F.max(F.array_max("t.positions")).alias("last_place"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS question, e AS q FROM v WHERE vec_id % 100 = 0)
SELECT question, vec_id, round(sim, 6) AS sim FROM (SELECT question, vec_id, list_cosine_similarity(e, q) AS sim, row_number() OVER (PARTITION BY question ORDER BY round(list_cosine_similarity(e, q), 6) DESC, vec_id) AS rn FROM v, q) WHERE rn <= 10""")
def many_questions(spark, sf_dir):
    """The ten nearest of all vectors for every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.top_k_each(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), "embedding"), 10, id_col="vec_id").withColumnRenamed("id", "vec_id")
