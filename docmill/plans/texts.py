"""Queries of default domains, canonical documents by time, and the whole hybrid retrieval with vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import documents as D
from docmill.operators import normalise as N
from docmill.operators import retrieve as R
from docmill.plans.corpus import BM25, EXACT, FOLD, HYBRID_REFINED, QUESTIONS, asked, docs, domain_sql, first_sql, hybrid_meta
from docmill.session import table


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a time of change, which goes by their id and falls together for some."""
    return docs(spark, d).withColumn("modified", F.timestamp_seconds(F.col("doc_id") * 7919 % 101))


def hybrid_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All steps of hybrid retrieval: three lists, fusion, filter, rerank and gate. Each question has the vector of a document."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    meant = spark.createDataFrame([(k, 10 * k) for k, _ in QUESTIONS], "query_id int, doc_id long")
    q = meant.join(vectors, "doc_id").select("query_id", F.col("embedding").alias("q"))
    return R.hybrid(docs(spark, d), asked(spark), 200, 30, vectors, q, hybrid_meta(spark, d), {"lang": "en"}, ("license", "und"), ("the ",), {"apache": ("apache",)})


def normal(spark: SparkSession, d: str) -> DataFrame:
    """Orders told in words, in normal form with their numbers and dates."""
    o = table(spark, d, "orders")
    told = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order  of Rs. "), F.format_number("o_totalprice", 2), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" \n—\u2019ﬁnal\u2019")).alias("text"))
    found = N.normalised(told)
    return found.select("doc_id", "normalized", "normalized_lower", F.round(F.col("numbers")[0]["number"]["value"], 2).alias("amount"), F.element_at("dates", 1).alias("day"))


NORMAL = """WITH t AS (SELECT o_orderkey AS doc_id, 'Order of Rs. ' || format('{:,.2f}', o_totalprice) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') || ' -' || chr(39) || 'final' || chr(39) AS normalized, round(o_totalprice, 2) AS amount, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT doc_id, normalized, lower(normalized) AS normalized_lower, amount, day FROM t"""
DENSE = """dn AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.vec_id // 10 AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id IN (10, 20, 30, 40, 50)))"""
FUSED = """fu AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS before FROM (
  SELECT query_id, doc_id, rank FROM b UNION ALL SELECT query_id, doc_id, rank FROM ex UNION ALL SELECT query_id, doc_id, rank FROM dn) WHERE rank <= 200 GROUP BY ALL)"""
HYBRID = HYBRID_REFINED.replace(f"WITH {BM25},", f"WITH {BM25}, {EXACT}, {DENSE}, {FUSED},").replace("1.0 / (60 + rank) AS before", "before").replace("FROM b JOIN documents", "FROM fu JOIN documents").replace("WHERE rank <= 300 AND lang", "WHERE lang")

CATALOGUE = {
    "classify_default_domains": (lambda s, d: D.classify(docs(s, d)), f"SELECT doc_id, {first_sql(D.DOMAINS, 'd_')} AS domain, {first_sql(D.AUTHORITY, 'a_')} AS authority, CAST(CASE WHEN total > 0 THEN least(1.0, round(0.4 + 0.1 * total, 6)) ELSE 0.2 END AS DOUBLE) AS confidence FROM (SELECT *, {' + '.join('d_' + n for n in D.DOMAINS)} AS total FROM (SELECT doc_id, {domain_sql(D.DOMAINS, 'd_')}, {domain_sql(D.AUTHORITY, 'a_')} FROM documents))"),
    "canonical_latest": (lambda s, d: D.aliases(dated(s, d), "modified"), f"SELECT doc_id, canonical FROM (SELECT doc_id, arg_max(doc_id, (doc_id * 7919 % 101, doc_id)) OVER w AS canonical, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY {FOLD})) WHERE n > 1"),
    "normalized_documents": (normal, NORMAL),
    "hybrid_with_vectors": (hybrid_with_vectors, HYBRID),
}


def queries() -> dict:
    return {name: query for name, (query, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in CATALOGUE.items() if text}
