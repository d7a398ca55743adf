"""Queries of retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators.retrieval import mean_metrics, numbered_queries, rank_by_cosine, ranked_with_first_hit, ranking_metrics, similar_entities
from evispark.operators.selection import global_numbers
from evispark.staging import stage, table


def retrieval_topk(spark, d):
    v = table(spark, d, "embeddings")
    return rank_by_cosine(numbered_queries(v), v, 10).select("q_id", "vec_id", "score", "rank")


def retrieval_metrics(spark, d):
    v = table(spark, d, "embeddings")
    q = numbered_queries(v)
    sizes = v.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    relevant = q.join(sizes, q["q_label"] == sizes["label"]).select("q_id", "n_relevant")
    share = F.round(F.try_divide(F.col("n_relevant"), F.lit(v.count() - 1)), 3)
    return ranking_metrics(ranked_with_first_hit(q, v), relevant).withColumn("random_precision", F.when(F.col("n_relevant") > 0, share))


def entity_embeddings(spark, d):
    """(entity_type, entity_id, model, embedding): claims in order of their ids get the vectors in order of theirs, as long as there are any."""
    ids = table(spark, d, "extracted_claims").filter("claim_id is not null").select("claim_id").distinct()
    numbers = global_numbers(ids, ["claim_id"]).select((F.col("number") - 1).alias("vec_id"), F.lit("claim").alias("entity_type"), F.col("claim_id").alias("entity_id"))
    return numbers.join(table(spark, d, "embeddings"), "vec_id").select("entity_type", "entity_id", F.lit("m").alias("model"), "embedding")


def similar_claims(spark, d):
    """Topics from the queries of the vectors, every third of them blank."""
    q = numbered_queries(table(spark, d, "embeddings")).select(F.col("q_id").alias("topic_id"), F.when(F.col("q_id") % 3 == 0, " ").otherwise("topic").alias("topic"), F.col("q_vec").alias("vector"))
    claims = table(spark, d, "extracted_claims").select(F.col("claim_id").alias("entity_id"))
    return similar_entities(q, claims, stage(entity_embeddings(spark, d), "embedded"), "claim", 10)


def retrieval_summary(spark, d):
    return mean_metrics(retrieval_metrics(spark, d))


_RANKED = """
WITH q AS (SELECT label AS q_label, vec_id AS q_id FROM embeddings WHERE vec_id % 100 = 0),
pairs AS (SELECT q.q_id, e.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score, e.label = q.q_label AS relevant
  FROM q JOIN embeddings x ON x.vec_id = q.q_id JOIN embeddings e ON e.vec_id <> q.q_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""
_METRICS = _RANKED + """,
rel AS (SELECT q.q_id, count(*) - 1 AS n_relevant FROM q JOIN embeddings e ON e.label = q.q_label GROUP BY 1),
agg AS (SELECT q_id, sum(CASE WHEN rank <= 5 AND relevant THEN 1 ELSE 0 END) h5, sum(CASE WHEN rank <= 10 AND relevant THEN 1 ELSE 0 END) h10, sum(CASE WHEN rank <= 20 AND relevant THEN 1 ELSE 0 END) h20,
  min(CASE WHEN relevant THEN rank END) AS first, sum(CASE WHEN rank <= 10 AND relevant THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM ranked GROUP BY 1),
m AS (SELECT r.q_id, n_relevant, CASE WHEN n_relevant > 0 THEN round(coalesce(h5 / 5, 0), 3) END AS precision_5, CASE WHEN n_relevant > 0 THEN round(coalesce(h10 / 10, 0), 3) END AS precision_10,
  CASE WHEN n_relevant > 0 THEN round(coalesce(h10 / n_relevant, 0), 3) END AS recall_10, CASE WHEN n_relevant > 0 THEN round(coalesce(h20 / n_relevant, 0), 3) END AS recall_20, CASE WHEN n_relevant > 0 THEN round(coalesce(1 / first, 0), 3) END AS mrr,
  CASE WHEN n_relevant > 0 THEN round(coalesce(dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= n_relevant), 0), 3) END AS ndcg_10 FROM rel r LEFT JOIN agg USING (q_id))"""

QUERIES = {"retrieval_topk": retrieval_topk, "retrieval_metrics": retrieval_metrics, "retrieval_summary": retrieval_summary, "similar_claims": similar_claims}
SQL = {
    "retrieval_topk": _RANKED + " SELECT q_id, vec_id, score, rank FROM ranked WHERE rank <= 10",
    "retrieval_metrics": _METRICS + " SELECT *, CASE WHEN n_relevant > 0 THEN round(n_relevant / (SELECT count(*) - 1 FROM embeddings), 3) END AS random_precision FROM m",
    "similar_claims": "WITH ids AS (SELECT claim_id, row_number() OVER (ORDER BY claim_id) - 1 AS vec_id FROM (SELECT DISTINCT claim_id FROM extracted_claims WHERE claim_id IS NOT NULL)), p AS (SELECT q.vec_id AS topic_id, claim_id AS entity_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS distance FROM embeddings q, ids JOIN embeddings e USING (vec_id) WHERE q.vec_id % 100 = 0 AND q.vec_id % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY distance, entity_id) AS rank FROM p) SELECT * FROM r WHERE rank <= 10",
    "retrieval_summary": _METRICS + " SELECT count(*) AS queries, round(avg(precision_5), 3) AS precision_5, round(avg(precision_10), 3) AS precision_10, round(avg(recall_10), 3) AS recall_10, round(avg(recall_20), 3) AS recall_20, round(avg(mrr), 3) AS mrr, round(avg(ndcg_10), 3) AS ndcg_10, round(avg(round(n_relevant / (SELECT count(*) - 1 FROM embeddings), 3)), 3) AS random_precision FROM m WHERE n_relevant > 0",
}
