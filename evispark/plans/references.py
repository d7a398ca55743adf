"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.operators.references import orphan_references, orphans_by_month, parent_rows, reference_rows
from evispark.staging import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = reference_rows(table(spark, sf_dir, "syntheses"), "syntheses", "synthesis_id")
    refs = refs.unionByName(reference_rows(table(spark, sf_dir, "review_sentences"), "review_sentences", "sentence_id"))
    return orphan_references(refs, parent_rows(table(spark, sf_dir, "extracted_claims")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "record_id", "claim_id", "reason")


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans_by_month(_orphans(spark, sf_dir))


_CASES = r"""
WITH raw AS (
  SELECT 'syntheses' AS ref_table, synthesis_id AS record_id, ingested_at, unnest(supporting_claim_ids) AS ref FROM syntheses
  UNION ALL
  SELECT 'review_sentences', sentence_id, ingested_at, unnest(supporting_claim_ids) FROM review_sentences),
refs AS (
  SELECT ref_table, record_id, lower(regexp_replace(ref, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS claim_id, min(ingested_at) AS record_at
  FROM raw WHERE record_id IS NOT NULL GROUP BY 1, 2, 3),
parents AS (SELECT claim_id, min(ingested_at) AS arrived_at, min(deleted_at) AS deleted_at FROM extracted_claims GROUP BY 1),
cases AS (
  SELECT r.ref_table, r.record_id, r.claim_id, r.record_at,
         CASE WHEN p.claim_id IS NULL THEN 'missing' WHEN p.deleted_at <= r.record_at THEN 'deleted' WHEN p.arrived_at > r.record_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON p.claim_id = r.claim_id WHERE r.claim_id <> '')
"""

QUERIES = {"p2_found": p2_found, "p2_by_month": p2_by_month}
SQL = {
    "p2_found": _CASES + "SELECT ref_table, record_id, claim_id, reason FROM cases WHERE reason IS NOT NULL",
    "p2_by_month": _CASES + "SELECT ref_table, strftime(record_at, '%Y-%m') AS month, reason, count(*) AS n_orphans FROM cases WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
