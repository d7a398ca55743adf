"""Queries of the problems of training data; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm.mixing import mix_checks, mix_shares, mix_sources, sized_documents
from evispark.llm.near import alike_groups, alike_pairs
from evispark.llm.scans import Repair
from evispark.llm.spans import shared_shares, shared_spans
from evispark.llm.splitting import oversized_pieces, piece_checks
from evispark.llm.tokens import encode_corpus, round_trip
from evispark.llm.vectors import nearest_vectors, neighbour_pairs
from evispark.staging import table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_pieces(*(table(spark, sf_dir, t) for t in ("paper_pages", "text_chunks", "split_limits")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).filter("piece_no > 1").select("item_kind", "item_id").distinct()


def p1_piece_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the pieces of every oversized item."""
    return piece_checks(*(table(spark, sf_dir, t) for t in ("paper_pages", "text_chunks", "split_limits")))


def _claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, id, text) of the three fields in which records are compared."""
    field = lambda c: F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text"))
    claims = table(spark, sf_dir, "extracted_claims").select(F.col("claim_id").alias("id"), F.explode(F.array(field("claim_text"), field("normalized_text"))).alias("x"))
    quotes = table(spark, sf_dir, "claim_candidates").select(F.col("candidate_id").alias("id"), field("source_quote").alias("x"))
    return claims.unionByName(quotes).select("x.field_name", "id", "x.text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(_claim_texts(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_groups(_claim_texts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(nearest_vectors(table(spark, sf_dir, "embedding_recordings")))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embedding_recordings")).select("model", "vec_id", "other", F.round("cosine", 9).alias("cosine"), "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repair(table(spark, sf_dir, "paper_pages"), table(spark, sf_dir, "papers")).found()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repair(table(spark, sf_dir, "paper_pages"), table(spark, sf_dir, "papers")).paragraphs()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mixture_targets")
    return mix_sources(sized_documents(table(spark, sf_dir, "documents"), targets), targets)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mixture_targets")
    return mix_shares(sized_documents(table(spark, sf_dir, "documents"), targets), targets)


#: Tokens of each mix of p7_budget.
BUDGET = 1_000_000


def p7_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached within a budget."""
    targets = table(spark, sf_dir, "mixture_targets")
    return mix_shares(sized_documents(table(spark, sf_dir, "documents"), targets), targets, BUDGET)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the mixture of each mix."""
    targets = table(spark, sf_dir, "mixture_targets")
    return mix_checks(sized_documents(table(spark, sf_dir, "documents"), targets), targets)


def p7_budget_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mixture_targets")
    return mix_checks(sized_documents(table(spark, sf_dir, "documents"), targets), targets, BUDGET)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shared_shares(docs, shared_spans(docs))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_piece_checks": p1_piece_checks, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_budget": p7_budget, "p7_checks": p7_checks, "p7_budget_checks": p7_budget_checks, "p8_found": p8_found, "p8_shares": p8_shares}

_LIMITED = r"""
WITH lim AS (SELECT item_kind, lower(regexp_replace(section_type, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS st, min(max_chars) AS max_chars FROM split_limits GROUP BY 1, 2),
items AS (
  SELECT 'page' AS item_kind, page_id AS item_id, NULL AS st, text FROM paper_pages
  UNION ALL
  SELECT 'chunk', chunk_id, lower(regexp_replace(section_type, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), text FROM text_chunks)
SELECT DISTINCT i.item_kind, i.item_id FROM items i
LEFT JOIN lim e ON e.item_kind = i.item_kind AND e.st = i.st
LEFT JOIN lim d ON d.item_kind = i.item_kind AND d.st IS NULL
WHERE length(i.text) > coalesce(e.max_chars, d.max_chars)
"""

_ALIKE = r"""
WITH t AS (
  SELECT 'claim_text' AS field_name, claim_id AS id, claim_text AS text FROM extracted_claims UNION ALL
  SELECT 'normalized_text', claim_id, normalized_text FROM extracted_claims UNION ALL
  SELECT 'source_quote', candidate_id, source_quote FROM claim_candidates),
s AS (SELECT DISTINCT field_name, id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS ws FROM t WHERE id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT field_name, id, len(ws) AS n, ws, row_number() OVER (ORDER BY field_name, id, ws) AS r FROM s WHERE len(ws) >= 8),
w AS (SELECT field_name, id, n, r, unnest(ws) AS word FROM k),
p AS (SELECT a.field_name, a.id AS id_a, b.id AS id_b FROM w a JOIN w b ON a.field_name = b.field_name AND a.word = b.word AND a.id < b.id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)
  GROUP BY a.field_name, a.id, b.id, a.r, b.r, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*)))
SELECT DISTINCT field_name, id_a, id_b FROM p
"""

_SHARED = """
WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200),
g AS (SELECT doc_id, s, md5(substr(text, s + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(n - 199)) AS s FROM t)),
shared AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT DISTINCT doc_id, s FROM g WHERE h IN (SELECT h FROM shared)),
marks AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM hits),
parts AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM marks)
SELECT doc_id, min(s) AS start_char, max(s) + 200 AS end_char FROM parts GROUP BY doc_id, part
"""

#: Mixes that can have copies: those with a source that has a weight, may be taken and has a text; all checks must hold for them.
_MIXES = "SELECT DISTINCT mix_id, true AS within_caps, true AS within_total, true AS shares_kept, true AS in_order FROM mixture_targets t WHERE target_weight > 0 AND coalesce(max_repeats, 1) > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0)"

SQL = {
    "p7_checks": _MIXES,
    "p7_budget_checks": _MIXES,
    "p1_found": _LIMITED,
    "p1_piece_checks": f"SELECT *, true AS within_limit, true AS overlapping, true AS covered, true AS numbered, true AS verbatim FROM ({_LIMITED})",
    "p3_found": _ALIKE,
    "p8_found": _SHARED,
    "p8_shares": f"WITH f AS ({_SHARED}), c AS (SELECT doc_id, sum(end_char - start_char)::BIGINT AS n FROM f GROUP BY 1) SELECT d.doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS shared_chars, round(coalesce(coalesce(n, 0) / nullif(length(text), 0), 0), 9) AS shared_share FROM documents d LEFT JOIN c USING (doc_id)",
}
