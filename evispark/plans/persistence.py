"""Queries of what is stored and of what models are asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions.text import UUID, classify_title
from evispark.operators import persistence as S
from evispark.operators.chunking import governing_heading
from evispark.operators.evaluation import rate
from evispark.operators.provenance import draft_markdown, links
from evispark.operators.sections import named_headings
from evispark.plans.documents import HITS, classify_sql
from evispark.staging import stage, table

HEADING = "State the claims of this text, each with its quote."
POOL_HEADING = "State what these claims have in common, with the claims used."


def persist_claims(spark, d):
    return S.accepted_claims(table(spark, d, "extracted_claims"), table(spark, d, "text_chunks")).select("claim_id", "paper_id", "chunk_id")


def persist_syntheses(spark, d):
    return S.stored_syntheses(table(spark, d, "syntheses"), table(spark, d, "extracted_claims"))[0].select("synthesis_id", "supporting_papers", "supporting_claims")


def persist_synthesis_links(spark, d):
    return S.stored_syntheses(table(spark, d, "syntheses"), table(spark, d, "extracted_claims"))[1]


def persist_sentences(spark, d):
    rows = S.stored_sentences(table(spark, d, "review_sentences"), table(spark, d, "extracted_claims"))
    return rows.select("sentence_id", F.array_join("claim_ids", ",").alias("claim_ids"), "is_supported")


def embedding_texts(spark, d):
    c = table(spark, d, "extracted_claims").dropDuplicates(["claim_id"]).select(F.lit("claim").alias("entity_type"), F.col("claim_id").alias("entity_id"), S.claim_text().alias("text"))
    s = table(spark, d, "syntheses").dropDuplicates(["synthesis_id"]).select(F.lit("synthesis").alias("entity_type"), F.col("synthesis_id").alias("entity_id"), S.synthesis_text().alias("text"))
    return c.unionByName(s).select("entity_type", "entity_id", F.md5(F.encode("text", "utf-8")).alias("digest"))


def claim_requests(spark, d):
    return S.chunk_requests(table(spark, d, "text_chunks"), HEADING).select("chunk_id", F.md5(F.encode("request", "utf-8")).alias("digest"))


def synthesis_requests(spark, d):
    pools = links(table(spark, d, "syntheses"), "synthesis_id").withColumnRenamed("record_id", "pool_id")
    return S.synthesis_requests(pools, table(spark, d, "extracted_claims"), table(spark, d, "papers"), POOL_HEADING)


def citation_cleanup(spark, d):
    drafts = draft_markdown(table(spark, d, "review_sentences"))
    return S.named_claims(drafts, "review_draft_id", "markdown", table(spark, d, "extracted_claims"))


def judge_batches(spark, d):
    rows = table(spark, d, "review_sentences").dropDuplicates(["sentence_id"])
    return S.batches(rows, "review_draft_id", ["section_title", "sentence_index", "sentence_id"]).select("sentence_id", "batch")


def draft_labels(spark, d):
    return table(spark, d, "syntheses").dropDuplicates(["synthesis_id"]).select("synthesis_id", S.draft_label().alias("label"))


def section_accuracy(spark, d):
    """Stored section types of chunks against the heading that governs them."""
    rows = table(spark, d, "text_chunks").filter("chunk_id is not null").dropDuplicates(["chunk_id"])
    gov = governing_heading(rows.select("paper_id", F.col("chunk_id").alias("page_id"), F.col("page_start").alias("page_number"), "start_char"), named_headings(table(spark, d, "paper_pages")))
    both = stage(rows.select("chunk_id", classify_title("section_title").alias("kind")).join(gov.select(F.col("page_id").alias("chunk_id"), "governing"), "chunk_id"), "kinds")
    return both.groupBy("governing").agg(F.count("*").alias("n"), rate(F.sum((F.col("kind") == F.col("governing")).cast("bigint")), F.count("*")).alias("accuracy"))


_ONE = """
WITH cl AS (SELECT DISTINCT ON (claim_id) * FROM extracted_claims), ch AS (SELECT DISTINCT ON (chunk_id) * FROM text_chunks WHERE chunk_id IS NOT NULL), syn AS (SELECT DISTINCT ON (synthesis_id) * FROM syntheses), sen AS (SELECT DISTINCT ON (sentence_id) * FROM review_sentences),
claims AS (SELECT claim_id, min(paper_id) AS paper_id FROM extracted_claims WHERE claim_id IS NOT NULL GROUP BY 1),
sl AS (SELECT synthesis_id, unnest(range(len(supporting_claim_ids))) AS pos, unnest(supporting_claim_ids) AS claim_id FROM syn),
rl AS (SELECT DISTINCT sentence_id, review_draft_id, claim_id FROM (SELECT sentence_id, review_draft_id, unnest(supporting_claim_ids) AS claim_id FROM sen) WHERE claim_id IN (SELECT claim_id FROM claims))"""

QUERIES = {f.__name__: f for f in (persist_claims, persist_syntheses, persist_synthesis_links, persist_sentences, embedding_texts, claim_requests, synthesis_requests, citation_cleanup, judge_batches, draft_labels, section_accuracy)}
SQL = {
    "persist_claims": _ONE + ", j AS (SELECT c.claim_id, k.paper_id, c.chunk_id, coalesce(c.start_char >= k.start_char AND c.end_char <= k.end_char AND c.page BETWEEN k.page_start AND k.page_end, false) AS ok FROM cl c JOIN ch k USING (chunk_id)) SELECT claim_id, paper_id, chunk_id FROM j WHERE chunk_id NOT IN (SELECT chunk_id FROM j WHERE NOT ok)",
    "persist_syntheses": _ONE + ", n AS (SELECT synthesis_id, count(DISTINCT paper_id) AS p, count(DISTINCT claim_id) AS c FROM sl JOIN claims USING (claim_id) GROUP BY 1) SELECT synthesis_id, coalesce(p, 0)::INT AS supporting_papers, coalesce(c, 0)::INT AS supporting_claims FROM syn LEFT JOIN n USING (synthesis_id)",
    "persist_synthesis_links": _ONE + " SELECT DISTINCT synthesis_id, claim_id FROM sl WHERE claim_id IN (SELECT claim_id FROM claims)",
    "persist_sentences": _ONE + ", g AS (SELECT sentence_id, string_agg(claim_id, ',' ORDER BY claim_id) AS ids FROM rl GROUP BY 1) SELECT sentence_id, coalesce(ids, '') AS claim_ids, ids IS NOT NULL AS is_supported FROM sen LEFT JOIN g USING (sentence_id)",
    "embedding_texts": _ONE + " SELECT 'claim' AS entity_type, claim_id AS entity_id, md5(coalesce(nullif(normalized_text, ''), claim_text)) AS digest FROM cl UNION ALL SELECT 'synthesis', synthesis_id, md5(concat_ws(chr(10), title, body)) FROM syn",
    "claim_requests": _ONE + rf" SELECT chunk_id, md5('{HEADING}' || chr(10) || chr(10) || 'section_type: ' || coalesce(section_type, 'unknown') || chr(10) || chr(10) || 'Chunk text:' || chr(10) || regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f]', ' ', 'g')) AS digest FROM ch",
    "synthesis_requests": _ONE + f""", p0 AS (SELECT synthesis_id AS pool_id, claim_id, min(pos) AS pos FROM sl GROUP BY 1, 2), r AS (SELECT p0.*, c.paper_id, c.claim_type, coalesce(nullif(normalized_text, ''), claim_text) AS text FROM p0 JOIN cl c USING (claim_id)), f AS (SELECT pool_id, paper_id, min(pos) AS first FROM r GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY first, paper_id) AS k FROM f),
l AS (SELECT n.*, CASE WHEN k <= 26 THEN chr((k + 64)::INT) ELSE 'P' || k END AS label, coalesce(nullif(regexp_replace(regexp_replace(replace(title, '_', ' '), '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'), ''), nullif(paper_key, ''), n.paper_id) AS name FROM n LEFT JOIN papers USING (paper_id)),
a AS (SELECT pool_id, string_agg('[' || label || '] ' || name, chr(10) ORDER BY first, paper_id) AS papers FROM l GROUP BY 1), b AS (SELECT r.pool_id, string_agg('- claim_id=' || claim_id || '; paper=' || label || '; type=' || coalesce(claim_type, '') || '; text=' || coalesce(text, ''), chr(10) ORDER BY pos) AS claims FROM r JOIN l USING (pool_id, paper_id) GROUP BY 1)
SELECT pool_id, '{POOL_HEADING}' || chr(10) || chr(10) || 'Papers:' || chr(10) || papers || chr(10) || chr(10) || 'Claims:' || chr(10) || claims AS request FROM a JOIN b USING (pool_id)""",
    "citation_cleanup": _ONE + f", t AS (SELECT review_draft_id, unnest(regexp_extract_all(concat_ws(' ', sentence_text, array_to_string(supporting_claim_ids, ' ')), '{UUID}')) AS claim_id FROM sen) SELECT DISTINCT review_draft_id, claim_id FROM t WHERE claim_id IN (SELECT claim_id FROM claims)",
    "judge_batches": _ONE + " SELECT sentence_id, ((row_number() OVER (PARTITION BY review_draft_id ORDER BY section_title NULLS FIRST, sentence_index NULLS FIRST, sentence_id) - 1) // 12)::INT AS batch FROM sen",
    "draft_labels": _ONE + " SELECT synthesis_id, coalesce(strftime(created_at, '%Y-%m-%d %H:%M'), 'unknown time') || ' - ' || coalesce(title, '') AS label FROM syn",
    "section_accuracy": f"WITH {HITS}, ch AS (SELECT DISTINCT ON (chunk_id) * FROM text_chunks WHERE chunk_id IS NOT NULL), c AS (SELECT chunk_id, paper_id, {classify_sql('section_title')} AS kind, page_start::BIGINT * 1000000000 + start_char AS at FROM ch), h AS (SELECT paper_id, section_type, page_number::BIGINT * 1000000000 + start_char AS at FROM hits), g AS (SELECT c.kind, coalesce(h.section_type, 'other') AS governing FROM c ASOF LEFT JOIN h ON c.paper_id = h.paper_id AND c.at >= h.at) SELECT governing, count(*) AS n, round(count(*) FILTER (kind = governing) / count(*), 3) AS accuracy FROM g GROUP BY 1",
}
