"""Queries of quotes, measures, comparison, validation, identities and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions.ids import NAMESPACE, request_key, stable_id, text_key
from evispark.functions.text import body_before_references, body_sentences, content_words
from evispark.operators import evaluation as E
from evispark.operators import validation as V
from evispark.operators.alignment import align_sentences
from evispark.operators.provenance import draft_markdown, normalize_support, sentence_support
from evispark.operators.quotes import locate_exact, locate_quotes, span_matches
from evispark.operators.replay import misses, replay
from evispark.staging import stage, table


def _claims(spark, d):
    return table(spark, d, "extracted_claims").dropDuplicates(["claim_id"])


def _candidates(spark, d):
    return table(spark, d, "claim_candidates").dropDuplicates(["candidate_id"])


def quote_locate_exact(spark, d):
    return locate_exact(table(spark, d, "claim_candidates"), table(spark, d, "text_chunks"))


def quote_locate(spark, d):
    return locate_quotes(table(spark, d, "claim_candidates"), table(spark, d, "text_chunks"))


def span_overlap_match(spark, d):
    gold = _claims(spark, d).select(F.col("claim_id").alias("gold_id"), "chunk_id", "claim_type", "start_char", "end_char")
    return span_matches(gold, quote_locate_exact(spark, d))


def gold_summary(spark, d):
    """Gold claims and candidates by their verbatim spans, both ways: micro recall and precision, F1 of the rounded two."""
    gold = stage(_claims(spark, d).select(F.col("claim_id").alias("gold_id"), "chunk_id", "claim_type", "start_char", "end_char"), "gold")
    found = stage(quote_locate_exact(spark, d), "found")
    m = span_matches(gold, found)
    back = span_matches(found.withColumnRenamed("candidate_id", "gold_id"), gold)
    n, hit = F.count("*"), F.sum(F.col("matched").cast("bigint"))
    a = m.agg(n.alias("gold"), hit.alias("matched"), E.rate(hit, n).alias("recall"), E.rate(F.sum(F.col("type_agrees").cast("bigint")), hit).alias("type_agreement"))
    total = _candidates(spark, d).filter("candidate_id is not null").join(table(spark, d, "text_chunks").filter("chunk_id is not null").select("chunk_id").distinct(), "chunk_id", "left_semi").agg(F.count("*").alias("predicted"))
    b = back.agg(F.sum(F.col("matched").cast("bigint")).alias("predicted_matched"))
    row = a.join(F.broadcast(b)).join(F.broadcast(total)).withColumn("precision", E.rate(F.col("predicted_matched"), F.col("predicted")))  # single rows
    return row.withColumn("f1", E.f1(F.col("precision"), F.col("recall")))


def claims_summary(spark, d):
    c = _candidates(spark, d)
    verbatim = stage(quote_locate_exact(spark, d).select("candidate_id", F.lit(True).alias("v")), "verbatim")
    chunks = F.countDistinct("chunk_id")
    rows = c.join(verbatim, "candidate_id", "left")
    return rows.groupBy("model").agg(
        F.count("*").alias("claims"), chunks.alias("chunks"), E.rate(F.count("*"), chunks).alias("claims_per_chunk"), E.share(F.coalesce("v", F.lit(False))).alias("verbatim_rate"), E.share(F.coalesce(F.col("normalized_text") != "", F.lit(False))).alias("normalized_rate"), E.share(F.col("confidence").between(0, 1)).alias("confidence_valid"), F.round(F.avg("confidence"), 3).alias("confidence_mean")
    )


def claim_types(spark, d):
    return E.most_common(_candidates(spark, d), "claim_type")


def _verdicts(spark, d):
    s = table(spark, d, "review_sentences").dropDuplicates(["sentence_id"])
    named = lambda c: F.when(c, "supported").when(~c, "unsupported")
    rows = s.select("sentence_id", named(F.col("is_supported")).alias("predicted"))
    return rows.join(sentence_support(s, table(spark, d, "extracted_claims")).select("sentence_id", named(F.col("is_supported")).alias("label")), "sentence_id")


def verdict_rates(spark, d):
    return E.verdict_rates(_verdicts(spark, d), "predicted", ["supported", "unsupported"])


def confusion_matrix(spark, d):
    return E.confusion_matrix(_verdicts(spark, d), "label", "predicted")


def cohen_kappa(spark, d):
    return E.cohen_kappa(stage(confusion_matrix(spark, d), "matrix"))


def usage_summary(spark, d):
    events = table(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("bigint")).withColumn("cost", F.when(F.col("event_type") != "error", F.col("value")))
    return E.usage(events, "event_type", "tokens", "cost", "value")


def first_mentions(spark, d):
    """References to claims that no earlier sentence of their draft names."""
    s = table(spark, d, "review_sentences").dropDuplicates(["sentence_id"])
    rows = s.select("review_draft_id", F.struct("section_title", "sentence_index", "sentence_id").alias("place"), F.explode(normalize_support("supporting_claim_ids")).alias("claim_id"))
    return rows.groupBy("review_draft_id", "claim_id").agg(F.min("place")["sentence_id"].alias("sentence_id"), F.count("*").alias("mentions"))


def word_overlap(spark, d):
    """Whether the normalized text reports its claim: at least 0.6 of the claim's content words."""
    rows = _claims(spark, d).select("claim_id", content_words("claim_text").alias("a"), content_words("normalized_text").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return rows.filter("b is not null and size(a) > 0").select("claim_id", both.alias("shared"), (both >= 0.6 * F.size("a")).alias("reported"))


def _by_model(spark, d, low):
    c = _candidates(spark, d).filter((F.col("confidence") < 0.5) if low else (F.col("confidence") >= 0.5))
    return c.groupBy("model").agg(F.count("*").alias("claims"), F.round(F.avg("confidence"), 6).alias("confidence"), E.share(F.col("claim_type") == "finding").alias("findings"))


def metrics_unpivot(spark, d):
    return E.unpivot_metrics(_by_model(spark, d, True), "model")


def gate_compare(spark, d):
    now, before = (E.unpivot_metrics(_by_model(spark, d, low), "model") for low in (False, True))
    return E.compare_metrics(now, before, {"confidence": "up", "findings": "down"}, 0.02)


def validate_constraints(spark, d):
    return V.violations(table(spark, d, "text_chunks"), V.chunk_rules()).unionByName(V.violations(table(spark, d, "extracted_claims"), V.claim_rules()))


def validate_locations(spark, d):
    return V.claim_locations(table(spark, d, "extracted_claims"), table(spark, d, "text_chunks"))


def repeated_keys(spark, d):
    return V.duplicate_keys(table(spark, d, "extracted_claims"), ["claim_id"])


def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", stable_id("document", F.col("doc_id").cast("string")).alias("id"))


def text_keys(spark, d):
    return _candidates(spark, d).select("candidate_id", text_key(F.col("model"), F.col("claim_text")).alias("key"))


def _requests(spark, d):
    return _candidates(spark, d).select("candidate_id", request_key(F.col("model"), F.col("chunk_id"), F.col("claim_text")).alias("key"))


def _recordings(spark, d):
    kept = _claims(spark, d).select("candidate_id", "claim_type")
    return _requests(spark, d).join(kept, "candidate_id").select("key", F.col("claim_type").alias("answer"))


def request_keys(spark, d):
    return _requests(spark, d)


def replay_join(spark, d):
    return replay(_requests(spark, d), _recordings(spark, d))


def replay_misses(spark, d):
    return misses(_requests(spark, d), _recordings(spark, d))


def sentence_alignment(spark, d):
    s = table(spark, d, "review_sentences").dropDuplicates(["sentence_id"])
    body = draft_markdown(s).select("review_draft_id", F.explode(body_sentences(body_before_references("markdown"))).alias("sentence"))
    body = body.withColumn("sentence", F.regexp_replace("sentence", r"\s*\[[0-9a-f, -]*\]\.?$", ""))
    return align_sentences(s, body, "review_draft_id")


_W = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_BASE = """
WITH cand AS (SELECT DISTINCT ON (candidate_id) * FROM claim_candidates WHERE candidate_id IS NOT NULL), cl AS (SELECT DISTINCT ON (claim_id) * FROM extracted_claims), ch AS (SELECT DISTINCT ON (chunk_id) * FROM text_chunks WHERE chunk_id IS NOT NULL),
sen AS (SELECT DISTINCT ON (sentence_id) * FROM review_sentences), syn AS (SELECT DISTINCT ON (synthesis_id) * FROM syntheses), claims AS (SELECT claim_id, min(paper_id) AS paper_id FROM extracted_claims WHERE claim_id IS NOT NULL GROUP BY 1)"""
_EXACT = _BASE + rf""",
q AS (SELECT candidate_id, chunk_id, claim_type, regexp_replace(source_quote, '^{_W}+|{_W}+$', '', 'g') AS quote FROM cand),
j AS (SELECT q.candidate_id, chunk_id, q.claim_type, start_char, quote, strpos(text, quote) AS e, strpos(regexp_replace(text, '{_W}', ' ', 'g'), regexp_replace(quote, '{_W}', ' ', 'g')) AS b FROM q JOIN ch USING (chunk_id) WHERE quote <> ''),
exact AS (SELECT candidate_id, chunk_id, claim_type, start_char + if(e > 0, e, b) - 1 AS start_char, start_char + if(e > 0, e, b) - 1 + length(quote) AS end_char FROM j WHERE e > 0 OR b > 0)"""
_MATCH = _EXACT + """,
best AS (SELECT g.claim_id AS gold_id, g.claim_type, max(CASE WHEN p.start_char IS NOT NULL THEN {'overlap': round(CASE WHEN least(g.end_char - g.start_char, p.end_char - p.start_char) > 0 THEN (least(g.end_char, p.end_char) - greatest(g.start_char, p.start_char)) / least(g.end_char - g.start_char, p.end_char - p.start_char) ELSE 0 END, 9), 't': p.claim_type} END) AS b
  FROM cl g LEFT JOIN exact p ON p.chunk_id = g.chunk_id AND p.start_char < g.end_char AND p.end_char > g.start_char GROUP BY 1, 2),
matches AS (SELECT gold_id, coalesce(b.overlap, 0) >= 0.5 AS matched, coalesce(b.overlap, 0) AS overlap, CASE WHEN coalesce(b.overlap, 0) >= 0.5 THEN coalesce(b.t = claim_type, false) END AS type_agrees FROM best)"""
_REAL = _BASE + """,
rl AS (SELECT DISTINCT sentence_id FROM (SELECT sentence_id, unnest(supporting_claim_ids) AS claim_id FROM sen) WHERE claim_id IN (SELECT claim_id FROM claims)),
sup AS (SELECT s.*, s.sentence_id IN (SELECT sentence_id FROM rl) AS real, coalesce(len(list_filter(supporting_claim_ids, lambda c: c <> '')), 0) > 0 AND s.sentence_id NOT IN (SELECT sentence_id FROM rl) AS phantom FROM sen s),
ver AS (SELECT CASE WHEN is_supported THEN 'supported' WHEN NOT is_supported THEN 'unsupported' END AS predicted, CASE WHEN real THEN 'supported' ELSE 'unsupported' END AS label FROM sup)"""
_KEYS = _BASE + ", req AS (SELECT candidate_id, sha256(coalesce(model, '') || chr(31) || coalesce(chunk_id, '') || chr(31) || coalesce(claim_text, '')) AS key FROM cand), rec AS (SELECT key, cl.claim_type AS answer FROM req JOIN cl USING (candidate_id))"
_GATE = "WITH cand AS (SELECT DISTINCT ON (candidate_id) * FROM claim_candidates), m AS (SELECT model, confidence < 0.5 AS low, count(*)::DOUBLE AS claims, round(avg(confidence), 6) AS confidence, round(avg((claim_type = 'finding')::INT), 3) AS findings FROM cand GROUP BY 1, 2), u AS (SELECT model || '/' || name AS metric, name, low, value FROM (UNPIVOT m ON claims, confidence, findings INTO NAME name VALUE value))"
_RULES = {
    "text_chunks": {"chunk_start": "start_char >= 0", "chunk_span": "end_char > start_char", "chunk_pages": "page_end >= page_start", "chunk_type": f"section_type IN {V.SECTION_TYPES}", "chunk_length": "length(text) = end_char - start_char"},
    "extracted_claims": {"claim_confidence": "confidence BETWEEN 0 AND 1", "claim_type": f"claim_type IN {V.CLAIM_TYPES}", "claim_start": "start_char >= 0", "claim_span": "end_char > start_char"},
}
_WORDS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) > 3))"

QUERIES = {
    f.__name__: f
    for f in (
        quote_locate_exact, quote_locate, span_overlap_match, gold_summary, claims_summary, claim_types, verdict_rates, confusion_matrix, cohen_kappa, usage_summary, first_mentions, word_overlap,
        metrics_unpivot, gate_compare, validate_constraints, validate_locations, repeated_keys, stable_ids, text_keys, request_keys, replay_join, replay_misses, sentence_alignment,
    )
}
SQL = {
    "quote_locate_exact": _EXACT + " SELECT * FROM exact",
    "span_overlap_match": _MATCH + " SELECT * FROM matches",
    "gold_summary": _MATCH + """, back AS (SELECT p.candidate_id, max(CASE WHEN least(g.end_char - g.start_char, p.end_char - p.start_char) > 0 THEN round((least(g.end_char, p.end_char) - greatest(g.start_char, p.start_char)) / least(g.end_char - g.start_char, p.end_char - p.start_char), 9) ELSE 0 END) AS o FROM exact p JOIN cl g ON p.chunk_id = g.chunk_id AND p.start_char < g.end_char AND p.end_char > g.start_char GROUP BY 1),
s AS (SELECT count(*) AS gold, count(*) FILTER (matched) AS matched, round(count(*) FILTER (matched) / count(*), 3) AS recall, round(count(*) FILTER (type_agrees) / nullif(count(*) FILTER (matched), 0), 3) AS type_agreement, (SELECT count(*) FROM back WHERE o >= 0.5) AS predicted_matched, (SELECT count(*) FROM cand JOIN ch USING (chunk_id)) AS predicted FROM matches),
t AS (SELECT *, round(predicted_matched / predicted, 3) AS precision FROM s) SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 3) END AS f1 FROM t""",
    "claims_summary": _EXACT + " SELECT model, count(*) AS claims, count(DISTINCT chunk_id) AS chunks, round(count(*) / count(DISTINCT chunk_id), 3) AS claims_per_chunk, round(avg((candidate_id IN (SELECT candidate_id FROM exact))::INT), 3) AS verbatim_rate, round(avg(coalesce(normalized_text <> '', false)::INT), 3) AS normalized_rate, round(avg((confidence BETWEEN 0 AND 1)::INT), 3) AS confidence_valid, round(avg(confidence), 3) AS confidence_mean FROM cand GROUP BY 1",
    "claim_types": _BASE + ", n AS (SELECT claim_type AS value, count(*) AS n FROM cand GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM n",
    "verdict_rates": _REAL + " SELECT count(predicted) AS judged, count(*) - count(predicted) AS skipped, round(count(*) FILTER (predicted = 'supported') / count(predicted), 3) AS supported, round(count(*) FILTER (predicted = 'unsupported') / count(predicted), 3) AS unsupported FROM ver",
    "confusion_matrix": _REAL + " SELECT label, predicted, count(*) AS n FROM ver WHERE label IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2",
    "cohen_kappa": _REAL + ", v AS (SELECT * FROM ver WHERE label IS NOT NULL AND predicted IS NOT NULL), a AS (SELECT label AS k, count(*) AS na FROM v GROUP BY 1), b AS (SELECT predicted AS k, count(*) AS nb FROM v GROUP BY 1), t AS (SELECT count(*) AS n, count(*) FILTER (label = predicted) / count(*) AS po, (SELECT sum(na::DOUBLE * nb) FROM a JOIN b USING (k)) / (count(*)::DOUBLE * count(*)) AS pe FROM v) SELECT n, round(po, 3) AS accuracy, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 3) END AS kappa FROM t",
    "usage_summary": "SELECT event_type, count(*) AS calls, sum((props ->> '$.k')::BIGINT)::BIGINT AS tokens, CASE WHEN event_type <> 'error' THEN round(sum(value), 6) END AS cost, round(avg(value), 3) AS latency_mean FROM events GROUP BY 1",
    "first_mentions": _BASE + ", r AS (SELECT review_draft_id, section_title, sentence_index, sentence_id, unnest(list_distinct(list_filter(supporting_claim_ids, lambda c: c <> ''))) AS claim_id FROM sen) SELECT review_draft_id, claim_id, arg_min(sentence_id, ROW(section_title, sentence_index, sentence_id)) AS sentence_id, count(*) AS mentions FROM r GROUP BY 1, 2",
    "word_overlap": _BASE + f", w AS (SELECT claim_id, {_WORDS('claim_text')} AS a, {_WORDS('normalized_text')} AS b FROM cl WHERE normalized_text IS NOT NULL) SELECT claim_id, len(list_intersect(a, b)) AS shared, len(list_intersect(a, b)) >= 0.6 * len(a) AS reported FROM w WHERE len(a) > 0",
    "metrics_unpivot": _GATE + " SELECT metric, value FROM u WHERE low",
    "gate_compare": _GATE + ", c AS (SELECT * FROM u WHERE NOT low), b AS (SELECT * FROM u WHERE low), j AS (SELECT coalesce(c.metric, b.metric) AS metric, coalesce(c.name, b.name) AS name, c.value, b.value AS base, c.metric IS NULL AS gone, b.metric IS NULL AS fresh FROM c FULL JOIN b ON c.metric = b.metric), g AS (SELECT *, CASE WHEN name = 'confidence' THEN value - base ELSE base - value END AS gain FROM j WHERE name IN ('confidence', 'findings')) SELECT metric, value, base, CASE WHEN gone THEN 'missing' WHEN fresh THEN 'new' WHEN base IS NULL THEN 'ok' WHEN value IS NULL OR gain < -0.02 THEN 'regressed' WHEN gain > 0.02 THEN 'improved' ELSE 'ok' END AS status FROM g",
    "validate_constraints": " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (NOT ({c})) AS n_violations, count(*) AS n_rows FROM {t}" for t, rules in _RULES.items() for k, c in rules.items()),
    "validate_locations": _BASE + ", x AS (SELECT claim_id, CASE WHEN k.chunk_id IS NULL THEN 'no chunk' WHEN NOT (c.page BETWEEN page_start AND page_end) THEN 'other page' WHEN c.start_char < k.start_char OR c.end_char > k.end_char THEN 'outside' END AS problem FROM cl c LEFT JOIN ch k ON k.chunk_id = c.chunk_id) SELECT * FROM x WHERE problem IS NOT NULL",
    "repeated_keys": "SELECT claim_id, count(*) AS n FROM extracted_claims GROUP BY 1 HAVING count(*) > 1",
    "stable_ids": f"WITH h AS (SELECT doc_id, sha1(unhex('{NAMESPACE.hex}') || encode('document:' || doc_id)) AS s FROM documents) SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(s, 17, 1))::INT + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id FROM h",
    "text_keys": _BASE + " SELECT candidate_id, substr(sha256(concat_ws(chr(10), model, claim_text)), 1, 24) AS key FROM cand",
    "request_keys": _KEYS + " SELECT * FROM req",
    "replay_join": _KEYS + ", k AS (SELECT key, min(answer) AS answer FROM rec GROUP BY 1) SELECT candidate_id, key, answer, k.key IS NOT NULL AS hit FROM req LEFT JOIN k USING (key)",
    "replay_misses": _KEYS + " SELECT DISTINCT key FROM req WHERE key NOT IN (SELECT key FROM rec)",
}
