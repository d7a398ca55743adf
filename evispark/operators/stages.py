"""Measures of the stages of an evaluation: claims, gold claims, headings, syntheses and review drafts, per case and summed up."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.similarity import lexical_coverage, similarity
from evispark.functions.text import CITATION, REFERENCES, UUID, body_sentences, cited_numbers, lines_with_ends, normalize_text, strip_citations, trim_ws
from evispark.operators.evaluation import f1, rate
from evispark.operators.provenance import live_claims, normalize_support

#: How alike a claim is to its span, how much spans overlap, least block of a located claim, words of a sentence that says something.
SPAN_MATCH, SPAN_OVERLAP, LOCATE_BLOCK, SUBSTANTIVE_WORDS = 0.8, 0.5, 8, 8


def n(condition: Column) -> Column:
    """The number of rows for which ``condition`` holds."""
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


# claims


def claim_metrics(claims: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, location_valid, span_text, span_similarity, span_match, verbatim, lexical_coverage): each claim with a chunk, once.

    The span is the page's text at the claim's places, empty where these make none; a claim without a page has an empty span.
    """
    k = chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", F.col("text").alias("chunk_text"), F.col("start_char").alias("lo"), F.col("end_char").alias("hi"), "page_start", "page_end", F.col("paper_id").alias("of"))
    p = pages.groupBy(F.col("paper_id").alias("of"), F.col("page_number").alias("page")).agg(F.max("text").alias("page_text"))
    rows = claims.filter("claim_id is not null").dropDuplicates(["claim_id"]).join(k, "chunk_id").join(p, ["of", "page"], "left")
    valid = (F.col("start_char") >= F.col("lo")) & (F.col("end_char") <= F.col("hi")) & F.col("page").between(F.col("page_start"), F.col("page_end"))
    span = F.when((F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")), F.expr("substring(page_text, start_char + 1, end_char - start_char)"))
    rows = rows.select("claim_id", "chunk_id", "claim_text", "chunk_text", F.coalesce(valid, F.lit(False)).alias("location_valid"), F.coalesce(span, F.lit("")).alias("span_text"))
    flat = normalize_text("claim_text")
    rows = rows.withColumn("alike", F.when(F.col("span_text") != "", F.coalesce(similarity("claim_text", "span_text"), F.lit(0.0))).otherwise(0.0))
    verbatim = F.coalesce((flat != "") & normalize_text("chunk_text").contains(flat), F.lit(False))
    return rows.select("claim_id", "chunk_id", "location_valid", "span_text", F.round("alike", 3).alias("span_similarity"), (F.col("alike") >= SPAN_MATCH).alias("span_match"), verbatim.alias("verbatim"), F.round(F.coalesce(lexical_coverage("claim_text", "chunk_text"), F.lit(0.0)), 3).alias("lexical_coverage"))


def chunk_cases(chunks: DataFrame, claims: DataFrame, valid: DataFrame, located: DataFrame) -> DataFrame:
    """(chunk_id, n_claims, n_unlocated, empty, rejected): what became of each chunk.

    ``valid`` is (claim_id, chunk_id, location_valid), ``located`` (candidate_id, chunk_id, how) with null for quotes that were not found. One claim outside its
    chunk loses them all.
    """
    c = valid.groupBy("chunk_id").agg(F.count("*").alias("n_claims"), F.min("location_valid").alias("all_valid"))
    u = located.groupBy("chunk_id").agg(n(F.col("how").isNull()).alias("n_unlocated"))
    rows = chunks.filter("chunk_id is not null").select("chunk_id").distinct().join(c, "chunk_id", "left").join(u, "chunk_id", "left").na.fill(0, ["n_claims", "n_unlocated"])
    return rows.select("chunk_id", "n_claims", "n_unlocated", (F.col("n_claims") == 0).alias("empty"), (~F.coalesce("all_valid", F.lit(True))).alias("rejected"))


def claim_summary(cases: DataFrame) -> DataFrame:
    """One row of :func:`chunk_cases`: chunks, claims, and the rates of empty and rejected chunks and of unlocated quotes."""
    rows = F.count("*")
    claims, lost = F.sum("n_claims"), F.sum("n_unlocated")
    return cases.agg(rows.alias("chunks"), claims.alias("claims"), rate(claims, rows).alias("claims_per_chunk"), rate(n(F.col("empty")), rows).alias("empty_chunk_rate"), rate(n(F.col("rejected")), rows).alias("rejected_chunk_rate"), rate(lost, claims + lost).alias("unlocated_rate"))


def worst_locations(metrics: DataFrame, limit: int = 5) -> DataFrame:
    """The claims that don't match their span, the least similar first."""
    return metrics.filter("not span_match").orderBy("span_similarity", "claim_id").limit(limit)


# gold claims


def _located(claims: pd.Series, texts: pd.Series) -> pd.DataFrame:
    out = []
    for claim, text in zip(claims, texts, strict=True):
        blocks = [b for b in difflib.SequenceMatcher(None, claim, text, autojunk=False).get_matching_blocks() if b.size >= LOCATE_BLOCK] if claim and text else []
        out.append((blocks[0].b, blocks[-1].b + blocks[-1].size) if blocks and 2 * sum(b.size for b in blocks) >= len(claim) else (None, None))
    return pd.DataFrame(out, columns=["s", "e"], dtype="Int64")


def locate_claims(rows: DataFrame, text: str, chunk_text: str) -> DataFrame:
    """``rows`` with s and e: where a claim comes from in its chunk's normalized text; null where less than half of it is found.

    Claims that stand there verbatim are found by the JVM, the others by blocks of 8 characters or more.
    """
    rows = rows.withColumn("_a", normalize_text(text)).withColumn("_b", normalize_text(chunk_text)).withColumn("_at", F.expr("if(_a <> '', instr(_b, _a), 0)"))
    # a plain equal stretch is the longest block there can be, if it is long enough to count as one
    whole = rows.filter((F.col("_at") > 0) & (F.length("_a") >= LOCATE_BLOCK)).withColumn("s", (F.col("_at") - 1).cast("bigint")).withColumn("e", F.col("s") + F.length("_a"))
    rest = rows.filter(~F.coalesce((F.col("_at") > 0) & (F.length("_a") >= LOCATE_BLOCK), F.lit(False))).withColumn("_x", F.pandas_udf(_located, "s bigint, e bigint")("_a", "_b"))
    return whole.drop("_a", "_b", "_at").unionByName(rest.select("*", "_x.s", "_x.e").drop("_a", "_b", "_at", "_x"))


def gold_claim_cases(gold: DataFrame, predicted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, n_gold, n_predicted, gold_matched, predicted_matched, predicted_unlocatable, type_agree) of each chunk with gold claims.

    ``gold`` is (chunk_id, claim_id, text, claim_type) with quotes that must stand verbatim, ``predicted`` the same with claims that are located by
    blocks. Both match by at least half of the shorter span; the type is that of the best overlap, of equal ones the last by name.
    """
    k = chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", F.col("text").alias("chunk_text")).join(gold.select("chunk_id").distinct(), "chunk_id", "left_semi")
    flat, whole = normalize_text("text"), normalize_text("chunk_text")
    g = gold.join(k, "chunk_id").select("chunk_id", F.col("claim_id").alias("g_id"), F.col("claim_type").alias("g_type"), flat.alias("q"), whole.alias("w")).withColumn("at", F.expr("if(q <> '', instr(w, q), 0)"))
    g = g.select("chunk_id", "g_id", "g_type", F.when(F.col("at") > 0, F.col("at") - 1).cast("bigint").alias("gs"), F.when(F.col("at") > 0, F.col("at") - 1 + F.length("q")).cast("bigint").alias("ge"))
    p = locate_claims(predicted.join(k, "chunk_id"), "text", "chunk_text").select("chunk_id", F.col("claim_id").alias("p_id"), F.col("claim_type").alias("p_type"), "s", "e")
    shorter = F.least(F.col("ge") - F.col("gs"), F.col("e") - F.col("s"))
    overlap = F.when(shorter > 0, F.greatest(F.lit(0), F.least("ge", "e") - F.greatest("gs", "s")) / shorter).otherwise(0.0)
    both = g.filter("gs is not null").join(p.filter("s is not null"), "chunk_id").withColumn("overlap", overlap).filter(F.col("overlap") >= SPAN_OVERLAP)
    best = both.groupBy("chunk_id", "g_id", "g_type").agg(F.max(F.struct("overlap", "p_type"))["p_type"].alias("t"))
    gold_hits = best.groupBy("chunk_id").agg(F.count("*").alias("gold_matched"), n(F.coalesce(F.col("t") == F.col("g_type"), F.lit(False))).alias("type_agree"))
    hits = both.select("chunk_id", "p_id").distinct().groupBy("chunk_id").agg(F.count("*").alias("predicted_matched"))
    sizes = g.groupBy("chunk_id").agg(F.count("*").alias("n_gold"))
    sizes = sizes.join(p.groupBy("chunk_id").agg(F.count("*").alias("n_predicted"), n(F.col("s").isNull()).alias("predicted_unlocatable")), "chunk_id", "left")
    cols = ["n_gold", "n_predicted", "gold_matched", "predicted_matched", "predicted_unlocatable", "type_agree"]
    return sizes.join(gold_hits, "chunk_id", "left").join(hits, "chunk_id", "left").na.fill(0, cols).select("chunk_id", *cols)


def gold_claim_summary(cases: DataFrame) -> DataFrame:
    """One row: recall and precision over all gold and predicted claims, F1 of these rounded values, agreement of types among the matched."""
    s = F.sum
    row = cases.agg(F.count("*").alias("gold_chunks"), rate(s("gold_matched"), s("n_gold")).alias("gold_recall"), rate(s("predicted_matched"), s("n_predicted")).alias("gold_precision"), rate(s("type_agree"), s("gold_matched")).alias("gold_type_agreement"), F.coalesce(s("predicted_unlocatable"), F.lit(0)).alias("gold_predicted_unlocatable"))
    return row.withColumn("gold_f1", f1(F.col("gold_precision"), F.col("gold_recall")))


# headings


def locate_lines(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """``headings`` (paper_id, page_number, heading, ...) with start_char: the place of the first line of their page that equals the heading, blanks aside; 0 where none does."""
    at = lines.select("paper_id", "page_number", trim_ws("line").alias("_line"), F.col("start_char").alias("_at")).filter("_line <> ''").groupBy("paper_id", "page_number", "_line").agg(F.min("_at").alias("_at"))
    rows = headings.withColumn("_line", trim_ws("heading")).join(at, ["paper_id", "page_number", "_line"], "left")
    return rows.withColumn("start_char", F.coalesce("_at", F.lit(0)).cast("bigint")).drop("_line", "_at")


def heading_cases(detected: DataFrame, gold: DataFrame, governed: DataFrame) -> DataFrame:
    """(paper_id, n_detected, n_gold, headings_matched, matched_type_correct, n_chunks, chunks_type_correct, missed) of each paper with gold headings.

    Both are (paper_id, page_number, start_char, section_type), gold with ``heading``; headings match by their place. ``governed`` is
    (paper_id, section_type, governing): chunks with their own type and that of the gold heading before them.
    """
    place = ["paper_id", "page_number", "start_char"]
    g = gold.groupBy(*place).agg(F.max(F.struct("section_type", "heading")).alias("x")).select(*place, F.col("x.section_type").alias("g_type"), F.col("x.heading").alias("heading"))
    papers = g.select("paper_id").distinct()
    rows = detected.join(papers, "paper_id", "left_semi").select(*place, F.col("section_type").alias("d_type"), F.lit(1).alias("d")).join(g.withColumn("g", F.lit(1)), place, "full_outer")
    both = F.col("d").isNotNull() & F.col("g").isNotNull()
    missed = F.when(F.col("d").isNull(), F.struct("page_number", "start_char", F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit(" "), F.col("heading"), F.lit(" ("), F.col("g_type"), F.lit(")")).alias("t")))
    out = rows.groupBy("paper_id").agg(F.count("d").alias("n_detected"), F.count("g").alias("n_gold"), n(both).alias("headings_matched"), n(both & (F.col("d_type") == F.col("g_type"))).alias("matched_type_correct"), F.array_join(F.array_sort(F.collect_list(missed))["t"], "; ").alias("missed"))
    c = governed.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), n(F.coalesce("section_type", F.lit("other")) == F.col("governing")).alias("chunks_type_correct"))
    return out.join(c, "paper_id", "left").na.fill(0, ["n_chunks", "chunks_type_correct"])


def heading_summary(cases: DataFrame) -> DataFrame:
    s = F.sum
    return cases.agg(F.count("*").alias("papers"), s("n_gold").alias("n_gold"), s("n_detected").alias("n_detected"), rate(s("headings_matched"), s("n_detected")).alias("heading_precision"), rate(s("headings_matched"), s("n_gold")).alias("heading_recall"), rate(s("matched_type_correct"), s("headings_matched")).alias("matched_type_accuracy"), rate(s("chunks_type_correct"), s("n_chunks")).alias("chunk_type_accuracy"))


# syntheses


def synthesis_cases(syntheses: DataFrame, claims: DataFrame) -> DataFrame:
    """(call_id, synthesis_id, n_cited, n_invented, unsupported, type_matches, supporting_papers, multi_paper, count_mismatch) of syntheses with ``call_id`` and ``requested``."""
    rows = syntheses.dropDuplicates(["synthesis_id"])
    cited = rows.select("synthesis_id", F.explode(normalize_support("supporting_claim_ids")).alias("claim_id"))
    per = cited.join(live_claims(claims).withColumn("known", F.lit(1)), "claim_id", "left").groupBy("synthesis_id").agg(F.count("*").alias("n_cited"), F.count("known").alias("valid"), F.countDistinct("paper_id").alias("papers"))
    rows = rows.join(per, "synthesis_id", "left").na.fill(0, ["n_cited", "valid", "papers"])
    wrong = ~(F.col("supporting_claims").eqNullSafe(F.col("valid")) & F.col("supporting_papers").eqNullSafe(F.col("papers")))
    return rows.select("call_id", "synthesis_id", "n_cited", (F.col("n_cited") - F.col("valid")).alias("n_invented"), (F.col("valid") == 0).alias("unsupported"), F.coalesce(F.col("synthesis_type") == F.col("requested"), F.lit(False)).alias("type_matches"), F.col("papers").alias("supporting_papers"), (F.col("papers") >= 2).alias("multi_paper"), wrong.alias("count_mismatch"))


def synthesis_summary(cases: DataFrame, calls: DataFrame) -> DataFrame:
    """One row over ``calls`` (call_id, error): calls, errors, the rate of empty calls, and rates over their syntheses."""
    ok = calls.filter("error is null").select("call_id").distinct()
    items = cases.join(ok, "call_id", "left_semi")
    full = items.select("call_id").distinct().withColumn("full", F.lit(1))
    a = calls.join(full, "call_id", "left").agg(F.count("*").alias("calls"), n(F.col("error").isNotNull()).alias("errors"), rate(n(F.col("error").isNull() & F.col("full").isNull()), n(F.col("error").isNull())).alias("empty_call_rate"))
    rows = F.count("*")
    b = items.agg(rows.alias("syntheses"), F.round(F.avg("n_cited"), 3).alias("claims_cited_mean"), rate(F.sum("n_invented"), F.sum("n_cited")).alias("invented_id_rate"), *[rate(n(F.col(c)), rows).alias(f"{k}_rate") for c, k in (("unsupported", "unsupported"), ("type_matches", "type_match"), ("multi_paper", "multi_paper"), ("count_mismatch", "count_mismatch"))])
    return a.join(F.broadcast(b))  # two single rows


# review drafts


def review_cases(sentences: DataFrame, claims: DataFrame, final: DataFrame, valid: DataFrame) -> DataFrame:
    """(review_draft_id and the measures of a draft): what its sentences cite and what its final text shows.

    ``final`` is (review_draft_id, markdown), ``valid`` (review_draft_id, number): the numbers of its references. Alignment of sentences with the text is
    :func:`evispark.operators.alignment.align_sentences`.
    """
    key = "review_draft_id"
    s = sentences.dropDuplicates(["sentence_id"]).select(key, "sentence_id", "is_supported", normalize_support("supporting_claim_ids").alias("ids"))
    known = s.select("sentence_id", F.explode("ids").alias("claim_id")).join(live_claims(claims), "claim_id", "left_semi").groupBy("sentence_id").agg(F.count("*").alias("known"))
    s = s.join(known, "sentence_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    linked, rows, cited = F.col("known") > 0, F.count("*"), F.sum(F.size("ids"))
    traces = s.groupBy(key).agg(rows.alias("n_sentences"), rate(n(linked), rows).alias("sentence_supported_rate"), rate(n((F.size("ids") > 0) & ~linked), rows).alias("sentence_phantom_support_rate"), rate(cited - F.sum("known"), cited).alias("sentence_invented_id_rate"), rate(n(~F.col("is_supported").eqNullSafe(linked)), rows).alias("sentence_flag_mismatch_rate"))
    parts = F.split("markdown", REFERENCES, 2)
    body, tail = parts[0], F.try_element_at(parts, F.lit(2))
    found = body_sentences(body)
    words = lambda x: F.size(F.filter(F.split(strip_citations(x), r"\s+"), lambda w: w != ""))
    solid = F.filter(found, lambda x: words(x) >= SUBSTANTIVE_WORDS)
    lines = F.filter(lines_with_ends(tail), lambda x: x.rlike(r"^\s*\[\d+\]\s"))
    v = valid.groupBy(key).agg(F.array_sort(F.collect_set("number")).alias("valid"))
    text = final.join(v, key, "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<int>"))).withColumn("used", cited_numbers(body)).withColumn("solid", solid)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    covered = F.size(F.filter("solid", lambda x: x.rlike(CITATION)))
    text = text.select(key, F.size(found).alias("n_body_sentences"), rate(covered, F.size("solid")).alias("body_citation_coverage"), joined(F.array_except("used", "valid")).alias("invalid_citation_numbers"), joined(F.array_except("valid", "used")).alias("uncited_references"), F.size(F.regexp_extract_all("markdown", F.lit(f"({UUID})"), F.lit(1))).alias("leaked_ids"), F.coalesce(F.size(lines) == F.size("valid"), F.lit(False)).alias("references_complete"))
    return traces.join(text, key)


def review_summary(cases: DataFrame) -> DataFrame:
    """One row: means of the rates over drafts (nulls skipped), and sums of what should not be there."""
    rates = ("sentence_supported_rate", "sentence_phantom_support_rate", "sentence_invented_id_rate", "sentence_flag_mismatch_rate", "body_citation_coverage")
    count = lambda c: F.size(F.filter(F.split(c, ","), lambda x: x != ""))
    return cases.agg(F.count("*").alias("drafts"), *[F.round(F.avg(c), 3).alias(c) for c in rates], rate(n(F.col("references_complete")), F.count("*")).alias("references_complete_rate"), F.sum(count("invalid_citation_numbers")).alias("invalid_citations"), F.sum("leaked_ids").alias("leaked_ids"))
