"""Queries of the stages of an evaluation: claims, headings, syntheses, review drafts, judges and an agent's runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.encoding import json_text
from evispark.functions.ids import agent_key, call_key
from evispark.functions.text import UUID, collapse_ws
from evispark.operators import evaluation as E
from evispark.operators import judging as J
from evispark.operators import stages as S
from evispark.operators import trajectories as T
from evispark.operators.chunking import governing_heading
from evispark.operators.persistence import batches
from evispark.operators.provenance import citation_numbers, sentence_support
from evispark.operators.quotes import locate_exact
from evispark.operators.sections import find_headings, page_lines
from evispark.plans.documents import _ALL_HITS, WS
from evispark.plans.evaluation import _EXACT, _REAL
from evispark.plans.provenance import _CITED, _POOLS, _support, cited_drafts, draft_pools
from evispark.staging import stage, table

TYPES = ("theme", "contradiction", "gap", "method_comparison", "insight")


def _md5(c):
    return F.md5(F.encode(c, "utf-8")).alias("digest")


def _chunks(spark, d):
    return table(spark, d, "text_chunks")


def _claims(spark, d):
    return table(spark, d, "extracted_claims")


def _metrics(spark, d):
    return S.claim_metrics(_claims(spark, d), _chunks(spark, d), table(spark, d, "paper_pages"))


def claim_fidelity(spark, d):
    """All measures of each claim against its chunk and its span."""
    return _metrics(spark, d).drop("span_text")


def claim_checks(spark, d):
    """The measures of each claim that need no alignment."""
    return _metrics(spark, d).select("claim_id", "chunk_id", "location_valid", F.length("span_text").alias("span_chars"), "verbatim")


def worst_locations(spark, d):
    return S.worst_locations(stage(_metrics(spark, d), "metrics")).select("claim_id", "span_similarity")


def chunk_claim_cases(spark, d):
    """Chunks with their claims and the quotes that don't stand in them up to white space."""
    c = table(spark, d, "claim_candidates").filter("candidate_id is not null").dropDuplicates(["candidate_id"]).join(_chunks(spark, d).filter("chunk_id is not null").select("chunk_id").distinct(), "chunk_id", "left_semi")
    exact = locate_exact(table(spark, d, "claim_candidates"), _chunks(spark, d)).select("candidate_id", F.lit("exact").alias("how"))
    return S.chunk_cases(_chunks(spark, d), _claims(spark, d), claim_checks(spark, d), c.select("candidate_id", "chunk_id").join(exact, "candidate_id", "left"))


def claim_stage_summary(spark, d):
    return S.claim_summary(chunk_claim_cases(spark, d))


def _sides(spark, d):
    """The quotes of one model as gold claims, those of the others as predicted ones."""
    c = table(spark, d, "claim_candidates").filter("candidate_id is not null and chunk_id is not null").dropDuplicates(["candidate_id"])
    rows = c.select("chunk_id", F.col("candidate_id").alias("claim_id"), F.col("source_quote").alias("text"), "claim_type", "model")
    large = F.coalesce(F.col("model").contains("large"), F.lit(False))
    return rows.filter(large).drop("model"), rows.filter(~large).drop("model")


def gold_claim_cases(spark, d):
    """Quotes of other models, located in their chunks by blocks, against the verbatim quotes of the large one."""
    return S.gold_claim_cases(*_sides(spark, d), _chunks(spark, d))


def gold_claim_summary(spark, d):
    return S.gold_claim_summary(gold_claim_cases(spark, d))


def _gold_headings(spark, d):
    """(paper_id, page_number, heading, section_type, start_char): what chunks say of the section they begin in, as labels."""
    c = _chunks(spark, d).filter("section_title is not null and paper_id is not null").groupBy("paper_id", F.col("page_start").alias("page_number"), collapse_ws("section_title").alias("heading")).agg(F.coalesce(F.min(F.lower(collapse_ws("section_type"))), F.lit("other")).alias("section_type"))
    return S.locate_lines(c, page_lines(table(spark, d, "paper_pages")))


def heading_cases(spark, d):
    gold = stage(_gold_headings(spark, d), "gold")
    detected = find_headings(table(spark, d, "paper_pages")).select("paper_id", "page_number", "start_char", "section_type")
    c = _chunks(spark, d).filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("paper_id", F.col("chunk_id").alias("page_id"), F.col("page_start").alias("page_number"), "start_char", F.lower(collapse_ws("section_type")).alias("section_type"))
    of = gold.groupBy("paper_id", "page_number", "start_char").agg(F.max(F.struct("section_type", "heading"))["section_type"].alias("section_type"))
    governed = governing_heading(c.drop("section_type"), of).join(c.select("page_id", "section_type"), "page_id")
    return S.heading_cases(detected, gold, governed)


def heading_metrics(spark, d):
    return S.heading_summary(stage(heading_cases(spark, d), "cases"))


def _nibble(c, i=1):
    return F.conv(F.substring(c, i, 1), 16, 10).cast("int")


def _requested(spark, d):
    """Syntheses of the 16 calls that their ids' first digit tells, with a type that was asked for."""
    types = F.array(*[F.lit(t) for t in TYPES])
    return table(spark, d, "syntheses").dropDuplicates(["synthesis_id"]).withColumn("call_id", _nibble("synthesis_id")).withColumn("requested", F.when(_nibble("synthesis_id", 2) < 12, F.col("synthesis_type")).otherwise(F.element_at(types, _nibble("synthesis_id", 2) - 11)))


def synthesis_cases(spark, d):
    return S.synthesis_cases(_requested(spark, d), _claims(spark, d))


def synthesis_summary(spark, d):
    """Twenty calls: the sixteen, three without syntheses, one that failed."""
    calls = spark.range(20).select(F.col("id").cast("int").alias("call_id"), F.when(F.col("id") == 19, "failed").alias("error"))
    return S.synthesis_summary(stage(synthesis_cases(spark, d), "cases"), calls)


def review_cases(spark, d):
    return S.review_cases(table(spark, d, "review_sentences"), _claims(spark, d), cited_drafts(spark, d), citation_numbers(_support(spark, d)))


def review_summary(spark, d):
    return S.review_summary(stage(review_cases(spark, d), "cases"))


def claim_judge_requests(spark, d):
    return J.claim_judge_requests(_chunks(spark, d), _claims(spark, d)).select("chunk_id", _md5("request"))


def synthesis_judge_requests(spark, d):
    return J.synthesis_judge_requests(table(spark, d, "syntheses"), J.cited_claims(_claims(spark, d), table(spark, d, "papers"))).select("synthesis_id", _md5("request"))


_ORDER = ["section_title", "sentence_index", "sentence_id"]


def _batched(spark, d):
    return batches(table(spark, d, "review_sentences").dropDuplicates(["sentence_id"]), "review_draft_id", _ORDER)


def review_judge_requests(spark, d):
    return J.review_judge_requests(_batched(spark, d), J.cited_claims(_claims(spark, d), table(spark, d, "papers")), _ORDER).select("review_draft_id", "batch", _md5("request"))


def judged_sentences(spark, d):
    """Sentences with the verdict of a judge that skips some and names some twice."""
    s = _batched(spark, d).select("review_draft_id", "batch", "sentence_id", *_ORDER[:2])
    items = stage(s.withColumn("number", F.row_number().over(Window.partitionBy("review_draft_id", "batch").orderBy(*_ORDER))), "items")
    real = sentence_support(table(spark, d, "review_sentences"), _claims(spark, d)).select("sentence_id", F.when(F.col("is_supported"), "supported").otherwise("unsupported").alias("verdict"))
    judged = items.filter(_nibble("sentence_id") != 0).join(real, "sentence_id")
    second = judged.filter(_nibble("sentence_id") == 1).withColumn("verdict", F.lit("partially_supported"))
    answers = judged.withColumn("pos", F.lit(0)).unionByName(second.withColumn("pos", F.lit(1))).select("review_draft_id", "batch", "number", "pos", "verdict")
    return J.align_verdicts(items.select("review_draft_id", "batch", "number", "sentence_id"), answers, ["review_draft_id", "batch"]).select("sentence_id", "number", "verdict")


def judge_agreement(spark, d):
    """The verdicts against the flags stored with the sentences; every fourth sentence counts as constructed."""
    flag = table(spark, d, "review_sentences").dropDuplicates(["sentence_id"]).select("sentence_id", F.when(F.col("is_supported"), "supported").otherwise("unsupported").alias("label"))
    rows = judged_sentences(spark, d).join(flag, "sentence_id").select("label", F.col("verdict").alias("predicted"), F.when(_nibble("sentence_id", 2) < 4, "constructed").otherwise("real").alias("origin"))
    return J.agreement(rows, "supported")


def authors_by_place(spark, d):
    """Authors with their last names, item by item."""
    p = table(spark, d, "papers").filter("size(authors) > 0").select("paper_id", "authors")
    last = p.select("paper_id", F.transform("authors", lambda a: F.element_at(F.split(a, " "), -1)).alias("last_names"))
    return J.zip_strict(p, last, "paper_id", "authors", "last_names").select("paper_id", "pos", F.col("authors").alias("author"), F.col("last_names").alias("last_name"))


def call_keys(spark, d):
    """Keys of the calls that ask for each chunk's claims."""
    k = _chunks(spark, d).filter("chunk_id is not null").dropDuplicates(["chunk_id"])
    return k.select("chunk_id", call_key(F.lit("reader"), F.lit("Claims"), F.lit("claims.v1"), F.lit(0.1), F.lit("Say \"what\"\nis claimed"), F.col("text")).alias("key"))


def _messages(spark, d):
    """Runs of an agent, one a draft that has syntheses: it looks for syntheses, gets three, and drafts from four; every second one asks for a new synthesis too."""
    p = stage(draft_pools(spark, d), "pools").join(table(spark, d, "syntheses").dropDuplicates(["synthesis_id"]).select("synthesis_id", "synthesis_type", "title", "body"), "synthesis_id")
    pick = lambda n, x: F.filter(F.array_sort(F.collect_list(F.struct("pos", "synthesis_id", "title", "body", "synthesis_type"))), lambda y: y["pos"] <= n)[x]
    g = p.groupBy(F.col("review_draft_id").alias("case_id")).agg(pick(3, "synthesis_id").alias("three"), pick(4, "synthesis_id").alias("four"), pick(3, "title").alias("titles"), pick(3, "body").alias("bodies"), pick(1, "synthesis_type")[0].alias("asked"))
    g = g.withColumn("odd", _nibble("case_id") % 2 == 1)
    none, items = F.lit(None).cast("array<string>"), F.transform(F.arrays_zip(F.col("titles").alias("title"), F.col("bodies").alias("text")), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    message = lambda pos, kind, tool=None, content=None, ids=none, typed=None, its=None: F.struct(F.lit(pos).alias("position"), F.lit(kind).alias("kind"), F.lit(tool).cast("string").alias("tool_name"), (content if content is not None else F.lit(None).cast("string")).alias("content"), F.lit("{}").alias("args"), none.alias("claim_ids"), ids.alias("synthesis_ids"), (typed if typed is not None else F.lit(None).cast("string")).alias("synthesis_type"), (its if its is not None else F.lit(None).cast("array<struct<title:string,text:string>>")).alias("items"))
    steps = [message(0, "prompt", content=F.lit("Draft a review.")), message(1, "call", "find_syntheses"), message(2, "return", "find_syntheses", F.array_join("three", " "), its=items), message(3, "call", "generate_draft", ids=F.col("four")), message(4, "return", "generate_draft", F.col("case_id"))]
    more = F.when(F.col("odd"), F.array(message(5, "call", "generate_new_syntheses", typed=F.col("asked")))).otherwise(F.array(message(5, "text")))
    rows = g.select("case_id", F.explode(F.concat(F.array(*steps), more)).alias("m")).select("case_id", "m.*")
    outputs = g.select("case_id", F.when(F.col("odd"), "Done.").otherwise(F.concat(F.lit("Saved "), F.coalesce(F.col("titles")[0], F.lit("")))).alias("output"))
    return rows, outputs, g.select("case_id")


def trajectory_checks(spark, d):
    messages, outputs, cases = _messages(spark, d)
    text = lambda *x: F.array(*[F.lit(y) for y in x])
    cases = cases.select("case_id", text("find_syntheses").alias("must_call"), text("generate_new_syntheses").alias("must_not_call"), F.array(text("find_syntheses", "generate_draft")).alias("order"), F.lit("theme").alias("synthesis_type"), F.lit(2).alias("max_tool_calls"))
    return T.trajectory_cases(cases, stage(messages, "messages"), outputs).withColumn("failed", F.array_join("failed", "; "))


def agent_summary(spark, d):
    return T.agent_summary(stage(trajectory_checks(spark, d).withColumn("failed", F.filter(F.split("failed", "; "), lambda x: x != "")), "cases"))


def agent_keys(spark, d):
    messages = T.canonical_messages(_messages(spark, d)[0])
    return messages.select("case_id", agent_key(F.lit("m"), F.col("messages"), F.lit("[]")).alias("key"))


def json_texts(spark, d):
    """Titles and file names as JSON strings."""
    return table(spark, d, "papers").select("paper_id", json_text("title").alias("title"), F.md5(F.encode(json_text(F.array_join("authors", "\n")), "utf-8")).alias("authors"))


def _config(spark, d, chunks):
    """The eight settings of a run over these tables."""
    c, s = table(spark, d, "claim_candidates"), table(spark, d, "review_sentences")
    one = lambda df, v: df.agg(v.cast("string").alias("value"))
    values = {"models": one(c, F.array_join(F.array_sort(F.collect_set("model")), ",")), "n_chunks": one(chunks, F.count("*")), "scenarios": one(s, F.countDistinct("review_draft_id")), "seed": spark.range(1).select(F.lit("0").alias("value"))}
    out = None
    for k, v in values.items():
        row = v.select(F.lit(k).alias("key"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def config_mismatch(spark, d):
    """A run over the chunks as delivered against one over each chunk once."""
    k = _chunks(spark, d)
    return E.config_mismatches(_config(spark, d, k), _config(spark, d, k.filter("chunk_id is not null").dropDuplicates(["chunk_id"])))


def gated_metrics(spark, d):
    """Candidates per model as summaries of a stage, those of it that have a direction."""
    c = table(spark, d, "claim_candidates").filter("candidate_id is not null").dropDuplicates(["candidate_id"])
    rows = c.groupBy("model").agg(F.round(F.avg("confidence"), 3).alias("confidence_mean"), E.share(F.col("claim_type") == "finding").alias("finding_rate"), F.count("*").cast("double").alias("claims"), F.lit(1.0).alias("latency_mean_s"))
    long = rows.unpivot(["model"], ["confidence_mean", "finding_rate", "claims", "latency_mean_s"], "key", "value").withColumn("stage", F.lit("claims"))
    directions = spark.createDataFrame([("claims", "confidence_mean", "up"), ("claims", "finding_rate", "up"), ("claims", "latency_mean_s", "down")], "stage string, key string, better string")
    return E.gated_metrics(long, directions)


def infra_errors(spark, d):
    """Errors of calls that the events tell: those of type error, every third of them of kind infra."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    kind = F.when(F.col("event_id") % 3 == 0, "infra").otherwise("model")
    return E.infra_errors(e.select(F.col("event_id").alias("case_id"), F.array(F.struct(kind.alias("kind"), F.col("props").alias("error"))).alias("errors")))


QUERIES = {
    f.__name__: f
    for f in (
        claim_fidelity, claim_checks, worst_locations, chunk_claim_cases, claim_stage_summary, gold_claim_cases, gold_claim_summary, heading_cases, heading_metrics, synthesis_cases, synthesis_summary, review_cases, review_summary,
        claim_judge_requests, synthesis_judge_requests, review_judge_requests, judged_sentences, judge_agreement, authors_by_place, call_keys, trajectory_checks, agent_summary, agent_keys, json_texts, config_mismatch, gated_metrics, infra_errors,
    )
}

_FLAT = lambda x: f"lower(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g'))"
_NIB = lambda c, i=1: f"('0x' || substr({c}, {i}, 1))::INT"
_CHECKS = _EXACT + f""",
pt AS (SELECT paper_id, page_number, max(text) AS text FROM paper_pages GROUP BY 1, 2),
vj AS (SELECT c.claim_id, c.chunk_id, coalesce(c.start_char >= k.start_char AND c.end_char <= k.end_char AND c.page BETWEEN k.page_start AND k.page_end, false) AS location_valid, CASE WHEN c.start_char >= 0 AND c.start_char < c.end_char THEN length(coalesce(substr(p.text, c.start_char + 1, c.end_char - c.start_char), '')) ELSE 0 END AS span_chars,
  coalesce({_FLAT('c.claim_text')} <> '' AND contains({_FLAT('k.text')}, {_FLAT('c.claim_text')}), false) AS verbatim FROM cl c JOIN ch k ON k.chunk_id = c.chunk_id LEFT JOIN pt p ON p.paper_id = k.paper_id AND p.page_number = c.page WHERE c.claim_id IS NOT NULL),
cc AS (SELECT ch.chunk_id, coalesce(n, 0) AS n_claims, coalesce(u, 0) AS n_unlocated, coalesce(n, 0) = 0 AS empty, NOT coalesce(v, true) AS rejected FROM ch LEFT JOIN (SELECT chunk_id, count(*) AS n, bool_and(location_valid) AS v FROM vj GROUP BY 1) a USING (chunk_id) LEFT JOIN (SELECT chunk_id, count(*) AS u FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM exact) GROUP BY 1) b USING (chunk_id))"""
_SECOND = lambda x: f"nullif(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g'), '')"
_HEADS = "WITH " + _ALL_HITS + f""",
gh AS (SELECT paper_id, page_start AS page_number, coalesce({_SECOND('section_title')}, '') AS heading, coalesce(min(lower({_SECOND('section_type')})), 'other') AS gt FROM text_chunks WHERE section_title IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1, 2, 3),
at0 AS (SELECT paper_id, page_number, bare AS heading, min(start_char) AS at0 FROM bare WHERE bare <> '' GROUP BY 1, 2, 3),
gl AS (SELECT g.paper_id, g.page_number, coalesce(at0, 0) AS start_char, gt, heading FROM gh g LEFT JOIN at0 USING (paper_id, page_number, heading)),
gp AS (SELECT paper_id, page_number, start_char, max({{'t': gt, 'h': heading}}) AS x FROM gl GROUP BY 1, 2, 3),
hm AS (SELECT coalesce(h.paper_id, g.paper_id) AS paper_id, g.page_number, g.start_char, h.section_type AS dt, h.paper_id IS NOT NULL AS d, g.x.t AS gt, g.x.h AS hd, g.paper_id IS NOT NULL AS g FROM (SELECT * FROM hits WHERE paper_id IN (SELECT paper_id FROM gp)) h FULL JOIN gp g ON h.paper_id = g.paper_id AND h.page_number = g.page_number AND h.start_char = g.start_char),
hc AS (SELECT paper_id, count(*) FILTER (d) AS n_detected, count(*) FILTER (g) AS n_gold, count(*) FILTER (d AND g) AS headings_matched, count(*) FILTER (d AND g AND dt = gt) AS matched_type_correct, coalesce(string_agg('p' || page_number || ' ' || hd || ' (' || gt || ')', '; ' ORDER BY page_number, start_char) FILTER (NOT d), '') AS missed FROM hm GROUP BY 1),
ck AS (SELECT DISTINCT ON (chunk_id) paper_id, page_start::BIGINT * 1000000000 + start_char AS spot, coalesce(lower(coalesce({_SECOND('section_type')}, CASE WHEN section_type IS NOT NULL THEN '' END)), 'other') AS st FROM text_chunks WHERE chunk_id IS NOT NULL),
go AS (SELECT paper_id, page_number::BIGINT * 1000000000 + start_char AS spot, x.t AS t FROM gp),
kc AS (SELECT c.paper_id, count(*) AS n_chunks, count(*) FILTER (c.st = coalesce(g.t, 'other')) AS chunks_type_correct FROM ck c ASOF LEFT JOIN go g ON c.paper_id = g.paper_id AND c.spot >= g.spot GROUP BY 1),
cases AS (SELECT hc.*, coalesce(n_chunks, 0) AS n_chunks, coalesce(chunks_type_correct, 0) AS chunks_type_correct FROM hc LEFT JOIN kc USING (paper_id))"""
_SYN = _REAL + f""",
sq AS (SELECT *, {_NIB('synthesis_id')} AS call_id, CASE WHEN {_NIB('synthesis_id', 2)} < 12 THEN synthesis_type ELSE (['theme', 'contradiction', 'gap', 'method_comparison', 'insight'])[{_NIB('synthesis_id', 2)} - 11] END AS requested FROM syn),
sl AS (SELECT DISTINCT synthesis_id, claim_id FROM (SELECT synthesis_id, unnest(supporting_claim_ids) AS claim_id FROM syn) WHERE claim_id <> ''),
sp AS (SELECT synthesis_id, count(*) AS n, count(c.claim_id) AS v, count(DISTINCT paper_id) AS p FROM sl LEFT JOIN claims c USING (claim_id) GROUP BY 1),
sc AS (SELECT call_id, q.synthesis_id, coalesce(n, 0) AS n_cited, coalesce(n - v, 0) AS n_invented, coalesce(v, 0) = 0 AS unsupported, coalesce(synthesis_type = requested, false) AS type_matches, coalesce(p, 0) AS supporting_papers, coalesce(p, 0) >= 2 AS multi_paper, supporting_claims IS DISTINCT FROM coalesce(v, 0) OR q.supporting_papers IS DISTINCT FROM coalesce(p, 0) AS count_mismatch FROM sq q LEFT JOIN sp USING (synthesis_id))"""
_CITE = r"\[(?:\d+(?:\s*[,–-]\s*\d+)*)\]"
_PLAIN = lambda x: f"regexp_replace(regexp_replace({x}, '{_CITE}', '', 'g'), '{UUID}', '', 'g')"
_REVIEW = _CITED + rf""",
sx AS (SELECT review_draft_id, sentence_id, is_supported, list_distinct(list_filter(coalesce(supporting_claim_ids, []), lambda c: c <> '')) AS ids FROM sen),
kn AS (SELECT sentence_id, count(*) AS known FROM (SELECT sentence_id, unnest(ids) AS claim_id FROM sx) WHERE claim_id IN (SELECT claim_id FROM claims) GROUP BY 1),
tr AS (SELECT review_draft_id, count(*) AS n_sentences, round(count(*) FILTER (coalesce(known, 0) > 0) / count(*), 3) AS sentence_supported_rate, round(count(*) FILTER (len(ids) > 0 AND coalesce(known, 0) = 0) / count(*), 3) AS sentence_phantom_support_rate, round((sum(len(ids)) - sum(coalesce(known, 0))) / nullif(sum(len(ids)), 0), 3) AS sentence_invented_id_rate, round(count(*) FILTER (is_supported IS DISTINCT FROM (coalesce(known, 0) > 0)) / count(*), 3) AS sentence_flag_mismatch_rate FROM sx LEFT JOIN kn USING (sentence_id) GROUP BY 1),
bd AS (SELECT review_draft_id, markdown, regexp_split_to_array(markdown, '(?im)^\s{{0,3}}#{{0,6}}\s*references\s*$') AS ps FROM cited),
ls AS (SELECT review_draft_id, markdown, ps[1] AS body, ps[2] AS tail, list_filter(list_transform(string_split(ps[1], chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')) AS l FROM bd),
se AS (SELECT *, list_filter(flatten(list_transform(l, lambda x: string_split(regexp_replace(regexp_replace(x, '^(?:[-*+]|\d+\.)\s+', ''), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: trim(x) <> '') AS ss FROM ls),
so AS (SELECT *, list_filter(ss, lambda x: len(list_filter(regexp_split_to_array({_PLAIN('x')}, '\s+'), lambda w: w <> '')) >= 8) AS solid FROM se),
nu AS (SELECT DISTINCT review_draft_id, unnest(range(ends[1], ends[len(ends)] + 1)) AS k FROM (SELECT review_draft_id, list_transform(regexp_extract_all(part, '\d+'), lambda x: try_cast(x AS INT)) AS ends FROM (SELECT review_draft_id, unnest(flatten(list_transform(regexp_extract_all(body, '{_CITE}'), lambda x: string_split(x, ',')))) AS part FROM so))),
va AS (SELECT review_draft_id, number AS k FROM numbers),
rv AS (SELECT tr.*, len(ss) AS n_body_sentences, CASE WHEN len(solid) > 0 THEN round(len(list_filter(solid, lambda x: regexp_matches(x, '{_CITE}'))) / len(solid), 3) END AS body_citation_coverage,
  coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM nu WHERE nu.review_draft_id = so.review_draft_id AND k NOT IN (SELECT k FROM va WHERE va.review_draft_id = so.review_draft_id)), '') AS invalid_citation_numbers,
  coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM va WHERE va.review_draft_id = so.review_draft_id AND k NOT IN (SELECT k FROM nu WHERE nu.review_draft_id = so.review_draft_id)), '') AS uncited_references,
  len(regexp_extract_all(markdown, '{UUID}')) AS leaked_ids, coalesce(len(list_filter(string_split(tail, chr(10)), lambda x: regexp_matches(x, '^\s*\[\d+\]\s'))) = (SELECT count(*) FROM va WHERE va.review_draft_id = so.review_draft_id), false) AS references_complete FROM tr JOIN so USING (review_draft_id))"""
_TITLED = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(title, '_', ' '), '^" + WS + "+|" + WS + "+$', '', 'g'), '" + WS + "+', ' ', 'g'), '^ | $', '', 'g'), ''), nullif(paper_key, ''), c.paper_id, '')"
_EVID = _REAL + f""",
ct AS (SELECT c.claim_id, '[' || {_TITLED} || '] ' || t AS cited FROM (SELECT claim_id, min(paper_id) AS paper_id, min(coalesce(nullif(normalized_text, ''), claim_text, '')) AS t FROM extracted_claims WHERE claim_id IS NOT NULL GROUP BY 1) c LEFT JOIN papers USING (paper_id)),
ba AS (SELECT *, (row_number() OVER (PARTITION BY review_draft_id ORDER BY section_title NULLS FIRST, sentence_index NULLS FIRST, sentence_id) - 1) // 12 AS batch, (row_number() OVER (PARTITION BY review_draft_id ORDER BY section_title NULLS FIRST, sentence_index NULLS FIRST, sentence_id) - 1) % 12 + 1 AS number FROM sen)"""
_EV = lambda src, key, ind: f"(SELECT {key}, string_agg('{ind}' || n || '. ' || cited, chr(10) ORDER BY n) AS ev FROM (SELECT {key}, cited, row_number() OVER (PARTITION BY {key} ORDER BY claim_id) AS n FROM (SELECT DISTINCT {key}, unnest(supporting_claim_ids) AS claim_id FROM {src}) JOIN ct USING (claim_id)) GROUP BY 1)"
_JUDGED = _EVID + f""",
jv AS (SELECT sentence_id, number, CASE {_NIB('sentence_id')} WHEN 0 THEN NULL WHEN 1 THEN 'partially_supported' ELSE CASE WHEN sentence_id IN (SELECT sentence_id FROM rl) THEN 'supported' ELSE 'unsupported' END END AS verdict FROM ba)"""
_ESC = lambda x: f"""'"' || array_to_string(list_transform(list_transform(range(length({x})), lambda i: substr({x}, (i + 1)::INT, 1)), lambda c: CASE WHEN c = chr(92) THEN chr(92) || chr(92) WHEN c = '"' THEN chr(92) || '"' WHEN c = chr(10) THEN chr(92) || 'n' WHEN c = chr(13) THEN chr(92) || 'r' WHEN c = chr(9) THEN chr(92) || 't' WHEN c = chr(12) THEN chr(92) || 'f' WHEN c = chr(8) THEN chr(92) || 'b' WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN chr(92) || printf('u%04x', unicode(c)) ELSE chr(92) || printf('u%04x', 55296 + ((unicode(c) - 65536) >> 10)) || chr(92) || printf('u%04x', 56320 + ((unicode(c) - 65536) & 1023)) END), '') || '"'"""
_RUNS = _POOLS + f""",
rn AS (SELECT review_draft_id AS case_id, {_NIB('review_draft_id')} % 2 = 1 AS odd, list(synthesis_id ORDER BY pos) AS ids, list(coalesce(title, '') ORDER BY pos) AS ts, list(synthesis_type ORDER BY pos) AS ty FROM pools JOIN syn USING (synthesis_id) GROUP BY 1),
tj AS (SELECT case_id, 2 + odd::INT AS n_tool_calls, (len(ids) >= 4)::INT AS invented, NOT odd AND ts[1] <> '' AS reports, 6 AS n_checks, list_sort(list_filter([CASE WHEN odd THEN 'does not call generate_new_syntheses' END, CASE WHEN odd AND coalesce(ty[1], '') <> 'theme' THEN 'synthesis_type theme' END, CASE WHEN odd THEN 'at most 2 tool calls' END, CASE WHEN len(ids) >= 4 THEN 'no invented ids' END], lambda x: x IS NOT NULL)) AS f FROM rn)"""
SQL = {
    "claim_checks": _CHECKS + " SELECT * FROM vj",
    "chunk_claim_cases": _CHECKS + " SELECT * FROM cc",
    "claim_stage_summary": _CHECKS + " SELECT count(*) AS chunks, sum(n_claims)::BIGINT AS claims, round(sum(n_claims) / count(*), 3) AS claims_per_chunk, round(count(*) FILTER (empty) / count(*), 3) AS empty_chunk_rate, round(count(*) FILTER (rejected) / count(*), 3) AS rejected_chunk_rate, round(sum(n_unlocated) / (sum(n_claims) + sum(n_unlocated)), 3) AS unlocated_rate FROM cc",
    "heading_cases": _HEADS + " SELECT * FROM cases",
    "heading_metrics": _HEADS + " SELECT count(*) AS papers, sum(n_gold)::BIGINT AS n_gold, sum(n_detected)::BIGINT AS n_detected, round(sum(headings_matched) / sum(n_detected), 3) AS heading_precision, round(sum(headings_matched) / sum(n_gold), 3) AS heading_recall, round(sum(matched_type_correct) / sum(headings_matched), 3) AS matched_type_accuracy, round(sum(chunks_type_correct) / sum(n_chunks), 3) AS chunk_type_accuracy FROM cases",
    "synthesis_cases": _SYN + " SELECT * FROM sc",
    "synthesis_summary": _SYN + " SELECT 20 AS calls, 1 AS errors, round((19 - count(DISTINCT call_id)) / 19, 3) AS empty_call_rate, count(*) AS syntheses, round(avg(n_cited), 3) AS claims_cited_mean, round(sum(n_invented) / sum(n_cited), 3) AS invented_id_rate, round(avg(unsupported::INT), 3) AS unsupported_rate, round(avg(type_matches::INT), 3) AS type_match_rate, round(avg(multi_paper::INT), 3) AS multi_paper_rate, round(avg(count_mismatch::INT), 3) AS count_mismatch_rate FROM sc",
    "review_cases": _REVIEW + " SELECT * FROM rv",
    "review_summary": _REVIEW + " SELECT count(*) AS drafts, " + ", ".join(f"round(avg({c}), 3) AS {c}" for c in ("sentence_supported_rate", "sentence_phantom_support_rate", "sentence_invented_id_rate", "sentence_flag_mismatch_rate", "body_citation_coverage")) + ", round(avg(references_complete::INT), 3) AS references_complete_rate, sum(len(list_filter(string_split(invalid_citation_numbers, ','), lambda x: x <> '')))::BIGINT AS invalid_citations, sum(leaked_ids)::BIGINT AS leaked_ids FROM rv",
    "claim_judge_requests": _REAL + ", l AS (SELECT chunk_id, string_agg(n || '. ' || coalesce(claim_text, ''), chr(10) ORDER BY n) AS l FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY claim_id) AS n FROM cl WHERE claim_id IS NOT NULL AND chunk_id IS NOT NULL) GROUP BY 1) SELECT chunk_id, md5('Passage:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Claims:' || chr(10) || l) AS digest FROM l JOIN ch USING (chunk_id)",
    "synthesis_judge_requests": _EVID + f" SELECT synthesis_id, md5('Synthesis type: ' || coalesce(synthesis_type, '') || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Body: ' || coalesce(body, '') || chr(10) || chr(10) || 'Cited claims:' || chr(10) || coalesce(ev, '(none)')) AS digest FROM syn LEFT JOIN {_EV('syn', 'synthesis_id', '')} USING (synthesis_id)",
    "review_judge_requests": _EVID + f" SELECT review_draft_id, batch::INT AS batch, md5(string_agg(number || '. Sentence: ' || coalesce(sentence_text, '') || chr(10) || '   Cited claims:' || chr(10) || coalesce(ev, ''), chr(10) || chr(10) ORDER BY number)) AS digest FROM ba LEFT JOIN {_EV('sen', 'sentence_id', '   ')} USING (sentence_id) GROUP BY 1, 2",
    "judged_sentences": _JUDGED + " SELECT * FROM jv",
    "judge_agreement": _JUDGED + f", x AS (SELECT CASE WHEN is_supported THEN 'supported' ELSE 'unsupported' END AS l, verdict AS p, {_NIB('sentence_id', 2)} < 4 AS made FROM jv JOIN sen USING (sentence_id)) SELECT count(p) AS judged, count(*) - count(p) AS skipped, round(count(*) FILTER (l = p) / count(p), 3) AS accuracy, round(count(*) FILTER (p IS NOT NULL AND (l = 'supported') = (p = 'supported')) / count(p), 3) AS binary_accuracy, round(count(*) FILTER (l = p AND NOT made) / nullif(count(p) FILTER (NOT made), 0), 3) AS real_accuracy, round(count(*) FILTER (made AND l <> 'supported' AND p <> 'supported') / nullif(count(p) FILTER (made AND l <> 'supported'), 0), 3) AS negatives_caught FROM x",
    "authors_by_place": "SELECT paper_id, unnest(range(len(authors))) AS pos, unnest(authors) AS author, unnest(list_transform(authors, lambda a: string_split(a, ' ')[-1])) AS last_name FROM papers WHERE len(authors) > 0",
    "call_keys": _REAL + f""" SELECT chunk_id, sha256('{{"input_text": ' || coalesce({_ESC('text')}, 'null') || ', "instructions": "Say ' || chr(92) || '"what' || chr(92) || '"' || chr(92) || 'nis claimed", "model": "reader", "prompt_version": "claims.v1", "temperature": 0.1, "text_format": "Claims"}}') AS key FROM ch""",
    "json_texts": f"SELECT paper_id, coalesce({_ESC('title')}, 'null') AS title, md5(coalesce({_ESC('array_to_string(authors, chr(10))')}, 'null')) AS authors FROM papers",
    "trajectory_checks": _RUNS + " SELECT case_id, n_tool_calls, invented, reports, n_checks, array_to_string(f, '; ') AS failed, len(f) = 0 AS passed FROM tj",
    "agent_summary": _RUNS + " SELECT count(*) AS cases, round(count(*) FILTER (len(f) = 0) / count(*), 3) AS pass_rate, round((sum(n_checks) - sum(len(f))) / sum(n_checks), 3) AS check_pass_rate, round(count(*) FILTER (invented > 0) / count(*), 3) AS invented_id_rate, round(count(*) FILTER (reports) / count(*), 3) AS reports_rate, round(avg(n_tool_calls), 3) AS tool_calls_mean FROM tj",
    "config_mismatch": "SELECT 'n_chunks' AS key, count(*)::VARCHAR AS here, count(DISTINCT chunk_id)::VARCHAR AS there FROM text_chunks HAVING count(*) <> count(DISTINCT chunk_id)",
    "gated_metrics": _REAL + ", m AS (SELECT model, round(avg(confidence), 3) AS confidence_mean, round(avg((claim_type = 'finding')::INT), 3) AS finding_rate FROM cand GROUP BY 1) SELECT concat_ws('/', model, 'claims', k) AS metric, v AS value, 'up' AS better FROM (UNPIVOT m ON confidence_mean, finding_rate INTO NAME k VALUE v)",
    "infra_errors": "SELECT event_id AS case_id, props AS error FROM events WHERE event_type = 'error' AND event_id % 3 = 0",
}
