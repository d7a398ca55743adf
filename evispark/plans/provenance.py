"""Queries over support, citations, selection and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.text import UUID, is_internal_title, metadata_from_name, parse_year
from evispark.operators import provenance as P
from evispark.operators import selection as S
from evispark.operators.persistence import improved_reference, named_claims
from evispark.staging import stage, table


def support_counts(spark, d):
    return P.support_counts(table(spark, d, "syntheses"), "synthesis_id", table(spark, d, "extracted_claims"))


def support_mismatches(spark, d):
    return P.count_mismatches(table(spark, d, "syntheses"), "synthesis_id", table(spark, d, "extracted_claims"))


def sentence_support(spark, d):
    return P.sentence_support(table(spark, d, "review_sentences"), table(spark, d, "extracted_claims"))


def claim_support_map(spark, d):
    rows = table(spark, d, "review_sentences").dropDuplicates(["sentence_id"])
    return rows.select("sentence_id", F.array_join(P.normalize_support("supporting_claim_ids"), ",").alias("claims"))


def draft_pools(spark, d):
    """(review_draft_id, pos, synthesis_id): the syntheses that share a claim with a draft, in order of their ids."""
    of = P.links(table(spark, d, "syntheses"), "synthesis_id").select(F.col("record_id").alias("synthesis_id"), "claim_id").distinct()
    s = table(spark, d, "review_sentences").dropDuplicates(["sentence_id"]).select("review_draft_id", F.explode(P.normalize_support("supporting_claim_ids")).alias("claim_id")).distinct()
    pairs = s.join(of, "claim_id").select("review_draft_id", "synthesis_id").distinct()
    return pairs.withColumn("pos", F.row_number().over(Window.partitionBy("review_draft_id").orderBy("synthesis_id")))


def drafts(spark, d):
    """(review_draft_id, title, markdown): drafts called by their least section title."""
    s = table(spark, d, "review_sentences")
    return P.draft_markdown(s).join(s.groupBy("review_draft_id").agg(F.min("section_title").alias("title")), "review_draft_id")


def named_in_drafts(spark, d, pools):
    """(review_draft_id, claim_id): existing claims whose ids stand in a draft or in one of its syntheses."""
    s = table(spark, d, "syntheses").dropDuplicates(["synthesis_id"])
    texts = drafts(spark, d).select("review_draft_id", F.col("markdown").alias("text")).unionByName(pools.join(s, "synthesis_id").select("review_draft_id", F.concat_ws("\n", "title", "body").alias("text")))
    return named_claims(texts, "review_draft_id", "text", table(spark, d, "extracted_claims")).distinct()


def _support(spark, d):
    pools = stage(draft_pools(spark, d), "pools")
    return P.support_claims(pools, table(spark, d, "syntheses"), table(spark, d, "extracted_claims"), named_in_drafts(spark, d, pools))


def citation_numbering(spark, d):
    return P.citation_numbers(_support(spark, d))


def reference_list(spark, d):
    return P.reference_list(citation_numbering(spark, d), table(spark, d, "papers"))


def cited_drafts(spark, d):
    return P.cite(drafts(spark, d), stage(_support(spark, d), "support"), table(spark, d, "papers"))


def citation_replace(spark, d):
    return cited_drafts(spark, d)


def reference_entries(spark, d):
    """The references of the cited drafts, one a line, with what the titles of unknown papers tell."""
    return cited_drafts(spark, d).select("review_draft_id", F.md5(F.encode(P.reference_section("markdown", improved_reference), "utf-8")).alias("digest"))


def title_dedupe(spark, d):
    """Drafts that repeat their title: only its first line is left."""
    twice = drafts(spark, d).withColumn("markdown", F.concat(F.lit("# "), F.upper("title"), F.lit("\n\n"), F.col("markdown")))
    return twice.select("review_draft_id", P.drop_repeated_titles(F.col("markdown"), F.col("title")).alias("markdown"))


def review_requests(spark, d):
    topics = drafts(spark, d).select("review_draft_id", F.col("title").alias("topic"))
    rows = P.review_requests(topics, stage(draft_pools(spark, d), "pools"), table(spark, d, "syntheses"), table(spark, d, "extracted_claims"), table(spark, d, "papers"))
    return rows.select("review_draft_id", F.md5(F.encode("request", "utf-8")).alias("digest"))


def unclaimed_round_robin(spark, d):
    rows = S.unclaimed(table(spark, d, "text_chunks"), table(spark, d, "extracted_claims"))
    return S.round_robin(rows, "paper_id", ["page_start", "start_char", "chunk_id"]).select("chunk_id", "paper_id", "round")


def claim_pool(spark, d):
    rows = table(spark, d, "extracted_claims").dropDuplicates(["claim_id"])
    return S.round_robin(rows, "paper_id", ["page", "start_char", "claim_id"]).select("claim_id", "paper_id", "round")


def sample_chunks(spark, d):
    rows = table(spark, d, "text_chunks").filter("chunk_id is not null").dropDuplicates(["chunk_id"])
    return S.sample_round_robin(rows, "paper_id", "chunk_id", 30).select("chunk_id", "paper_id", "round")


def ingest_dedupe(spark, d):
    return S.dedupe_by_content(table(spark, d, "documents"), "doc_id", "text")


def recency_fallback_asc(spark, d):
    return S.most_recent(table(spark, d, "extracted_claims"), "claim_id", 60, newest=False).select("claim_id", "created_at")


def recency_fallback_desc(spark, d):
    return S.most_recent(table(spark, d, "syntheses"), "synthesis_id", 20).select("synthesis_id", "created_at")


def paper_structure(spark, d):
    return S.paper_structure(table(spark, d, "papers"), table(spark, d, "paper_pages"), table(spark, d, "text_chunks"))


TABLES = ("papers", "paper_pages", "text_chunks", "claim_candidates", "extracted_claims", "syntheses", "review_sentences", "embedding_recordings")


def table_counts(spark, d):
    return S.table_counts({t: table(spark, d, t) for t in TABLES})


def paper_keys(spark, d):
    return S.next_paper_keys(table(spark, d, "papers"))


def backfill_metadata(spark, d):
    return S.backfill_metadata(table(spark, d, "papers"))


def metadata_from_names(spark, d):
    m = metadata_from_name("file_name")
    return table(spark, d, "papers").select("paper_id", m["authors_text"].alias("authors_text"), m["year"].alias("year"), m["title"].alias("title"), is_internal_title("title").alias("internal"))


def page_years(spark, d):
    return table(spark, d, "paper_pages").dropDuplicates(["page_id"]).select("page_id", parse_year("text").alias("year"))


def invented_ids(spark, d):
    """Per synthesis: cited, invented, papers, whether it spans papers."""
    s = stage(P.links(table(spark, d, "syntheses"), "synthesis_id").select("record_id", "claim_id").distinct(), "links")
    rows = s.join(P.live_claims(table(spark, d, "extracted_claims")).withColumn("known", F.lit(1)), "claim_id", "left")
    return rows.groupBy("record_id").agg(F.count("*").alias("cited"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("invented"), F.countDistinct("paper_id").alias("papers"), (F.countDistinct("paper_id") > 1).alias("multi_paper"))


_ONE = """
WITH claims AS (SELECT claim_id, min(paper_id) AS paper_id FROM extracted_claims WHERE claim_id IS NOT NULL GROUP BY 1),
syn AS (SELECT DISTINCT ON (synthesis_id) * FROM syntheses), sen AS (SELECT DISTINCT ON (sentence_id) * FROM review_sentences),
slinks AS (SELECT synthesis_id AS record_id, unnest(range(len(supporting_claim_ids))) AS pos, unnest(supporting_claim_ids) AS claim_id FROM syn),
rlinks AS (SELECT sentence_id AS record_id, review_draft_id, section_title, sentence_index, unnest(range(len(supporting_claim_ids))) AS pos, unnest(supporting_claim_ids) AS claim_id FROM sen)"""
_COUNTS = _ONE + """,
cnt AS (SELECT record_id, count(DISTINCT paper_id) AS p, count(DISTINCT claim_id) AS c FROM slinks JOIN claims USING (claim_id) GROUP BY 1),
counts AS (SELECT synthesis_id AS record_id, coalesce(p, 0) AS supporting_papers, coalesce(c, 0) AS supporting_claims FROM syn LEFT JOIN cnt ON record_id = synthesis_id)"""
_W = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_TRIM = lambda x: f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"
_WS1 = lambda x: f"regexp_replace({_TRIM(x)}, '{_W}+', ' ', 'g')"
_EDGE = lambda x: f"regexp_replace({x}, '^[ \\-_,]+|[ \\-_,]+$', '', 'g')"


def authors_sql(text: str) -> str:
    """SQL for the authors of a byline, by the rules of the survey (I4)."""
    t = f"nullif({_WS1(text)}, '')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace(translate({t}, '−‐‑‒–—', '------'), '[*†‡§¶#⊥∥‖]+', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '([A-Za-z])\d+\b', '\1', 'g'), '([A-Z]\.)([A-Z][a-z])', '\1 \2', 'g')"
    t = _EDGE(t)
    parts = rf"list_filter(list_transform(regexp_split_to_array({t}, ';|,|\s+(?:and|&)\s+'), lambda p: {_EDGE('p')}), lambda p: p <> '')"
    words = f"list_filter(string_split({t}, ' '), lambda w: w <> '')"
    names = rf"NOT contains({t}, ',') AND NOT contains({t}, '.') AND len({words}) BETWEEN 2 AND 4 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, '^\p{{Lu}}'))) = 0"
    return rf"CASE WHEN coalesce({t}, '') = '' THEN []::VARCHAR[] WHEN regexp_matches({t}, '(?i)\bet\s+al\.?\b') THEN [{t}] WHEN len({parts}) > 1 THEN {parts} WHEN {names} THEN {words} ELSE [{t}] END"


_STEM = r"regexp_replace(file_name, '\.[^.]+$', '')"
def named_sql(name: str, extra: str) -> str:
    """SQL for n_authors (text), n_year and n_title of the names in ``name``, beside the columns ``extra`` of papers."""
    return rf"""
n AS (SELECT {extra}, {_WS1(rf"replace(regexp_replace({name}, '(?i)\.(?:pdf|txt|md)$', ''), '_', ' ')")} AS stem FROM papers),
m AS (SELECT *, regexp_matches(stem, '(?:^|[\s-])(?:19|20)\d{{2}}(?:[\s-]|$)') AS has, regexp_extract(stem, '^(.*?)(?:^|[\s-])((?:19|20)\d{{2}})(?:[\s-]|$)(.*)$', ['a', 'y', 't']) AS g FROM n),
named AS (SELECT *, CASE WHEN has THEN nullif({_EDGE('g.a')}, '') END AS n_authors, CASE WHEN has THEN try_cast(g.y AS INT) END AS n_year, CASE WHEN has THEN coalesce(nullif({_EDGE('g.t')}, ''), nullif(stem, '')) ELSE nullif(stem, '') END AS n_title FROM m)"""


_NAME = "WITH " + named_sql("file_name", "*").lstrip() + rf""",
lows AS (SELECT *, lower({_TRIM('title')}) AS low FROM named),
flags AS (SELECT *, low IN ('no job name', 'untitled', 'untitled document', 'untitled-1', '(no title)', 'adobe pdf') OR starts_with(low, 'microsoft word - ') OR regexp_matches(low, '\d+\.\.\d+') OR regexp_matches(low, '^[a-z]{{1,4}}\d+[a-z]?(?:\s+\d+\.\.\d+)?$') AS internal FROM lows)"""
_CLEAN = lambda x: _WS1(f"replace({x}, '_', ' ')")
#: Drafts, their pools of syntheses, the claims behind them and the numbers of their papers, by the rules of the survey (F7, H1, I13, N12).
_POOLS = _ONE + rf""",
pools AS (SELECT *, row_number() OVER (PARTITION BY review_draft_id ORDER BY synthesis_id) AS pos FROM (SELECT DISTINCT r.review_draft_id, s.record_id AS synthesis_id FROM rlinks r JOIN slinks s USING (claim_id) WHERE claim_id <> '')),
lines AS (SELECT review_draft_id, coalesce(section_title, '') AS st, sentence_index, sentence_id, coalesce(sentence_text, '') || CASE WHEN len(ids) > 0 THEN ' [' || array_to_string(ids, ', ') || ']' ELSE '' END AS line FROM (SELECT *, list_sort(list_distinct(list_filter(supporting_claim_ids, lambda c: c <> ''))) AS ids FROM sen)),
parts AS (SELECT review_draft_id, st, '## ' || st || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY sentence_index NULLS FIRST, sentence_id) AS txt FROM lines GROUP BY 1, 2),
md AS (SELECT review_draft_id, string_agg(txt, chr(10) || chr(10) ORDER BY st) AS markdown FROM parts GROUP BY 1),
topics AS (SELECT review_draft_id, min(section_title) AS title FROM review_sentences GROUP BY 1),
texts AS (SELECT review_draft_id, markdown AS t FROM md UNION ALL SELECT review_draft_id, concat_ws(chr(10), title, body) FROM pools JOIN syn USING (synthesis_id)),
extra AS (SELECT DISTINCT review_draft_id, claim_id FROM (SELECT review_draft_id, unnest(regexp_extract_all(t, '{UUID}')) AS claim_id FROM texts) WHERE claim_id IN (SELECT claim_id FROM claims)),
used AS (SELECT review_draft_id, claim_id, 0 AS kind, p.pos AS a, s.pos AS b, '' AS c FROM pools p JOIN slinks s ON s.record_id = p.synthesis_id WHERE claim_id <> '' UNION ALL SELECT review_draft_id, claim_id, 1, 0, 0, claim_id FROM extra),
support AS (SELECT review_draft_id, claim_id, paper_id, min(ROW(kind, a, b, c)) AS spot FROM used JOIN claims USING (claim_id) GROUP BY 1, 2, 3)"""
_NUMBERED = """,
firsts AS (SELECT review_draft_id, paper_id, min(spot) AS spot FROM SUPPORT WHERE paper_id IS NOT NULL GROUP BY 1, 2),
numbers AS (SELECT review_draft_id, paper_id, row_number() OVER (PARTITION BY review_draft_id ORDER BY spot, paper_id) AS number FROM firsts),""" + named_sql("coalesce(nullif(file_name, ''), nullif(title, ''), '')", "*") + rf""",
best AS (SELECT *, coalesce(nullif(title, ''), n_title, nullif(file_name, ''), paper_key) AS b0 FROM named),
refs AS (SELECT paper_id, CASE WHEN len(au) = 0 THEN 'Unknown authors' ELSE regexp_replace(array_to_string(au, ', '), '\.+$', '') END || '. (' || coalesce(coalesce(year, n_year)::VARCHAR, 'n.d.') || '). ' ||
  coalesce({_CLEAN(f"CASE WHEN coalesce(nullif(file_name, '') IS NOT NULL AND n_title IS NOT NULL AND {_CLEAN('b0')} = {_CLEAN(_STEM)}, false) THEN n_title ELSE b0 END")}, '') || '.' AS text FROM (SELECT *, CASE WHEN len(authors) > 0 THEN authors ELSE {authors_sql('n_authors')} END AS au FROM best)),
entries AS (SELECT review_draft_id, number, coalesce(text, 'paper_id=' || paper_id) AS reference FROM numbers LEFT JOIN refs USING (paper_id))"""
_NUMBERS = _POOLS + _NUMBERED.replace("SUPPORT", "support")
_SAME = lambda x: f"lower({_WS1(f"regexp_replace({_TRIM(x)}, '^#+', '')")})"


def _dedupe(markdown: str, title: str) -> str:
    """SQL for a text with only the first line that equals its title (F10)."""
    ls = f"string_split({markdown}, chr(10))"
    return _TRIM(f"array_to_string(list_filter({ls}, lambda x, i: {_SAME('x')} <> {_SAME(title)} OR i = list_position(list_transform({ls}, lambda y: {_SAME('y')} = {_SAME(title)}), true)), chr(10))")


_CITED = _NUMBERS + rf""",
nums AS (SELECT review_draft_id, list({{'c': claim_id, 'n': number}}) AS nums FROM support JOIN numbers USING (review_draft_id, paper_id) GROUP BY 1),
lists AS (SELECT review_draft_id, string_agg('[' || number || '] ' || reference, chr(10) ORDER BY number) AS refs FROM entries GROUP BY 1),
one AS (SELECT review_draft_id, title, {_dedupe('markdown', 'title')} AS m FROM md JOIN topics USING (review_draft_id)),
two AS (SELECT o.*, refs, CASE WHEN nums IS NULL THEN m ELSE array_to_string(list_transform(regexp_extract_all(m, '\[[^\]]+\]|[^\[]+|\['), lambda p: CASE WHEN starts_with(p, '[') AND len(list_filter(nums, lambda x: contains(p, x.c))) > 0 THEN '[' || array_to_string(list_sort(list_distinct(list_transform(list_filter(nums, lambda x: contains(p, x.c)), lambda x: x.n))), ', ') || ']' ELSE p END), '') END AS r FROM one o LEFT JOIN nums USING (review_draft_id) LEFT JOIN lists USING (review_draft_id)),
three AS (SELECT review_draft_id, refs, {_dedupe('r', 'title')} AS m FROM two),
cited AS (SELECT review_draft_id, CASE WHEN refs IS NULL THEN m ELSE regexp_replace(m, '{_W}+$', '') || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || refs END AS markdown FROM three)"""
QUERIES = {f.__name__: f for f in (support_counts, support_mismatches, sentence_support, claim_support_map, citation_numbering, reference_list, citation_replace, reference_entries, title_dedupe, review_requests, unclaimed_round_robin, claim_pool, sample_chunks, ingest_dedupe, recency_fallback_asc, recency_fallback_desc, paper_structure, table_counts, paper_keys, backfill_metadata, metadata_from_names, page_years, invented_ids)}
SQL = {
    "support_counts": _COUNTS + " SELECT * FROM counts",
    "support_mismatches": _COUNTS + " SELECT c.*, s.supporting_papers AS stored_papers, s.supporting_claims AS stored_claims FROM counts c JOIN syn s ON s.synthesis_id = c.record_id WHERE s.supporting_papers IS DISTINCT FROM c.supporting_papers OR s.supporting_claims IS DISTINCT FROM c.supporting_claims",
    "sentence_support": _ONE + ", real AS (SELECT DISTINCT record_id FROM rlinks WHERE claim_id IN (SELECT claim_id FROM claims)), x AS (SELECT sentence_id, coalesce(len(list_distinct(list_filter(supporting_claim_ids, lambda c: c <> ''))), 0) AS claimed, sentence_id IN (SELECT record_id FROM real) AS is_supported FROM sen) SELECT *, claimed > 0 AND NOT is_supported AS phantom FROM x",
    "claim_support_map": _ONE + " SELECT sentence_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(supporting_claim_ids, lambda c: c <> ''))), ','), '') AS claims FROM sen",
    "citation_numbering": _NUMBERS + " SELECT * FROM numbers",
    "reference_list": _NUMBERS + " SELECT * FROM entries",
    "citation_replace": _CITED + " SELECT * FROM cited",
    "reference_entries": _CITED + rf", l AS (SELECT review_draft_id, string_agg('[' || number || '] ' || reference, chr(10) || chr(10) ORDER BY number) AS entries2 FROM entries GROUP BY 1) SELECT review_draft_id, md5(CASE WHEN entries2 IS NULL THEN m ELSE regexp_replace(m, '{_W}+$', '') || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || entries2 END) AS digest FROM three LEFT JOIN l USING (review_draft_id)",
    "title_dedupe": _POOLS + f" SELECT review_draft_id, {_dedupe("('# ' || upper(title) || chr(10) || chr(10) || markdown)", 'title')} AS markdown FROM md JOIN topics USING (review_draft_id)",
    "review_requests": _POOLS + _NUMBERED.replace("SUPPORT", "(SELECT * FROM support WHERE spot[1] = 0)") + """,
txt AS (SELECT claim_id, min(paper_id) AS paper_id, min(coalesce(nullif(normalized_text, ''), claim_text, '')) AS t FROM extracted_claims WHERE claim_id IS NOT NULL GROUP BY 1),
ev AS (SELECT review_draft_id, synthesis_id, string_agg('   - claim_id=' || claim_id || ' [' || number || ']: ' || t, chr(10) ORDER BY b) AS ev FROM (SELECT p.review_draft_id, p.synthesis_id, s.claim_id, min(s.pos) AS b FROM pools p JOIN slinks s ON s.record_id = p.synthesis_id WHERE s.claim_id <> '' GROUP BY 1, 2, 3) JOIN txt USING (claim_id) JOIN numbers USING (review_draft_id, paper_id) GROUP BY 1, 2),
bl AS (SELECT review_draft_id, string_agg('S' || pos || ' (' || coalesce(synthesis_type, '') || ') ' || coalesce(title, '') || ': ' || coalesce(body, '') || coalesce(chr(10) || ev, ''), chr(10) ORDER BY pos) AS bl FROM pools JOIN syn USING (synthesis_id) LEFT JOIN ev USING (review_draft_id, synthesis_id) GROUP BY 1),
rf AS (SELECT review_draft_id, string_agg('[' || number || '] ' || reference, chr(10) ORDER BY number) AS rf FROM entries GROUP BY 1)
SELECT review_draft_id, md5('Topic: ' || coalesce(title, '') || chr(10) || chr(10) || 'Paper references:' || chr(10) || coalesce(rf || chr(10), '') || chr(10) || 'Syntheses, each with the evidence claims behind it:' || chr(10) || bl) AS digest FROM bl JOIN topics USING (review_draft_id) LEFT JOIN rf USING (review_draft_id)""",
    "unclaimed_round_robin": "WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM text_chunks WHERE chunk_id IS NOT NULL) SELECT chunk_id, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY page_start, start_char, chunk_id) AS round FROM c WHERE NOT EXISTS (SELECT 1 FROM extracted_claims x WHERE x.chunk_id = c.chunk_id)",
    "claim_pool": "WITH c AS (SELECT DISTINCT ON (claim_id) * FROM extracted_claims) SELECT claim_id, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY page, start_char, claim_id) AS round FROM c",
    "sample_chunks": "WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, paper_id FROM text_chunks WHERE chunk_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY md5('0:' || chunk_id), chunk_id) AS round FROM c) SELECT * FROM r ORDER BY round, paper_id LIMIT 30",
    "ingest_dedupe": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "recency_fallback_asc": "SELECT claim_id, created_at FROM (SELECT DISTINCT ON (claim_id) claim_id, created_at FROM extracted_claims) ORDER BY created_at NULLS LAST, claim_id LIMIT 60",
    "recency_fallback_desc": "SELECT synthesis_id, created_at FROM (SELECT DISTINCT ON (synthesis_id) synthesis_id, created_at FROM syntheses) ORDER BY created_at DESC NULLS LAST, synthesis_id LIMIT 20",
    "paper_structure": "SELECT p.paper_id, p.paper_key, coalesce(n_pages, 0) AS n_pages, coalesce(n_sections, 0) AS n_sections, coalesce(n_chunks, 0) AS n_chunks FROM (SELECT DISTINCT paper_id, paper_key FROM papers) p LEFT JOIN (SELECT paper_id, count(DISTINCT page_id) AS n_pages FROM paper_pages GROUP BY 1) a USING (paper_id) LEFT JOIN (SELECT paper_id, count(DISTINCT section_title) AS n_sections, count(DISTINCT chunk_id) AS n_chunks FROM text_chunks GROUP BY 1) b USING (paper_id)",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
    "paper_keys": "SELECT paper_id, printf('P%03d', row_number() OVER (ORDER BY created_at, paper_id)) AS next_key FROM papers",
    "backfill_metadata": _NAME + rf", w AS (SELECT *, coalesce(title = '', true) OR {_TRIM("replace(title, '_', ' ')")} = {_TRIM(f"replace({_STEM}, '_', ' ')")} OR coalesce(internal, true) AS weak FROM flags), o AS (SELECT paper_id, title AS t0, year AS y0, CASE WHEN weak THEN coalesce(n_title, title) ELSE title END AS title, coalesce(year, n_year) AS year FROM w) SELECT paper_id, title, year, title IS DISTINCT FROM t0 OR year IS DISTINCT FROM y0 AS changed FROM o",
    "metadata_from_names": _NAME + " SELECT paper_id, n_authors AS authors_text, n_year AS year, n_title AS title, internal FROM flags",
    "page_years": r"SELECT DISTINCT ON (page_id) page_id, nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), '')::INT AS year FROM paper_pages",
    "invented_ids": _ONE + ", l AS (SELECT DISTINCT record_id, claim_id FROM slinks WHERE claim_id <> '') SELECT record_id, count(*) AS cited, count(*) FILTER (c.claim_id IS NULL) AS invented, count(DISTINCT paper_id) AS papers, count(DISTINCT paper_id) > 1 AS multi_paper FROM l LEFT JOIN claims c USING (claim_id) GROUP BY 1",
}
