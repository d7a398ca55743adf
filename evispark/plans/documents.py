"""Queries over pages, lines, sections and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions.text import SECTION_RULES, SECTION_TITLES, body_sentences, cited_numbers, classify_title, clip, content_words, normalize_text, strip_citations
from evispark.operators.chunking import chunk_pages, governing_heading, match_sections, tag_chunks
from evispark.operators.sections import detect_sections, named_headings, next_lines, page_lines, running_headers, section_intervals
from evispark.staging import stage, table


def _pages(spark, d):
    return table(spark, d, "paper_pages")


def chunk_pages_query(spark, d):
    return chunk_pages(_pages(spark, d)).select("page_id", "start_char", "end_char", F.md5(F.encode("text", "utf-8")).alias("digest"))


def line_offsets(spark, d):
    return next_lines(page_lines(_pages(spark, d))).select("page_id", "line_no", "start_char", F.length("line").alias("n_chars"), F.length("next_line").alias("next_chars"))


def running_headers_query(spark, d):
    return running_headers(_pages(spark, d))


def known_headings(spark, d):
    return named_headings(_pages(spark, d)).drop("paper_id", "line_no")


def _sections(spark, d):
    return stage(section_intervals(named_headings(_pages(spark, d)), _pages(spark, d)), "sections")


def section_intervals_query(spark, d):
    return _sections(spark, d)


def detect_sections_query(spark, d):
    return detect_sections(_pages(spark, d))


def _chunks(spark, d):
    return chunk_pages(_pages(spark, d)).drop("text")


def chunk_section_tag(spark, d):
    return tag_chunks(_chunks(spark, d), _sections(spark, d)).drop("paper_id")


def chunk_section_match(spark, d):
    s = _sections(spark, d)
    return match_sections(tag_chunks(_chunks(spark, d), s), s).select("page_id", "start_char", "section_pos")


def chunk_gold_asof(spark, d):
    return governing_heading(_chunks(spark, d), named_headings(_pages(spark, d))).select("page_id", "start_char", "governing")


def title_types(spark, d):
    rows = table(spark, d, "text_chunks").groupBy("section_title").agg(F.count("*").alias("n"))
    return rows.select("section_title", "n", classify_title("section_title").alias("section_type"))


def body_sentences_query(spark, d):
    rows = table(spark, d, "syntheses").dropDuplicates(["synthesis_id"])
    return rows.select("synthesis_id", F.posexplode(body_sentences("body")).alias("pos", "sentence"))


def cited_numbers_query(spark, d):
    return _pages(spark, d).dropDuplicates(["page_id"]).select("page_id", F.array_join(cited_numbers("text"), ",").alias("numbers"))


def strip_citations_query(spark, d):
    return _pages(spark, d).dropDuplicates(["page_id"]).select("page_id", F.length("text").alias("n_chars"), F.length(strip_citations("text")).alias("n_left"))


def content_words_query(spark, d):
    rows = table(spark, d, "extracted_claims").dropDuplicates(["claim_id"])
    return rows.select("claim_id", F.size(content_words("claim_text")).alias("n_words"), clip("claim_text", 60).alias("label"), F.md5(F.encode(normalize_text("claim_text"), "utf-8")).alias("digest"))


WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
EOL = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
_PAGES = "pages AS (SELECT DISTINCT ON (page_id) page_id, paper_id, page_number, text FROM paper_pages WHERE page_id IS NOT NULL)"
_LINES = _PAGES + rf""",
raws AS (SELECT paper_id, page_id, page_number, regexp_extract_all(text, '[^{EOL}]*(?:\r\n|[{EOL}])|[^{EOL}]+') AS raw FROM pages WHERE text <> ''),
raw1 AS (SELECT paper_id, page_id, page_number, unnest(raw) AS raw, unnest(range(len(raw))) AS line_no FROM raws),
lines AS (SELECT paper_id, page_id, page_number, line_no, coalesce(sum(length(raw)) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char, regexp_replace(raw, '(?:\r\n|[{EOL}])$', '') AS line FROM raw1),
bare AS (SELECT *, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS bare FROM lines),
running AS (SELECT paper_id, bare AS line, count(DISTINCT page_number) AS n_pages FROM bare WHERE bare <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 3)"""
_NUM = r"(?:[A-Z]\.)?\d{1,2}(?:\.\d{1,2}){0,3}"
_NAMES = "|".join(sorted(SECTION_TITLES, key=lambda t: (-len(t), t)))


def classify_sql(title: str) -> str:
    t = f"regexp_replace(lower(regexp_replace({title}, '{WS}+', ' ', 'g')), '^ | $', '', 'g')"
    names = " ".join(f"WHEN {t} = '{k}' THEN '{v}'" for k, v in SECTION_TITLES.items())
    rules = " ".join(f"WHEN regexp_matches({t}, '{r}') THEN '{v}'" for r, v in SECTION_RULES)
    return f"CASE {names} {rules} ELSE 'methods' END"


HITS = _LINES + rf""",
hits AS (SELECT paper_id, page_id, page_number, line_no, start_char, title, {classify_sql('title')} AS section_type FROM (
  SELECT b.*, regexp_replace(bare, '^{_NUM}\.?\s+', '') AS title FROM bare b WHERE regexp_matches(bare, '(?i)^(?:{_NUM}\.?\s+)?(?:{_NAMES})$')
    AND NOT EXISTS (SELECT 1 FROM running r WHERE r.paper_id = b.paper_id AND r.line = b.bare)))"""
_INTERVALS = """,
sizes AS (SELECT paper_id, page_number, max(coalesce(length(text), 0)) AS n_chars FROM pages GROUP BY 1, 2),
ends AS (SELECT paper_id, min(page_number) AS first_page, max(page_number) AS last_page, arg_max(n_chars, page_number) AS last_chars FROM sizes GROUP BY 1),
ordered AS (SELECT h.*, lead(page_number) OVER w AS next_page, lead(start_char) OVER w AS next_char, row_number() OVER w AS pos FROM hits h WINDOW w AS (PARTITION BY paper_id ORDER BY page_number, start_char)),
sections AS (
  SELECT o.paper_id, o.pos, title, section_type, o.page_number AS page_start, start_char, coalesce(next_page, last_page) AS page_end, CASE WHEN next_page = o.page_number THEN next_char ELSE n_chars END AS end_char, CONFIDENCE AS confidence
  FROM ordered o JOIN ends e ON e.paper_id = o.paper_id JOIN sizes s ON s.paper_id = o.paper_id AND s.page_number = coalesce(next_page, last_page)
  UNION ALL SELECT paper_id, 1, 'Full Text', 'other', first_page, 0, last_page, last_chars, 0.3 FROM ends WHERE paper_id NOT IN (SELECT paper_id FROM hits))"""
_SECTIONS = HITS + _INTERVALS.replace("CONFIDENCE", "0.75::DOUBLE")
_TITLE = lambda x: f"(length({x}) BETWEEN 1 AND 90 AND len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')) <= 12 AND regexp_matches({x}, '^\\p{{Lu}}') AND NOT regexp_matches({x}, '[.,;:]$') AND length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) >= 0.6 * length(replace({x}, ' ', '')))"
_PLAUSIBLE = lambda x: f"coalesce(try_cast(nullif(regexp_extract({x}, '^(?:[A-Z]\\.)?(\\d+)', 1), '') AS INT) BETWEEN 1 AND 20, false)"
_SOLID = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
_NUMBERED = rf"^({_NUM})\.?{WS}+({_SOLID}.*)$"
_BODY = lambda x: f"coalesce(len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')) >= 5 OR {_PLAUSIBLE(f"coalesce(nullif(regexp_extract({x}, '{_NUMBERED}', 1), ''), nullif(regexp_extract({x}, '^({_NUM})\\.?$', 1), ''))")}, false)"
_NAMED = lambda t: classify_sql(t).replace("ELSE 'methods' END", "END")
#: All headings from the rules of the survey: each line's kind, types level by level, one heading a place.
_ALL_HITS = _LINES + rf""",
seen AS (SELECT *, first_value(nullif(bare, '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f1, first_value(nullif(bare, '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS f2,
  lead(bare) OVER (PARTITION BY page_id ORDER BY line_no) AS nx, lead(start_char) OVER (PARTITION BY page_id ORDER BY line_no) AS nx_start, regexp_replace(bare, '^[■▪]{WS}*', '') AS plain FROM bare),
parts AS (SELECT *, nullif(regexp_extract(plain, '{_NUMBERED}', 1), '') AS num, nullif(regexp_extract(plain, '{_NUMBERED}', 2), '') AS num_title, nullif(regexp_extract(plain, '^({_NUM})\.?$', 1), '') AS lone FROM seen WHERE bare <> ''),
kinds AS (SELECT *, CASE WHEN regexp_matches(plain, '(?i)^(?:{_NUM}\.?{WS}+)?(?:{_NAMES})$') THEN 'known' WHEN regexp_matches(plain, '(?i)^abstract{WS}*[:.—–-]{WS}*{_SOLID}') THEN 'abstract' WHEN regexp_matches(bare, '^[■▪]') AND {_TITLE('plain')} THEN 'bullet'
  WHEN regexp_matches(plain, '^[IVX]{{1,5}}\.\s+[A-Z][A-Z0-9 ,&:/\-–]+$') AND {_BODY('f1')} THEN 'roman' WHEN {_PLAUSIBLE('num')} AND coalesce({_TITLE('num_title')}, false) AND {_BODY('f1')} THEN 'numbered' WHEN {_PLAUSIBLE('lone')} AND coalesce({_TITLE('nx')}, false) AND {_BODY('f2')} THEN 'next' END AS kind FROM parts),
found AS (SELECT paper_id, page_id, page_number, line_no AS lno, CASE WHEN kind = 'next' THEN nx_start ELSE start_char END AS start_char, CASE WHEN kind = 'next' THEN nx ELSE bare END AS b, kind,
  CASE kind WHEN 'known' THEN regexp_replace(plain, '(?i)^{_NUM}\.?{WS}+', '') WHEN 'abstract' THEN 'Abstract' WHEN 'bullet' THEN plain WHEN 'roman' THEN regexp_replace(plain, '^[IVX]{{1,5}}\.\s+', '') WHEN 'numbered' THEN num_title ELSE nx END AS title,
  CASE WHEN kind IN ('known', 'numbered') THEN num WHEN kind = 'roman' THEN regexp_extract(plain, '^([IVX]+)', 1) WHEN kind = 'next' THEN lone END AS number FROM kinds WHERE kind IS NOT NULL),
t0 AS (SELECT f.*, len(string_split(regexp_replace(number, '^[A-Z]\.', ''), '.')) - 1 AS depth, {_NAMED('title')} AS own FROM found f WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.paper_id = f.paper_id AND r.line = f.b)),
t1 AS (SELECT *, CASE WHEN coalesce(depth, 0) = 0 THEN coalesce(own, 'methods') ELSE own END AS ty FROM t0),
""" + ",\n".join(
    rf"t{k + 1} AS (SELECT a.* REPLACE (CASE WHEN ty IS NULL AND depth = {k} THEN coalesce((SELECT arg_max(b.ty, b.page_number::BIGINT * 1000000 + b.lno) FROM t{k} b WHERE b.paper_id = a.paper_id AND b.number = regexp_replace(a.number, '\.[^.]*$', '') AND b.page_number::BIGINT * 1000000 + b.lno < a.page_number::BIGINT * 1000000 + a.lno AND b.ty IS NOT NULL), 'methods') ELSE ty END AS ty) FROM t{k} a)"
    for k in (1, 2, 3)
) + """,
hits AS (SELECT DISTINCT ON (page_id, start_char) paper_id, page_id, page_number, start_char, title, ty AS section_type, CASE kind WHEN 'known' THEN 0.75 WHEN 'abstract' THEN 0.7 WHEN 'bullet' THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM t4 ORDER BY page_id, start_char, lno)"""
_CHUNK = r""",
walk(page_id, n, s, e) AS (
  SELECT page_id, length(text), 0, CASE WHEN length(text) <= 1500 THEN length(text) ELSE cut(text, 0) END FROM pages WHERE text <> ''
  UNION ALL
  SELECT w.page_id, n, greatest(e - 150, s + 1), CASE WHEN greatest(e - 150, s + 1) + 1500 >= n THEN n ELSE cut(p.text, greatest(e - 150, s + 1)) END FROM walk w JOIN pages p ON p.page_id = w.page_id WHERE e < n),
chunks AS (SELECT p.paper_id, w.page_id, p.page_number, w.s AS start_char, w.e AS end_char, substr(p.text, w.s + 1, w.e - w.s) AS text FROM walk w JOIN pages p ON p.page_id = w.page_id WHERE regexp_matches(substr(p.text, w.s + 1, w.e - w.s), '[^\s\x0b\x1c-\x1f\x85\p{Z}]'))"""


def _cut(text: str, start: str) -> str:
    """SQL for the end of a window of 1500 that begins at ``start``: the last delimiter of the first kind beyond 750."""
    w = f"substr({text}, ({start}) + 1, 1500)"
    last = lambda x: f"(1500 - coalesce(length(list_last(string_split({w}, {x}))), 0) - length({x}))"
    cases = " ".join(f"WHEN {last(x)} > 750 THEN ({start}) + {last(x)} + length({x})" for x in (r"(chr(10) || chr(10))", "'. '", "chr(10)", "' '"))
    return f"(CASE {cases} ELSE ({start}) + 1500 END)"


_CHUNKS = _CHUNK.replace("cut(text, 0)", _cut("text", "0")).replace("cut(p.text, greatest(e - 150, s + 1))", _cut("p.text", "greatest(e - 150, s + 1)"))
_TAGGED = """,
cand AS (SELECT c.page_id, c.page_number, c.start_char, c.end_char, c.paper_id, s.title AS section_title, s.section_type, row_number() OVER (PARTITION BY c.page_id, c.start_char ORDER BY coalesce(s.page_start = c.page_number AND s.start_char <= c.start_char, false) DESC,
   CASE WHEN s.page_start = c.page_number AND s.start_char <= c.start_char THEN s.start_char ELSE s.page_start END DESC NULLS LAST, s.pos NULLS LAST) AS n
  FROM chunks c LEFT JOIN sections s ON s.paper_id = c.paper_id AND c.page_number BETWEEN s.page_start AND s.page_end),
tagged AS (SELECT * EXCLUDE (n) FROM cand WHERE n = 1)"""

QUERIES = {
    "chunk_pages": chunk_pages_query, "line_offsets": line_offsets, "running_headers": running_headers_query, "known_headings": known_headings, "section_intervals": section_intervals_query, "detect_sections": detect_sections_query,
    "chunk_section_tag": chunk_section_tag, "chunk_section_match": chunk_section_match, "chunk_gold_asof": chunk_gold_asof, "title_types": title_types, "body_sentences": body_sentences_query, "cited_numbers": cited_numbers_query,
    "strip_citations": strip_citations_query, "content_words": content_words_query,
}
_CITE = r"\[(?:\d+(?:\s*[,–-]\s*\d+)*)\]"
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
SQL = {
    "chunk_pages": f"WITH RECURSIVE {_PAGES}{_CHUNKS} SELECT page_id, start_char, end_char, md5(text) AS digest FROM chunks",
    "line_offsets": f"WITH {_LINES} SELECT page_id, line_no, start_char, length(line) AS n_chars, length(first_value(nullif(bare, '') IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS next_chars FROM bare",
    "running_headers": f"WITH {_LINES} SELECT * FROM running",
    "known_headings": f"WITH {HITS} SELECT page_id, page_number, start_char, title, section_type FROM hits",
    "section_intervals": f"WITH {_SECTIONS} SELECT * FROM sections",
    "detect_sections": f"WITH {_ALL_HITS}{_INTERVALS.replace('CONFIDENCE', 'o.confidence')} SELECT * FROM sections",
    "chunk_section_tag": f"WITH RECURSIVE {_SECTIONS}{_CHUNKS}{_TAGGED} SELECT page_id, page_number, start_char, end_char, section_title, section_type FROM tagged",
    "chunk_section_match": f"WITH RECURSIVE {_SECTIONS}{_CHUNKS}{_TAGGED}, m AS (SELECT t.page_id, t.start_char, s.pos AS section_pos, row_number() OVER (PARTITION BY t.page_id, t.start_char ORDER BY s.start_char DESC NULLS LAST, s.pos NULLS LAST) AS n FROM tagged t LEFT JOIN sections s ON s.paper_id = t.paper_id AND t.page_number BETWEEN s.page_start AND s.page_end AND (s.title = t.section_title OR s.section_type = t.section_type)) SELECT page_id, start_char, section_pos FROM m WHERE n = 1",
    "chunk_gold_asof": f"WITH RECURSIVE {HITS}{_CHUNKS}, c AS (SELECT *, page_number::BIGINT * 1000000000 + start_char AS at FROM chunks), h AS (SELECT paper_id, section_type, page_number::BIGINT * 1000000000 + start_char AS at FROM hits) SELECT c.page_id, c.start_char, coalesce(h.section_type, 'other') AS governing FROM c ASOF LEFT JOIN h ON c.paper_id = h.paper_id AND c.at >= h.at",
    "title_types": f"SELECT section_title, count(*) AS n, {classify_sql('section_title')} AS section_type FROM text_chunks GROUP BY 1",
    "body_sentences": rf"WITH s AS (SELECT DISTINCT ON (synthesis_id) synthesis_id, body FROM syntheses), l AS (SELECT synthesis_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')) AS ls FROM s), p AS (SELECT synthesis_id, list_filter(flatten(list_transform(ls, lambda x: string_split(regexp_replace(regexp_replace(x, '^(?:[-*+]|\d+\.)\s+', ''), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: regexp_matches(x, '[^\s\x0b\x1c-\x1f\x85\p{{Z}}]')) AS ss FROM l) SELECT synthesis_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM p",
    "cited_numbers": rf"WITH {_PAGES}, g AS (SELECT page_id, unnest(flatten(list_transform(regexp_extract_all(text, '{_CITE}'), lambda x: string_split(x, ',')))) AS part FROM pages), e AS (SELECT page_id, list_transform(regexp_extract_all(part, '\d+'), lambda x: try_cast(x AS INT)) AS ends FROM g), n AS (SELECT DISTINCT page_id, unnest(range(ends[1], ends[len(ends)] + 1)) AS k FROM e) SELECT p.page_id, CASE WHEN p.text IS NULL THEN '' ELSE coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM n WHERE n.page_id = p.page_id), '') END AS numbers FROM pages p",
    "strip_citations": rf"WITH {_PAGES} SELECT page_id, length(text) AS n_chars, length(regexp_replace(regexp_replace(text, '{_CITE}', '', 'g'), '{_UUID}', '', 'g')) AS n_left FROM pages",
    "content_words": rf"WITH c AS (SELECT DISTINCT ON (claim_id) claim_id, claim_text, regexp_replace(regexp_replace(claim_text, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM extracted_claims) SELECT claim_id, len(list_distinct(list_filter(regexp_extract_all(lower(claim_text), '[a-z0-9]+'), lambda x: length(x) > 3))) AS n_words, CASE WHEN length(flat) > 60 THEN substr(flat, 1, 59) || '…' ELSE flat END AS label, md5(lower(flat)) AS digest FROM c",
}
