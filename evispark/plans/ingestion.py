"""Queries of first pages, streams and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evispark.functions.bylines import first_pages, merged_metadata
from evispark.operators.ingestion import ingest
from evispark.plans.documents import _ALL_HITS, _CHUNKS, _INTERVALS, EOL, WS
from evispark.plans.provenance import authors_sql
from evispark.sources.snapshots import fingerprint
from evispark.staging import shared_dir, table
from evispark.streaming.incremental import ingest_stream, windowed_counts


def first_page_metadata(spark, d):
    return first_pages(table(spark, d, "paper_pages")).withColumn("authors", F.array_join("authors", "|"))


def ingest_papers(spark, d):
    """All papers ingested twice into empty tables; what the tables hold then."""
    at = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    papers = table(spark, d, "papers")
    for _ in range(2):
        ingest(papers, table(spark, d, "paper_pages").filter("paper_id is not null"), at)
    count = lambda t, n: spark.read.parquet(f"{at}/{t}.parquet").groupBy("paper_id").agg(F.count("*").alias(n))
    rows = spark.read.parquet(f"{at}/papers.parquet").select("paper_id")
    for t, n in (("paper_pages", "n_pages"), ("sections", "n_sections"), ("text_chunks", "n_chunks")):
        rows = rows.join(count(t, n), "paper_id", "left")
    return rows.na.fill(0, ["n_pages", "n_sections", "n_chunks"])


def stream_ingest(spark, d):
    """All documents through a stream, file by file, into a table of distinct contents."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/documents.parque[t]")
    ingest_stream(source, at, "contents", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/contents.parquet").select("sha256", F.length("text").alias("n_chars"))


def events_per_day(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def snapshot_fingerprint(spark, d):
    pages = table(spark, d, "paper_pages").dropDuplicates(["page_id"]).select(F.col("paper_id").alias("paper_key"), "page_number", "text")
    chunks = table(spark, d, "text_chunks").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("key"), "text")
    return fingerprint(pages, chunks)


def paper_metadata(spark, d):
    return merged_metadata(table(spark, d, "papers"), table(spark, d, "paper_pages")).withColumn("authors", F.array_join("authors", "|"))


QUERIES = {"first_page_metadata": first_page_metadata, "stream_ingest": stream_ingest, "events_per_day": events_per_day, "snapshot_fingerprint": snapshot_fingerprint, "paper_metadata": paper_metadata, "ingest_papers": ingest_papers}
_CLEAN = lambda x: f"nullif(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g'), '')"
_PLAIN = lambda x: f"translate(replace(replace(replace(replace(replace({x}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '−‐‑‒–—', '------')"
_AFFILIATION = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{m}')" for m in ("abstract", "department", "university", "institute", "college", "school", "state key laboratory", "cnrs", "supporting information", "received", "revised", "keywords")) + f" OR trim({x}) IN ('*', '■'))"
_NAMES = lambda x: rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({x}, '[*†‡§¶#⊥∥‖0-9]+', '', 'g'), '^[ ,]+|[ ,]+$', '', 'g'), '(?i)\s*(?:,|;|\band\b|&)\s*'), lambda n: trim(n)), lambda n: n <> '')"
_NAME_LIST = lambda x: rf"(len({_NAMES(x)}) >= 2 AND len(list_filter({_NAMES(x)}, lambda n: NOT regexp_full_match(n, '[A-Z][A-Za-z''-]*\.?(?:\s+[A-Z][A-Za-z''-]*\.?){{0,2}}'))) = 0)"
_BYLINE = lambda x: rf"(NOT {_AFFILIATION(x)} AND length({x}) <= 250 AND NOT regexp_matches({x}, '(?i)\b(?:abstract|keywords|introduction)\b') AND (regexp_matches({x}, '\b[A-Z]\.\s*(?:[A-Z]\.\s*)?[A-Z][A-Za-z-]+') OR {_NAME_LIST(x)}))"
#: First pages by the rules of the survey (I5, I6, I10).
_FIRST = rf"""
WITH one AS (SELECT DISTINCT ON (page_id) paper_id, text FROM paper_pages WHERE page_number = 1 AND page_id IS NOT NULL),
ls AS (SELECT paper_id, text, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[{EOL}]'), lambda x: {_CLEAN(_PLAIN('x'))}), lambda x: x IS NOT NULL) AS ls FROM one),
ix AS (SELECT *, coalesce(list_position(list_transform(ls[1:12], lambda x: {_BYLINE('x')}), true), 0) AS i FROM ls),
bys AS (SELECT *, ls[i:i + 3] AS b FROM ix),
cut AS (SELECT *, coalesce(nullif(list_position(list_transform(b, lambda x: {_AFFILIATION('x')}), true), 0) - 1, 4) AS n1, coalesce(nullif(list_position(list_transform(b, lambda x: contains(lower(x), ' and ') AND NOT ends_with(rtrim(x), ',')), true), 0), 4) AS n2 FROM bys),
txt AS (SELECT *, array_to_string(b[1:least(n1, n2)], ' ') AS by_text FROM cut),
first AS (SELECT paper_id, CASE WHEN i > 1 THEN {_CLEAN("array_to_string(ls[1:i - 1], ' ')")} END AS title, CASE WHEN i > 1 THEN {authors_sql('by_text')} ELSE []::VARCHAR[] END AS authors, nullif(regexp_extract(text, '\b((?:19|20)\d{{2}})\b', 1), '')::INT AS year FROM txt)"""
_INTERNAL = r"(low IN ('no job name', 'untitled', 'untitled document', 'untitled-1', '(no title)', 'adobe pdf') OR starts_with(low, 'microsoft word - ') OR regexp_matches(low, '\d+\.\.\d+') OR regexp_matches(low, '^[a-z]{1,4}\d+[a-z]?(?:\s+\d+\.\.\d+)?$'))"
_HASH = "('0x' || substr(sha256(concat_ws(chr(31), {})), 1, 12))::BIGINT"
SQL = {
    "ingest_papers": f"WITH RECURSIVE {_ALL_HITS}{_INTERVALS.replace('CONFIDENCE', 'o.confidence')}{_CHUNKS} SELECT p.paper_id, coalesce(a, 0) AS n_pages, coalesce(b, 0) AS n_sections, coalesce(c, 0) AS n_chunks FROM (SELECT min(paper_id) AS paper_id FROM papers WHERE file_sha256 IS NOT NULL GROUP BY file_sha256) p LEFT JOIN (SELECT paper_id, count(*) AS a FROM pages GROUP BY 1) USING (paper_id) LEFT JOIN (SELECT paper_id, count(*) AS b FROM sections GROUP BY 1) USING (paper_id) LEFT JOIN (SELECT paper_id, count(*) AS c FROM chunks GROUP BY 1) USING (paper_id)",
    "first_page_metadata": _FIRST + " SELECT paper_id, title, array_to_string(authors, '|') AS authors, year FROM first",
    "paper_metadata": _FIRST + rf", f AS (SELECT paper_id, min(title) AS tt, min(authors) AS ta, min(year) AS ty FROM first GROUP BY 1), p AS (SELECT *, nullif(title, '') AS dt, lower(regexp_replace(title, '^{WS}+|{WS}+$', '', 'g')) AS low FROM papers) SELECT p.paper_id, CASE WHEN nullif(tt, '') IS NOT NULL AND (dt IS NULL OR {_INTERNAL}) THEN tt ELSE coalesce(dt, nullif(tt, '')) END AS title, array_to_string(CASE WHEN len(p.authors) > 0 THEN p.authors ELSE coalesce(ta, []) END, '|') AS authors, coalesce(ty, p.year) AS year FROM p LEFT JOIN f USING (paper_id)",
    "snapshot_fingerprint": f"WITH h AS (SELECT {_HASH.format('paper_id, page_number::VARCHAR, text')} AS h FROM (SELECT DISTINCT ON (page_id) * FROM paper_pages) UNION ALL SELECT {_HASH.format('chunk_id, text')} FROM (SELECT DISTINCT ON (chunk_id) * FROM text_chunks)) SELECT substr(sha256(sum(h)::VARCHAR || ':' || count(*)), 1, 16) AS fingerprint FROM h",
    "stream_ingest": "SELECT DISTINCT sha256(text) AS sha256, length(text) AS n_chars FROM documents WHERE text IS NOT NULL",
    "events_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
