import json

import pytest
from pyspark.sql import functions as F

from evispark.schemas import TABLES, schema
from evispark.operators.ingestion import ingest
from evispark.operators.sections import page_lines
from evispark.sources import gold as G
from evispark.sources import reports as R
from evispark.sources import snapshots as N
from evispark.sources.tables import append_new, replace, reset
from evispark.streaming.incremental import ingest_stream, windowed_counts


def test_schemas():
    assert all(schema(t).fields for t in TABLES)


def test_append_and_replace(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    for _ in range(2):
        append_new(rows, str(tmp_path), "t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 2
    replace(spark.read.parquet(f"{tmp_path}/t.parquet").filter("k = 1"), str(tmp_path), "t")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/t.parquet").collect()] == [(1, "a")]


def test_snapshot_round_trip(spark, tmp_path):
    papers = spark.createDataFrame([("A", "T", ["x"], 2001, "f.pdf", "00")], "paper_key string, title string, authors array<string>, year int, file_name string, file_sha256 string")
    pages = spark.createDataFrame([("A", 1, "one"), ("A", 2, "two")], "paper_key string, page_number int, text string")
    chunks = spark.createDataFrame([("A", "S", "other", 1, 1, 0, 3, "one")], "paper_key string, section_title string, section_type string, page_start int, page_end int, start_char int, end_char int, text string")
    N.write_snapshot(papers, pages, chunks, f"{tmp_path}/s", "now")
    back = N.read_snapshot(spark, f"{tmp_path}/s")
    assert sorted(tuple(r) for r in N.snapshot_pages(back).collect()) == [("A", 1, "one"), ("A", 2, "two")]
    chunk = N.snapshot_chunks(back).first()
    assert chunk.key == "A:p1:0-3" and len(chunk.chunk_id) == 36
    keyed = chunks.selectExpr("'k' as key", "text")
    assert N.fingerprint(pages, keyed).first() == N.fingerprint(pages.orderBy("text"), keyed).first() != N.fingerprint(pages.limit(1), keyed).first()


def test_other_versions_are_refused(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"version": 2, "papers": [{"key": "A"}]}')
    with pytest.raises(Exception, match="snapshot version 2"):
        N.read_snapshot(spark, str(tmp_path)).collect()


def test_answers(spark):
    rows = spark.createDataFrame([('{"claims": [{"claim_text": "x", "confidence": 0.5}]}',), ("no json",), (None,)], "parsed string")
    got = [r.error for r in N.answers(rows, "claims").collect()]
    assert got[0] is None and got[2] == "unreadable answer"


def test_stream_adds_each_content_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, text string")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        ingest_stream(source, str(tmp_path), "t", f"{tmp_path}/checkpoint").awaitTermination()
    rows.withColumn("k", rows.k + 10).write.mode("append").parquet(f"{tmp_path}/in")
    ingest_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), str(tmp_path), "t", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/t.parquet").collect()) == ["a", "b"]


def test_windows(spark):
    rows = spark.sql("select timestamp'2024-01-01 05:00' as ts, 'a' as g union all select timestamp'2024-01-01 06:00', 'a' union all select timestamp'2024-01-02 01:00', 'a'")
    assert sorted(r.n for r in windowed_counts(rows, "ts", "g").collect()) == [1, 2]


def write(tmp_path, name, value):
    (tmp_path / name).write_text(json.dumps(value))
    return str(tmp_path / name)


def test_gold_labels_and_their_problems(spark, tmp_path):
    heads = write(tmp_path, "s.json", {"snapshot_fingerprint": "f", "papers": {"P1": [{"page": 1, "heading": "Intro", "normalized_type": "introduction"}, {"page": 9, "heading": "Intro", "normalized_type": "introduction"}, {"page": 1, "heading": "Gone", "normalized_type": "methods"}, {"page": 1, "heading": "Intro", "normalized_type": "nonsense"}], "P9": [{"page": 1, "heading": "x", "normalized_type": "other"}]}})
    pages = spark.createDataFrame([("P1", "g", 1, "Intro \ntext")], "paper_id string, page_id string, page_number int, text string")
    lines = page_lines(pages).withColumnRenamed("paper_id", "paper_key")
    papers = pages.selectExpr("paper_id as paper_key", "page_number")
    got = {(r.key, r.problem) for r in G.section_problems(G.read_gold_sections(spark, heads, "f"), papers, papers, lines).collect()}
    assert got == {("P1", "unknown page"), ("P1", "no such line"), ("P1", "unknown type"), ("P9", "unknown paper")}
    claims = write(tmp_path, "c.json", {"snapshot_fingerprint": "f", "chunks": {"k": [{"quote": "Some  text", "claim_type": "finding"}, {"quote": "other", "claim_type": "finding"}, {"quote": "text", "claim_type": "guess"}], "z": [{"quote": "q", "claim_type": "finding"}]}})
    chunks = spark.createDataFrame([("k", "some text here")], "chunk_key string, text string")
    gold = G.read_gold_claims(spark, claims, "f")
    bad = G.claim_problems(gold, chunks)
    assert {(r.key, r.problem) for r in bad.collect()} == {("k", "quote not verbatim"), ("k", "unknown type"), ("z", "unknown chunk")}
    queries = G.read_retrieval_queries(spark, write(tmp_path, "q.json", {"snapshot_fingerprint": "f", "queries": [{"id": "q1", "query": "x", "relevant_chunks": ["k", "k", "z"]}, {"id": "q2", "query": "y", "relevant_chunks": []}]}), "f")
    assert sorted((r.q_id, r.chunk_key) for r in queries.collect()) == [("q1", "k"), ("q1", "z"), ("q2", None)] or queries.count() == 3
    known = spark.createDataFrame([("q2",)], "q_id string")
    assert {(r.key, r.problem) for r in G.relevance_problems(queries, chunks).collect()} == {("q1", "unknown chunk")}
    assert G.all_problems(bad, None, G.relevance_problems(queries, chunks, known)).filter("kind = 'relevance'").first().problem == "unknown query"


def test_labels_that_do_not_fit_are_left_out(spark, tmp_path):
    path = write(tmp_path, "c.json", {"snapshot_fingerprint": "old", "chunks": {"k": [{"quote": "q", "claim_type": "finding"}]}})
    with pytest.warns(UserWarning, match="gold claims left out"):
        assert G.optional(lambda: G.read_gold_claims(spark, path, "new"), "gold claims") is None
    with pytest.warns(UserWarning):
        assert G.optional(lambda: G.read_gold_claims(spark, str(tmp_path / "missing.json"), "new"), "gold") is None
    assert G.optional(lambda: G.read_gold_claims(spark, path, "old"), "gold").count() == 1


def test_reports_and_baselines(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.latest_report(spark, str(tmp_path / "reports"))
    rows = lambda v: spark.createDataFrame([("m", "claims", "rate", v)], "model string, stage string, key string, value double")
    for run, v in (("20240101T000000Z", 0.1), ("20240201T000000Z", 0.2), ("calibration-9", 0.9)):
        R.write_report(rows(v), {"seed": "0", "git": "abc"}, str(tmp_path / "reports"), run)
    last = R.latest_report(spark, str(tmp_path / "reports"))
    assert [tuple(r) for r in R.measures(last).collect()] == [("m", "claims", "rate", 0.2)]
    with pytest.raises(FileNotFoundError):
        R.read_baseline(spark, str(tmp_path))
    for _ in range(2):
        R.write_baseline(last, spark.createDataFrame([("m/claims/rate", 0.2, "up")], "metric string, value double, better string"), str(tmp_path))
    config, metrics = R.read_baseline(spark, str(tmp_path))
    assert [tuple(r) for r in config.collect()] == [("seed", "0")] and [tuple(r) for r in metrics.collect()] == [("m/claims/rate", 0.2, "up")]


def test_recordings_stay_as_they_are(spark, tmp_path):
    calls = spark.createDataFrame([("k", "m", "v", 1, None, "{}"), ("n", "m", "v", 1, 2, None)], "key string, model string, prompt_version string, input_tokens bigint, output_tokens bigint, parsed string")
    R.save_recordings(calls, str(tmp_path))
    R.save_recordings(calls.withColumn("parsed", F.lit("[]")), str(tmp_path))
    assert {(r.key, r.parsed) for r in spark.read.parquet(f"{tmp_path}/recordings.parquet").collect()} == {("k", "{}"), ("n", "[]")}
    assert [tuple(r) for r in R.usage_rows(calls.limit(1), F.lit("r")).collect()] == [("r", "m", "v", 1, 0)]
    one = spark.sql("select timestamp'2024-01-02 03:04:05' as t").select(R.run_id(F.col("t")).alias("i"), R.formatted(F.lit(0.1234), "pct").alias("p"), R.formatted(F.lit(None).cast("double"), "usd").alias("n")).first()
    assert tuple(one) == ("20240102T030405Z", "12.3%", "–")


def test_ingestion_and_reset(spark, tmp_path):
    papers = spark.createDataFrame([("p", "T", "aa"), ("q", "T", "aa"), ("r", "U", "bb"), ("s", "V", None)], "paper_id string, title string, file_sha256 string")
    pages = spark.createDataFrame([("p", "g1", 1, "Abstract\nWe study things."), ("q", "g2", 1, "Copy"), ("r", "g3", 1, None)], "paper_id string, page_id string, page_number int, text string")
    for _ in range(2):
        ingest(papers, pages, str(tmp_path))
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    assert sorted(r.paper_id for r in read("papers").collect()) == ["p", "r"]
    assert [(r.page_id, r.section_title) for r in read("text_chunks").collect()] == [("g1", "Abstract")]
    assert sorted((r.paper_id, r.title) for r in read("sections").collect()) == [("p", "Abstract"), ("r", "Full Text")]
    assert reset(spark, str(tmp_path)) == ["text_chunks", "sections", "paper_pages", "papers"] and reset(spark, str(tmp_path)) == []
