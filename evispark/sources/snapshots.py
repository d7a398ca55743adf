"""Nested JSON: snapshots of papers, recordings of calls, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions.ids import stable_id
from evispark.schemas import ANSWERS, RECORDING, SNAPSHOT

VERSION = 1


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row per paper of a snapshot; any other version than 1 is an error when rows are read."""
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    checked = raw.withColumn("ok", F.when(F.col("version") == VERSION, True).otherwise(F.raise_error(F.concat(F.lit("snapshot version "), F.coalesce(F.col("version").cast("string"), F.lit("null"))))))
    return checked.filter("ok").select(F.posexplode("papers").alias("pos", "p")).select("pos", "p.*")


def snapshot_pages(papers: DataFrame) -> DataFrame:
    """(paper_key, page_number, text)."""
    return papers.select(F.col("key").alias("paper_key"), F.explode("pages").alias("n", "text")).select("paper_key", F.col("n").cast("int").alias("page_number"), "text")


def snapshot_chunks(papers: DataFrame) -> DataFrame:
    """(paper_key, chunk_id, key, section and places, text) with identities derived from the key."""
    rows = papers.select(F.col("key").alias("paper_key"), F.explode("chunks").alias("c")).select("paper_key", "c.*")
    return rows.withColumn("chunk_id", stable_id("chunk", F.col("key")))


def write_snapshot(papers: DataFrame, pages: DataFrame, chunks: DataFrame, path: str, created_at: str) -> None:
    """Papers with their pages and chunks as nested JSON, one document a paper; a chunk's key is ``paper:p<page>:<start>-<end>``."""
    key = F.format_string("%s:p%d:%d-%d", F.col("paper_key"), F.col("page_start"), F.col("start_char"), F.col("end_char"))
    c = chunks.select("paper_key", F.struct(key.alias("key"), "section_title", "section_type", "page_start", "page_end", "start_char", "end_char", "text").alias("c"))
    c = c.groupBy("paper_key").agg(F.sort_array(F.collect_list("c")).alias("chunks"))
    p = pages.groupBy("paper_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("page_number").cast("string"), "text")))).alias("pages"))
    rows = papers.join(p, "paper_key", "left").join(c, "paper_key", "left")
    paper = F.struct(F.col("paper_key").alias("key"), "title", "authors", "year", "file_name", F.col("file_sha256").alias("pdf_sha256"), "pages", "chunks")
    rows.select(F.lit(VERSION).alias("version"), F.lit(created_at).alias("created_at"), F.array(paper).alias("papers")).write.json(path)


def fingerprint(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fingerprint): 16 hex digits over all page and chunk texts, whatever their order. Hashes are added up, never gathered."""
    h = lambda *cols: F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cols), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    one = pages.select(h("paper_key", F.col("page_number").cast("string"), "text").alias("h")).unionAll(chunks.select(h("key", "text").alias("h")))
    return one.agg(F.sum("h").alias("s"), F.count("*").alias("n")).select(F.substring(F.sha2(F.concat_ws(":", F.col("s").cast("string"), F.col("n").cast("string")), 256), 1, 16).alias("fingerprint"))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """One row per recorded call; the answer stays JSON text."""
    return spark.read.schema(RECORDING).option("multiLine", True).json(path)


def answers(recordings: DataFrame, kind: str, column: str = "parsed") -> DataFrame:
    """``recordings`` with ``answer`` parsed to the kind's structure, null and ``error`` set where it doesn't fit."""
    parsed = F.from_json(column, ANSWERS[kind])
    return recordings.withColumn("answer", parsed).withColumn("error", F.when(F.col(column).isNull() | parsed.isNull(), F.lit("unreadable answer")))
