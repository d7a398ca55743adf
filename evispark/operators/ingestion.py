"""Ingestion of papers: what is new by content goes into the tables of papers, pages, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.ids import stable_id
from evispark.operators.chunking import chunk_pages, tag_chunks
from evispark.operators.sections import detect_sections
from evispark.sources.tables import append_new, exists
from evispark.staging import stage


def ingest(papers: DataFrame, pages: DataFrame, folder: str, max_chars: int = 1500, overlap: int = 150) -> None:
    """Add to the tables of ``folder`` the papers whose file they don't have, with their pages, sections and tagged chunks.

    ``papers`` is (paper_id, file_sha256, ...), ``pages`` (paper_id, page_id, page_number, text). Papers without a digest are left out, of several with one the
    least id is taken. Identities of sections and chunks follow from their places. Papers are written last and every table takes each key once, so an
    ingestion that broke off is finished by running it again.
    """
    spark = papers.sparkSession
    new = papers.filter("file_sha256 is not null").groupBy("file_sha256").agg(F.min("paper_id").alias("paper_id"))
    if exists(spark, f"{folder}/papers.parquet"):
        new = new.join(spark.read.parquet(f"{folder}/papers.parquet").select("file_sha256"), "file_sha256", "left_anti")
    new = stage(new, "new")
    of = pages.filter("page_id is not null").dropDuplicates(["page_id"]).join(new.select("paper_id"), "paper_id", "left_semi")
    of = stage(of, "pages")
    sections = stage(detect_sections(of), "sections")
    place = lambda *cs: F.concat_ws(":", *[F.col(c).cast("string") for c in cs])
    chunks = tag_chunks(chunk_pages(of, max_chars, overlap), sections)
    append_new(of, folder, "paper_pages", ["page_id"])
    append_new(sections.withColumn("section_id", stable_id("section", place("paper_id", "pos"))), folder, "sections", ["section_id"])
    append_new(chunks.withColumn("chunk_id", stable_id("chunk", place("page_id", "start_char", "end_char"))), folder, "text_chunks", ["chunk_id"])
    append_new(papers.dropDuplicates(["paper_id"]).join(new, ["paper_id", "file_sha256"], "left_semi"), folder, "papers", ["file_sha256"])
