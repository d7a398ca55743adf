"""Chunks of page texts with places that point back into the page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.staging import stage

#: What a chunk may end behind, in order of preference.
DELIMITERS = ("\n\n", ". ", "\n", " ")


def chunk_bounds(text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Half-open places of the windows over ``text``.

    A window that isn't the last ends behind the last delimiter of the first kind that stands far
    enough in it (beyond 80 characters and half its length), else at its size. The next one begins
    ``overlap`` characters earlier, but always after the one before.
    """
    start = 0
    while start < len(text):
        stop = min(start + max_chars, len(text))
        if stop < len(text):
            least = max(80, (stop - start) // 2)
            places = ((text.rfind(d, start, stop) - start, len(d)) for d in DELIMITERS)
            stop = next((start + at + size for at, size in places if at > least), stop)
        yield start, stop
        if stop >= len(text):
            return
        start = max(stop - overlap, start + 1)


def chunk_pages(pages: DataFrame, max_chars: int = 1500, overlap: int = 150) -> DataFrame:
    """(paper_id, page_id, page_number, start_char, end_char, text): the chunks of each page.

    Blank chunks are dropped; null and empty texts have none; a page that stands on several rows is cut
    once. Raises ValueError for sizes that can't be.
    """
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive, and overlap from 0 to below it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, starts, stops, texts = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for a, b in chunk_bounds(text, max_chars, overlap):
                    if text[a:b].strip():
                        of.append(i), starts.append(a), stops.append(b), texts.append(text[a:b])
            at = pa.array(of, pa.int32())
            yield pa.record_batch([*(batch.column(c).take(at) for c in range(3)), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(texts, pa.string())], names=["paper_id", "page_id", "page_number", "start_char", "end_char", "text"])

    rows = pages.filter("text <> ''").select("paper_id", "page_id", "page_number", "text").dropDuplicates(["page_id"])
    return rows.mapInArrow(run, "paper_id string, page_id string, page_number int, start_char int, end_char int, text string")


def _by_page(sections: DataFrame) -> DataFrame:
    """``sections`` (s_paper, s_from, s_to, ...) with a row for each page they span: about a row a page, as they follow each other.

    So chunks meet them by an equal (paper, page), and no paper's chunks are compared with all its sections.
    """
    return sections.filter("s_to >= s_from").withColumn("s_page", F.explode(F.sequence("s_from", "s_to")))


def tag_chunks(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Each chunk with the section it lies in: (chunk's columns, section_title, section_type).

    Among the sections that span the chunk's page, one that began on the same page at or before the chunk goes
    first (the last to begin), else the one with the latest first page; ties go to the earliest in the list (``pos``).
    So a chunk above a page's first heading gets that later heading, as a section that begins on the page is its latest.
    """
    names = [c for c in chunks.columns if c not in ("section_title", "section_type")]
    c = chunks.select(*names).withColumn("_row", F.struct("paper_id", "page_id", "page_number", "start_char"))
    s = sections.select(F.col("paper_id").alias("s_paper"), F.col("page_start").alias("s_from"), F.col("page_end").alias("s_to"), F.col("start_char").alias("s_char"), "pos", F.col("title").alias("section_title"), "section_type")
    rows = c.join(_by_page(s), (F.col("paper_id") == F.col("s_paper")) & (F.col("page_number") == F.col("s_page")), "left")
    begun = F.coalesce((F.col("s_from") == F.col("page_number")) & (F.col("s_char") <= F.col("start_char")), F.lit(False))
    w = Window.partitionBy("_row").orderBy(begun.desc(), F.when(begun, F.col("s_char")).otherwise(F.col("s_from")).desc_nulls_last(), F.col("pos").asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*names, "section_title", "section_type")


def match_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk's columns, section_pos): the section a tagged chunk is filed under.

    Sections of the paper that span the page and have the chunk's title or type; the one that begins farthest into its page wins,
    whatever page that is, and ties go to the earliest in the list.
    """
    names = chunks.columns
    s = sections.select(F.col("paper_id").alias("s_paper"), F.col("page_start").alias("s_from"), F.col("page_end").alias("s_to"), F.col("start_char").alias("s_char"), F.col("pos").alias("section_pos"), F.col("title").alias("s_title"), F.col("section_type").alias("s_type"))
    on = (F.col("paper_id") == F.col("s_paper")) & (F.col("page_number") == F.col("s_page")) & ((F.col("section_title") == F.col("s_title")) | (F.col("section_type") == F.col("s_type")))
    w = Window.partitionBy("paper_id", "page_id", "page_number", "start_char").orderBy(F.col("s_char").desc_nulls_last(), F.col("section_pos").asc_nulls_last())
    return chunks.join(_by_page(s), on, "left").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*names, "section_pos")


def governing_heading(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """(paper_id, page_id, page_number, start_char, governing): the type of the last heading at or before each chunk, else ``other``.

    Both are ordered by (page, place) in one pass: a union, sorted into ranges, with a running last value in each range. What a range begins
    with comes from the last heading of the ranges before it, so a paper of any length is spread over many tasks and nothing is joined by range.
    """
    h = headings.select("paper_id", F.lit(None).cast("string").alias("page_id"), "page_number", F.col("start_char").cast("bigint").alias("start_char"), F.col("section_type").alias("kind"), F.lit(0).alias("side"))
    c = chunks.select("paper_id", "page_id", "page_number", F.col("start_char").cast("bigint").alias("start_char"), F.lit(None).cast("string").alias("kind"), F.lit(1).alias("side"))
    order = ["paper_id", "page_number", "start_char", "side"]
    rows = stage(h.unionByName(c).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    last = rows.filter("kind is not null").groupBy("part").agg(F.max(F.struct(*order, "kind")).alias("x")).select("part", F.struct(F.col("x.paper_id").alias("paper"), F.col("x.kind").alias("kind")).alias("x"))
    parts = rows.select("part").distinct().join(last, "part", "left")
    carried = parts.select("part", F.last("x", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row per range
    w = Window.partitionBy("part", "paper_id").orderBy("page_number", "start_char", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("kind", ignorenulls=True).over(w)).filter("side = 1").join(F.broadcast(carried), "part")
    before = F.when(F.col("before.paper") == F.col("paper_id"), F.col("before.kind"))
    return rows.select("paper_id", "page_id", "page_number", F.col("start_char").cast("int").alias("start_char"), F.coalesce("own", before, F.lit("other")).alias("governing"))
