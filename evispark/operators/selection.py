"""Ingestion, selection and fallbacks: anti-joins, round robin, recency, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.text import is_filename_title, is_internal_title, metadata_from_name
from evispark.staging import broadcast_if_small, stage


def dedupe_by_content(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(sha256, key of the first, copies): each content once, by the least key; null texts are left out."""
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.sha2(F.encode(text, "utf-8"), 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def new_content(batch: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``batch`` whose content isn't among ``known`` (sha256)."""
    return batch.withColumn("sha256", F.sha2(F.encode(text, "utf-8"), 256)).join(known.select("sha256"), "sha256", "left_anti")


def unclaimed(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """Chunks, once each, from which no claim was taken."""
    return chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).join(claims.select("chunk_id").filter("chunk_id is not null").distinct(), "chunk_id", "left_anti")


def global_numbers(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with a number from 1 in a total order: ranges are sorted apart and numbered on from each other."""
    parts = stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def round_robin(rows: DataFrame, group: str, order: list[Column | str], limit: int | None = None) -> DataFrame:
    """``rows`` with ``round``: the first of each group, then the second, and so on; ``limit`` cuts that order.

    With a limit no round beyond it can count, so each group is cut before the shuffle. Without one, rows are numbered in one order
    of sorted ranges and a group's first number is taken off, so a group with a third of all rows is numbered by many tasks.
    """
    if limit is not None:
        out = rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("round") <= limit)
        return out.orderBy("round", group).limit(limit)
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for k, o in zip(keys, order, strict=True)])
    numbered = global_numbers(keyed, [group, *keys], "round").drop(*keys)
    first = numbered.groupBy(group).agg(F.min("round").alias("_first"))
    on = numbered[group].eqNullSafe(first[group])
    return numbered.join(first, on).withColumn("round", F.col("round") - F.col("_first") + 1).drop("_first").drop(first[group])


def sample_round_robin(rows: DataFrame, group: str, key: str, limit: int, seed: int = 0) -> DataFrame:
    """``limit`` rows in round robin over groups, each in a seeded order that any engine repeats; 0 or less takes all."""
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    out = round_robin(rows, group, [shuffled, F.col(key)], limit if limit > 0 else None)
    return out


def most_recent(rows: DataFrame, key: str, n: int, newest: bool = True) -> DataFrame:
    """The ``n`` newest (or oldest) rows by created_at; ties go by key."""
    at = F.col("created_at")
    return rows.dropDuplicates([key]).orderBy(at.desc_nulls_last() if newest else at.asc_nulls_last(), key).limit(n)


def paper_structure(papers: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, n_pages, n_sections, n_chunks): children counted before they are joined; none count as 0."""
    p = pages.groupBy("paper_id").agg(F.countDistinct("page_id").alias("n_pages"))
    c = chunks.groupBy("paper_id").agg(F.countDistinct("section_title").alias("n_sections"), F.countDistinct("chunk_id").alias("n_chunks"))
    rows = papers.select("paper_id", "paper_key").distinct().join(p, "paper_id", "left").join(c, "paper_id", "left")
    return rows.na.fill(0, ["n_pages", "n_sections", "n_chunks"])


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def next_paper_keys(papers: DataFrame) -> DataFrame:
    """(paper_id, next_key): the keys P001, P002, ... that papers get in order of arrival."""
    return global_numbers(papers.select("paper_id", "created_at"), ["created_at", "paper_id"]).select("paper_id", F.format_string("P%03d", "number").alias("next_key"))


def backfill_metadata(papers: DataFrame) -> DataFrame:
    """Papers with what their file names tell: (paper_id, title, year, changed).

    A year is filled only where it is missing, a title only where it is missing, left by a writing program, or nothing but the file's name.
    """
    named = metadata_from_name("file_name")
    weak = is_filename_title("title", "file_name") | F.coalesce(is_internal_title("title"), F.lit(True))
    rows = papers.select("paper_id", F.col("title").alias("old_title"), F.col("year").alias("old_year"), F.when(weak, F.coalesce(named["title"], F.col("title"))).otherwise(F.col("title")).alias("title"), F.coalesce("year", named["year"]).alias("year"))
    return rows.select("paper_id", "title", "year", (~(F.col("title").eqNullSafe(F.col("old_title")) & F.col("year").eqNullSafe(F.col("old_year")))).alias("changed"))


def overlaid_metadata(papers: DataFrame, known: DataFrame) -> DataFrame:
    """``papers`` with title, authors and year of ``known`` (file_name, ...) for the files that are known there; what is empty there stays as it was."""
    k = known.dropDuplicates(["file_name"]).select("file_name", F.nullif("title", F.lit("")).alias("_title"), F.when(F.size("authors") > 0, F.col("authors")).alias("_authors"), F.col("year").alias("_year"))
    rows = papers.join(k, "file_name", "left")
    for c in ("title", "authors", "year"):
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
    return rows.select(*papers.columns)


def merged(primary: dict[str, Column], fallback: dict[str, Column]) -> dict[str, Column]:
    """title, authors and year of two sources, field by field; an empty text or list counts as missing."""
    text = lambda c: F.nullif(c, F.lit(""))
    some = lambda c: F.when(F.size(c) > 0, c)
    return {"title": F.coalesce(text(primary["title"]), text(fallback["title"])), "authors": F.coalesce(some(primary["authors"]), some(fallback["authors"])), "year": F.coalesce(primary["year"], fallback["year"])}


def in_paper_order(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Sampled chunks back in the order of their papers (paper_id, number), pages and places."""
    return rows.join(broadcast_if_small(papers.select("paper_id", "number")), "paper_id", "left").orderBy(F.col("number").asc_nulls_last(), "page_start", "start_char", "chunk_id").drop("number")


def overview(papers: DataFrame, structure: DataFrame, newest: int = 20) -> DataFrame:
    """The ``newest`` papers with their authors as one text and the counts of :func:`paper_structure`."""
    rows = papers.dropDuplicates(["paper_id"]).orderBy(F.col("created_at").desc_nulls_last(), "paper_id").limit(newest)
    return rows.select("paper_id", "title", F.array_join("authors", ", ").alias("authors")).join(structure, "paper_id")


def responses_in_order(responses: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(group, values): a batch's answers by their index, whatever order they came in."""
    return responses.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(index, value)))[value].alias("values"))
