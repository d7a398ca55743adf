"""Labels, queries, scenarios and agent cases from JSON, as tables, and what is wrong with labels."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions.text import normalize_text, trim_ws
from evispark.operators.validation import CLAIM_TYPES, SECTION_TYPES

SCENARIO = "id string, topic string, synthesis_types array<string>, max_claims int"
AGENT_CASE = "id string, prompt string, must_call array<string>, must_not_call array<string>, `order` array<array<string>>, synthesis_type string, max_tool_calls int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_scenarios(spark: SparkSession, path: str, max_claims: int = 60) -> DataFrame:
    return _read(spark, path, SCENARIO).withColumn("max_claims", F.coalesce("max_claims", F.lit(max_claims)))


def read_agent_cases(spark: SparkSession, path: str, max_calls: int = 8) -> DataFrame:
    empty = F.array().cast("array<string>")
    rows = _read(spark, path, AGENT_CASE)
    return rows.withColumn("must_call", F.coalesce("must_call", empty)).withColumn("must_not_call", F.coalesce("must_not_call", empty)).withColumn("order", F.coalesce("order", F.array().cast("array<array<string>>"))).withColumn("max_tool_calls", F.coalesce("max_tool_calls", F.lit(max_calls)))


def _checked(raw: DataFrame, fingerprint: str) -> DataFrame:
    """``raw`` if it was made for the snapshot with this fingerprint; else reading it is an error."""
    wrong = F.raise_error(F.concat(F.lit("labels of another snapshot: "), F.coalesce("snapshot_fingerprint", F.lit("none"))))
    return raw.withColumn("ok", F.when(F.col("snapshot_fingerprint") == fingerprint, True).otherwise(wrong)).filter("ok")


def read_gold_sections(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """(paper_key, page_number, heading, section_type) of {papers: {key: [heading]}}; places come from :func:`evispark.operators.stages.locate_lines`."""
    raw = _read(spark, path, "snapshot_fingerprint string, papers map<string, array<struct<page: int, heading: string, normalized_type: string>>>")
    rows = _checked(raw, fingerprint).select(F.explode("papers").alias("paper_key", "hs")).select("paper_key", F.explode("hs").alias("h"))
    return rows.select("paper_key", F.col("h.page").alias("page_number"), "h.heading", F.col("h.normalized_type").alias("section_type"))


def read_gold_claims(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """(chunk_key, pos, quote, claim_type) of {chunks: {key: [claim]}}."""
    raw = _read(spark, path, "snapshot_fingerprint string, chunks map<string, array<struct<quote: string, claim_type: string>>>")
    return _checked(raw, fingerprint).select(F.explode("chunks").alias("chunk_key", "cs")).select("chunk_key", F.posexplode("cs").alias("pos", "c")).select("chunk_key", "pos", "c.*")


def read_retrieval_queries(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """(q_id, query, chunk_key) of {queries: [{id, query, relevant_chunks}]}: a row for each relevant chunk, once; a query without any has one with null."""
    raw = _read(spark, path, "snapshot_fingerprint string, queries array<struct<id: string, query: string, relevant_chunks: array<string>>>")
    rows = _checked(raw, fingerprint).select(F.explode("queries").alias("q"))
    return rows.select(F.col("q.id").alias("q_id"), "q.query", F.explode_outer(F.array_distinct("q.relevant_chunks")).alias("chunk_key"))


def optional(load: Callable[[], DataFrame], name: str) -> DataFrame | None:
    """What ``load`` reads, or None with a warning where the labels are missing or of another snapshot: their stage is left out."""
    try:
        found = load()
        found.limit(1).count()
        return found
    except (PySparkException, FileNotFoundError, ValueError) as e:
        warnings.warn(f"{name} left out: {str(e).splitlines()[0][:200]}", stacklevel=2)
        return None


_PROBLEM = ("kind", "key", "problem")


def _problems(rows: DataFrame, kind: str, key: str, checks: dict[str, object]) -> DataFrame:
    """(kind, key, problem): the first check, in order, that a row fails."""
    problem = F.lit(None).cast("string")
    for text, bad in reversed(checks.items()):
        problem = F.when(F.coalesce(bad, F.lit(True)), text).otherwise(problem)
    return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), problem.alias("problem")).filter("problem is not null").distinct()


def section_problems(gold: DataFrame, papers: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Gold headings (paper_key, page_number, heading, section_type) of unknown papers, of unknown types, on pages that aren't there, or not a line of theirs.

    ``papers`` is (paper_key), ``pages`` (paper_key, page_number), ``lines`` (paper_key, page_number, line).
    """
    line = trim_ws("heading")
    rows = gold.withColumn("line", line).join(papers.select("paper_key").distinct().withColumn("p", F.lit(True)), "paper_key", "left")
    rows = rows.join(pages.select("paper_key", "page_number").distinct().withColumn("g", F.lit(True)), ["paper_key", "page_number"], "left")
    rows = rows.join(lines.select("paper_key", "page_number", trim_ws("line").alias("line")).distinct().withColumn("l", F.lit(True)), ["paper_key", "page_number", "line"], "left")
    return _problems(rows, "sections", "paper_key", {"unknown paper": F.col("p").isNull(), "unknown type": ~F.col("section_type").isin(*SECTION_TYPES), "unknown page": F.col("g").isNull(), "no such line": F.col("l").isNull()})


def claim_problems(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold claims (chunk_key, quote, claim_type) of unknown chunks (chunk_key, text), of unknown types, or with quotes that don't stand in them."""
    rows = gold.join(chunks.select("chunk_key", "text").dropDuplicates(["chunk_key"]).withColumn("c", F.lit(True)), "chunk_key", "left")
    quote = normalize_text("quote")
    return _problems(rows, "claims", "chunk_key", {"unknown chunk": F.col("c").isNull(), "unknown type": ~F.col("claim_type").isin(*CLAIM_TYPES), "quote not verbatim": ~((quote != "") & normalize_text("text").contains(quote))})


def relevance_problems(relevant: DataFrame, chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Relevance (q_id, chunk_key) of queries that aren't among ``queries`` (q_id), and of unknown chunks."""
    rows = relevant.filter("chunk_key is not null").join(chunks.select("chunk_key").distinct().withColumn("c", F.lit(True)), "chunk_key", "left")
    rows = rows.withColumn("q", F.lit(True)) if queries is None else rows.join(queries.select("q_id").distinct().withColumn("q", F.lit(True)), "q_id", "left")
    return _problems(rows, "relevance", "q_id", {"unknown query": F.col("q").isNull(), "unknown chunk": F.col("c").isNull()})


def all_problems(*found: DataFrame | None) -> DataFrame:
    """The problems of all kinds of labels there are; those that were left out have none."""
    return reduce(DataFrame.unionByName, [f.select(*_PROBLEM) for f in found if f is not None])
