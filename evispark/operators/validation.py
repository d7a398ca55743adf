"""Constraints of the stored tables as counts of the rows that break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of claims and sections.
CLAIM_TYPES = ("finding", "method", "limitation", "dataset", "metric", "background", "future_work", "other")
SECTION_TYPES = ("abstract", "introduction", "related_work", "methods", "results", "discussion", "limitations", "conclusion", "other")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations, n_rows): rows for which a rule is false, in one pass; a rule that is null is kept."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.sum(F.when(~c, 1).otherwise(0)).alias(k) for k, c in rules.items()])
    return counts.unpivot(["n_rows"], list(rules), "rule", "n_violations").select("rule", F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"), "n_rows")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys on more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def chunk_rules() -> dict[str, Column]:
    c = F.col
    return {"chunk_start": c("start_char") >= 0, "chunk_span": c("end_char") > c("start_char"), "chunk_pages": c("page_end") >= c("page_start"), "chunk_type": c("section_type").isin(*SECTION_TYPES), "chunk_length": F.length("text") == c("end_char") - c("start_char")}


def claim_rules() -> dict[str, Column]:
    c = F.col
    return {"claim_confidence": c("confidence").between(0, 1), "claim_type": c("claim_type").isin(*CLAIM_TYPES), "claim_start": c("start_char") >= 0, "claim_span": c("end_char") > c("start_char")}


def claim_locations(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, problem): claims without a chunk, outside its places or on another page."""
    k = chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", F.col("start_char").alias("from"), F.col("end_char").alias("to"), "page_start", "page_end", F.lit(1).alias("known"))
    rows = claims.dropDuplicates(["claim_id"]).join(k, "chunk_id", "left")
    problem = F.when(F.col("known").isNull(), "no chunk").when(~F.col("page").between(F.col("page_start"), F.col("page_end")), "other page").when((F.col("start_char") < F.col("from")) | (F.col("end_char") > F.col("to")), "outside")
    return rows.select("claim_id", problem.alias("problem")).filter("problem is not null")
