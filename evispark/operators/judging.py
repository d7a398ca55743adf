"""What judges are asked, how their answers are lined up with what was asked, and how far they agree with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.operators.evaluation import rate
from evispark.operators.provenance import normalize_support, title_of


def numbered(rows: DataFrame, group: list[str], order: list[str], line: Column, name: str, joint: str = "\n") -> DataFrame:
    """(group, name): the lines of each group, numbered from 1 in order; ``line`` may use ``number``."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    rows = rows.withColumn("number", n).select(*group, F.struct("number", line.alias("line")).alias("x"))
    return rows.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], joint).alias(name))


def claim_judge_requests(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """(chunk_id, request): each chunk with claims, its text and its numbered claims in order of their ids."""
    c = claims.filter("claim_id is not null and chunk_id is not null").dropDuplicates(["claim_id"])
    lists = numbered(c, ["chunk_id"], ["claim_id"], F.concat(F.col("number").cast("string"), F.lit(". "), F.coalesce("claim_text", F.lit(""))), "list")
    k = chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    return lists.join(k, "chunk_id").select("chunk_id", F.concat(F.lit("Passage:\n"), F.col("text"), F.lit("\n\nClaims:\n"), F.col("list")).alias("request"))


def cited_claims(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """(claim_id, cited): ``[paper] text`` of each claim, the paper by its title, else key, else id."""
    c = claims.filter("claim_id is not null").groupBy("claim_id").agg(F.min("paper_id").alias("paper_id"), F.min(F.coalesce(F.nullif("normalized_text", F.lit("")), "claim_text", F.lit(""))).alias("text"))
    p = papers.dropDuplicates(["paper_id"]).select("paper_id", title_of().alias("paper"))
    return c.join(p, "paper_id", "left").select("claim_id", F.concat(F.lit("["), F.coalesce("paper", "paper_id", F.lit("")), F.lit("] "), F.col("text")).alias("cited"))


def _evidence(rows: DataFrame, key: str, cited: DataFrame, indent: str) -> DataFrame:
    ids = rows.select(key, F.explode(normalize_support("supporting_claim_ids")).alias("claim_id")).join(cited, "claim_id")
    return numbered(ids, [key], ["claim_id"], F.concat(F.lit(indent), F.col("number").cast("string"), F.lit(". "), F.col("cited")), "evidence")


def synthesis_judge_requests(syntheses: DataFrame, cited: DataFrame) -> DataFrame:
    """(synthesis_id, request): type, title, body, and the numbered claims it cites, ``(none)`` without any."""
    s = syntheses.dropDuplicates(["synthesis_id"])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = s.join(_evidence(s, "synthesis_id", cited, ""), "synthesis_id", "left")
    return rows.select("synthesis_id", F.concat(F.lit("Synthesis type: "), text("synthesis_type"), F.lit("\nTitle: "), text("title"), F.lit("\nBody: "), text("body"), F.lit("\n\nCited claims:\n"), F.coalesce("evidence", F.lit("(none)"))).alias("request"))


def review_judge_requests(batched: DataFrame, cited: DataFrame, order: list[str]) -> DataFrame:
    """(review_draft_id, batch, request): the sentences of a batch, numbered, each with the claims it cites."""
    rows = batched.join(_evidence(batched, "sentence_id", cited, "   "), "sentence_id", "left")
    line = F.concat(F.col("number").cast("string"), F.lit(". Sentence: "), F.coalesce("sentence_text", F.lit("")), F.lit("\n   Cited claims:\n"), F.coalesce("evidence", F.lit("")))
    return numbered(rows, ["review_draft_id", "batch"], order, line, "request", "\n\n")


def align_verdicts(items: DataFrame, judgments: DataFrame, group: list[str]) -> DataFrame:
    """``items`` (group, number, ...) with the verdict of ``judgments`` (group, pos, number, verdict): of several with one number the last holds, a missing one is null."""
    last = judgments.groupBy(*group, "number").agg(F.max(F.struct("pos", "verdict"))["verdict"].alias("verdict"))
    return items.join(last, [*group, "number"], "left")


def zip_strict(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, pos, a, b): two arrays of a row, item by item; arrays of unlike length are an error when read."""
    rows = left.select(key, a).join(right.select(key, b), key)
    same = F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(F.raise_error(F.concat(F.lit("unlike lengths of "), F.col(key).cast("string"))))
    return rows.select(key, F.posexplode(same).alias("pos", "x")).select(key, "pos", f"x.{a}", f"x.{b}")


def agreement(items: DataFrame, positive: str) -> DataFrame:
    """One row of (label, predicted, origin): judged, skipped, accuracy, binary accuracy (``positive`` or not), accuracy on real items, and constructed negatives caught."""
    judged = F.col("predicted").isNotNull()
    same, is_yes = F.col("label") == F.col("predicted"), (F.col("label") == positive) == (F.col("predicted") == positive)
    n = lambda c: F.sum((judged & c).cast("bigint"))
    real, negative = F.col("origin") == "real", (F.col("origin") != "real") & (F.col("label") != positive)
    return items.agg(n(F.lit(True)).alias("judged"), F.sum((~judged).cast("bigint")).alias("skipped"), rate(n(same), n(F.lit(True))).alias("accuracy"), rate(n(is_yes), n(F.lit(True))).alias("binary_accuracy"), rate(n(same & real), n(real)).alias("real_accuracy"), rate(n(negative & (F.col("predicted") != positive)), n(negative)).alias("negatives_caught"))


def unsupported_statements(checks: Column) -> Column:
    """The statements of an array of (statement, supported) that aren't supported."""
    return F.transform(F.filter(checks, lambda x: ~x["supported"]), lambda x: x["statement"])

