"""Structured sentences against the sentences of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.similarity import ratio_bound, similarity
from evispark.functions.text import normalize_text

LEAST_RATIO = 0.85


def align_sentences(structured: DataFrame, body: DataFrame, key: str, least: float = LEAST_RATIO) -> DataFrame:
    """(key, sentence_id, aligned): whether a sentence of the same ``key`` in ``body`` (key, sentence) is alike.

    Equal sentences are joined first. Only what is left is compared by ratio, within its key, and only where the lengths allow
    the ratio at all: the bound is exact, so nothing is lost.
    """
    s = structured.select(key, "sentence_id", normalize_text("sentence_text").alias("s"))
    b = body.select(key, normalize_text("sentence").alias("b")).filter("b <> ''").distinct()
    equal = s.join(b.withColumnRenamed("b", "s"), [key, "s"], "left_semi").select(key, "sentence_id")
    rest = s.filter("s <> ''").join(equal, [key, "sentence_id"], "left_anti")
    near = rest.join(b, key).filter(ratio_bound(F.col("s"), F.col("b")) >= least).filter(similarity("s", "b") >= least).select(key, "sentence_id").distinct()
    hits = equal.unionByName(near).distinct().withColumn("aligned", F.lit(True))
    return s.select(key, "sentence_id").join(hits, [key, "sentence_id"], "left").withColumn("aligned", F.coalesce("aligned", F.lit(False)))
