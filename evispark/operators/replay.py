"""Recorded calls: requests are answered by a join with recordings, and what isn't recorded is a miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(requests: DataFrame, recordings: DataFrame, key: str = "key") -> DataFrame:
    """``requests`` with the answer of their recording and ``hit``; of several recordings of a key the least answer counts."""
    kept = recordings.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("answer").alias("answer"))
    return requests.join(kept.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(requests: DataFrame, recordings: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys that no recording has: what a provider would have to be asked."""
    return requests.select(key).distinct().join(recordings.select(key), key, "left_anti")


def prune(recordings: DataFrame, used: DataFrame, key: str = "key") -> DataFrame:
    """The recordings that are still asked for."""
    return recordings.join(used.select(key).distinct(), key, "left_semi")
