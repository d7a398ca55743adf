"""Measures of an evaluation as aggregates: rates, agreement, histograms, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.selection import global_numbers


def rate(n: Column, of: Column) -> Column:
    """n / of to 3 places, null for nothing."""
    return F.round(F.try_divide(n.cast("double"), of.cast("double")), 3)


def share(condition: Column) -> Column:
    """The share of rows for which ``condition`` holds, among those for which it isn't null."""
    return F.round(F.avg(condition.cast("double")), 3)


def f1(precision: Column, recall: Column) -> Column:
    """From rounded values; null if either is null or 0."""
    return F.when((precision > 0) & (recall > 0), F.round(2 * precision * recall / (precision + recall), 3))


def verdict_rates(rows: DataFrame, verdict: str, labels: list[str]) -> DataFrame:
    """One row: judged, skipped (null), and the share of each label among the judged."""
    judged = F.count(verdict)
    return rows.agg(judged.alias("judged"), F.sum(F.col(verdict).isNull().cast("bigint")).alias("skipped"), *[rate(F.sum((F.col(verdict) == x).cast("bigint")), judged).alias(x) for x in labels])


def confusion_matrix(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.filter(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def cohen_kappa(matrix: DataFrame) -> DataFrame:
    """(n, accuracy, kappa) of a confusion matrix; kappa is null without rows or when chance alone agrees."""
    total = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"))
    a, b = matrix.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("na")), matrix.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "k").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("c", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return total.join(F.broadcast(chance)).select("n", F.round(po, 3).alias("accuracy"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 3)).alias("kappa"))  # two single rows


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, rank): counts, the largest first, ties by value."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return global_numbers(counts.withColumn("_o", -F.col("n")), ["_o", "value"], "rank").drop("_o")


def unpivot_metrics(rows: DataFrame, id_col: str) -> DataFrame:
    """(metric, value) with metric as ``<id>/<column>`` for every numeric column."""
    cols = [c for c in rows.columns if c != id_col]
    typed = rows.select(F.col(id_col).cast("string").alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(["_id"], cols, "name", "value").select(F.concat_ws("/", "_id", "name").alias("metric"), "value")


def compare_metrics(current: DataFrame, baseline: DataFrame, directions: dict[str, str], tolerance: float) -> DataFrame:
    """(metric, value, base, status) for the metrics with a direction (up or down) by name.

    ok, improved or regressed beyond ``tolerance``; missing or new where one side lacks the metric; a null baseline is ok.
    """
    better = F.create_map(*[F.lit(x) for kv in directions.items() for x in kv])
    c = current.select("metric", "value", F.lit(1).alias("here"))
    b = baseline.select("metric", F.col("value").alias("base"), F.lit(1).alias("there"))
    rows = c.join(b, "metric", "full_outer").withColumn("better", better[F.element_at(F.split("metric", "/"), -1)]).filter("better is not null")
    gain = F.when(F.col("better") == "up", F.col("value") - F.col("base")).otherwise(F.col("base") - F.col("value"))
    status = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "new").when(F.col("base").isNull(), "ok").when(F.col("value").isNull() | (gain < -tolerance), "regressed").when(gain > tolerance, "improved").otherwise("ok")
    return rows.select("metric", "value", "base", status.alias("status"))


#: The settings that two reports must have in common to be compared.
CONFIG_KEYS = ("snapshot_fingerprint", "models", "judge_model", "n_chunks", "seed", "scenarios", "agent_cases", "prompt_versions")


def config_mismatches(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, here, there) of the settings (key, value) among CONFIG_KEYS that differ; a missing one differs from any value."""
    rows = current.select("key", F.col("value").alias("here")).join(baseline.select("key", F.col("value").alias("there")), "key", "full_outer")
    return rows.filter(F.col("key").isin(*CONFIG_KEYS) & ~F.col("here").eqNullSafe(F.col("there")))


#: Fixed value: what only live calls have, which is no quality.
UNGATED = ("latency_mean_s",)


def gated_metrics(summaries: DataFrame, directions: DataFrame) -> DataFrame:
    """(metric, value, better) with metric as ``model/stage/key`` of summaries (model, stage, key, value): those with a direction (stage, key, better)."""
    rows = summaries.join(F.broadcast(directions), ["stage", "key"]).filter(~F.col("key").isin(*UNGATED))
    return rows.select(F.concat_ws("/", "model", "stage", "key").alias("metric"), F.col("value").cast("double").alias("value"), "better")


def infra_errors(cases: DataFrame) -> DataFrame:
    """(case_id, error) of the errors of kind infra, nested ones too: ``cases`` is (case_id, errors array of (kind, error))."""
    return cases.select("case_id", F.explode("errors").alias("e")).filter("e.kind = 'infra'").select("case_id", "e.error")


def support_verdict(checks: Column) -> Column:
    """Of an array of booleans: all true is supported, none (or no check) unsupported, else partial."""
    yes = F.size(F.filter(checks, lambda x: x))
    return F.when(F.coalesce(F.size(checks) <= 0, F.lit(True)) | (yes == 0), "unsupported").when(yes == F.size(checks), "supported").otherwise("partial")


def faithfulness(unsupported: Column, total: Column) -> Column:
    """Nothing, or at least half unsupported, is unfaithful; none unsupported faithful; else partial."""
    return F.when((total == 0) | (2 * unsupported >= total), "unfaithful").when(unsupported == 0, "faithful").otherwise("partial")


def usage(calls: DataFrame, group: str, tokens: str, cost: str, latency: str) -> DataFrame:
    """Per group: calls, tokens, cost (null if any call has none) and mean latency."""
    total = F.when(F.count(cost) == F.count("*"), F.round(F.sum(cost), 6))
    return calls.groupBy(group).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), total.alias("cost"), F.round(F.avg(latency), 3).alias("latency_mean"))
