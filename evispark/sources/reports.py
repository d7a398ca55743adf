"""Reports and baselines of evaluations, recordings of calls, and usage rows: written and read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators.evaluation import CONFIG_KEYS
from evispark.sources.tables import append_new, exists, replace

#: A report's rows: the settings of its run (key, value) with null model and stage, and the measures (model, stage, key, value).
REPORT = "model string, stage string, key string, text string, value double"


def write_report(summaries: DataFrame, settings: dict[str, str], folder: str, run_id: str) -> None:
    """Write the measures (model, stage, key, value) and settings of a run to ``<folder>/<run_id>``."""
    spark = summaries.sparkSession
    rows = spark.createDataFrame([(None, None, k, v, None) for k, v in sorted(settings.items())], REPORT)
    rows.unionByName(summaries.select("model", "stage", "key", F.lit(None).cast("string").alias("text"), F.col("value").cast("double").alias("value"))).coalesce(1).write.json(f"{folder}/{run_id}")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report whose name sorts last, calibrations aside; FileNotFoundError where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
    names = [n for n in names if not n.startswith("calibration")]
    if not names:
        raise FileNotFoundError(f"no report in {folder}")
    return read_report(spark, f"{folder}/{names[-1]}")


def measures(report: DataFrame) -> DataFrame:
    return report.filter("stage is not null").select("model", "stage", "key", "value")


def settings(report: DataFrame) -> DataFrame:
    return report.filter("stage is null").select("key", F.col("text").alias("value"))


def write_baseline(report: DataFrame, gated: DataFrame, folder: str, name: str = "baseline") -> None:
    """Write a report's settings that must agree and its ``gated`` (metric, value, better) as the baseline; the old one stays until the new one is whole."""
    config = settings(report).filter(F.col("key").isin(*CONFIG_KEYS)).select(F.col("key").alias("metric"), F.col("value").alias("text"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("better"))
    replace(config.unionByName(gated.select("metric", F.lit(None).cast("string").alias("text"), "value", "better")).orderBy("metric").coalesce(1), folder, name)


def read_baseline(spark: SparkSession, folder: str, name: str = "baseline") -> tuple[DataFrame, DataFrame]:
    """(settings (key, value), metrics (metric, value, better)) of the baseline; FileNotFoundError where there is none."""
    path = f"{folder}/{name}.parquet"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.schema("metric string, text string, value double, better string").parquet(path)
    return rows.filter("better is null").select(F.col("metric").alias("key"), F.col("text").alias("value")), rows.filter("better is not null").select("metric", "value", "better")


def save_recordings(calls: DataFrame, folder: str) -> None:
    """Keep answered calls (key, model, prompt_version, ..., parsed) under their keys; one that is there already stays as it is."""
    append_new(calls.filter("key is not null and parsed is not null"), folder, "recordings", ["key"])


def usage_rows(calls: DataFrame, run_id: Column) -> DataFrame:
    """(run_id, model, prompt_version, input_tokens, output_tokens): a row a call; missing counts are 0."""
    return calls.select(run_id.alias("run_id"), "model", "prompt_version", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")])


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def formatted(value: Column, kind: str) -> Column:
    """A measure as text: pct, float or usd; a dash for null."""
    text = {"pct": F.format_string("%.1f%%", value * 100), "float": F.format_string("%.2f", value), "usd": F.format_string("$%.4f", value)}[kind]
    return F.when(value.isNull(), "–").otherwise(text)
