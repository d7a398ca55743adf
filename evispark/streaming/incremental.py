"""Incremental ingestion: new content only, and counts per window with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evispark.sources.tables import append_new


def ingest_stream(source: DataFrame, folder: str, name: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Append each content of ``source`` to the table ``name`` once, over batches and restarts.

    A batch is deduplicated by content and joined against what the table has, so a batch that is run again after a failure
    adds nothing, and no state grows with the stream.
    """

    def batch(rows: DataFrame, _: int) -> None:
        append_new(rows.filter(F.col(text).isNotNull()).withColumn("sha256", F.sha2(F.encode(text, "utf-8"), 256)), folder, name, ["sha256"])

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, group: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window start, group, n) of a stream or a table; in a stream rows later than ``late`` are dropped and windows close."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), group, "n")


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that come to a folder, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
