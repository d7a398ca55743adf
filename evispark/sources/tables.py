"""Tables in a folder, one Parquet data set each; appends that a second delivery doesn't double."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.schemas import schema
from evispark.staging import drop_path


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schema(name)).parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_new(batch: DataFrame, folder: str, name: str, keys: list[str]) -> None:
    """Append the rows of ``batch`` whose keys the table doesn't have, each key once."""
    path = f"{folder}/{name}.parquet"
    rows = batch.dropDuplicates(keys)
    if exists(batch.sparkSession, path):
        rows = rows.join(batch.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


#: Tables in the order in which they can be emptied: those that refer to others first.
CHILDREN_FIRST = ("embedding_recordings", "review_sentences", "review_drafts", "syntheses", "extracted_claims", "claim_candidates", "text_chunks", "sections", "paper_pages", "papers")


def reset(spark: SparkSession, folder: str) -> list[str]:
    """Drop all tables of a folder, children first; gives the names of those that were there."""
    gone = [t for t in CHILDREN_FIRST if exists(spark, f"{folder}/{t}.parquet")]
    for t in gone:
        drop_path(spark, f"{folder}/{t}.parquet")
    return gone


def replace(df: DataFrame, folder: str, name: str) -> None:
    """Swap a table's contents: the new data are complete beside the old before these go.

    The old data are set aside by a rename and dropped at the end, so at every moment one of the two is whole; a swap that broke off
    between the renames is finished by the next one.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, now = f"{folder}/_{name}.new", f"{folder}/{name}.parquet"
    df.write.mode("overwrite").parquet(new)
    at, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (now, f"{folder}/_{name}.old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.delete(aside, True)
        fs.rename(at, aside)
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), at)
    fs.delete(aside, True)
